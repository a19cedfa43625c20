"""Lines, cells and tables from positioned text.

pieces: doc_id, page, x, y, width, font_size, text. A page is the unit of the folds (lines are anchored on their first piece,
cells on the gap before, blocks on their tightest step, columns on a sweep over the cells' edges), all done in one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.functions.text import strip

# Fixed values of the layout.
LINE_LEAST, LINE_SHARE = 2.0, 0.4
CELL_GAP, CELL_FONT = 1.2, 6.0
BLOCK_GAP, BLOCK_LINES, BLOCK_COLUMNS = 1.35, 3, 3
OCR_LEAST = 40


_KEY = ["doc_id", "page"]


def _runs(*columns: pd.Series) -> np.ndarray:
    """Where, in sorted rows, another value of the columns begins."""
    opens = np.zeros(len(columns[0]), bool)
    opens[:1] = True
    for c in columns:
        opens[1:] |= c.to_numpy()[1:] != c.to_numpy()[:-1]
    return opens


def _lines(pages: pd.DataFrame) -> pd.DataFrame:
    """line and baseline: a piece within reach of its line's first piece belongs to it.

    All pages of a part advance together, a line a step: of each page the pieces near the first that is not yet in a
    line are compared with it, and those up to the first that is out of reach are that line.
    """
    pages = pages.sort_values(
        [*_KEY, "y", "x"], ascending=[True, True, False, True], kind="stable"
    ).reset_index(drop=True)
    y, reach = pages["y"].to_numpy(), np.maximum(LINE_LEAST, LINE_SHARE * pages["font_size"].to_numpy())
    opens = _runs(pages["doc_id"], pages["page"])
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], len(pages))
    # a place down all pages of the part, one below the other: nothing further off than the widest reach joins a line
    most = reach.max(initial=0.0) + 1.0
    down = (np.cumsum(opens) - 1) * (np.ptp(y) + 2 * most if len(y) else 0.0) - y
    line, first = np.zeros(len(pages), np.int32), np.zeros(len(pages), np.int64)
    number = 0
    while len(at):
        sizes = np.minimum(ends, np.searchsorted(down, down[at] + most, "right") + 1) - at
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(at - begin, sizes) + np.arange(sizes.sum())
        anchor = np.repeat(at, sizes)
        out = np.append(0, np.cumsum(np.abs(y[place] - y[anchor]) > reach[place]))
        own = out[1:] == np.repeat(out[begin], sizes)
        line[place[own]], first[place[own]] = number, anchor[own]
        at, number = at + np.add.reduceat(own.astype(np.int64), begin), number + 1
        more = at < ends
        at, ends = at[more], ends[more]
    return pages.assign(line=line, baseline=y[first]).drop(columns="part")


def _cells(pieces: pd.DataFrame) -> pd.DataFrame:
    """One row a cell of pieces with line and baseline: a wide gap after the piece before starts a new one."""
    pieces = pieces.sort_values([*_KEY, "line", "x", "text"], kind="stable").reset_index(drop=True)
    new_line = _runs(pieces["doc_id"], pieces["page"], pieces["line"])
    x, end, font = pieces["x"].to_numpy(), (pieces["x"] + pieces["width"]).to_numpy(), pieces["font_size"].to_numpy()
    opens = new_line.copy()
    opens[1:] |= x[1:] - end[:-1] > CELL_GAP * np.maximum(font[:-1], CELL_FONT)
    first = np.flatnonzero(opens)
    stop = np.append(first[1:], len(pieces))
    words = [t.strip() for t in pieces["text"]]
    out = pieces.loc[first, [*_KEY, "line", "baseline"]].reset_index(drop=True)
    number = np.cumsum(opens) - 1
    in_line = number - np.repeat(number[new_line], np.diff(np.append(np.flatnonzero(new_line), len(pieces))))
    texts = [" ".join(words[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)]
    return out.assign(cell=in_line[first].astype(np.int32), left=x[first], right=end[stop - 1], text=texts)


def _blocks(pages: pd.DataFrame) -> pd.DataFrame:
    """block: runs of lines of two cells or more are islands; an island is cut again where a step down is wider than the
    tightest step of the stretch before allows, and stretches of too few lines are no block.
    """
    pages = pages.sort_values([*_KEY, "line"], kind="stable").reset_index(drop=True)
    wide = (pages["n_cells"] >= 2).to_numpy()
    opens = _runs(pages["doc_id"], pages["page"], pd.Series(wide))
    step = np.append(0.0, -np.diff(pages["baseline"].to_numpy()))
    bounds = np.append(np.flatnonzero(opens), len(pages))
    cuts = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        while wide[a] and b - a > 2:
            # tightest of the steps before each line; the first step of a stretch has none before it
            tightest = np.minimum.accumulate(np.where(step[a + 1 : b] != 0, step[a + 1 : b], np.inf))
            over = np.flatnonzero(step[a + 2 : b] > BLOCK_GAP * tightest[:-1])
            if not len(over):
                break
            a += 2 + int(over[0])
            cuts.append(a)
    opens[cuts] = True
    stretch = np.cumsum(opens) - 1
    table = wide & (np.bincount(stretch)[stretch] >= BLOCK_LINES)
    page = np.cumsum(_runs(pages["doc_id"], pages["page"]))
    # blocks are numbered on their page
    begins = table & opens
    number = np.cumsum(begins) - 1
    before = np.concatenate(([0], np.bincount(page, weights=begins).cumsum()))[page]
    return pages.assign(block=np.where(table, number - before, -1).astype(np.int32))[[*_KEY, "line", "block"]]


def _page_cells(pages: pd.DataFrame) -> pd.DataFrame:
    cells = _cells(_lines(pages))
    heads = cells["cell"] == 0
    lines = cells.loc[heads, [*_KEY, "line", "baseline"]].reset_index(drop=True)
    many = np.diff(np.append(np.flatnonzero(heads), len(cells)))
    blocks = _blocks(lines.assign(n_cells=many))["block"].to_numpy()
    return cells.assign(block=np.repeat(blocks, many))


def _placed(cells: pd.DataFrame) -> pd.DataFrame:
    """col_no (-1 where a line or its block is left as it is) and n_columns of cells in the order of their lines.

    Spans of all blocks at once: edges become their ranks, moved up by block, so one sweep in order of the left edges merges what overlaps or
    touches, and the first span that ends behind a cell's left edge is found by bisection.
    """
    n, inside = len(cells), (cells["block"] >= 0).to_numpy()
    col_no, n_columns = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    own = np.flatnonzero(inside)
    if not len(own):
        return cells.assign(col_no=col_no, n_columns=n_columns)
    block = np.cumsum(_runs(cells["doc_id"], cells["page"], cells["block"]))[own]
    line = np.cumsum(_runs(cells["doc_id"], cells["page"], cells["line"]))[own]
    edges = np.concatenate([cells[c].to_numpy()[own] for c in ("left", "right")])
    rank = np.unique(edges, return_inverse=True)[1].astype(np.int64)
    up = block * (int(rank.max()) + 1)
    left, right = rank[: len(own)] + up, rank[len(own) :] + up
    order = np.lexsort((right, left))
    reach = np.maximum.accumulate(right[order])
    opens = np.ones(len(own), bool)
    opens[1:] = (left[order][1:] > reach[:-1]) | (block[order][1:] != block[order][:-1])
    at = np.flatnonzero(opens)
    span_left, span_right, span_block = left[order][at], reach[np.append(at[1:], len(own)) - 1], block[order][at]
    first, many = np.searchsorted(span_block, block), np.bincount(span_block, minlength=int(block.max()) + 1)[block]
    met = np.minimum(np.searchsorted(span_right, left, "right"), len(at) - 1)
    lies = (span_right[met] > left) & (span_left[met] < right) & (span_block[met] == block)
    column = np.where(lies, met - first, -1)
    # a line fits if each of its cells has a column of its own
    lines = np.unique(line, return_inverse=True)[1]
    size = np.bincount(lines)
    told = np.unique(lines[lies].astype(np.int64) * (int(many.max()) + 1) + column[lies]) // (int(many.max()) + 1)
    fits = np.bincount(told, minlength=len(size)) == size
    filled = fits[lines] & (size[lines] == many)
    used = np.zeros(int(block.max()) + 1, bool)
    used[block[filled]] = True
    good = fits[lines] & used[block] & (many >= BLOCK_COLUMNS)
    col_no[own], n_columns[own] = np.where(good, column, -1), many
    return cells.assign(col_no=col_no, n_columns=n_columns)


def _spelled(cells: pd.DataFrame) -> pd.DataFrame:
    """page's text: cells of a line joined by bars, empty columns between a table's cells kept, lines below each other."""
    texts, places = cells["text"].tolist(), cells["col_no"].tolist()
    opens = _runs(cells["doc_id"], cells["page"], cells["line"])
    bounds = np.append(np.flatnonzero(opens), len(cells)).tolist()
    lines = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if places[a] < 0:
            lines.append(" | ".join(texts[a:b]).strip())
            continue
        # columns rise along a line, as its cells do
        at, parts = places[a], [texts[a]]
        for k in range(a + 1, b):
            parts += [" |"] * (places[k] - at - 1) + [f" | {texts[k]}"]
            at = places[k]
        lines.append("".join(parts).strip())
    heads = cells.loc[opens, _KEY].reset_index(drop=True)
    pages = np.append(np.flatnonzero(_runs(heads["doc_id"], heads["page"])), len(heads)).tolist()
    joined = ["\n".join(lines[a:b]) for a, b in zip(pages[:-1], pages[1:], strict=True)]
    return heads.iloc[pages[:-1]].assign(text=joined)


_TYPES = {
    "doc_id": "string",
    "page": "int",
    "x": "double",
    "y": "double",
    "width": "double",
    "font_size": "double",
    "text": "string",
}
_CELL = "doc_id string, page int, line int, baseline double, cell int, left double, right double, text string, block int, col_no int, n_columns int"


def _dealt(pieces: DataFrame):
    """Whole pages dealt to parts, several times as many as there are partitions: one call of a helper folds many small pages."""
    parts = 8 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solid = pieces.where(strip(F.col("text")) != "").select(*(F.col(c).cast(t).alias(c) for c, t in _TYPES.items()))
    return solid.withColumn("part", F.pmod(F.xxhash64("doc_id", "page"), F.lit(parts))).groupBy("part")


def page_cells(pieces: DataFrame) -> DataFrame:
    """The cells of every line (left, right, text) with the line's baseline and block (-1 outside tables), the column that a
    table's cell stands in (-1 where the line or its block is left as it is) and the number of columns of its block. Blank pieces go.
    """
    return _dealt(pieces).applyInPandas(lambda pages: _placed(_page_cells(pages)), _CELL)


def column_spans(cells: DataFrame) -> DataFrame:
    """The spans of each block's columns in the cells of page_cells that stand in one."""
    held = cells.where("col_no >= 0").groupBy(*_KEY, "block", "col_no")
    return held.agg(F.min("left").alias("col_left"), F.max("right").alias("col_right"))


def layout_text(pieces: DataFrame) -> DataFrame:
    """doc_id, text: cells joined by ` | `, inner empty columns kept; pages parted by a blank line.

    Two shuffles: pages to the parts that fold them to text, and their texts to the documents.
    """
    pages = _dealt(pieces).applyInPandas(lambda pages: _spelled(_placed(_page_cells(pages))), "doc_id string, page int, text string")
    listed = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))


def needs_ocr(docs: DataFrame) -> DataFrame:
    """Docs (doc_id, kind, encoding_issues, text) with needs_ocr."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return docs.withColumn(
        "needs_ocr", (F.col("kind") == "image") | F.coalesce("encoding_issues", F.lit(False)) | blank
    )


def pages_to_reread(docs: DataFrame) -> DataFrame:
    """Docs (doc_id, n_pages, ocr_text, flagged array<int>): flagged pages first, then all others where the text is under
    40 characters a page. A document has one page at least, whatever n_pages says.
    """
    n_pages = F.greatest(F.coalesce(F.col("n_pages").cast("int"), F.lit(1)), F.lit(1))
    thin = F.char_length(strip(F.coalesce("ocr_text", F.lit("")))) < OCR_LEAST * n_pages
    none = F.array().cast("array<int>")
    flagged = F.coalesce("flagged", none)
    every = F.sequence(F.lit(1), n_pages)
    order = F.concat(flagged, F.when(thin, F.array_except(every, flagged)).otherwise(none))
    return docs.select("doc_id", F.posexplode(order).alias("rank", "page"))
