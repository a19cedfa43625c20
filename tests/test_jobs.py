"""Readers, sinks, layout, inference and streams on small inputs."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rowcheck import staging as S
from rowcheck.operators import completeness, gate, headers, inference, layout, scoring
from rowcheck.plans.spec import Field, TableSpec
from rowcheck.sources import files, sinks
from rowcheck.streaming import streams

SF = "/root/testdata/sf0.001"


def test_read_delimited(spark, tmp_path):
    parts = {
        "a.csv": b"a;b\n1;\"x;y\nz\"\n;\n2\n",
        "b.txt": "﻿name\tq\r\né\t1\t\r\n".encode(),
        "c.csv": "k,v\nå,2\n".encode("cp1252"),
        "wide.csv": b"a,b\n1,2,3\n",
        "empty.csv": b" \n",
        "twice.csv": b"A,a\n1,2\n",
        "one.csv": b"only\nx\ny\n",
        "u16.csv": "a,b\n1,2\n".encode("utf-16"),
    }
    for name, raw in parts.items():
        (tmp_path / name).write_bytes(raw)
    heads, grid, errors = files.read_delimited(spark, str(tmp_path))
    short = lambda df: [(r["doc_id"].rsplit("/", 1)[1], *list(r)[1:]) for r in df.collect()]
    rows = {}
    for name, k, cells in sorted(short(grid)):
        rows.setdefault(name, []).append(cells)
    assert rows == {
        "a.csv": [["1", "x;y\nz"], ["2", ""]],
        "b.txt": [["é", "1"]],
        "c.csv": [["å", "2"]],
        "one.csv": [["x"], ["y"]],
        "u16.csv": [["1", "2"]],
    }
    assert {e[0] for e in short(errors)} == {
        "wide.csv", "empty.csv", "twice.csv"
    } and {e[3] for e in short(errors)} == {"malformed"}
    assert sorted(h[2] for h in short(heads) if h[0] == "a.csv") == ["a", "b"]
    assert files.read_uniform(spark, str(tmp_path / "one.csv")).columns == ["only"]


def test_classify_files(spark, tmp_path):
    def zipped(name, body=b"x"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, body)
        return out.getvalue()

    parts = {
        "p": b"%PDF-1.7",
        "x": zipped("xl/workbook.xml"),
        "o": zipped("mimetype", files.ODS),
        "z": zipped("word/document.xml"),
        "s": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
        "i": b"\x89PNG\r\n\x1a\n",
        "t": "a;é".encode("cp1252"),
        "n": b"a\x00b",
        "u": "a".encode("utf-16"),
    }
    for name, raw in parts.items():
        (tmp_path / name).write_bytes(raw)
    got = files.classify_files(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert {r["path"][-1]: r["kind"] for r in got.collect()} == {
        "p": "pdf",
        "x": "spreadsheet",
        "o": "spreadsheet",
        "z": "unsupported",
        "s": "spreadsheet",
        "i": "image",
        "t": "text",
        "n": "unsupported",
        "u": "text",
    }
    assert sum(r["n"] for r in files.kind_counts(got).collect()) == 9


def test_decode_and_cases(spark, tmp_path):
    df = spark.createDataFrame(
        [(bytearray(b"\xe9"),), (bytearray("é".encode()),), (bytearray(b"\x81"),), (None,)], "b binary"
    )
    assert [r[0] for r in df.select(files.decode_text(F.col("b"))).collect()] == ["é", "é", "\x81", None]
    (tmp_path / "c.json").write_text(
        json.dumps({"name": "c1", "expected": [{"total": "1.50", "n": None}, {"total": 2}]})
    )
    cases, rows = files.read_cases(spark, str(tmp_path))
    assert cases.count() == 1 and [
        (r["row_idx"], r["row"].get("total")) for r in rows.orderBy("row_idx").collect()
    ] == [(0, "1.50"), (1, "2")]


def test_write_gated(spark, tmp_path):
    out = gate.gate(S.staged_lines(spark, SF), S.LINES, S.LINE_RULES)
    sinks.write_gated(out, str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g/rows"))
    assert back.count() == 6000 and back.where(f"{sinks.STATUS} = 'flagged'").count() == gate.flagged_rows(out).count()
    # the table's own column of that name stays
    assert {r["status"] for r in back.select("status").distinct().collect()} == {"A", "N", "R", None}
    assert spark.read.parquet(str(tmp_path / "g/findings")).count() == gate.findings(out).count()


def piece(text, x, y, width=None, doc="d"):
    return (doc, 1, float(x), float(y), float(width or 5 * len(text)), 9.0, text)


PIECES = "doc_id string, page int, x double, y double, width double, font_size double, text string"


def shown(spark, pieces):
    return layout.layout_text(spark.createDataFrame(pieces, PIECES)).first()["text"]


def test_layout(spark):
    assert shown(spark, [piece("25", 300, 100), piece("26 618,54", 360, 100)]) == "25 | 26 618,54"
    assert shown(spark, [piece("two", 50, 100), piece("words", 68, 101), piece(" ", 200, 100)]) == "two words"
    table = []
    for k, row in enumerate(
        (
            ("Filter", "3", "st", "19", "900,00"),
            ("Pump", "1", "st", "19", "5 000,00"),
            ("Valve", "2", "st", "25", "80,00"),
        )
    ):
        table += [piece(t, x, 700 - 12 * k, 40) for t, x in zip(row, (50, 200, 260, 320, 400), strict=True)]
    table += [
        piece("Fitting on site", 50, 664, 95),
        piece("19", 320, 664, 40),
        piece("4 833,50", 400, 664, 40),
        piece("Amount due", 320, 600, 40),
        piece("39,00", 400, 600, 40),
    ]
    lines = shown(spark, table).split("\n")
    assert lines[3] == "Fitting on site | | | 19 | 4 833,50" and lines[4] == "Amount due | 39,00" and lines[0] == "Filter | 3 | st | 19 | 900,00"


def test_parse_answers(spark):
    texts = {
        "a": '```json\n[{"x": 1}, 7, {"x": null}]\n```',
        "b": '{"rows": [{"x": "q"}]}',
        "c": '{"x": "lone"}',
        "d": "no",
        "e": 'Sure: [{"x": [1, 2]}] ok',
        "f": None,
        "g": "[]",
        "h": '{"x": "[draft]", "y": "5"}',
        "i": '{"x": "[draft]", "rows": [{"x": "inner"}]}',
    }
    got = inference.parse_answers(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    rows = sorted(
        (r["doc_id"], r["row_idx"], (r["row"] or {}).get("x"), r["error"]) for r in got if r["row_idx"] is not None
    )
    assert [r[:3] for r in rows] == [
        ("a", 0, "1"),
        ("a", 1, None),
        ("b", 0, "q"),
        ("c", 0, "lone"),
        ("e", 0, "[1,2]"),
        ("h", 0, "[draft]"),
        ("i", 0, "inner"),
    ]
    assert {r["doc_id"] for r in got if r["error"]} == {"d", "f"}
    with pytest.raises(ValueError, match="extractor"):
        inference.extract_with(spark.range(1).toDF("doc_id"), None, "x int")
    assert inference.extract_with(spark.range(3).toDF("doc_id"), lambda it: it, "doc_id long").count() == 3


STATEMENT = "Statement for Ostlund KB SE100200300401\nInvoices Q31050372 and Q31050374 are due, Q31050380, Q31050389 too.\nAlso Q31050398. VAT SE400300200101. Footer: Q31050372"


@pytest.mark.parametrize(
    "returned,missing",
    [
        (["Q31050372", "Q31050374"], 3),
        (["Q31050372"], 4),
        (["Q31050372", "Q31050374", "Q31050380", "Q31050389", "Q31050398"], 0),
        (["1", "2"], 0),
    ],
)
def test_completeness(spark, returned, missing):
    spec = TableSpec("invoices", (Field("invoice_number", "text", at=1), Field("note", "text", at=2)))
    rows = spark.createDataFrame(
        [("d", k, n, "x") for k, n in enumerate(returned)],
        "doc_id string, row_idx int, invoice_number string, note string",
    )
    texts = spark.createDataFrame(
        [("d", STATEMENT), ("none", STATEMENT), ("short", "Page 1")], "doc_id string, text string"
    )
    got = completeness.find_incomplete(texts, rows, spec).collect()
    assert len(got) == (missing > 0)
    if missing:
        assert got[0]["column"] == "invoice_number" and got[0][
            "row_idx"
        ] == -1 and got[0]["detail"].count("Q3105") == missing
    assert [r["doc_id"] for r in completeness.find_empty(texts, rows).collect()] == ["none"]


def test_header_conflicts(spark):
    spec = TableSpec("t", (Field("id", "int8", at=0, made="identity"), Field("total", "numeric", at=1)))
    heads = spark.createDataFrame(
        [("d", 0, "Total"), ("d", 1, "TOTAL "), ("e", 0, "id"), ("e", 1, "To tal")],
        "doc_id string, position int, header string",
    )
    aligned = headers.align(heads, spec)
    assert {
        (r["doc_id"], r["problem"]) for r in headers.header_conflicts(aligned).collect()
    } == {("d", "claimed twice"), ("d", "repeated")}
    assert {r["header"] for r in headers.unmatched_headers(aligned).collect()} == {"id", "To tal"}
    assert [(r["doc_id"], r["column"]) for r in headers.missing_columns(aligned, spec).collect()] == [("e", "total")]


def test_perfect_run_is_all_correct(spark):
    out = scoring.perfect_run(S.expected_orders(spark, SF), S.ORDERS, "invoices", [("invoice_number",)])
    assert {r["outcome"] for r in out.select("outcome").distinct().collect()} == {"correct"}


def test_stream_gate_equals_batch(spark, tmp_path):
    staged = S.staged_lines(spark, SF)
    staged.repartition("doc_id").write.parquet(str(tmp_path / "in"))
    stream = streams.landing(spark, str(tmp_path / "in"), ", ".join(f"{n} {t}" for n, t in staged.dtypes))
    streams.stream_gate(stream, S.LINES, S.LINE_RULES, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = gate.findings(gate.gate(staged, S.LINES, S.LINE_RULES))
    key = lambda df: sorted(map(str, df.select("doc_id", "row_idx", "column", "rule").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out/findings"))) == key(batch)
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 6000


def test_stream_checks_and_counts_equal_batch(spark, tmp_path):
    staged = S.staged_lines(spark, SF)
    staged.write.parquet(str(tmp_path / "in"))
    stream = streams.landing(spark, str(tmp_path / "in"), ", ".join(f"{n} {t}" for n, t in staged.dtypes))
    got = streams.drained(
        gate.findings(streams.stream_checks(stream, S.LINES, S.LINE_RULES)), str(tmp_path / "o"), str(tmp_path / "c")
    )
    want = gate.findings(gate.gate(staged, S.LINES, S.LINE_RULES, infer=False))
    key = lambda df: sorted(map(str, df.select("doc_id", "row_idx", "column", "rule").collect()))
    assert key(got) == key(want)
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").alias("who"), F.col("ts").cast("timestamp").alias("ts")
    )
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    counts = streams.stream_rate_limit(live, 2, 86400)
    query = counts.writeStream.format("memory").queryName("limits").outputMode("complete").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    total = spark.table("limits").agg(F.sum("n"), F.sum("allowed"), F.sum("refused")).first()
    assert total[0] == events.count() == total[1] + total[2]


def test_streams_over_folders_of_part_files(spark, tmp_path):
    """A table that is a folder of part files streams like one that is a file."""
    from rowcheck import queries as Q

    for name in ("orders", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("m02_stream_checks", "m03_stream_rate_limit"):
        parts, whole = (sorted(map(str, Q.QUERIES[name](spark, at).collect())) for at in (str(tmp_path), SF))
        assert parts == whole and parts


def test_missing_identifiers_shown_and_counted(spark):
    """A document that misses many rows shows the first few of them."""
    spec = TableSpec("t", (Field("invoice_number", "text", 1),))
    keys = [f"AB{k:05d}" for k in range(40)]
    texts = spark.createDataFrame([("d", " ".join(keys) + " AB00050x xAB00051 AB000521")], "doc_id string, text string")
    rows = spark.createDataFrame(
        [("d", k, keys[k]) for k in range(5)], "doc_id string, row_idx int, invoice_number string"
    )
    said = completeness.find_incomplete(texts, rows, spec).first()["detail"]
    assert said == "the document names 41 and 5 came back; missing: " + ", ".join(keys[5:11]) + ", ..."


def test_first_row_of_a_hot_key_wins(spark):
    """Rows that share a key over many spread tasks, rows without one and refused rows."""
    spec = TableSpec("t", (Field("k", "text", 1), Field("n", "int4", 2, required=True)))
    rows = [("d", i, "hot", "1") for i in range(300)] + [
        ("d", 300 + i, None, "1") for i in range(50)
    ] + [("a", 0, "hot", "x"), ("e", 0, "other", "2")]
    staged = spark.createDataFrame(rows, "doc_id string, row_idx int, k string, n string").repartition(7)
    got = {(r["doc_id"], r["row_idx"]): r["refusal"] for r in scoring.dry_run_load(staged, spec, [("k",)]).collect()}
    assert got["d", 0] is None and got["a", 0] == "type" and got["e", 0] is None
    assert all(got["d", i] == "duplicate" for i in range(1, 300)) and all(got["d", i] is None for i in range(300, 350))


def test_lines_and_blocks_against_a_plain_fold():
    """The vectorised folds of a page against the rules spelled out, over random pages."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        pages = pd.DataFrame(
            {
                "doc_id": rng.choice(["a", "b"], n),
                "page": rng.integers(1, 4, n),
                "x": rng.uniform(0, 500, n).round(),
                "y": rng.uniform(0, 90, n).round(1),
                "width": 10.0,
                "font_size": rng.choice([5.0, 9.0, 20.0], n),
                "text": "t",
                "part": 0,
            }
        )
        got = layout._lines(pages)
        for _, page in got.groupby(["doc_id", "page"]):
            anchor, line = None, -1
            for y, font, at, base in zip(page["y"], page["font_size"], page["line"], page["baseline"], strict=True):
                if anchor is None or abs(y - anchor) > max(2.0, 0.4 * font):
                    anchor, line = y, line + 1
                assert (at, base) == (line, anchor)
        heads = pd.DataFrame(
            {
                "doc_id": "a",
                "page": np.repeat([1, 2], [n, 7]),
                "line": [*range(n), *range(7)],
                "baseline": -np.cumsum(rng.choice([10.0, 12.0, 13.0, 17.0, 30.0], n + 7)),
                "n_cells": rng.choice([1, 2, 3], n + 7, p=[0.1, 0.5, 0.4]),
            }
        )
        heads.loc[heads["page"] == 2, "baseline"] += 5000
        blocks = layout._blocks(heads)
        for number, page in heads.groupby("page"):
            runs, run, pitch, rows = [], [], None, list(zip(page["baseline"], page["n_cells"], strict=True))
            for k, (y, cells) in enumerate(rows):
                step = rows[k - 1][0] - y if k else 0
                if cells < 2 or (run and len(run) > 1 and step > 1.35 * pitch):
                    runs.append(run)
                    run = []
                if cells >= 2:
                    pitch = step if len(run) == 1 else min(pitch, step) if run else None
                    run = [*run, k]
            want = [-1] * len(rows)
            for block, own in enumerate(r for r in [*runs, run] if len(r) >= 3):
                for k in own:
                    want[k] = block
            assert blocks.loc[blocks["page"] == number, "block"].tolist() == want
