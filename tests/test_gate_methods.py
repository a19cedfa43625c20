"""Methods that Spark generates for the gate are short enough for the JVM to compile them."""

import contextlib
import io
import re

import pytest
from rowcheck import staging as S
from rowcheck.functions import text as X
from rowcheck.operators import gate, scoring
from rowcheck.queries import QUERIES

#: The JVM never compiles a method of more bytes.
LONGEST = 8000


def test_methods_of_the_gate(spark, tmp_path):
    S.staged_lines(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/staged")
    gated = gate.gate(spark.read.parquet(f"{tmp_path}/staged"), S.LINES, S.LINE_RULES)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (gated, gate.findings(gated), gate.check_summary(gated)):
            said = io.StringIO()
            with contextlib.redirect_stdout(said):
                df.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
            assert sizes and max(sizes) <= LONGEST, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_named_dates(spark):
    """Dates with an English month name, in one look at the text."""
    cases = {
        "1 March 2026": "2026-03-01", "March 1, 2026": "2026-03-01", "1 mar. 2026": "2026-03-01", "Sept. 30 2025": "2025-09-30",
        "30 SEP, 2025": "2025-09-30", " 1 March\t2026 ": "2026-03-01", "1 Mar., 2026": "2026-03-01", "20260301": "2026-03-01",
        " 2026-03-01": "2026-03-01", "1 Marc 2026": None, "March 1 2026 x": None, "1, March 2026": None, "31 June 2026": None,
        "1 March 26": None, "March, 1 2026": None, "1 March 2026,": None, "001 March 2026": None, "1 Mar,. 2026": None, "2026 March 1": None,
    }
    df = spark.createDataFrame(list(cases.items()), "said string, want string")
    got = {r["said"]: r["d"] for r in df.select("said", X.to_date_strict(df["said"]).cast("string").alias("d")).collect()}
    assert got == cases


def test_flags_widen_in_one_pass(spark, tmp_path):
    """The findings, and so the gate below them, are read once."""
    found = spark.createDataFrame(
        [("d", 1, "line_total", "arithmetic"), ("d", 2, "ref", "length"), ("d", 3, None, "empty"), ("d", 4, "ref", "arithmetic")],
        "doc_id string, row_idx long, column string, rule string",
    )
    found.write.parquet(f"{tmp_path}/found")
    wide = scoring.widen_flags(spark.read.parquet(f"{tmp_path}/found"), S.LINE_RULES)
    got = sorted((r["row_idx"], r["column"]) for r in wide.collect())
    assert got == [(1, "line_total"), (1, "quantity"), (1, "unit_price"), (2, "ref"), (4, "ref")]
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        wide.explain()
    assert said.getvalue().split("Initial Plan")[0].count("FileScan") == 1


def test_methods_of_the_staging(spark):
    """Rendering the lines, which every query of the gate begins with."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            S.staged_lines(spark, "/root/testdata/sf0.001").explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
        assert sizes and max(sizes) <= LONGEST, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("most", [100, 1])
def test_rows_are_not_moved_to_their_documents(spark, tmp_path, monkeypatch, most):
    """A document's number convention comes to its rows, wherever they lie; with too many documents it is joined, with the same result."""
    monkeypatch.setattr(gate, "BROADCAST_DOCUMENTS", most)
    rows = [("a", 0, "1.5"), ("a", 1, "1,250"), ("b", 0, "1,5"), ("b", 1, "1.250"), ("c", 0, "1.250"), (None, 0, "1,250"), (None, 1, "7")]
    spark.createDataFrame(rows, "doc_id string, row_idx long, weight string").write.parquet(f"{tmp_path}/staged")
    gated = gate.gate(spark.read.parquet(f"{tmp_path}/staged"), S.LINES)
    found = {(r["doc_id"], r["row_idx"]): None if r["w"] is None else float(r["w"]) for r in gated.selectExpr("doc_id", "row_idx", "weight as w").collect()}
    assert found == {("a", 0): 1.5, ("a", 1): 1250, ("b", 0): 1.5, ("b", 1): 1250, ("c", 0): None, (None, 0): None, (None, 1): 7}
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        gated.explain()
    if most > 1:
        assert "Exchange hashpartitioning" not in said.getvalue() and "BroadcastHashJoin" in said.getvalue()


def test_methods_of_the_scoring(spark):
    """Cells of paired rows: what is compared by value is worked out in short methods, and pairs carry their rows, so no join looks them up."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            outcomes = QUERIES["j10_cell_outcomes"](spark, "/root/testdata/sf0.001")
            outcomes.explain("codegen")
            outcomes.explain()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
        assert sizes and max(sizes) <= LONGEST, sizes
        # expected once; stored, its two kinds of flags and what was reported: one each
        assert said.getvalue().split("== Physical Plan ==")[-1].count("FileScan") <= 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_pairs_of_odd_rows(spark):
    """Rows without a key, second rows of a key and rows that nobody returned: an outcome a cell each."""
    expected = [("d", 0, "a", "1.0"), ("d", 1, "a", "1"), ("d", 2, None, "1"), ("d", 3, None, "1"), ("d", 4, "b", "2"), ("e", 0, "b", "2")]
    stored = [("d", 7, "a", "1", None), ("d", 8, "a", "9", None), ("d", 9, None, "1", None), ("d", 5, "b", "3", "check")]
    flags = spark.createDataFrame([("d", 5, "weight"), ("d", 8, "weight")], "doc_id string, row_idx long, column string")
    got = scoring.cell_outcomes(
        spark.createDataFrame(expected, "doc_id string, row_idx long, key string, weight string"),
        spark.createDataFrame(stored, "doc_id string, row_idx long, key string, weight string, refusal string"),
        flags, spark.createDataFrame([("e",)], "doc_id string"), S.LINES, ["weight"],
    )
    assert sorted((r["doc_id"], r["e_idx"], r["r_idx"], r["outcome"]) for r in got.collect()) == [
        ("d", 0, 7, "correct"), ("d", 1, None, "missing"), ("d", 2, None, "missing"), ("d", 3, None, "missing"), ("d", 4, 5, "flagged"),
        ("e", 0, None, "held"),
    ]
