"""The gate's truth tables as small frames."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from rowcheck.functions import text as X
from rowcheck.operators import gate
from rowcheck.plans.spec import Arithmetic, Field, TableSpec, ValueRule, computed_default, multiplies_to, parse_rules, rejects, requires, shaped, sums_to, within
from rowcheck.sources import sinks

NBSP = " "


def gated(spark, columns, rows, rules=(), **more):
    spec = TableSpec("t", tuple(Field(at=k, **c) for k, c in enumerate(columns)))
    names = ", ".join(f"`{c['name']}` string" for c in columns)
    staged = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], f"doc_id string, row_idx int, {names}")
    return gate.gate(staged, spec, rules, **more).orderBy("row_idx").collect()


def one(spark, kind, texts, **more):
    """(value, rule) of each text in one column."""
    out = gated(spark, [{"name": "v", "kind": kind, **more}], [(t,) for t in texts])
    return [(r["v"], r["findings"][0]["rule"] if r["findings"] else None) for r in out]


NUMBERS = [
    (["10.00"], None, "10"),
    (["1234.56"], None, "1234.56"),
    (["-10.50"], None, "-10.5"),
    (["0"], None, "0"),
    (["10,00"], None, "10"),
    (["1234,5"], None, "1234.5"),
    (["0,99"], None, "0.99"),
    (["1.234,56"], None, "1234.56"),
    (["1,234.56"], None, "1234.56"),
    (["1.234.567,89"], None, "1234567.89"),
    (["1,234,567.89"], None, "1234567.89"),
    (["1,234"], None, "ambiguous_number"),
    (["1.234"], None, "ambiguous_number"),
    (["1.234.567"], None, "1234567"),
    (["€ 1.234,56"], None, "1234.56"),
    ([f"1{NBSP}234,56"], None, "1234.56"),
    (["(1.234,56)"], None, "-1234.56"),
    (["1,234"], 2, "1234"),
    (["1,234"], 3, "ambiguous_number"),
    (["1,234", "10,50"], 3, "1.234"),
    (["1,234", "9,876.50"], 3, "1234"),
    (["1,234", "10,50"], 2, "1234"),
    (["1,234", "10,50", "9,876.50"], 3, "ambiguous_number"),
    (["2 st"], 2, "2"),
    (["3,5 Std"], 2, "3.5"),
    (["34 768,38 SEK"], 2, "34768.38"),
    (["USD 1,234.56"], 2, "1234.56"),
    (["EUR 24.031,71"], 2, "24031.71"),
    (["25 %"], 2, "25"),
    (["19%"], 2, "19"),
    (["(1 200,00) SEK"], 2, "-1200"),
    (["12a34"], 2, "type"),
    (["pcs"], 2, "type"),
    (["(-5)"], 2, "5"),
    (["€ (5.00)"], 2, "type"),
    (["(€ 5.00)"], 2, "-5"),
]


def test_numbers(spark):
    for texts, scale, want in NUMBERS:
        value, rule = one(spark, "numeric", texts, scale=scale)[0]
        assert rule == want if not want[-1].isdigit() else value == Decimal(want), (texts, scale, value, rule)


@pytest.mark.parametrize(
    "data_type,texts,want",
    [
        ("int4", ["3", "31 st", "3.5", "1.2345678901234567e+19", "99999999999"], [3, 31, "type", "type", "type"]),
        ("bool", ["true", "false", "Yes", "no", "1", "0", "maybe"], [True, False, True, False, True, False, "type"]),
        ("float8", ["-2.5", "1e3", "x"], [-2.5, 1000.0, "type"]),
        (
            "json",
            ['{"kind": "order", "lines": 3}', "[1, 2, 3]", "{not json", '"just a string"'],
            ['{"kind": "order", "lines": 3}', "[1, 2, 3]", "type", "type"],
        ),
        ("uuid", ["{6F9619FF-8B86-D011-B42D-00CF4FC964FF}", "6f96"], ["6f9619ff-8b86-d011-b42d-00cf4fc964ff", "type"]),
        (
            "time",
            ["09:30", "23:59:59.5", "24:00", "09", "0930"],
            ["09:30:00", "23:59:59.500000", "type", "09:00:00", "09:30:00"],
        ),
        ("timetz", ["09:30:00+02:00", "0930Z", "09:30+25:00"], ["09:30:00+02:00", "09:30:00+00:00", "type"]),
        ("text", ["null", "N/A", "Nonesuch Ltd"], [None, None, "Nonesuch Ltd"]),
    ],
)
def test_scalars(spark, data_type, texts, want):
    got = one(spark, data_type, texts)
    for (value, rule), expected in zip(got, want, strict=True):
        assert (rule if expected == "type" else value) == expected


def test_dates(spark):
    good = [
        "2026-09-01",
        "20260901",
        "01 September 2026",
        "1 September 2026",
        "01 Sep 2026",
        "September 1, 2026",
        "Sep 1 2026",
        "01 SEPTEMBER 2026",
    ]
    bad = ["05/01/2026", "05-01-2026", "01.02.2026", "01 Brumaire 2026", "2026-02-30", "2026"]
    got = one(spark, "date", good + bad)
    assert all(str(v) == "2026-09-01" for v, _ in got[: len(good)]) and all(r == "type" for _, r in got[len(good) :])
    stamps = one(spark, "timestamp", ["2026-02-06T14:30:00", "01 September 2026 14:30", "September 1, 2026", "14:30"])
    assert [str(v) for v, _ in stamps] == ["2026-02-06 14:30:00", "2026-09-01 14:30:00", "2026-09-01 00:00:00", "None"]


def test_enum_array_and_not_null(spark):
    assert one(spark, "status", ["draft", "posted"], labels=("draft", "sent")) == [("draft", None), (None, "enum")]
    assert one(spark, "_text", ["a,b,c", "{ a , b ,}", '["x, y", "z"]'])[:3] == [
        (["a", "b", "c"], None), (["a", "b"], None), (["x, y", "z"], None)
    ]
    assert one(spark, "_int4", ["1,2", "1,x"]) == [([1, 2], None), (None, "type")]
    assert one(
        spark, "_status", ["draft,sent", "draft,posted"], labels=("draft", "sent")
    ) == [(["draft", "sent"], None), (None, "enum")]
    assert one(spark, "numeric", [None, ""], required=True, scale=2) == [(None, "not_null"), (None, "not_null")]
    assert one(spark, "numeric", [None], required=True, scale=2, default="0") == [(None, None)]


MONEY = [{"name": n, "kind": "numeric", "scale": 2, "required": True} for n in ("net", "tax", "total")]


def rules_of(rows):
    return [[(f["column"], f["rule"]) for f in r["findings"]] for r in rows]


def test_sums_and_skips(spark):
    rows = [
        ("100", "25", "125.00"),
        ("100", "25", "125.01"),
        ("100", "25", "125.02"),
        ("100", None, "1"),
        ("100", "25", "not a number"),
    ]
    assert rules_of(gated(spark, MONEY, rows, [sums_to(("net", "tax"), "total")])) == [
        [], [], [("total", "arithmetic")], [("tax", "not_null")], [("total", "type")]
    ]
    whole = [{"name": n, "kind": "int4"} for n in ("net", "tax", "total")]
    assert rules_of(gated(spark, whole, [("1", "1", "3")], [sums_to(("net", "tax"), "total")])) == [[]]


def test_arithmetic_of_amounts_that_only_just_fit(spark):
    """Nothing raises, nothing is let through unseen: sums beyond the column's width, products beyond 18 and beyond 38 digits."""
    most = "9" * 32
    rows = [
        ("1e31", "1e31", "2e31"),
        ("1e31", "1e31", "1e31"),
        (most, most, most),
        (most, "0.5", most + ".5"),
        (most, "-" + most, "0.02"),
        ("1e33", "1", "1"),
    ]
    got = rules_of(gated(spark, MONEY, rows, [sums_to(("net", "tax"), "total")]))
    assert got == [
        [], [("total", "arithmetic")], [("total", "arithmetic")], [], [("total", "arithmetic")], [("net", "type")]
    ]
    rows = [
        ("20000000000000", "2", "7"),
        ("20000000000000", "2", "40000000000000.01"),
        ("20000000000000", "2", "40000000000000.02"),
        (most, most, most),
        ("0.0123456", "100", "1.24"),
    ]
    got = rules_of(gated(spark, MONEY, rows, [multiplies_to(("net", "tax"), "total")]))
    assert got == [[("total", "arithmetic")], [], [("total", "arithmetic")], [("total", "arithmetic")], []]
    loose = [{"name": n, "kind": "numeric"} for n in ("a", "b", "c")]
    rows = [
        ("200000000000", "2", "7"), ("0.0000000001", "3", "0.0000000003"), ("1.0000000001", "1000000", "1000000.0001")
    ]
    assert rules_of(gated(spark, loose, rows, [multiplies_to(("a", "b"), "c")])) == [[("c", "arithmetic")], [], []]


def test_spelling_of_what_leaves(spark):
    spec = TableSpec(
        "t",
        (
            Field("n", "numeric", 1, scale=2),
            Field("at", "timestamp", 2),
            Field("d", "date", 3),
            Field("j", "json", 4),
            Field("l", "_numeric", 5),
        ),
    )
    rows = [
        ("d", 0, "1.50", "2026-02-06T03:04:05.678", "1 Sep 2026", '{"a": [1]}', "1.50,2"),
        ("d", 1, "(1.234,00)", "2026-02-06", None, None, None),
        ("d", 2, ".5", None, None, None, None),
        ("d", 3, "x", None, None, None, None),
    ]
    staged = spark.createDataFrame(
        rows, "doc_id string, row_idx int, n string, at string, d string, j string, l string"
    )
    got = [
        json.loads(r["json"]) for r in sinks.to_json_rows(gate.gate(staged, spec), spec).orderBy("row_idx").collect()
    ]
    assert got[0] == {
        "n": "1.50", "at": "2026-02-06T03:04:05.678000", "d": "2026-09-01", "j": {"a": [1]}, "l": ["1.5", "2"]
    }
    assert [r["n"] for r in got[1:]] == ["-1234.00", "0.5", None] and got[1]["at"] == "2026-02-06T00:00:00"


def test_values(spark):
    columns = [
        {"name": "q", "kind": "numeric", "scale": 3},
        {"name": "p", "kind": "numeric", "scale": 4},
        {"name": "t", "kind": "numeric", "scale": 2},
        {"name": "who", "kind": "varchar", "size": 19},
    ]
    rules = [
        multiplies_to(("q", "p"), "t"),
        rejects("who", ("Ostlund Pumpar KB",)),
        shaped("who", "[A-Z].*"),
        requires("who"),
        within("q", Decimal(1), Decimal(50)),
    ]
    rows = [
        ("12", "245.00", "2940.00", "Ok"),
        ("12", "245.00", "122940.00", "OSTLUND   PUMPAR  kb"),
        ("51", "1", "51", None),
        (None, "1", "1", "lower"),
        ("0.5", "2", "1", "X"),
    ]
    assert rules_of(gated(spark, columns, rows, rules)) == [
        [],
        [("who", "length"), ("t", "arithmetic"), ("who", "rejected_value")],
        [("who", "required"), ("q", "range")],
        [("who", "pattern")],
        [("q", "range")],
    ]


def test_a_long_reject_list_is_joined(spark):
    bad = tuple(f"firm {k}" for k in range(1500))
    got = gated(spark, [{"name": "who", "kind": "text"}], [("FIRM 7",), ("firm x",), (None,)], [rejects("who", bad)])
    assert rules_of(got) == [[("who", "rejected_value")], [], []]


def test_summary_status_and_findings(spark):
    spec = TableSpec("t", (Field("v", "int4", 1, required=True),))
    staged = spark.createDataFrame(
        [("a", 0, "1"), ("a", 1, "x"), ("b", 0, "2"), ("a", 2, None)], "doc_id string, row_idx int, v string"
    )
    out = gate.gate(staged, spec)
    found = gate.findings(out)
    assert [
        tuple(r)[:4] for r in gate.ordered_findings(out).select("doc_id", "row_idx", "column", "rule").collect()
    ] == [("a", 1, "v", "type"), ("a", 2, "v", "not_null")]
    assert {
        (r["doc_id"], r["status"]) for r in gate.document_status(staged.select("doc_id").distinct(), found).collect()
    } == {("a", "flagged"), ("b", "ok")}
    assert {
        (r["doc_id"], r["rows"], r["failures"], tuple(r["rules"])) for r in gate.check_summary(out).collect()
    } == {("a", 3, 2, ("not_null", "type")), ("b", 1, 0, ())}
    assert gate.clean_rows(out).count() == 2 and gate.flagged_rows(out).count() == 2


def test_result_does_not_depend_on_partitioning(spark):
    from rowcheck import staging as S

    staged = S.staged_lines(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(str, gate.findings(gate.gate(df, S.LINES, S.LINE_RULES)).collect()))
    assert key(staged.repartition(1)) == key(staged.orderBy(F.rand(3)).repartition(13))


@pytest.mark.parametrize("locale", ["plain", "point", "comma", "space"])
def test_round_trip_of_rendered_cells(spark, locale):
    df = spark.sql(
        "select cast(id * 7919 % 100000007 as decimal(18,2)) / 100 as n, date_add(date'1999-01-01', cast(id * 37 % 20000 as int)) as d from range(500)"
    )
    df = df.select(F.col("n").cast("decimal(18,2)").alias("n"), "d")
    text = X.render_number(F.col("n"), 2, locale)
    back = df.select(
        "n",
        "d",
        X.normalise_number(X.strip_number(text)["body"], 2).cast("decimal(18,2)").alias("m"),
        X.to_date_strict(X.render_date(F.col("d"), locale)).alias("e"),
    )
    assert back.where("n <> m or d <> e or m is null or e is null").count() == 0


def test_specs_and_rules():
    assert [
        computed_default(x) for x in ("'draft'::text", "0", "true", "NULL::int", "now()", None, "truex", '"draft"')
    ] == [False, False, False, False, True, True, True, False]
    spec = TableSpec(
        "t",
        (Field("b", "numeric", at=2, scale=2), Field("a", "int2", at=1), Field("id", "int8", at=0, made="identity")),
    )
    assert spec.struct_type().simpleString() == "struct<a:smallint,b:decimal(38,6)>"
    with pytest.raises(ValueError, match="point"):
        TableSpec("t", (Field("g", "point"),)).struct_type()
    with pytest.raises(ValueError, match="no column"):
        TableSpec("t", (Field("id", "int8", made="identity"),)).struct_type()
    kinds = parse_rules(
        [
            {"terms": ["a"], "equals": "b"},
            {"factors": ["a"], "equals": "b", "tolerance": 1},
            {"column": "a", "reject": ["x"]},
            {"column": "a", "pattern": "x+"},
            {"column": "a", "require": True},
            {"column": "a", "max": 3},
        ]
    )
    assert [
        k.operation if isinstance(k, Arithmetic) else k.test for k in kinds
    ] == ["sum", "product", "reject", "pattern", "require", "range"] and kinds[0].tolerance == Decimal("0.01")
    for bad in ({"column": "a"}, {"column": "a", "pattern": "("}, {"terms": ["a"], "equals": "b", "more": 1}):
        with pytest.raises(Exception):
            parse_rules([bad])
