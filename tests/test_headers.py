from rowcheck import queries as Q
from rowcheck import staging as S
from rowcheck.operators import headers

SF = "/root/testdata/sf0.001"


def test_to_staged_over_all_customers(spark):
    """Also documents in which two headings claim one column: the first position is read, no file ends the job."""
    aligned = headers.align(Q._headers(spark, SF), Q._HEAD_SPEC, Q._aliases(spark, SF))
    grid = S.table(spark, SF, "customer").selectExpr(
        "c_custkey as doc_id", "c_custkey as row_idx", "array('c0', 'c1', 'c2', 'c3') as cells"
    )
    got = {r["doc_id"]: r for r in headers.to_staged(grid, aligned, Q._HEAD_SPEC).collect()}
    first, twice = {}, set()
    for r in aligned.where("column is not null").collect():
        key = (r["doc_id"], r["column"])
        if key in first:
            twice.add(r["doc_id"])
        first[key] = min(first.get(key, r["position"]), r["position"])
    assert twice and len(got) == grid.count()
    for doc, row in got.items():
        assert all(
            row[c.name] == (
                f"c{first[doc, c.name]}" if (doc, c.name) in first else None
            ) for c in Q._HEAD_SPEC.extractable
        )
