"""The catalog over JDBC gives what the same rows give as frames."""

import pytest
from rowcheck.operators.schema import column_specs
from rowcheck.sources.catalog import Catalog, read_in_parts, read_specs

URL = "jdbc:derby:memory:catalog;create=true"
NAMES = Catalog("attributes", "types", "enums", "defaults")


@pytest.fixture(scope="module")
def frames(spark):
    columns = [
        (10 + t, "public", f"table{t}", f"column{k}", k - 1, k % 4, 20 if k % 4 == 0 else 655366 if k % 4 == 1 else -1, k % 2 == 0, k == 5,
         "d" if k == 3 else "", "s" if k == 7 else "", f"what {k} says")
        for t in range(40) for k in range(9)
    ]
    made = {
        "attributes": spark.createDataFrame(
            columns,
            "attrelid long, schema string, name string, attname string, attnum long, atttypid long, atttypmod int, attnotnull boolean, "
            "attisdropped boolean, attidentity string, attgenerated string, description string",
        ),
        "types": spark.createDataFrame([(0, "varchar"), (1, "numeric"), (2, "int4"), (3, "mood")], "oid long, typname string"),
        "enums": spark.createDataFrame([(3, 2.0, "sad"), (3, 1.0, "glad"), (3, 1.5, "so so")], "enumtypid long, enumsortorder double, enumlabel string"),
        "defaults": spark.createDataFrame([(12, 2, "now()"), (49, 1, "'x'::text")], "adrelid long, adnum long, expr string"),
    }
    for name, df in made.items():
        kinds = ", ".join(f"{c} VARCHAR(64)" for c, kind in df.dtypes if kind == "string")
        df.write.option("createTableColumnTypes", kinds).jdbc(URL, name, mode="overwrite")
    return made


def test_specs_over_jdbc(spark, frames):
    want = [str(r) for r in column_specs(*(frames[n] for n in ("attributes", "types", "enums", "defaults"))).collect()]
    got = read_specs(spark, URL, NAMES, parts=6)
    assert [str(r) for r in got.collect()] == want and len(want) == 40 * 6
    one = read_specs(spark, URL, NAMES).where("name = 'table7'")
    assert one.count() == 6 and {tuple(r["enum_labels"]) for r in one.collect()} == {(), ("glad", "so so", "sad")}


def test_every_range_is_read_apart(spark, frames):
    df = read_in_parts(spark, URL, "attributes", "attrelid", 6, {})
    assert df.rdd.getNumPartitions() == 6 and df.count() == 360
    assert all(n > 0 for n in df.rdd.glom().map(len).collect())
    spark.createDataFrame([], "attrelid long").write.jdbc(URL, "nothing", mode="overwrite")
    assert read_in_parts(spark, URL, "nothing", "attrelid", 6, {}).count() == 0
