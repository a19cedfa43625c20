"""Table definitions from a database's catalog, read over JDBC in parts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rowcheck.operators.schema import column_specs


@dataclass(frozen=True)
class Catalog:
    """Where the rows of column_specs lie: a table's name or a subquery in brackets with an alias, each."""

    attributes: str
    types: str
    enums: str
    defaults: str


#: PostgreSQL's own tables under the names that column_specs takes.
POSTGRES = Catalog(
    attributes="""(SELECT a.attrelid::bigint AS attrelid, n.nspname::text AS schema, c.relname::text AS name, a.attname::text AS attname,
  a.attnum::bigint AS attnum, a.atttypid::bigint AS atttypid, a.atttypmod AS atttypmod, a.attnotnull, a.attisdropped,
  a.attidentity::text AS attidentity, a.attgenerated::text AS attgenerated, d.description
  FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid AND c.relkind IN ('r', 'p', 'v', 'm', 'f')
  JOIN pg_namespace n ON n.oid = c.relnamespace AND n.nspname NOT IN ('pg_catalog', 'information_schema')
  LEFT JOIN pg_description d ON d.objoid = a.attrelid AND d.objsubid = a.attnum AND d.classoid = 'pg_class'::regclass) attributes""",
    types="(SELECT oid::bigint AS oid, typname::text AS typname FROM pg_type) types",
    enums="(SELECT enumtypid::bigint AS enumtypid, enumsortorder, enumlabel::text AS enumlabel FROM pg_enum) enums",
    defaults="""(SELECT adrelid::bigint AS adrelid, adnum::bigint AS adnum, pg_get_expr(adbin, adrelid) AS expr FROM pg_attrdef) defaults""",
)


def read_in_parts(spark: SparkSession, url: str, table: str, key: str, parts: int, properties: Mapping[str, str]) -> DataFrame:
    """A table over JDBC by `parts` connections, each with a range of the whole-numbered `key`; the database is asked for its bounds first."""
    source = spark.read.format("jdbc").option("url", url).options(**properties)
    asked = f'(SELECT MIN("{key}") AS "low", MAX("{key}") AS "high" FROM {table}) bounds'
    low, high = source.option("dbtable", asked).load().first()
    whole = spark.read.format("jdbc").option("url", url).options(**properties).option("dbtable", table)
    if low is None:
        return whole.load()
    bounds = {"partitionColumn": key, "lowerBound": int(low), "upperBound": int(high) + 1, "numPartitions": max(1, min(parts, int(high) - int(low) + 1))}
    return whole.options(**bounds).load()


def read_specs(
    spark: SparkSession, url: str, catalog: Catalog = POSTGRES, parts: int = 8, properties: Mapping[str, str] | None = None
) -> DataFrame:
    """A5: the columns of all tables that a catalog lists, as column_specs gives them. properties: user, password, driver and the like.

    Ranges are of the identifiers of tables and types, so a table's columns come over one connection; filters on the result's schema and
    name go down to the database. An empty catalog gives no rows.
    """
    read = lambda table, key: read_in_parts(spark, url, table, key, parts, properties or {})
    return column_specs(
        read(catalog.attributes, "attrelid"), read(catalog.types, "oid"), read(catalog.enums, "enumtypid"), read(catalog.defaults, "adrelid")
    )
