"""Staged inputs drawn from the given tables: what documents would have said, with known mistakes planted by key arithmetic.

Each frame is a projection of its table (no window, no shuffle), so it grows with it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcheck.functions.text import apart, render_date, render_number
from rowcheck.plans.spec import Field, TableSpec, multiplies_to, shaped, within

LOCALES = ("plain", "point", "comma", "space")

LINES = TableSpec(
    "invoice_lines",
    (
        Field("id", "int8", 1, required=True, made="identity"),
        Field("order_no", "int8", 2, required=True),
        Field("ref", "varchar", 3, size=12),
        Field("quantity", "numeric", 4, required=True, scale=3),
        Field("unit_price", "numeric", 5, required=True, scale=2),
        Field("line_total", "numeric", 6, required=True, scale=2),
        Field("weight", "numeric", 7),
        Field("status", "text", 8, required=True, labels=("A", "N", "R")),
        Field("shipped", "date", 9),
        Field("paid", "bool", 10),
        Field("created_at", "timestamptz", 11, required=True, default="now()"),
    ),
)
LINE_RULES = (multiplies_to(("quantity", "unit_price"), "line_total"), within("quantity", Decimal(1), Decimal(45)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores where it is read in fewer splits than there are cores: rendering and gating cost far more
    than moving the rows. A larger table already is in many splits and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores, *keys)


def by_locale(doc: Column, make) -> Column:
    """make(locale) for the document's locale: its number modulo four."""
    out = make(LOCALES[0])
    for k, name in enumerate(LOCALES[1:], start=1):
        out = F.when(doc % 4 == k, make(name)).otherwise(out)
    return out


def cents(c: Column) -> Column:
    """Whole cents as an exact decimal amount."""
    return (c.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc (file number), planted (0..96), exact quantity, price, total, weight and date of every line item."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    price = F.col("l_partkey") * 37 % 90000 + 100
    quantity = F.col("l_quantity").cast("bigint")
    return li.select(
        (F.col("l_suppkey") % 40).alias("doc"),
        (
            (
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
            ) * 10_000 + F.col("l_suppkey")
        ).alias("row_idx"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 97).alias("planted"),
        F.col("l_orderkey").alias("order_no"),
        quantity.alias("quantity"),
        price.alias("price"),
        (quantity * price).alias("total"),
        (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("weight"),
        F.col("l_returnflag").alias("status"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        (F.col("l_linenumber") % 2 == 0).alias("paid"),
    )


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text: doc_id, row_idx and one text column per column of LINES."""
    f = line_facts(spark, sf_dir)
    p = F.col("planted")
    total = F.col("total") + F.when(p == 0, 100).otherwise(0)
    money = lambda c: by_locale(F.col("doc"), lambda name: render_number(cents(c), 2, name))
    whole = by_locale(
        F.col("doc"),
        lambda name: F.col("weight").cast("string") if name == "plain" else render_number(F.col("weight"), 0, name),
    )
    halves = by_locale(F.col("doc"), lambda name: render_number(F.col("weight").cast("decimal(18,1)"), 1, name))
    said = {
        "doc_id": F.format_string("f%03d", "doc"),
        "row_idx": F.col("row_idx"),
        "order_no": F.col("order_no").cast("string"),
        "ref": F.concat(
            F.lit("L-"), F.lpad(F.col("order_no").cast("string"), 8, "0"), F.when(p == 5, "-CORRECTED").otherwise("")
        ),
        "quantity": F.when(p == 2, "abc").otherwise(
            F.concat(F.col("quantity").cast("string"), F.when(F.col("row_idx") % 2 == 0, " st").otherwise(""))
        ),
        "unit_price": F.concat(F.when(F.col("doc") % 4 == 2, "USD ").otherwise(""), money(F.col("price"))),
        "line_total": F.when(p == 1, "n/a").otherwise(money(total)),
        "weight": F.when(F.col("row_idx") % 3 == 0, halves).otherwise(whole),
        "status": F.when(p == 3, "X").otherwise(F.col("status")),
        "shipped": F.when(p == 4, "05/01/2026").otherwise(
            by_locale(F.col("doc"), lambda name: render_date(F.col("shipped"), name))
        ),
        "paid": F.when(F.col("paid"), "Yes").otherwise("n"),
    }
    return f.select(*(made.alias(name) for name, made in apart(said).items()))


STATEMENT = TableSpec(
    "invoices",
    (
        Field("invoice_number", "varchar", 1, required=True, size=32),
        Field("status", "text", 2),
        Field("total", "numeric", 3, scale=2),
    ),
)


def statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rows): per customer a text that names all orders; rows lack every order whose key is a multiple of 11."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("invoice_number"),
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
    )
    texts = o.groupBy("doc_id").agg(F.array_sort(F.collect_list("invoice_number")).alias("n")).select(
        "doc_id",
        F.concat(F.lit("Statement of account. Open invoices: "), F.array_join("n", ", "), F.lit(".")).alias("text"),
    )
    rows = o.where("k % 11 <> 0").select(
        "doc_id", F.col("k").alias("row_idx"), "invoice_number", "status", F.col("total").cast("string").alias("total")
    )
    return texts, rows


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage records: the user is the document, the event type the model."""
    e = table(spark, sf_dir, "events")
    tokens = (F.col("event_id") * 13 % 5000).cast("bigint")
    return e.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("model"),
        tokens.alias("input_tokens"),
        (tokens % 700).alias("output_tokens"),
        (tokens % 90).alias("cached_input_tokens"),
        F.lit(1).cast("bigint").alias("calls"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for every model that has events but one (the last by name): bounded by the number of models."""
    models = table(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct()
    last = models.agg(F.max("model").alias("last"))
    n = F.length("model")
    return models.join(F.broadcast(last), F.col("model") != F.col("last")).select(
        "model",
        n.cast("decimal(8,2)").alias("input"),
        (n * 4).cast("decimal(8,2)").alias("output"),
        F.when(n % 2 == 0, (n * F.lit(Decimal("0.5"))).cast("decimal(8,2)")).alias("cached_input"),
    )


ORDERS = TableSpec(
    "orders",
    (
        Field("invoice_number", "varchar", 1, required=True, size=32),
        Field("status", "text", 2),
        Field("total", "numeric", 3, scale=2),
        Field("issued_on", "date", 4),
        Field("note", "text", 5),
    ),
)
ORDER_COLUMNS = [c.name for c in ORDERS.columns]


def expected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (customer), row_idx, the order's columns as text."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        k.alias("row_idx"),
        F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 9, "0")).alias("invoice_number"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_on"),
        F.when(k % 4 == 0, F.col("o_orderpriority")).alias("note"),
        k.alias("k"),
    )


def returned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as an approach returned them: some lost, some doubled, numbers spelled otherwise, values wrong, blank or invented; `refusal` for rows the table refused."""
    e = expected_orders(spark, sf_dir).where("k % 11 <> 0")
    k = F.col("k")
    e = e.withColumn("copy", F.explode(F.when(k % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return e.select(
        "doc_id",
        (k * 2 + F.col("copy")).alias("row_idx"),
        F.when(
            k % 2 == 0, F.translate("invoice_number", "-", " ")
        ).otherwise(F.lower("invoice_number")).alias("invoice_number"),
        F.when(k % 13 == 0, F.lit("?")).otherwise(F.lower("status")).alias("status"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.concat("total", F.lit("00"))).alias("total"),
        F.concat("issued_on", F.lit("T00:00:00")).alias("issued_on"),
        F.when(k % 23 == 0, F.lit("made up")).otherwise(F.col("note")).alias("note"),
        F.when(k % 29 == 0, F.lit("check")).alias("refusal"),
        "k",
    )


def order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged cells of returned_orders: the status of every 26th key, the total of every 58th."""
    r = returned_orders(spark, sf_dir)
    status = r.where("k % 26 = 0").select("doc_id", "row_idx", F.lit("status").alias("column"))
    return status.unionByName(r.where("k % 58 = 0").select("doc_id", "row_idx", F.lit("total").alias("column")))


ORDER_RULES = (shaped("status", "[FO]"),)


def land_orders(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Orders as landing files, in folders file=<name>: t0 to t19 by customer, delimited (odd ones with tabs and decimal commas; t7 has a
    line too wide, t9 two headings for one column), and p<customer> for every fiftieth customer, a statement behind a PDF's mark.
    """
    o = expected_orders(spark, sf_dir).withColumn("f", F.col("doc_id") % 20).withColumn(
        "file", F.concat(F.lit("t"), F.col("f").cast("string"))
    )
    odd = F.col("f") % 2 == 1
    cells = ("invoice_number", "status", "total", "issued_on", "extra")
    total = F.when(odd, F.translate("total", ".", ",")).otherwise(F.col("total"))
    made = o.withColumn("total", total).withColumn("extra", F.concat(F.lit('say "'), "status", F.lit('"')))
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    last = F.when(F.col("f") == 7, F.lit("one too many")).otherwise(F.lit(""))
    line = F.when(odd, F.concat_ws("\t", *quoted, last)).otherwise(F.concat_ws(";", *quoted))
    names = ("Invoice Number", "STATUS", "total", "Issued-On")
    head = F.when(odd, F.when(F.col("f") == 9, "\t".join((*names, "Invoice_number"))).otherwise("\t".join((*names, "extra")))).otherwise(
        ";".join((*names, "extra"))
    )
    heads = made.select("file", "f").distinct().select(
        "file", head.alias("value"), F.lit(-1).cast("long").alias("k")
    )
    lines = made.select("file", line.alias("value"), "k").unionByName(heads)
    lines.repartition("file").sortWithinPartitions("file", "k").drop("k").write.partitionBy("file").text(folder)
    texts, _ = statements(spark, sf_dir)
    some = texts.where("doc_id % 50 = 0").select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("file"), F.concat(F.lit("%PDF-1.7 "), "text").alias("value")
    )
    paid = expected_orders(spark, sf_dir).where("doc_id % 50 = 0").select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("file"),
        F.concat_ws(" ", F.lit("line"), "invoice_number", "status", "total").alias("value"),
    )
    # many small files: making them costs far more than their bytes, so a number of tasks that does not follow those
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    some.unionByName(paid).repartition(tasks, "file").sortWithinPartitions("file", "value").write.partitionBy("file").mode("append").text(folder)


def read_statements(docs: DataFrame) -> tuple[DataFrame, DataFrame, None]:
    """An extractor of land_orders' statements: it reads their lines, but for every order whose number eleven divides."""
    texts = docs.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("line "))
    cells = texts.select("doc_id", F.posexplode(F.transform(lines, lambda x: F.split(x, " "))).alias("row_idx", "c"))
    rows = cells.select(
        "doc_id",
        "row_idx",
        F.col("c")[1].alias("invoice_number"),
        F.col("c")[2].alias("status"),
        F.col("c")[3].alias("total"),
        F.substring(F.col("c")[1], 5, 9).cast("long").alias("k"),
    )
    return texts, rows.where("k % 11 <> 0").drop("k"), None
