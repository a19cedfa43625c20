"""Invoices are worked out in one pass over their lines."""

import contextlib
import io
from decimal import Decimal as D

from pyspark.sql import functions as F
from rowcheck.operators import invoices
from rowcheck.queries import QUERIES


def test_one_join(spark):
    """Lines are read and summed once and meet their header once, so a task holds one sort of them."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        QUERIES["l02_large_amounts"](spark, "/root/testdata/sf0.001").explain()
    plan = said.getvalue().split("Initial Plan")[-1]
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1


def test_amounts_that_do_not_fit(spark):
    """A line, the net of several rates, shipping or a total that MONEY does not hold; negative lines that bring a rate back."""
    big = "9000000000000000"
    rows = [
        (1, 1, "25", "100"), (1, 2, "12", "10"), (1, 3, "12", "10"), (2, 1, "25", big), (2, 2, "12", big), (3, 1, "25", big + "0"), (3, 2, "12", "1"),
        (4, 1, "25", "8"), (5, 1, "25", big), (6, 1, "25", "5"), (6, 2, "12", "-5"), (7, 1, "0", big), (7, 2, "0", big), (7, 3, "0", "-" + big),
    ]
    lines = spark.createDataFrame(rows, "invoice int, line_no int, tax_rate string, lump_sum string").select(
        "invoice", "line_no", F.lit("x").alias("description"), F.lit(None).cast("decimal(12,3)").alias("quantity"),
        F.lit(None).cast("decimal(12,4)").alias("unit_price"), F.col("tax_rate").cast("decimal(5,2)").alias("tax_rate"),
        F.col("lump_sum").cast("decimal(38,2)").alias("lump_sum"),
    )
    header = spark.createDataFrame([(k, 0, big + "0" if k == 4 else "0", 0) for k in (1, 2, 3, 4, 5, 6, 7, 8)], "invoice int, discount int, shipping string, misprint int")
    header = header.withColumn("shipping", F.col("shipping").cast("decimal(38,2)"))
    got = {r["invoice"]: (r["subtotal"], r["tax"], r["total"], r["oversized"]) for r in invoices.invoice_header(lines, header).collect()}
    assert got == {
        1: (D(120), D("27.40"), D("147.40"), None), 2: (None, None, None, "net"), 3: (None, None, None, "line"), 4: (D(8), None, None, "shipping"),
        5: (D(big), D("2250000000000000"), None, "total"), 6: (D(0), D(0), D(0), None), 7: (D(big), D(0), D(big), None),
    }
    found = {r["invoice"]: r["amount"] for r in invoices.oversized(lines, header).collect()}
    assert found == {2: "net", 3: "line", 4: "shipping", 5: "total"}
