"""Invoice arithmetic in exact decimals.

Amounts are MONEY, below 1e16. An invoice with an amount that this does not hold has no totals (NULL) instead of wrong ones, and `oversized` says
which; no amount ends the job or touches other invoices.

lines: invoice, line_no, description, quantity, unit_price, tax_rate (percent), lump_sum (NULL, or the total of a line without quantity);
header: invoice, discount (percent), shipping, misprint (added to the printed total).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


MONEY = "decimal(18,2)"


def line_totals(lines: DataFrame) -> DataFrame:
    """lines with line_total: the lump sum, or quantity times price; NULL where MONEY does not hold it."""
    total = F.round(
        F.col("quantity").try_cast("decimal(16,3)") * F.col("unit_price").try_cast("decimal(16,4)"), 2
    ).try_cast(MONEY)
    lump = F.col("lump_sum")
    return lines.withColumn("line_total", F.when(lump.isNotNull(), lump.try_cast(MONEY)).otherwise(total))


def _whole_sum(c: str) -> Column:
    """The sum of a column of MONEY, NULL where one of it is."""
    return F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c).try_cast(MONEY))


def _discounted(net: DataFrame, header: DataFrame) -> DataFrame:
    """net (invoice, net, ...) with discount_amount, subtotal (net less discount, half up), shipping and misprint."""
    off = F.round(F.col("net") * F.col("discount").try_cast("decimal(5,2)") / 100, 2).try_cast(MONEY)
    given = lambda c: F.coalesce(c, F.lit(0)).try_cast(MONEY).alias(c)
    subtotal = (F.col("net") - F.col("discount_amount")).try_cast(MONEY).alias("subtotal")
    joined = net.join(header, "invoice").withColumn("discount_amount", off)
    return joined.select(*net.columns, "discount_amount", subtotal, given("shipping"), given("misprint"))


def invoice_totals(lines: DataFrame, header: DataFrame) -> DataFrame:
    """L1: invoice, net, discount_amount, subtotal (net less discount, half up)."""
    return _discounted(line_totals(lines).groupBy("invoice").agg(_whole_sum("line_total").alias("net")), header)


def _rates(lines: DataFrame, header: DataFrame) -> DataFrame:
    """A row per invoice and rate: invoice, tax_rate, gross, tax, and of the whole invoice lines (those that MONEY does not hold), net,
    discount_amount, subtotal, shipping, misprint. Lines are summed once; what an invoice comes to is the sum of its rates.
    """
    by_rate = line_totals(lines).groupBy("invoice", "tax_rate").agg(
        F.sum("line_total").alias("sum__"), F.count_if(F.col("line_total").isNull()).alias("lacking__")
    )
    own = W.partitionBy("invoice")
    held = lambda c, lacking: F.when(lacking == 0, c.try_cast(MONEY))
    summed = by_rate.select(
        "invoice",
        "tax_rate",
        held(F.col("sum__"), F.col("lacking__")).alias("gross"),
        F.sum("lacking__").over(own).alias("lines"),
        F.sum("sum__").over(own).alias("net"),
        F.max("tax_rate").over(own).alias("top"),
    ).withColumn("net", held(F.col("net"), F.col("lines")))
    return _taxed(_discounted(summed, header))


def tax_by_rate(lines: DataFrame, header: DataFrame) -> DataFrame:
    """L2: invoice, tax_rate, gross, tax: each rate's share after discount, shipping on the highest rate, one rounding per rate."""
    return _rates(lines, header).select("invoice", "tax_rate", "gross", "tax")


def _taxed(joined: DataFrame) -> DataFrame:
    """A row per invoice and rate with its tax.

    In whole cents tax = (gross subtotal + shipping net) rate / net. The division is taken in steps of whole numbers and
    remainders, so all amounts that MONEY holds are exact; half a cent is rounded away from zero. An invoice of net 0 has no tax.
    """
    ship = F.when(F.col("tax_rate") == F.col("top"), F.col("shipping")).otherwise(F.lit(0).cast(MONEY))
    cents = lambda c: (c * 100).cast("decimal(18,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    quotient = lambda a, b: whole((a - a % b) / b)
    rate = (F.col("tax_rate").try_cast("decimal(5,2)") * 100).cast("decimal(5,0)")
    above = whole(cents(F.col("gross")) * cents(F.col("subtotal"))) + whole(cents(ship) * cents(F.col("net")))
    sign = F.when((above < 0) != (F.col("net") < 0), -1).otherwise(1)
    steps = joined.withColumn("rate__", rate).withColumn(
        "below__", whole(F.abs(cents(F.col("net"))))
    ).withColumn("above__", whole(F.abs(above)))
    steps = steps.withColumn("sign__", sign).withColumn("below__", F.when(F.col("below__") != 0, F.col("below__")))
    steps = steps.withColumn(
        "whole__", quotient(F.col("above__"), F.col("below__"))
    ).withColumn("rest__", F.col("above__") % F.col("below__"))
    # hundredths of a hundredth of a cent, the fraction left out: it cannot change a half-up rounding of whole steps
    fine = whole(F.col("whole__").cast("decimal(20,0)") * F.col("rate__")) + quotient(
        whole(F.col("rest__").cast("decimal(20,0)") * F.col("rate__")), F.col("below__")
    )
    tax = quotient(
        whole(fine) + 5000, whole(F.lit(10000))
    ).try_cast("decimal(18,0)") * F.lit(Decimal("0.01")) * F.col("sign__")
    # net 0: no tax; a net, discount or shipping that is not known: no tax is
    held = F.when(F.col("net") == 0, F.lit(0).cast(MONEY)).otherwise(tax.try_cast(MONEY))
    return steps.select(*(c for c in joined.columns if c != "top"), held.alias("tax"))


def invoice_header(lines: DataFrame, header: DataFrame) -> DataFrame:
    """L2, L3: subtotal, shipping, tax, total and the printed total; oversized: the first amount (line, net, shipping, tax or total) that
    MONEY does not hold.
    """
    whole = ("invoice", "lines", "net", "subtotal", "shipping", "misprint")
    out = _rates(lines, header).groupBy(*whole).agg(_whole_sum("tax").alias("tax"))
    out = out.withColumn("total", (F.col("subtotal") + F.col("shipping") + F.col("tax")).try_cast(MONEY))
    lacks = lambda c: F.col(c).isNull()
    amount = F.when(F.col("lines") > 0, "line").when(lacks("net"), "net").when(lacks("shipping"), "shipping").when(
        lacks("tax"), "tax"
    ).when(lacks("total"), "total")
    return out.select(
        "invoice",
        "subtotal",
        "shipping",
        "tax",
        "total",
        (F.col("total") + F.col("misprint")).try_cast(MONEY).alias("printed_total"),
        amount.alias("oversized"),
    )


def oversized(lines: DataFrame, header: DataFrame) -> DataFrame:
    """L1, L2: invoice, amount (line, net, shipping, tax or total): the first amount of an invoice that MONEY does not hold."""
    found = invoice_header(lines, header).select("invoice", F.col("oversized").alias("amount"))
    return found.where("amount is not null")


def expected_rows(lines: DataFrame) -> DataFrame:
    """L3: numbered lines; a lump sum has neither quantity nor price."""
    lump = F.col("lump_sum").isNotNull()
    number = F.row_number().over(W.partitionBy("invoice").orderBy("line_no"))
    kept = line_totals(lines)
    return kept.select(
        "invoice",
        number.alias("line_no"),
        "description",
        F.when(~lump, F.col("quantity")).alias("quantity"),
        F.when(~lump, F.col("unit_price")).alias("unit_price"),
        "line_total",
        "tax_rate",
    )
