"""URL filter: rules first, then a blocked Bloom filter over listed canonical URLs and an exact join.

The filter is a table: one row per block of four 64-bit words, one bit of each word set per listed
URL, so a probe touches one row. It has at most MOST_BLOCKS rows however long the list is, which bounds what is
broadcast. Pages that the filter lets through are possible hits; only they are shuffled to the exact hash join that
removes false positives. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import cut, join_back

#: 40 bytes a row: the broadcast filter stays under 42 MB.
MOST_BLOCKS = 1 << 20
KEYS_A_BLOCK = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Spam shows by a run of three such signs: titles and paragraphs padded with them.
SPAM = r"(%%%|\*\*\*|\$\$\$|&amp;&amp;&amp;|###|@@@|~~~|\^\^\^)"
HEADLINE = r"<h1>([^<]*)</h1>"
_PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; null or no :// gives the empty text."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _escapes(path_: Column) -> Column:
    """Percent escapes in one form: letters, digits and - . _ ~ stand for themselves, other escapes have capitals; a % without two hex digits stays."""
    hexed = lambda x: F.substring(x, 1, 2)
    sign = lambda x: F.chr(F.conv(hexed(x), 16, 10).try_cast("int"))
    rest = lambda x: F.substring(x, 3, 1 << 30)

    def one(x: Column, k: Column) -> Column:
        plain = hexed(x).rlike("^[2-7][0-9A-Fa-f]$") & sign(x).rlike("^[A-Za-z0-9._~-]$")
        whole = F.concat(
            F.lit("%"), F.when(hexed(x).rlike("^[0-9A-Fa-f]{2}$"), F.concat(F.upper(hexed(x)), rest(x))).otherwise(x)
        )
        return F.when(k == 0, x).when(plain, F.concat(sign(x), rest(x))).otherwise(whole)

    return F.when(path_.contains("%"), F.array_join(F.transform(F.split(path_, "%"), one), "")).otherwise(path_)


def _no_dots(path_: Column) -> Column:
    """Path without . and .. segments; .. takes the segment before it along."""
    step = lambda done, x: F.when(
        x == "..", F.regexp_replace(done, "/[^/]*$", "")
    ).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    folded = F.aggregate(F.split(F.substring(path_, 2, 1 << 30), "/"), F.lit(""), step)
    return F.when(path_.contains("/."), folded).otherwise(path_)


def canonical(host_: Column, path_: Column) -> Column:
    """One text for all spellings of a page: host without user, default port, closing full stop and www.; path with escapes in one
    form, without . and .. segments and without a closing / or .html. Scheme, query and fragment are gone.
    """
    bare = F.regexp_replace(F.regexp_replace(host_, r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    return F.concat(
        F.regexp_replace(bare, r"^www\.", ""), F.regexp_replace(_no_dots(_escapes(path_)), r"(/|\.html?)$", "")
    )


def fitting_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host or a subdomain of it is the url's and whose path starts the url's; of equal rules the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest_last = sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0]))
    for _, (says, own, start) in longest_last:
        fits = ((host_ == own) | host_.endswith("." + own)) & path_.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    spread = F.xxhash64(url, F.lit(1))
    words = [
        F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(63).cast("int")
        ) for k in range(4)
    ]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block__"), *(w.alias(f"w{k}__") for k, w in enumerate(words))]


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """(table of blocks, their number) for the distinct column `listed`."""
    blocks = min(MOST_BLOCKS, max(16, listed.count() // KEYS_A_BLOCK + 1))
    words = listed.select(*_bits(F.col("listed"), blocks))
    return words.groupBy("block__").agg(*(F.bit_or(f"w{k}__").alias(f"f{k}__") for k in range(4))), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    Takes page_id and url (other columns are not read) and the column `listed` of canonical URLs. The fitting rule
    decides; without one a page is blocked if its canonical URL is listed, else allowed. A null url, or one without ://,
    has empty host and path, fits no rule and is listed only if the empty text is. Null entries of the list are ignored, repeated ones
    count once. Repeated rows give repeated results; an empty table gives an empty result, an empty list lists nothing.
    """
    # the list and what pages are probed by are each written once: small beside the pages, and read several times
    listed = cut(listed.select(F.col("listed").cast("string").alias("listed")).where("listed is not null").distinct())
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule__"))
    free = F.col("by_rule__").isNull()
    asked = ruled.withColumn("url__", F.when(free, canonical(F.col("host"), F.col("path"))))
    table, blocks = bloom(listed)
    probed = asked.select("*", *_bits(F.col("url__"), blocks)).join(F.broadcast(table), "block__", "left")
    passes = free
    for k in range(4):
        passes = passes & (F.col(f"f{k}__").bitwiseAND(F.col(f"w{k}__")) != 0)
    columns = ["page_id", "host", "path", "rule"]
    judged = cut(
        probed.select(
            *columns, "by_rule__", F.when(F.coalesce(passes, F.lit(False)), F.col("url__")).alias("possible__")
        )
    )
    settled = judged.where("possible__ is null").select(
        *columns, F.coalesce("by_rule__", F.lit("allow")).alias("verdict")
    )
    possible = judged.where("possible__ is not null").select(*columns, "possible__")
    # the exact hash join, over the distinct URLs; pages of one that very many have are spread
    counts = possible.groupBy("possible__").agg(F.count("*").alias("n"))
    hits = cut(counts.join(listed, F.col("possible__") == F.col("listed")).select("possible__", "n", F.lit(True).alias("hit")))
    exact = join_back(possible, hits, "possible__", "n")
    return settled.unionByName(
        exact.select(*columns, F.when(F.col("hit").isNotNull(), "block").otherwise("allow").alias("verdict"))
    )


def listed_in(pages: DataFrame, spam: str = SPAM, headline: str = HEADLINE) -> DataFrame:
    """Canonical URLs of the pages under whose headline some page, on whatever host, shows a run of signs.

    A page's own html does not say whether it is listed: its headline was copied to or from a page that does. Pages without a headline count
    by their own signs. A headline that very many pages share is one row before they meet it.
    """
    title = F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), headline, 1), F.lit(""))
    own = pages.where(F.col("url").contains("://")).select(
        canonical(host(F.col("url")), path(F.col("url"))).alias("listed"),
        F.coalesce(F.xxhash64(title), F.lit(0).cast("long")).alias("title"),
        title.isNull().alias("bare"),
        F.coalesce(F.col("html").rlike(spam), F.lit(False)).alias("shows"),
    )
    own = cut(own)
    titled = own.where(~F.col("bare"))
    bad = titled.groupBy("title").agg(F.count("*").alias("n"), F.bool_or("shows").alias("bad")).where("bad")
    met = join_back(titled.select("listed", "title"), cut(bad.select("title", "bad", "n")), "title", "n").where("bad")
    return met.select("listed").unionByName(own.where("bare AND shows").select("listed")).distinct()
