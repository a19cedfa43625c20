"""Personal data: base patterns, and terms that give a protected entity away.

Base spans come from four patterns. The method on top is information-theoretic sanitisation: a term t in a document of an entity e
(an e-mail address, IP, card or phone number found by the patterns) discloses e when their pointwise mutual information leaves at
most BITS of what there is to know about e:

    log2(N / n_e) - log2(N n_et / (n_e n_t)) = log2(n_t / n_et) <= BITS

with N documents, n_e and n_t of them holding e and t, n_et holding both, all counted over the whole corpus. So N takes no part: with one bit
a term gives e away if e stands in half of the term's documents, in a corpus of any size. An entity of which no more than BITS are
unknown beforehand (n_e 2^BITS >= N) cannot be given away. Every occurrence of a disclosing term in e's documents becomes a span of kind
`term`; `sanitise` removes base spans and generalises terms to a placeholder.

Everything is DataFrame functions. Texts are kept only of documents with base spans; counts are plain aggregates, combined before each
shuffle. A term of up to 2^BITS documents is given with any entity beside it, without being paired. Others need an entity in several of
their documents; entities of the same documents are one class, so a list of addresses that stands in many documents is paired once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowcheck.llm.common import cut, fresh

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns, tried only where a match can begin: they find the same spans without
#: trying every place of a long run again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Three letters or more, with hyphens and apostrophes between letters; no part of an address or of a word with digits.
TERM = r"(?<![\p{L}\p{N}@._%+'’-])(?=[\p{L}'’-]{3})\p{L}++(?:['’-]\p{L}++)*+(?![\p{N}@_%+-]|[.'’]\p{L})"
BITS = 1
_NONE = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """Every match in text: array of (start, end, value) in code points, end exclusive."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["value"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))
        return F.struct(
            end.alias("at"),
            F.when(part["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"),
        )

    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    plain, doubled = F.regexp_replace(back, "(.).?", "$1"), F.translate(
        F.regexp_replace(back, ".(.?)", "$1"), "0123456789", "0246813579"
    )
    total = F.aggregate(
        F.split(F.concat(plain, doubled), ""), F.lit(0), lambda a, c: a + F.coalesce(c.try_cast("int"), F.lit(0))
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    count = F.length(_digits(value))
    if kind == "card":
        return F.when(count.between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return count.between(9, 15)


#: A text without this cannot hold the kind: most texts skip the pattern's bookkeeping.
_HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
}


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind: array of (start, end, value)."""
    return F.when(
        text.rlike(_HINTS[kind]), F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    ).otherwise(F.array().cast(_NONE))


def _spelled(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _ranked(order: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"),
        F.lit(order).alias("order"),
        s["end"].alias("end"),
        F.lit(kind).alias("kind"),
        s["value"].alias("value"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, counts, spans (start, order of kind, end, kind, entity) of every row; text where there are spans, else null; clean: SHA-256 of the
    text where there are none, else null.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    found = plain.select("doc_id", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    spans = F.concat(*(F.transform(kind, _ranked(n, kind)) for n, kind in enumerate(KINDS)))
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in KINDS)
    listed = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *counts, spans.alias("spans"))
    some = F.size("spans") > 0
    return listed.withColumn(
        "clean", F.when(~some, F.sha2("text", 256))
    ).withColumn("text", F.when(some, F.col("text")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, scanned: DataFrame, bits: int = BITS) -> DataFrame:
    """row, term: the terms of a row that reveal one of its entities, by counts over all documents."""
    times = 1 << bits
    holding = scanned.where(F.size("spans") > 0)
    mentions = holding.select(
        "row", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("entity")
    )
    # entities that stand in the same rows cannot be told apart by what stands beside them
    marks = (F.sum(F.xxhash64("row").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("second"), "row")))
    sets = mentions.groupBy("entity").agg(F.count("*").alias("n_e"), *(m.alias(f"m{k}") for k, m in enumerate(marks)))
    unknown = cut(sets.where(F.col("n_e") * times < scanned.count()))
    classes = cut(mentions.join(unknown, "entity").select("row", "n_e", "m0", "m1").distinct())
    most = classes.agg(F.max("n_e")).first()[0] or 0
    terms = docs.select(
        F.explode(_terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")
    ).groupBy("term").agg(F.count("*").alias("n_t"))
    rare = terms.where(F.col("n_t") <= times * most)
    with_some = holding.join(classes.select("row").distinct(), "row", "left_semi")
    own = cut(with_some.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(rare, "term"))
    at_once = own.where(F.col("n_t") <= times).select("row", "term")
    key = ["n_e", "m0", "m1", "term"]
    pairs = cut(own.where(F.col("n_t") > times).join(classes.where("n_e > 1"), "row").where(F.col("n_t") <= times * F.col("n_e")))
    counted = pairs.groupBy(*key).agg(F.count("*").alias("n_et"), F.max("n_t").alias("n_t"))
    reveals = counted.where(F.col("n_t") <= times * F.col("n_et")).select(*key)
    return at_once.unionByName(pairs.join(reveals, key, "left_semi").select("row", "term").distinct())


def _occurrences(holding: DataFrame) -> DataFrame:
    """row, start, end, term of every term in the texts (row, text): lengths are added up over the pieces between and of the terms."""
    parts = F.arrays_zip(
        F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("value")
    )
    pieces = holding.select("row", F.posexplode(parts).alias("at", "p")).select(
        "row", "at", F.length("p.gap").alias("gap"), F.col("p.value").alias("value")
    )
    length = F.coalesce(F.length("value"), F.lit(0))
    ends = F.sum(F.col("gap") + length).over(
        W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ).cast("int")
    return pieces.withColumn("end", ends).where("value is not null").select(
        "row", (F.col("end") - length).alias("start"), "end", F.lower("value").alias("term")
    )




def find(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_sha256 (of the sanitised text) for every row.

    Takes doc_id and text (other columns are not read). Spans are kind:start:end in code points, end exclusive, by start
    and then kind in the order email, ip, card, phone, term; base_sha256 is of the base spans alone. Null and empty texts have none
    (base_sha256 is that of the empty text). A null doc_id stays null; repeated rows count as documents of their own and give
    repeated results. A term is given once however many entities it discloses. An empty table gives an empty result.
    """
    scanned = cut(scan(docs))
    given_away = cut(disclosing(docs, scanned, bits))
    mentioned = _occurrences(scanned.where(F.size("spans") > 0)).join(given_away, ["row", "term"])
    place = F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("term").alias("kind"))
    terms = mentioned.groupBy("row").agg(F.collect_set(place).alias("terms"))
    joined = scanned.join(terms, "row", "left")
    base = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    every = F.concat(
        base, F.coalesce("terms", F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))
    )
    listed = joined.select(
        "doc_id",
        "text",
        "clean",
        *(f"n_{k}" for k in KINDS),
        F.sha2(_spelled(base), 256).alias("base_sha256"),
        _spelled(every).alias("spans"),
    )
    clean = F.coalesce("clean", F.sha2(masked(F.col("text"), F.col("spans")), 256))
    return listed.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", clean.alias("clean_sha256"))


def masked(text: Column, spans: Column) -> Column:
    """text with each listed span (kind:start:end, comma-joined) replaced by its kind in brackets; a span that begins inside an earlier one is dropped with it."""
    parts = F.filter(F.split(spans, ","), lambda s: s != "")
    cut_ = F.transform(
        parts,
        lambda s: F.struct(
            F.split(s, ":")[0].alias("kind"),
            F.split(s, ":")[1].cast("int").alias("start"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(
            acc["out"],
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
            F.lit("["),
            F.upper(s["kind"]),
            F.lit("]"),
        )
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(
        cut_, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )


def sanitise(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (unique doc_id) with base spans and disclosing terms of text replaced by [EMAIL], [IP], [CARD], [PHONE], [TERM]."""
    # names that docs does not have, so what is joined cannot be taken for its own columns
    own, spans = fresh(docs, "found_id"), fresh(docs, "found_spans")
    found = find(docs, bits).where("spans <> ''").select(
        F.col("doc_id").alias(own), F.col("spans").alias(spans)
    )
    joined = docs.join(found, F.col("doc_id").cast("long") == F.col(own), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(spans)))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
