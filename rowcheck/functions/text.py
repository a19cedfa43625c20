"""Column functions on single cells: nothing-words, numbers, dates and other scalars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the gate.
NULL_WORDS = ("", "null", "none", "n/a", "na", "nan", "nil")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
CURRENCY = "€$£¥₹₽₩"
MONTHS = {
    "january": 1,
    "jan": 1,
    "february": 2,
    "feb": 2,
    "march": 3,
    "mar": 3,
    "april": 4,
    "apr": 4,
    "may": 5,
    "june": 6,
    "jun": 6,
    "july": 7,
    "jul": 7,
    "august": 8,
    "aug": 8,
    "september": 9,
    "sep": 9,
    "sept": 9,
    "october": 10,
    "oct": 10,
    "november": 11,
    "nov": 11,
    "december": 12,
    "dec": 12,
}

# White space as documents hold it: ASCII, its separators, no-break and typographic spaces.
_SPACES = [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
]
WHITE = "".join(map(chr, _SPACES))
_WHITE = "[" + "".join(rf"\u{n:04x}" for n in _SPACES) + "]"
_LONGEST_WORD = max(map(len, NULL_WORDS))


def strip(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    """A blank cell is NULL, another is stripped."""
    return F.nullif(strip(c), F.lit(""))


def normalise_header(c: Column) -> Column:
    """Lower case, each run of other characters than 0-9a-z one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def null_words(c: Column, labels: tuple[str, ...] = ()) -> Column:
    """A spelled-out nothing is NULL, unless an enum label is spelled so."""
    own = {label.lower() for label in labels}
    words = [w for w in NULL_WORDS if w not in own]
    if not words:
        return c
    bare = strip(c)
    # a long cell is settled by its size; only a short one is folded and looked up
    return F.when((F.octet_length(bare) <= _LONGEST_WORD) & F.lower(bare).isin(*words), F.lit(None)).otherwise(c)


#: A cell of digits and separators alone needs none of the steps that take presentation off.
_BARE = r"^[0-9][0-9.,]*\z"
_WORD_BEFORE = rf"^[A-Za-z]{{1,4}}\.?{_WHITE}+"
_WORD_BEHIND = rf"(?<!^)(?<!{_WHITE}){_WHITE}*(?:%|[A-Za-z]{{1,6}}\.?)\z"


def number_core(c: Column) -> Column:
    """D3, first step: without white space, a short code in front and a unit or % behind."""
    cut = F.regexp_replace(F.regexp_replace(strip(c), _WORD_BEFORE, ""), _WORD_BEHIND, "")
    return F.when(c.rlike(_BARE), c).otherwise(cut)


def number_signed(core: Column) -> Column:
    """D3, second step: a minus if the number is negative, then its digits and separators.

    Parentheses are a minus, and a minus inside them takes it back; they count only where nothing but
    they and what they hold is left, so a currency sign in front of them leaves them for the parser to refuse.
    """
    plain = lambda x: F.translate(x, WHITE + CURRENCY, "")
    inner, outer = plain(F.substring(core, F.lit(2), F.length(core) - 2)), plain(core)
    held = (
        F.when(inner.startswith("-"), F.substring(inner, 2, 1 << 30))
        .when(inner.startswith("+"), F.concat(F.lit("-"), F.substring(inner, 2, 1 << 30)))
        .otherwise(F.concat(F.lit("-"), inner))
    )
    free = F.when(outer.startswith("+"), F.substring(outer, 2, 1 << 30)).otherwise(outer)
    closed = core.startswith("(") & core.endswith(")")
    return F.when(core.rlike(_BARE), core).when(closed, held).otherwise(free)


def number_text(c: Column) -> Column:
    """D3: both steps. Letters inside the digits stay and fail later."""
    return number_signed(number_core(c))


def number_body(text: Column) -> Column:
    """D3: the digits and separators of a number_text."""
    return F.when(text.startswith("-"), F.substring(text, 2, 1 << 30)).otherwise(text)


def number_negative(text: Column) -> Column:
    return text.startswith("-")


def _bound(c: Column, use) -> Column:
    """use(c) with c worked out once: for expressions that name it often and cannot have a column for it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def apart(columns: Mapping[str, Column]) -> dict[str, Column]:
    """columns, the first of them by way of an array function, which keeps their projection out of the whole stage.

    In a whole stage all steps of all cells become one method; beyond 8,000 bytes the JVM never compiles it and runs it many times slower.
    A projection of its own is cut into short methods.
    """
    out = dict(columns)
    for name in list(out)[:1]:
        out[name] = F.get(F.transform(F.array(out[name]), lambda x: x), F.lit(0))
    return out


def strip_number(c: Column) -> Column:
    """D3: struct (body, negative)."""
    parts = lambda text: F.struct(number_body(text).alias("body"), number_negative(text).alias("negative"))
    return F.when(c.isNotNull(), _bound(number_core(c), lambda core: _bound(number_signed(core), parts)))


def _separators(body: Column) -> tuple[Column, Column]:
    return (F.length(body) - F.length(F.replace(body, F.lit(s), F.lit(""))) for s in (".", ","))


def _last_is_dot(body: Column) -> Column:
    return body.rlike(r"(?s)\.[^.,]*$")


def decimal_evidence(body: Column) -> Column:
    """The separator that a body proves to be the decimal point, else NULL."""
    dots, commas = _separators(body)
    lone = F.when(dots > 0, F.lit(".")).otherwise(F.lit(","))
    other = F.when(dots > 0, F.lit(",")).otherwise(F.lit("."))
    return (
        F.when((dots > 0) & (commas > 0), F.when(_last_is_dot(body), F.lit(".")).otherwise(F.lit(",")))
        .when((dots == 0) & (commas == 0), F.lit(None))
        .when(dots + commas > 1, other)
        .when(~body.rlike(r"(?s)^[^.,]*[.,][0-9]{3}$"), lone)
    )


#: One separator before one or two digits: the common amount.
_POINT_SURE = r"^[0-9]+[.,][0-9]{1,2}\z"


def normalise_number(body: Column, scale: int | None = None, convention: Column | None = None) -> Column:
    """Plain decimal text; NULL where one separator before three digits could be either kind."""
    dots, commas = _separators(body)
    no_dots, no_commas = F.replace(body, F.lit("."), F.lit("")), F.replace(body, F.lit(","), F.lit(""))
    bare, pointed = F.translate(body, ".,", ""), F.translate(body, ",", ".")
    unclear = body.rlike(r"(?s)^[^.,]*[.,][0-9]{3}$")
    if scale is not None and scale < 3:
        settled = bare
    elif convention is not None:
        lone = F.when(dots > 0, F.lit(".")).otherwise(F.lit(","))
        settled = F.when(convention.isNotNull(), F.when(convention == lone, pointed).otherwise(bare))
    else:
        settled = F.lit(None).cast("string")
    return (
        F.when(~body.contains(".") & ~body.contains(","), body).when(body.rlike(_POINT_SURE), pointed).when(
            (dots > 0) & (commas > 0), F.when(_last_is_dot(body), no_commas).otherwise(F.translate(no_dots, ",", "."))
        ).when(dots + commas > 1, bare).when(~unclear, pointed).otherwise(settled)
    )


def signed(number: Column, negative: Column) -> Column:
    return F.when(negative, F.concat(F.lit("-"), number)).otherwise(number)


_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$"


def to_decimal(number: Column, scale: int) -> Column:
    """Exact, or NULL."""
    return F.when(number.rlike(_DECIMAL), number.try_cast(f"decimal(38,{scale})"))


def exact_spelling(number: Column) -> Column:
    """An exact number as it was written, without leading zeros and with a digit before the point; trailing zeros stay.

    number is the text that to_decimal takes. A number with an exponent is spelled by its value, without trailing zeros.
    """
    text = F.regexp_replace(F.regexp_replace(number, r"^([+-]?)0*(?=[0-9])", "$1"), r"^([+-]?)\.", "$10.")
    plain = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"\.$", "")
    usual = number.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z")
    return F.when(usual, number).when(plain.rlike("[eE]"), trimmed(number.try_cast("decimal(38,10)"))).otherwise(plain)


def trimmed(c: Column) -> Column:
    """A decimal as text without trailing zeros: its spelling where the written one is not known."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def to_integer(number: Column, kind: str) -> Column:
    """Digits only; out of range is NULL."""
    return F.when(
        number.rlike(r"^-?[0-9]+$"), number.try_cast({"int2": "smallint", "int4": "int", "int8": "bigint"}[kind])
    )


def to_float(number: Column, kind: str) -> Column:
    """D8, keeping the sign."""
    return F.when(number.rlike(_DECIMAL), number.try_cast("float" if kind == "float4" else "double"))


def to_boolean(c: Column) -> Column:
    """D9."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def _month(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(known, F.lower(c))


_NAMED = rf"^(?:[0-9]{{1,2}}{_WHITE}+[A-Za-z]+\.?,?|[A-Za-z]+\.?{_WHITE}+[0-9]{{1,2}},?){_WHITE}+[0-9]{{4}}\z"


def _named(c: Column) -> Column:
    """ISO text of a date with an English month name, else NULL: three words, day and month in either order, then the year.

    The month may be followed by a full stop, the word before the year by a comma.
    """
    # one look at the whole text settles its shape; in that shape there is one word of letters and one number of less than four digits
    month = _month(F.regexp_extract(c, "[A-Za-z]+", 0)).cast("string")
    day = F.regexp_extract(c, r"(?<![0-9])[0-9]{1,2}(?![0-9])", 0)
    made = F.concat(F.substring(c, -4, 4), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(c.rlike(_NAMED), made)


def to_date_strict(c: Column) -> Column:
    """ISO (with or without hyphens) or an English month name; digits-only regional dates are NULL."""
    text = strip(c)
    part = lambda at, n: F.substring(text, at, n)
    digits = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    # an ISO date needs no stripping
    spelled = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c).when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text
    ).when(text.rlike(r"^[0-9]{8}\z"), digits).otherwise(_named(text))
    return spelled.try_cast("date")


_DAY = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})"
_CLOCK = r"[0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{2}(?:[0-9]{2}(?:[.,][0-9]+)?)?)?"
_OFFSET = r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)"


def _clock(c: Column) -> Column:
    """HH:mm:ss, with six more digits where there is a fraction, of an ISO clock time (colons or none, minutes and seconds optional)."""
    digits = F.rpad(F.translate(F.regexp_extract(c, r"^[0-9:]+", 0), ":", ""), 6, "0")
    fraction = F.rpad(F.regexp_extract(c, r"[.,]([0-9]{1,6})", 1), 6, "0")
    whole = F.regexp_replace(digits, r"^(..)(..)(..)$", "$1:$2:$3")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def _offset(c: Column) -> Column:
    """+HH:mm of an ISO offset; the empty text where there is none."""
    digits = F.rpad(F.translate(c, ":", ""), 5, "0")
    return F.when(c == "", c).when(c == "Z", "+00:00").otherwise(F.regexp_replace(digits, r"^(...)(..)$", "$1:$2"))


def to_timestamp_strict(c: Column, zone: bool) -> Column:
    """ISO in its extended and basic forms, or a named date with an optional clock time behind it.

    Without zone an offset is dropped, as the column keeps wall time.
    """
    text = strip(c)
    whole = rf"(?s)^({_DAY})(?:.({_CLOCK})({_OFFSET})?)?\z"
    part = lambda k: F.regexp_extract(text, whole, k)
    day = F.regexp_replace(F.translate(part(1), "-", ""), r"^(....)(..)(..)$", "$1-$2-$3")
    behind = F.concat(F.lit(" "), _clock(part(2)), _offset(part(3)) if zone else F.lit(""))
    iso = F.concat(day, F.when(part(2) == "", F.lit("")).otherwise(behind))
    # a clock time behind a named date stands after the last space and has a colon
    last = F.regexp_extract(text, rf"{_WHITE}({_CLOCK})\z", 1)
    timed = text.rlike(rf"{_WHITE}{_CLOCK}\z") & last.contains(":")
    date = F.when(timed, strip(F.substring(text, F.lit(1), F.length(text) - F.length(last)))).otherwise(text)
    named = F.concat(_named(date), F.when(timed, F.concat(F.lit(" "), _clock(last))).otherwise(F.lit("")))
    return F.when(text.rlike(whole), iso).otherwise(named).try_cast("timestamp" if zone else "timestamp_ntz")


def to_time_strict(c: Column) -> Column:
    """HH:mm:ss as text, with six more digits where there is a fraction and the offset where one is given."""
    text = strip(c)
    whole = rf"^T?({_CLOCK})({_OFFSET})?\z"
    clock, offset = (F.regexp_extract(text, whole, k) for k in (1, 2))
    made = F.concat(_clock(clock), _offset(offset))
    sound = made.rlike(
        r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{6})?(?:[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?\z"
    )
    return F.when(text.rlike(whole), F.when(sound, made))


def strict_json(c: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; NULL for others.

    Spark's parser stops behind the first value. As the one member of an array and of an object the text must close both: what follows
    a value can at most close one of them.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), F.get(listed, F.lit(0)))


def to_json_container(c: Column) -> Column:
    """The text if it is a JSON object or array, without anything behind it."""
    kind = F.schema_of_variant(strict_json(c))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), c)


def number_key(c: Column) -> Column:
    """A text that numbers of one value share, however they are written: sign, digits without outer zeros, place of the point.

    As decimals are read: white space around and `_` between do not count, an exponent may follow. What is no number (NaN too, which
    equals nothing) is NULL, and so is an exponent beyond 18 digits.
    """
    text = F.lower(F.replace(strip(c), F.lit("_"), F.lit("")))
    part = lambda k: F.regexp_extract(text, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:e([+-]?[0-9]+))?\z", k)
    whole, fraction = part(2), part(3)
    digits = F.concat(whole, fraction)
    from_first = F.ltrim(digits, F.lit("0"))
    power = F.when(part(4) == "", F.lit(0).cast("bigint")).otherwise(
        F.when(F.length(part(4)) <= 19, part(4).try_cast("bigint"))
    )
    point = F.length(whole) - (F.length(digits) - F.length(from_first)) + power
    minus = F.when(part(1) == "-", "-").otherwise("")
    number = F.concat(minus, F.rtrim(from_first, F.lit("0")), F.lit("e"), point.cast("string"))
    endless = F.regexp_extract(text, r"^([+-]?)inf(?:inity)?\z", 0)
    return F.when(digits != "", F.when(power.isNotNull(), F.when(from_first == "", "0").otherwise(number))).when(
        endless != "", F.concat(F.when(endless.startswith("-"), "-").otherwise(""), F.lit("inf"))
    )


def to_uuid(c: Column) -> Column:
    """Lower case with hyphens."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^urn:uuid:|[{}]", ""), "-", "")
    return F.when(
        digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    )


def to_enum(c: Column, labels: tuple[str, ...]) -> Column:
    """Exact membership."""
    return F.when(c.isin(*labels), c) if labels else F.lit(None).cast("string")


def array_items(c: Column) -> Column:
    """Texts of the items: a JSON array, or items between commas, optional braces around them."""
    text = strip(c)
    json = F.from_json(text, "array<string>")
    plain = F.filter(F.transform(F.split(F.regexp_replace(text, r"^\{|\}$", ""), ","), strip), lambda x: x != "")
    return F.when(text.startswith("[") & json.isNotNull(), json).otherwise(plain)


def iso_timestamp(c: Column) -> Column:
    """ISO text of a timestamp, six digits of a second only where there are any."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def render_cell(c: Column, kind: str) -> Column:
    """Staged text of a typed source cell; a whole float has no point up to 2^53."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) <= float(2**53))
        out = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    elif kind == "date":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        out = iso_timestamp(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def folded(c: Column) -> Column:
    """Without any white space, lower case."""
    return F.lower(F.translate(c, WHITE, ""))


def render_number(c: Column, digits: int, locale: str) -> Column:
    """L4: `plain` 1234.56, `point` 1.234,56, `comma` 1,234.56, `space` 1 234,56 with a no-break space."""
    if locale == "plain":
        return c.cast(f"decimal(38,{digits})").cast("string")
    text = F.format_number(c, digits)
    return {"comma": text, "point": F.translate(text, ",.", ".,"), "space": F.translate(text, ",.", " ,")}[locale]


def render_date(c: Column, locale: str) -> Column:
    """L4: ISO for `plain`, `1 March 2026` for `point` and `space`, `March 1, 2026` for `comma`."""
    return F.date_format(
        c, {"plain": "yyyy-MM-dd", "comma": "MMMM d, yyyy", "point": "d MMMM yyyy", "space": "d MMM yyyy"}[locale]
    )
