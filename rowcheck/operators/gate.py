"""Coercion and rules over staged text rows: every row comes back, with its findings.

A staged frame has doc_id, row_idx and one text column per extractable column of the table. The gate is
projections only, but for one aggregate per document (number conventions). Each step of a cell (text of the number, its
body, the plain number, the value, what is wrong with it) is a column of its own, so each is computed once; what a finding says is
spelled out only for rows that have one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcheck.functions import text as X
from rowcheck.plans.spec import FLOATS, INTEGERS, JSONS, Arithmetic, Field, Rule, TableSpec, ValueRule
from rowcheck.sources.shared import written

FINDING = "struct<column:string,rule:string,detail:string,value:string>"
#: A reject list longer than this is joined instead of written into the plan.
LONGEST_LIST = 1000
#: A joined reject list of up to this many bytes goes to every task; a longer one is shuffled to.
BROADCAST_BYTES = 8 << 20
#: Number conventions of up to this many documents go to every task; those of more are shuffled to.
BROADCAST_DOCUMENTS = 100_000
#: What coercion found in a cell, as code__<column>.
LACKING, UNCLEAR, WRONG_TYPE, NO_LABEL = 1, 2, 3, 4


def finding(column: str, rule: str, detail: Column | str, value: Column | None = None) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    shown = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct(
        F.lit(column).alias("column"), F.lit(rule).alias("rule"), text.alias("detail"), shown.alias("value")
    )


def _held(c: Column) -> Column:
    """c, computed where it stands. A filter on the findings would else be pushed down into every cell's expression and
    multiplied there until planning takes longer than the run; filter by document before the gate instead.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def number_conventions(staged: DataFrame, spec: TableSpec, columns: Sequence[Field] | None = None) -> DataFrame:
    """Per document and scalar numeric column the proven decimal separator, else NULL. Only text cells give evidence.

    Cells without a separator prove nothing and are not looked at; what the others prove is or-ed as bits (1 for a
    point, 2 for a comma), which combines before the shuffle, so one giant file is no hot key.
    """
    texts = dict(staged.dtypes)
    numbers = [
        c for c in (spec.extractable if columns is None else columns) if c.is_number and texts.get(c.name) == "string"
    ]
    if not numbers:
        return staged.select("doc_id").distinct()
    cell = lambda c: F.col(f"`{c.name}`")
    marked = lambda c: F.when(cell(c).contains(".") | cell(c).contains(","), X.number_core(cell(c)))
    step = lambda df, of: df.select(
        "doc_id", *(made.alias(name) for name, made in X.apart({c.name: of(cell(c)) for c in numbers}).items())
    )
    cells = staged.select("doc_id", *(marked(c).alias(c.name) for c in numbers))
    cells = step(step(cells, X.number_signed), lambda text: X.decimal_evidence(X.number_body(text)))
    bits = lambda c: F.when(cell(c) == ".", 1).when(cell(c) == ",", 2)
    found = cells.groupBy("doc_id").agg(*(F.bit_or(bits(c)).alias(c.name) for c in numbers))
    return found.select("doc_id", *(F.when(cell(c) == 1, ".").when(cell(c) == 2, ",").alias(c.name) for c in numbers))


def as_text(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed cells spelled as a document would print them; arrays and structs as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def spelled(c: Field) -> Column:
        kind = kinds.get(c.name)
        if kind is None:
            return F.lit(None).cast("string").alias(c.name)
        if kind in ("array", "struct", "map"):
            return F.to_json(F.col(c.name)).alias(c.name)
        return F.col(c.name).cast("string").alias(c.name)

    return df.select("doc_id", "row_idx", *(spelled(c) for c in spec.extractable))


def _converted(c: Field, text: Column, number: Column | None) -> Column:
    """The typed value, NULL where the text does not fit."""
    if c.element is not None:
        element = c.element
        return F.transform(X.array_items(text), lambda x: _scalar(element, x, _plain_number(element, x)))
    return _scalar(c, text, number)


def _plain_number(c: Field, text: Column) -> Column | None:
    if not c.is_number:
        return None
    parts = X.strip_number(text)
    return X.signed(X.normalise_number(parts["body"], c.scale), parts["negative"])


def _scalar(c: Field, text: Column, number: Column | None) -> Column:
    if c.labels:
        return X.to_enum(text, c.labels)
    if c.is_exact:
        return X.to_decimal(number, c.decimal_scale)
    if c.kind in INTEGERS:
        return X.to_integer(number, c.kind)
    if c.kind in FLOATS:
        return X.to_float(number, c.kind)
    if c.kind in JSONS:
        return X.to_json_container(text)
    simple = {
        "bool": X.to_boolean,
        "date": X.to_date_strict,
        "uuid": X.to_uuid,
        "time": X.to_time_strict,
        "timetz": X.to_time_strict,
    }
    if c.kind in simple:
        return simple[c.kind](text)
    if c.kind in ("timestamp", "timestamptz"):
        return X.to_timestamp_strict(text, c.kind == "timestamptz")
    if c.is_text:
        return text
    raise ValueError(f"column {c.name!r} has the unsupported type {c.kind!r}")


def _step(step: str):
    return lambda c: F.col(f"`{step}__{c.name}`")


_raw, _core, _text, _body, _plain, _value, _code, _point = map(
    _step, ("raw", "core", "text", "body", "plain", "value", "code", "point")
)


def _number(c: Field) -> Column:
    return X.signed(_plain(c), X.number_negative(_text(c)))


def _spelled(c: Field) -> Column:
    """A cell's value as text: an exact number as it was written."""
    return X.exact_spelling(_number(c)) if c.is_exact else _value(c).cast("string")


def _code_of(c: Field) -> Column:
    """0, or what is wrong with the cell."""
    absent = F.lit(0) if c.may_lack else F.lit(LACKING)
    code = F.when(_raw(c).isNull(), absent)
    if c.is_text and c.element is None:
        return code.otherwise(0)
    wrong = F.coalesce(
        F.exists(_value(c), lambda x: x.isNull()), F.lit(True)
    ) if c.element is not None else _value(c).isNull()
    if c.is_number:
        code = code.when(_plain(c).isNull(), UNCLEAR)
    return code.when(wrong, NO_LABEL if c.labels else WRONG_TYPE).otherwise(0)


def _cell_finding(c: Field) -> Column:
    said = F.when(
        _code(c) == LACKING,
        finding(c.name, "not_null", f"column {c.name!r} must have a value and the document gave none"),
    )
    unclear = f" could be grouped or decimal in {c.name!r}: neither a scale nor another value of the column settles it"
    said = said.when(
        _code(c) == UNCLEAR, finding(c.name, "ambiguous_number", F.concat(_raw(c), F.lit(unclear)), _raw(c))
    )
    said = said.when(
        _code(c) == NO_LABEL,
        finding(c.name, "enum", F.concat(_raw(c), F.lit(f" is not one of {', '.join(c.labels)}")), _raw(c)),
    )
    return said.when(
        _code(c) == WRONG_TYPE, finding(c.name, "type", F.concat(_raw(c), F.lit(f" is not a valid {c.kind}")), _raw(c))
    )


def _few(points: DataFrame) -> DataFrame:
    """Number conventions (doc_id, point__<column>) ready to be joined: worked out at once and, if not too many documents have any, sent to every
    task, so that rows are not moved to their documents, of which there may be few and large ones.
    """
    some = reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c in points.columns[1:]))
    known = written(points.where(some))
    return F.broadcast(known) if known.count() <= BROADCAST_DOCUMENTS else known


def _cells(
    staged: DataFrame, spec: TableSpec, conventions: DataFrame | None, infer: bool, keep: Mapping[str, Column]
) -> DataFrame:
    """doc_id, row_idx, keep and the steps of every extractable column: raw, text, plain, value, code."""
    columns = spec.extractable
    numbers = [c for c in columns if c.is_number]
    unsettled = [c for c in numbers if c.scale is None or c.scale >= 3]
    if conventions is None and infer and unsettled:
        conventions = number_conventions(staged, spec, unsettled)
    held = set(staged.columns)
    cell = lambda c: F.col(f"`{c.name}`").cast("string") if c.name in held else F.lit(None).cast("string")
    raws = X.apart({f"raw__{c.name}": X.null_words(cell(c), c.labels) for c in columns})
    raws = [c.alias(name) for name, c in raws.items()]
    cells = staged.select("doc_id", "row_idx", *(c.alias(name) for name, c in keep.items()), *raws)
    proven = [] if conventions is None else [c for c in unsettled if c.name in conventions.columns]
    if proven:
        points = conventions.select("doc_id", *(F.col(f"`{c.name}`").alias(f"point__{c.name}") for c in proven))
        cells = cells.join(_few(points), "doc_id", "left")
    if numbers:
        point = lambda c: _point(c) if c in proven else None
        cells = cells.withColumns(X.apart({f"core__{c.name}": X.number_core(_raw(c)) for c in numbers}))
        cells = cells.withColumns(X.apart({f"text__{c.name}": X.number_signed(_core(c)) for c in numbers}))
        cells = cells.withColumns({f"body__{c.name}": X.number_body(_text(c)) for c in numbers})
        cells = cells.withColumns(
            X.apart({f"plain__{c.name}": X.normalise_number(_body(c), c.scale, point(c)) for c in numbers})
        )
    number = lambda c: _number(c) if c.is_number else None
    cells = cells.withColumns(X.apart({f"value__{c.name}": _converted(c, _raw(c), number(c)) for c in columns}))
    return cells.withColumns(X.apart({f"code__{c.name}": _code_of(c) for c in columns}))


def _listed(cases: Sequence[tuple[Column, Column]]) -> Column:
    """The findings of the cases (condition, finding) that hold; a row without any skips all of their texts."""
    none = F.array().cast(f"array<{FINDING}>")
    if not cases:
        return none
    some = reduce(lambda a, b: a | b, (F.coalesce(hit, F.lit(False)) for hit, _ in cases))
    found = F.filter(F.array(*(F.when(hit, said) for hit, said in cases)), lambda f: f.isNotNull())
    return _held(F.when(some, found).otherwise(none))


def _outcome(
    cells: DataFrame, spec: TableSpec, kept: Sequence[str], cases: Sequence[tuple[Column, Column]], codes: bool
) -> DataFrame:
    columns = spec.extractable
    whole = lambda c: F.when(
        ~F.exists(_value(c), lambda x: x.isNull()), _value(c)
    ) if c.element is not None else _value(c)
    exact = [made.alias(name) for name, made in X.apart({c.name: _spelled(c) for c in columns if c.is_exact}).items()]
    return cells.select(
        "doc_id",
        "row_idx",
        *kept,
        *(whole(c).alias(c.name) for c in columns),
        *(_code(c) for c in columns if codes),
        F.struct(*(_raw(c).alias(c.name) for c in columns)).alias("raw"),
        *([F.struct(*exact).alias("spelled")] if exact else []),
        _listed([*((_code(c) > 0, _cell_finding(c)) for c in columns), *cases]).alias("findings"),
    )


def coerce(
    staged: DataFrame,
    spec: TableSpec,
    conventions: DataFrame | None = None,
    infer: bool = True,
    codes: bool = False,
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Typed columns, `raw` (staged texts, NULL words gone), `spelled` (exact numbers as written) and `findings`, at most one per cell.

    Separators are settled by the column's scale, then the document's own convention, else the cell is
    refused. infer=False takes no document-wide convention (streams of single rows). codes adds code__<column>
    per column: 0, or LACKING, UNCLEAR, WRONG_TYPE, NO_LABEL. keep carries further columns of the staged rows along.
    """
    keep = keep or {}
    return _outcome(_cells(staged, spec, conventions, infer, keep), spec, list(keep), [], codes)


def _sound(*columns: Field) -> Column:
    """Coercion let all of the cells through and they have values: fixed before the rules, so they do not silence each other."""
    return reduce(lambda a, b: a & b, ((_code(c) == 0) & _value(c).isNotNull() for c in columns))


def check_length(c: Field) -> tuple[Column, Column]:
    """E2."""
    size = F.char_length(_value(c))
    said = F.concat(size.cast("string"), F.lit(f" characters, but {c.name!r} is {c.kind}({c.size})"))
    return (size > c.size) & (_code(c) == 0), finding(c.name, "length", said, _value(c))


def check_sum(rule: Arithmetic, members: Sequence[Field], target: Field) -> tuple[Column, Column]:
    """(broken, what the members come to). Whole parts and fractions are added apart, so no sum of storable numbers overflows."""
    whole = lambda c: F.when(_value(c) < 0, F.ceil(_value(c))).otherwise(F.floor(_value(c)))
    part = lambda c: _value(c) % 1
    plus = lambda xs: reduce(lambda a, b: a + b, xs)
    wholes, parts = plus(map(whole, members)), plus(map(part, members))
    # the fractions differ by less than their number: where the whole parts lie 18 digits apart nothing can make up for it
    apart = (wholes - whole(target)).try_cast("decimal(18,0)")
    off = F.abs(apart + (parts - part(target)))
    shown = F.coalesce(F.try_add(wholes.try_cast("decimal(27,0)"), parts).cast("string"), wholes.cast("string"))
    return apart.isNull() | (off > F.lit(rule.tolerance)), shown


def check_product(rule: Arithmetic, members: Sequence[Field], target: Field) -> tuple[Column, Column]:
    """(broken, what the members come to). Up to 18 digits a number the product is exact; longer ones are multiplied at the width
    of a decimal and compared at six digits, and a product that no decimal holds cannot be the target.
    """
    times = lambda xs: reduce(F.try_multiply, xs)
    narrow = lambda c: _value(c).try_cast(f"decimal(18,{min(c.decimal_scale, 8)})")
    lossless = reduce(lambda a, b: a & b, (narrow(c) == _value(c) for c in (*members, target)))
    exact, wide = times(map(narrow, members)), times(map(_value, members))
    off = F.when(lossless, F.abs(exact - narrow(target))).otherwise(F.abs(F.try_subtract(wide, _value(target))))
    shown = F.coalesce(F.when(lossless, exact.cast("string")).otherwise(wide.cast("string")), F.lit("more than fits"))
    return off.isNull() | (off > F.lit(rule.tolerance)), shown


_OPERATIONS = {"sum": check_sum, "product": check_product}


def check_arithmetic(rule: Arithmetic, spec: TableSpec) -> tuple[Column, Column] | None:
    """A finding on the target; only exact numbers qualify, and rows that lack one of them are left alone."""
    members, target = [spec.column(n) for n in rule.members], spec.column(rule.target)
    if not all(c.is_exact for c in (*members, target)):
        return None
    broken, shown = _OPERATIONS[rule.operation](rule, members, target)
    said = F.concat(
        F.lit(f"{', '.join(rule.members)} come to "), X.trimmed(shown), F.lit(", the document says "), _spelled(target)
    )
    return _sound(*members, target) & broken, finding(target.name, "arithmetic", said, _spelled(target))


def check_reject(rule: ValueRule, c: Field) -> tuple[Column, Column]:
    """E5."""
    bad = sorted({"".join(v.split()).lower() for v in rule.values})
    return X.folded(_spelled(c)).isin(*bad) & _sound(c), _rejected(c)


def _rejected(c: Field) -> Column:
    return finding(
        c.name, "rejected_value", F.concat(_spelled(c), F.lit(f" can never be right for {c.name!r}")), _spelled(c)
    )


def check_pattern(rule: ValueRule, c: Field) -> tuple[Column, Column]:
    """E6."""
    said = F.concat(_spelled(c), F.lit(f" does not have the shape {rule.pattern}"))
    return ~_spelled(c).rlike(rf"\A(?:{rule.pattern})\z") & _sound(c), finding(c.name, "pattern", said, _spelled(c))


def check_require(rule: ValueRule, c: Field) -> tuple[Column, Column]:
    """E7."""
    return _value(c).isNull() & (_code(c) == 0), finding(
        c.name, "required", f"column {c.name!r} is expected and the document gave no value"
    )


def check_range(rule: ValueRule, c: Field) -> tuple[Column, Column] | None:
    """E8."""
    if not c.is_number:
        return None
    outside = [_value(c) < F.lit(rule.low)] if rule.low is not None else []
    outside += [_value(c) > F.lit(rule.high)] if rule.high is not None else []
    said = F.concat(_spelled(c), F.lit(f" is outside {rule.low} to {rule.high}"))
    return reduce(lambda a, b: a | b, outside) & _sound(c), finding(c.name, "range", said, _spelled(c))


_TESTS = {"reject": check_reject, "pattern": check_pattern, "require": check_require, "range": check_range}


def _rule_cases(
    cells: DataFrame, spec: TableSpec, rules: Sequence[Rule]
) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """(cells with what long lists match, cases): length, then arithmetic, then value rules, on cells that coercion let through."""
    columns = {c.name: c for c in spec.extractable}
    used = [r for r in rules if columns.keys() >= set(r.columns)]
    cases = [check_length(c) for c in columns.values() if c.size is not None and c.is_text and c.element is None]
    cases += [check_arithmetic(r, spec) for r in used if isinstance(r, Arithmetic)]
    for k, rule in enumerate(r for r in used if isinstance(r, ValueRule)):
        c = columns[rule.column]
        if rule.test == "reject" and len(rule.values) > LONGEST_LIST:
            bad = sorted({"".join(v.split()).lower() for v in rule.values})
            listed = cells.sparkSession.createDataFrame([(v,) for v in bad], f"bad{k}__ string")
            listed = F.broadcast(listed) if sum(map(len, bad)) <= BROADCAST_BYTES else listed
            cells = cells.withColumn(f"key{k}__", X.folded(_spelled(c))).join(
                listed, F.col(f"key{k}__") == F.col(f"bad{k}__"), "left"
            )
            cases.append((F.col(f"bad{k}__").isNotNull() & _sound(c), _rejected(c)))
        else:
            cases.append(_TESTS[rule.test](rule, c))
    return cells, [case for case in cases if case is not None]


def gate(
    staged: DataFrame,
    spec: TableSpec,
    rules: Sequence[Rule] = (),
    conventions: DataFrame | None = None,
    infer: bool = True,
) -> DataFrame:
    """Every staged row, typed, with all its findings."""
    cells, cases = _rule_cases(_cells(staged, spec, conventions, infer, {}), spec, rules)
    hits = {f"hit{k}__": hit for k, (hit, _) in enumerate(cases)}
    cells = cells.withColumns(X.apart(hits)) if hits else cells
    return _outcome(cells, spec, [], [(F.col(f"hit{k}__"), said) for k, (_, said) in enumerate(cases)], False)


def findings(gated: DataFrame) -> DataFrame:
    """One row per finding; sort by (doc_id, row_idx, column, position) to show them."""
    found = gated.where(F.size("findings") > 0).select(
        "doc_id", "row_idx", F.posexplode("findings").alias("position", "f")
    )
    return found.select("doc_id", "row_idx", "position", "f.*")


def ordered_findings(gated: DataFrame) -> DataFrame:
    return findings(gated).orderBy("doc_id", "row_idx", F.coalesce("column", F.lit("")), "position")


def document_status(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, status: flagged if it has a finding."""
    counts = found.groupBy("doc_id").agg(F.count("*").alias("failures"))
    flagged = F.when(F.col("failures") > 0, "flagged").otherwise("ok")
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", flagged.alias("status"))


def check_summary(gated: DataFrame) -> DataFrame:
    """Per document rows, failures and the sorted distinct rule names, in one aggregate."""
    names = F.array_distinct(F.transform("findings", lambda f: f["rule"]))
    rules = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("findings") > 0, names)))))
    return gated.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.sum(F.size("findings")).alias("failures"), rules.alias("rules")
    )


def flagged_cells(found: DataFrame) -> DataFrame:
    """E13."""
    return found.where("column is not null").select("doc_id", "row_idx", "column").distinct()


def clean_rows(gated: DataFrame) -> DataFrame:
    """Rows without a finding; the findings lie on the row, so no join is needed."""
    return gated.where(F.size("findings") == 0)


def flagged_rows(gated: DataFrame) -> DataFrame:
    return gated.where(F.size("findings") > 0)
