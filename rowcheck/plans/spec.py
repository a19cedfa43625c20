"""What a target table looks like, and the rules declared for it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import types as T

# Names of the catalog's types.
INTEGERS = {"int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType()}
FLOATS = {"float4": T.FloatType(), "float8": T.DoubleType()}
EXACT = ("numeric", "decimal")
TEXTS = ("text", "varchar", "bpchar", "char", "name")
JSONS = ("json", "jsonb")
OTHERS = {
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "time": T.StringType(),
    "timetz": T.StringType(),
    "uuid": T.StringType(),
}
DEFAULT_TOLERANCE = Decimal("0.01")


@dataclass(frozen=True)
class Field:
    """A column: what it is called and where it stands, which cells it takes, and who else than a document fills it."""

    name: str
    kind: str
    at: int = 0
    required: bool = False
    #: limits of a cell: labels of an enum, characters, digits behind the point
    labels: tuple[str, ...] = ()
    size: int | None = None
    scale: int | None = None
    #: text of the default, or `identity` / `generated` where the database makes the value
    default: str | None = None
    made: str | None = None
    note: str | None = None

    @property
    def extractable(self) -> bool:
        """Whether a document may supply the column: the database does not compute it."""
        return self.made is None and (self.default is None or not computed_default(self.default))

    @property
    def may_lack(self) -> bool:
        """Whether a row without the cell can be stored."""
        return self.default is not None or not self.required

    @property
    def element(self) -> Field | None:
        """The element of an array column."""
        if not self.kind.startswith("_"):
            return None
        return replace(self, kind=self.kind[1:], required=False, default=None, made=None)

    @property
    def decimal_scale(self) -> int:
        """Digits kept behind the point: more than declared, as the gate does not round."""
        return 10 if self.scale is None else max(self.scale, 6)

    @property
    def is_number(self) -> bool:
        return not self.labels and (self.kind in INTEGERS or self.kind in FLOATS or self.is_exact)

    @property
    def is_exact(self) -> bool:
        return not self.labels and self.kind in EXACT

    @property
    def is_text(self) -> bool:
        """Whether any text will do."""
        return not self.labels and self.kind in TEXTS

    def spark_type(self) -> T.DataType:
        if self.element is not None:
            return T.ArrayType(self.element.spark_type())
        if self.labels or self.kind in TEXTS or self.kind in JSONS:
            return T.StringType()
        if self.kind in EXACT:
            return T.DecimalType(38, self.decimal_scale)
        for known in (INTEGERS, FLOATS, OTHERS):
            if self.kind in known:
                return known[self.kind]
        raise ValueError(f"column {self.name!r} has the unsupported type {self.kind!r}")


def computed_default(text: str | None) -> bool:
    """A default that starts like a literal is one; anything else, or an unknown text, is computed."""
    if text is None:
        return True
    return re.match(r"""(?i)\s*(['"0-9+.-]|(true|false|null)\s*(::|$))""", text) is None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Field, ...]
    schema: str = "public"

    @property
    def extractable(self) -> list[Field]:
        return sorted((c for c in self.columns if c.extractable), key=lambda c: c.at)

    def column(self, name: str) -> Field:
        return next(c for c in self.columns if c.name == name)

    def struct_type(self) -> T.StructType:
        wanted = self.extractable
        if not wanted:
            raise ValueError(f"table {self.name!r} has no column that a document can supply")
        return T.StructType(
            [T.StructField(c.name, c.spark_type(), True, {"ordinal": c.at, "data_type": c.kind}) for c in wanted]
        )


@dataclass(frozen=True)
class Arithmetic:
    """The members of a row, added or multiplied, give the target within the tolerance."""

    operation: str
    members: tuple[str, ...]
    target: str
    tolerance: Decimal = DEFAULT_TOLERANCE

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.members, self.target)


@dataclass(frozen=True)
class ValueRule:
    """What is known of one column's values: `reject` (values that cannot be), `pattern`, `require` or `range`."""

    column: str
    test: str
    values: tuple[str, ...] = ()
    pattern: str = ""
    low: Decimal | None = None
    high: Decimal | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)


Rule = Arithmetic | ValueRule


def sums_to(members: Sequence[str], target: str, tolerance: Decimal = DEFAULT_TOLERANCE) -> Arithmetic:
    return Arithmetic("sum", tuple(members), target, tolerance)


def multiplies_to(members: Sequence[str], target: str, tolerance: Decimal = DEFAULT_TOLERANCE) -> Arithmetic:
    return Arithmetic("product", tuple(members), target, tolerance)


def rejects(column: str, values: Sequence[str]) -> ValueRule:
    return ValueRule(column, "reject", values=tuple(map(str, values)))


def shaped(column: str, pattern: str) -> ValueRule:
    re.compile(pattern)
    return ValueRule(column, "pattern", pattern=pattern)


def requires(column: str) -> ValueRule:
    return ValueRule(column, "require")


def within(column: str, low: Decimal | None = None, high: Decimal | None = None) -> ValueRule:
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    return ValueRule(column, "range", low=low, high=high)


def _number(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


# The keys of rules in their JSON form, the needed ones and those that may be added.
_SHAPES = {
    ("terms", "equals"): (("tolerance",), sums_to),
    ("factors", "equals"): (("tolerance",), multiplies_to),
    ("column", "reject"): ((), rejects),
    ("column", "pattern"): ((), shaped),
    ("column", "require"): (
        (), lambda column, asked: requires(column) if asked is True else _refuse("require must be true")
    ),
    ("column",): (("min", "max"), lambda column, low=None, high=None: within(column, _number(low), _number(high))),
}


def _refuse(why: str):
    raise ValueError(why)


def parse_rules(items: Sequence[Mapping]) -> list[Rule]:
    """Rules from JSON objects; the keys say which kind each is. Anything unclear is an error."""
    return [_parse_rule(item) for item in items]


def _parse_rule(item: Mapping) -> Rule:
    for needed, (more, make) in _SHAPES.items():
        if set(needed) <= set(item) <= {*needed, *more}:
            given = [item[k] for k in needed]
            if more == ("tolerance",):
                return make(*given, _number(item.get("tolerance", DEFAULT_TOLERANCE)))
            return make(*given, *(item.get(k) for k in more))
    raise ValueError(f"not a rule: {sorted(item)}")
