"""Metadata filters: nine predicates with two-valued logic.

A comparison with a missing key is false, so its negation is true. Whole and floating numbers compare as doubles; text
and booleans only ever equal their own kind and have no order; NaN equals and precedes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfig
from ..types import Scalar

_ORDERS = {"gt": lambda d: d > 0, "gte": lambda d: d >= 0, "lt": lambda d: d < 0, "lte": lambda d: d <= 0}


@dataclass(frozen=True)
class Filter:
    """op with its key and values, or its parts. Build with the functions below or from JSON with ``parse``."""

    op: str
    key: str = ""
    values: tuple[Scalar, ...] = ()
    parts: tuple[Filter, ...] = ()

    def matches(self, meta: Mapping[str, Scalar]) -> bool:
        """On plain metadata, in Python."""
        if self.op == "and":
            return all(p.matches(meta) for p in self.parts)
        if self.op == "or":
            return any(p.matches(meta) for p in self.parts)
        if self.op == "not":
            return not self.parts[0].matches(meta)
        if self.key not in meta:
            return False
        own = meta[self.key]
        if self.op in ("eq", "in"):
            return any(_equal(own, v) for v in self.values)
        (v,) = self.values
        return _number(own) and _number(v) and _ORDERS[self.op](float(own) - float(v))

    def compile(self, source: Source) -> Column:
        """As a column that is never null."""
        return self._compile(source, exact=True)

    def where(self, source: Source) -> Column:
        """As a condition for ``where``: null may stand for false outside negations, so that scans can use it."""
        return self._compile(source, exact=False)

    def _compile(self, source: Source, exact: bool) -> Column:
        if self.op == "and":
            return reduce(lambda a, b: a & b, [p._compile(source, exact) for p in self.parts], F.lit(True)) if self.parts else F.lit(True)
        if self.op == "or":
            return reduce(lambda a, b: a | b, [p._compile(source, exact) for p in self.parts]) if self.parts else F.lit(False)
        if self.op == "not":
            return ~self.parts[0]._compile(source, exact=True)
        if self.op in ("eq", "in"):
            tests = source.equals(self.key, self.values)
        else:
            tests = source.ordered(self.key, self.op, self.values[0])
        if tests is None:
            return F.lit(False)
        return F.coalesce(tests, F.lit(False)) if exact else tests


def _number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _equal(a: Scalar, b: Scalar) -> bool:
    if _number(a) and _number(b):
        return float(a) == float(b)
    return type(a) is type(b) and a == b


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


class Source:
    """Where the values of a key are: ``kinds(key)`` gives a number, text and boolean column, any of which may be None."""

    def kinds(self, key: str) -> tuple[Column | None, Column | None, Column | None]:
        raise NotImplementedError

    def whole(self, key: str) -> Column | None:
        """A plain column of whole numbers, where the key is one: scans can be pruned by comparing it as it is."""
        return None

    def equals(self, key: str, values: tuple[Scalar, ...]) -> Column | None:
        number, text, flag = self.kinds(key)
        tests = []
        numbers = [v for v in values if _number(v) and not math.isnan(float(v))]
        if number is not None and numbers:
            whole = self.whole(key)
            if whole is not None and all(float(v).is_integer() and abs(v) < 1 << 53 for v in numbers):
                tests.append(whole.isin([int(v) for v in numbers]))
            else:
                tests.append(number.isin([float(v) for v in numbers]))
        texts = [v for v in values if isinstance(v, str)]
        if text is not None and texts:
            tests.append(text.isin(texts))
        flags = [v for v in values if isinstance(v, bool)]
        if flag is not None and flags:
            tests.append(flag.isin(flags))
        if not tests:
            return None
        # one kind of a tagged value is set and the others are null; any of several tests may hold
        return tests[0] if len(tests) == 1 else reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    def ordered(self, key: str, op: str, value: Scalar) -> Column | None:
        number, _, _ = self.kinds(key)
        if number is None or not _number(value) or math.isnan(float(value)):
            return None
        whole = self.whole(key)
        if whole is not None and float(value).is_integer() and abs(value) < 1 << 53:
            return _compare(op, whole, F.lit(int(value)))
        v = F.lit(float(value))
        # the difference decides, so infinity has no order against itself
        test = _compare(op, number, v) if math.isfinite(float(value)) else ~F.isnan(number - v) & _compare(op, number - v, F.lit(0.0))
        return ~F.isnan(number) & test


class MapSource(Source):
    """A map column of tagged values."""

    def __init__(self, column: str = "meta"):
        self.column = column

    def kinds(self, key: str):
        v = F.try_element_at(F.col(self.column), F.lit(key))
        return F.coalesce(v["f"], v["i"].cast("double")), v["s"], v["b"]


class ColumnSource(Source):
    """Plain columns, null for a missing key. names maps keys to columns where they differ."""

    def __init__(self, df: DataFrame, names: Mapping[str, str] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.names = dict(names or {})

    def kinds(self, key: str):
        name = self.names.get(key, key)
        t = self.types.get(name)
        if isinstance(t, T.NumericType):
            return F.col(name).cast("double"), None, None
        if isinstance(t, T.StringType):
            return None, F.col(name), None
        if isinstance(t, T.BooleanType):
            return None, None, F.col(name)
        return None, None, None

    def whole(self, key: str) -> Column | None:
        name = self.names.get(key, key)
        return F.col(name) if isinstance(self.types.get(name), T.IntegralType) else None


def eq(key: str, value: Scalar) -> Filter:
    return Filter("eq", key, (_scalar(value),))


def is_in(key: str, values: list[Scalar]) -> Filter:
    return Filter("in", key, tuple(map(_scalar, values)))


def gt(key: str, value: Scalar) -> Filter:
    return Filter("gt", key, (_scalar(value),))


def gte(key: str, value: Scalar) -> Filter:
    return Filter("gte", key, (_scalar(value),))


def lt(key: str, value: Scalar) -> Filter:
    return Filter("lt", key, (_scalar(value),))


def lte(key: str, value: Scalar) -> Filter:
    return Filter("lte", key, (_scalar(value),))


def all_of(*parts: Filter) -> Filter:
    return Filter("and", parts=parts)


def any_of(*parts: Filter) -> Filter:
    return Filter("or", parts=parts)


def negate(part: Filter) -> Filter:
    return Filter("not", parts=(part,))


def _scalar(v: Any) -> Scalar:
    if not isinstance(v, str | int | float | bool):
        raise InvalidConfig("filters compare with text, numbers and booleans")
    return v


def parse(data: Any) -> Filter:
    """A filter from its JSON form: an object with one operator, such as {"eq": ["lang", "ja"]} or {"and": [...]}."""
    if not isinstance(data, Mapping) or len(data) != 1:
        raise InvalidConfig("a filter is an object with one operator")
    ((op, arg),) = data.items()
    if op in ("and", "or"):
        if not isinstance(arg, list):
            raise InvalidConfig(f"{op} takes a list of filters")
        return Filter(op, parts=tuple(map(parse, arg)))
    if op == "not":
        return negate(parse(arg))
    if op not in ("eq", "in", *_ORDERS):
        raise InvalidConfig(f"unknown filter operator: {op}")
    if not isinstance(arg, list) or len(arg) != 2 or not isinstance(arg[0], str):
        raise InvalidConfig(f"{op} takes a key and a value")
    if op == "in":
        if not isinstance(arg[1], list):
            raise InvalidConfig("in takes a list of values")
        return is_in(arg[0], arg[1])
    return Filter(op, arg[0], (_scalar(arg[1]),))
