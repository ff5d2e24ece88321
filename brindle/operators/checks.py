"""Row checks with readable diagnostics.

A rule names a column (nested paths too) and either one or two comparisons or any predicate.
Null and NaN values fail every comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class InvalidParameter(ValueError):
    """A driver-side value that breaks a rule."""

    def __init__(self, name: str, value, expected: str):
        super().__init__(f"invalid parameter `{name}`: expected {expected}, got {value}")
        self.name, self.value, self.expected = name, value, expected


@dataclass(frozen=True)
class Rule:
    """``bounds`` such as (">= ", 0.0), or ``predicate`` with the text of what is ``expected``."""

    column: str
    bounds: tuple[tuple[str, float], ...] = ()
    predicate: Column | None = None
    expected: str | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.column

    @property
    def expects(self) -> str:
        if self.expected:
            return self.expected
        if len(self.bounds) == 1:
            op, b = self.bounds[0]
            return f"{op} {b}"
        low = next((x for x in self.bounds if x[0][0] == ">"), None)
        high = next((x for x in self.bounds if x[0][0] == "<"), None)
        if len(self.bounds) != 2 or not low or not high:
            raise ValueError("a range has one lower and one upper bound")
        return f"in {'[' if low[0] == '>=' else '('}{low[1]}, {high[1]}{']' if high[0] == '<=' else ')'}"

    def holds(self, kind: T.DataType | None = None) -> Column:
        if self.predicate is not None:
            return F.coalesce(self.predicate, F.lit(False))
        c = F.col(self.column)
        ok = F.lit(True)
        for op, b in self.bounds:
            ok = ok & _OPS[op](c, F.lit(b))
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            ok = ok & ~F.isnan(c)
        return F.coalesce(ok, F.lit(False))

    def check(self, value) -> None:
        """The same rule on one driver-side value."""
        ok = all({">": value > b, ">=": value >= b, "<": value < b, "<=": value <= b}[op] for op, b in self.bounds)
        if not ok:
            raise InvalidParameter(self.label, value, self.expects)


def _kind(df: DataFrame, rule: Rule) -> T.DataType | None:
    return None if rule.predicate is not None else df.select(F.col(rule.column)).schema[0].dataType


def passing(df: DataFrame, *rules: Rule) -> DataFrame:
    """The rows that meet all rules."""
    for r in rules:
        df = df.where(r.holds(_kind(df, r)))
    return df


def violations(df: DataFrame, *rules: Rule) -> DataFrame:
    """The rows that break a rule, once for each rule broken, with a ``violation`` text."""
    broken = [
        F.when(~r.holds(_kind(df, r)), F.concat(F.lit(f"invalid parameter `{r.label}`: expected {r.expects}, got "), F.coalesce(F.col(r.column).cast("string"), F.lit("null"))))
        for r in rules
    ]
    return df.withColumn("violation", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())))


def enforce(df: DataFrame, *rules: Rule) -> DataFrame:
    """``df``, failing the job at the first row that breaks a rule."""
    for r in rules:
        text = F.concat(F.lit(f"invalid parameter `{r.label}`: expected {r.expects}, got "), F.coalesce(F.col(r.column).cast("string"), F.lit("null")))
        df = df.where(F.when(r.holds(_kind(df, r)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    return df
