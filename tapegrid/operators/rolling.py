"""Trailing moments from running sums.

Spark re-aggregates a sliding frame for every row, so a 576-bar frame costs 576 updates a row.
Inside a block of bounded length the same moments come from differences of running sums, whatever
the window. Values are centred on the block's first known value before squaring (never on a later
one), and a window whose values never change has exactly zero spread. A window counts only if every
bar in it is known, unless ``least`` lowers that bar.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrid.config import EPS


def _from_start(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(W.unboundedPreceding, 0)


def add_running_sums(df: DataFrame, window: WindowSpec, series: Mapping[str, Column]) -> DataFrame:
    """Running count, sum, sum of squares and number of changes of each series."""
    start = _from_start(window)
    df = df.withColumns({f"_v_{k}": v for k, v in series.items()})
    anchors = {}
    for k in series:
        value = F.col(f"_v_{k}")
        anchors[f"_c_{k}"] = F.first(value, ignorenulls=True).over(start)
        anchors[f"_p_{k}"] = F.lag(value).over(window)
    df = df.withColumns(anchors)
    sums = {}
    for k in series:
        value = F.col(f"_v_{k}")
        moved = value - F.col(f"_c_{k}")
        changed = F.when(value != F.col(f"_p_{k}"), 1).otherwise(0)
        sums[f"_n_{k}"] = F.count(value).over(start)
        sums[f"_s_{k}"] = F.coalesce(F.sum(moved).over(start), F.lit(0.0))
        sums[f"_q_{k}"] = F.coalesce(F.sum(moved * moved).over(start), F.lit(0.0))
        sums[f"_d_{k}"] = F.sum(changed).over(start)
    return df.withColumns(sums).drop(*[f"_p_{k}" for k in series])


@dataclass(frozen=True)
class Trailing:
    """Moments of the ``size`` bars that end ``shift`` bars before the current one."""

    name: str
    size: int
    window: WindowSpec
    shift: int = 0

    def _difference(self, kind: str, size: int | None = None) -> Column:
        column = F.col(f"_{kind}_{self.name}")
        end = F.lag(column, self.shift, 0).over(self.window) if self.shift else column
        return end - F.lag(column, self.shift + (size or self.size), 0).over(self.window)

    @property
    def complete(self) -> Column:
        return self._difference("n") == self.size

    @property
    def total(self) -> Column:
        """Sum of the values."""
        return F.when(self.complete, self._difference("s") + self.size * F.col(f"_c_{self.name}"))

    @property
    def mean(self) -> Column:
        return F.when(self.complete, F.col(f"_c_{self.name}") + self._difference("s") / self.size)

    @property
    def variance(self) -> Column:
        centre = self._difference("s") / self.size
        spread = F.greatest(self._difference("q") / self.size - centre * centre, F.lit(0.0))
        constant = self._difference("d", self.size - 1) == 0
        return F.when(self.complete, F.when(constant, F.lit(0.0)).otherwise(spread))

    @property
    def std(self) -> Column:
        """Population standard deviation."""
        return F.sqrt(self.variance)

    @property
    def sample_std(self) -> Column:
        return F.sqrt(self.variance * (self.size / (self.size - 1)))

    def zscore(self, value: Column) -> Column:
        return (value - self.mean) / (self.std + EPS)


def add_pair_sums(
    df: DataFrame, window: WindowSpec, pairs: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """Running sums over the rows where both sides of a pair are known."""
    start = _from_start(window)
    values, anchors, sums = {}, {}, {}
    for k, (a, b) in pairs.items():
        known = a.isNotNull() & b.isNotNull()
        values[f"_a_{k}"] = F.when(known, a)
        values[f"_b_{k}"] = F.when(known, b)
    df = df.withColumns(values)
    for k in pairs:
        for side in ("a", "b"):
            value = F.col(f"_{side}_{k}")
            anchors[f"_c{side}_{k}"] = value - F.first(value, ignorenulls=True).over(start)
    df = df.withColumns(anchors)
    zero = F.lit(0.0)
    for k in pairs:
        a, b = F.col(f"_ca_{k}"), F.col(f"_cb_{k}")
        sums[f"_n_{k}"] = F.count(a).over(start)
        for name, value in {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}.items():
            sums[f"_s{name}_{k}"] = F.coalesce(F.sum(value).over(start), zero)
    return df.withColumns(sums).drop(*values, *anchors)


@dataclass(frozen=True)
class PairTrailing:
    """Population moments of a pair over the last ``size`` rows."""

    name: str
    size: int
    window: WindowSpec
    least: int | None = None

    def _difference(self, kind: str) -> Column:
        column = F.col(f"_{kind}_{self.name}")
        return column - F.lag(column, self.size, 0).over(self.window)

    @property
    def count(self) -> Column:
        return self._difference("n")

    def _moment(self, a: str, b: str) -> Column:
        n = self.count.cast("double")
        product = self._difference(f"s{a}{b}") / n
        return product - (self._difference(f"s{a}") / n) * (self._difference(f"s{b}") / n)

    def _guard(self, value: Column) -> Column:
        return F.when(self.count >= (self.least or self.size), value)

    @property
    def cov(self) -> Column:
        return self._guard(self._moment("a", "b"))

    @property
    def var_a(self) -> Column:
        return self._guard(F.greatest(self._moment("a", "a"), F.lit(0.0)))

    @property
    def var_b(self) -> Column:
        return self._guard(F.greatest(self._moment("b", "b"), F.lit(0.0)))

    @property
    def corr(self) -> Column:
        """Correlation with the small constant in the denominator that the features use."""
        return self.cov / (F.sqrt(self.var_a) * F.sqrt(self.var_b) + EPS)

    @property
    def pearson(self) -> Column:
        return F.try_divide(self.cov, F.sqrt(self.var_a * self.var_b))

    @property
    def beta(self) -> Column:
        """Slope of the first side on the second."""
        return self.cov / (self.var_b + EPS)
