"""Shared intermediate tables of one study, each settled at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid import schema
from tapegrid.config import Study
from tapegrid.functions.columns import between
from tapegrid.operators import features as feat
from tapegrid.operators import grid as gridding
from tapegrid.operators import positions, returns, walkforward
from tapegrid.operators.scoring import daily_ic
from tapegrid.operators.trees import TreeSettings, trees_out_of_sample
from tapegrid.session import settle

FRAME_KEYS = ("coin", "horizon", "family", "inputs", "policy", "period")


class Lab:
    """Raw bars and settlements of a study, and the tables derived from them."""

    def __init__(
        self,
        spark: SparkSession,
        study: Study,
        raw: DataFrame,
        funding: DataFrame,
        tree_settings: TreeSettings = TreeSettings(),
    ):
        self.spark, self.study = spark, study
        self._raw, self._funding = raw, funding
        self.tree_settings = tree_settings
        self._held: dict[tuple, DataFrame] = {}

    def _once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._held:
            self._held[key] = settle(build())
        return self._held[key]

    @property
    def raw(self) -> DataFrame:
        return self._once(("raw",), lambda: self._raw)

    @property
    def funding(self) -> DataFrame:
        return self._once(("funding",), lambda: self._funding)

    @property
    def grid(self) -> DataFrame:
        return self._once(("grid",), lambda: gridding.align_on_grid(self.raw, self.study))

    @property
    def returns(self) -> DataFrame:
        return self._once(("returns",), lambda: gridding.log_returns(self.grid, self.study))

    @property
    def research_returns(self) -> DataFrame:
        s = self.study
        return self.returns.where(between("open_time", s.grid_start, s.research_end))

    @property
    def features(self) -> DataFrame:
        return self._once(("features",), lambda: feat.build_features(self.grid, self.study))

    @property
    def volatility_frame(self) -> DataFrame:
        return self._once(
            ("volatility",),
            lambda: feat.volatility_frame(self.features, self.study, self.study.horizons),
        )

    @property
    def sigma(self) -> DataFrame:
        return self._once(("sigma",), lambda: returns.realised_sigma(self.grid, self.study))

    def period_bars(self, period: str) -> DataFrame:
        return self._once(
            ("bars", period),
            lambda: positions.period_bars(self.grid, self.funding, self.study, period),
        )

    def hold(self, period: str) -> DataFrame:
        return self._once(
            ("hold", period), lambda: positions.buy_and_hold(self.period_bars(period))
        )

    def predictions(
        self,
        family: str,
        inputs: str = "all",
        policy: str = "expanding",
        period: str = "research",
        horizons: tuple[int, ...] | None = None,
    ) -> DataFrame:
        """Out-of-sample predictions of every coin and horizon with their configuration keys."""
        s = self.study
        horizons = tuple(horizons or s.horizons)
        months, end = s.periods[period]
        columns = schema.input_set(s, inputs)

        def build() -> DataFrame:
            if family == "trees":
                frame = trees_out_of_sample(
                    self.features, s, columns, policy, months, end, horizons,
                    settings=self.tree_settings,
                )
            else:
                frame = walkforward.out_of_sample(
                    self.features, s, family, columns, policy, months, end, horizons
                )
            return frame.withColumns(
                {
                    "family": F.lit(family),
                    "inputs": F.lit(inputs),
                    "policy": F.lit(policy),
                    "period": F.lit(period),
                }
            )

        return self._once(("pred", family, inputs, policy, period, horizons), build)

    def pooled_predictions(
        self, inputs: str = "all", period: str = "research", horizons: tuple[int, ...] | None = None
    ) -> DataFrame:
        s = self.study
        horizons = tuple(horizons or s.horizons)
        months, end = s.periods[period]

        def build() -> DataFrame:
            frame = walkforward.pooled_out_of_sample(
                self.features, s, schema.input_set(s, inputs), months, end, horizons
            )
            return frame.withColumns(
                {"family": F.lit("ridge"), "inputs": F.lit(inputs), "period": F.lit(period)}
            )

        return self._once(("pooled", inputs, period, horizons), build)

    def volatility_predictions(
        self, model: str = "har", period: str = "research", horizons: tuple[int, ...] | None = None
    ) -> DataFrame:
        s = self.study
        horizons = tuple(horizons or s.horizons)
        months, end = s.periods[period]
        har = schema.har_inputs(s)

        def build() -> DataFrame:
            if model == "trees":
                frame = trees_out_of_sample(
                    self.volatility_frame, s, schema.volatility_inputs(s), "expanding", months,
                    end, horizons, settings=self.tree_settings,
                ).join(
                    walkforward.month_means(self.volatility_frame, s, har, months, horizons),
                    ["coin", "horizon", "test_month"],
                    "left",
                )
            else:
                columns = har if model == "har" else schema.volatility_inputs(s)
                frame = walkforward.volatility_out_of_sample(
                    self.volatility_frame, s, model, columns, har, months, end, horizons
                )
            return frame.withColumns({"model": F.lit(model), "period": F.lit(period)})

        return self._once(("vol", model, period, horizons), build)

    def daily_ic(self, name: tuple, frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return self._once(("ic", *name), lambda: daily_ic(frame, keys))
