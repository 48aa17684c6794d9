"""Column lists and schemas, generated from a study's parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tapegrid.config import Study

# fixed values: the kline file layout
KLINE_COLUMNS = (
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "count",
    "taker_buy_volume",
    "taker_buy_quote_volume",
    "ignore",
)
FUNDING_COLUMNS = ("calc_time", "funding_interval_hours", "last_funding_rate")
BAR_FIELDS = (
    "open",
    "high",
    "low",
    "close",
    "volume",
    "quote_volume",
    "count",
    "taker_buy_volume",
    "taker_buy_quote_volume",
)

# Files are read as text, because a header line may or may not be there.
KLINE_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in KLINE_COLUMNS])
FUNDING_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in FUNDING_COLUMNS])

ACTIVITY_FIELDS = ("volume", "quote_volume", "count")
FLOW_KINDS = {"vol": ("taker_buy_volume", "volume"), "qv": ("taker_buy_quote_volume", "quote_volume")}


@dataclass(frozen=True)
class FeatureColumn:
    """One feature: whose it is, its name, and whether models take it.

    ``of`` is the role of the asset it describes, ``x`` being the target; cross features describe
    the target and ``against`` a context.
    """

    of: str
    kind: str
    name: str
    is_input: bool
    against: str | None = None


@dataclass(frozen=True)
class _Formula:
    name: str
    kind: str
    is_input: bool = True


def _formulas(s: Study) -> list[_Formula]:
    """What is computed for every asset. Levels drift, and means of returns or of the quote flow
    repeat what other columns say: those are kept for reading, not for fitting."""
    wicks = ("candle_range_pct", "candle_body_pct", "upper_wick_pct", "lower_wick_pct")
    return [
        _Formula("logret_1", "price"),
        *[_Formula(f"trail_ret_{n}", "price") for n in s.lags],
        *[_Formula(f"roll_mean_logret_{n}", "price", False) for n in s.mean_windows],
        _Formula(f"roll_vol_logret_{s.long_window}", "price"),
        *[_Formula(name, "price") for name in wicks],
        *[_Formula(f"{f}_log", "activity", False) for f in ACTIVITY_FIELDS],
        *[_Formula(f"{f}_z_{s.long_window}", "activity") for f in ACTIVITY_FIELDS],
        *[_Formula(f"taker_buy_ratio_{k}", "flow", k != "qv") for k in FLOW_KINDS],
        *[
            _Formula(f"taker_buy_ratio_{k}_ma{n}", "flow", k != "qv")
            for n in s.flow_windows
            for k in FLOW_KINDS
        ],
    ]


def excess_pairs(s: Study) -> list[tuple[str, int]]:
    """The benchmark is compared at every excess lag, the other contexts at the first one."""
    lags = {c: s.excess_lags if c == s.benchmark else s.excess_lags[:1] for c in s.contexts}
    return [(c, n) for c, own in lags.items() for n in own]


def feature_table(s: Study) -> list[FeatureColumn]:
    """Every feature column, in the order of the feature frame."""
    order = {"price": 0, "activity": 1, "flow": 2}
    own = [
        FeatureColumn(role, f.kind, f"{role}_{f.name}", f.is_input)
        for role in (*s.contexts, "x")
        for f in _formulas(s)
    ]
    cross = [
        *[(c, f"x_minus_{c}_trail_ret_{n}") for c, n in excess_pairs(s)],
        *[(c, f"corr_x_{c}_logret_{s.corr_window}") for c in s.contexts],
        *[(c, f"beta_x_{c}_{s.beta_window}") for c in s.contexts],
    ]
    return sorted(own, key=lambda f: order[f.kind]) + [
        FeatureColumn("x", "cross", name, True, against) for against, name in cross
    ]


def formula_names(s: Study, kind: str) -> list[str]:
    return [f.name for f in _formulas(s) if f.kind == kind]


def asset_feature_names(s: Study) -> list[str]:
    return [f.name for f in _formulas(s)]


def cross_features(s: Study) -> list[str]:
    return [f.name for f in feature_table(s) if f.kind == "cross"]


def feature_names(s: Study) -> list[str]:
    return [f.name for f in feature_table(s)]


def _inputs(s: Study) -> list[FeatureColumn]:
    """Columns models take, the asset's own before the contexts', cross features last."""
    place = {role: i for i, role in enumerate(("x", *s.contexts))}
    formula = {name: i for i, name in enumerate(asset_feature_names(s))}
    taken = [f for f in feature_table(s) if f.is_input]
    single = [f for f in taken if f.kind != "cross"]
    single.sort(key=lambda f: (place[f.of], formula[f.name.removeprefix(f"{f.of}_")]))
    return single + [f for f in taken if f.kind == "cross"]


def model_inputs(s: Study) -> list[str]:
    return [f.name for f in _inputs(s)]


def own_inputs(s: Study) -> list[str]:
    return [f.name for f in _inputs(s) if f.of == "x" and f.against is None]


def importance_groups(s: Study) -> dict[str, list[str]]:
    """Inputs that say something about each asset; a cross feature belongs to its context."""
    groups: dict[str, list[str]] = {role: [] for role in ("x", *s.contexts)}
    for f in _inputs(s):
        groups[f.against or f.of].append(f.name)
    return groups


def input_set(s: Study, name: str) -> list[str]:
    sets = importance_groups(s)
    return {"all": model_inputs(s), "own": sets["x"]}.get(name) or sets[name]


def label_names(s: Study) -> list[str]:
    return [f"{kind}_{h}" for h in s.horizons for kind in ("fwd_logret", "sigma", "y")]


def har_inputs(s: Study) -> list[str]:
    return [f"log_rv_{n}" for n in s.har_windows]


def volatility_inputs(s: Study) -> list[str]:
    return [*model_inputs(s), "hour"]
