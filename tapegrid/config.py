"""Parameters of a study.

Every operator takes its widths, thresholds and month lists from a :class:`Study`, so one code path
serves five-minute market bars and the daily or hourly bars built from other tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---- fixed values: published constants of the method, needed for equal results ----
EPS = 1e-12
QUANTILES = {"q10": 0.1, "q30": 0.3, "q50": 0.5, "q70": 0.7, "q90": 0.9}
RULES = {"median": ("q50", "q50"), "outer30": ("q30", "q70"), "outer10": ("q10", "q90")}
EDGE_PER_UNIT_IC = {"median": 0.80, "outer30": 1.16, "outer10": 1.755}
TOP_DECILE_EDGE = 1.755
FEES_BPS = {"taker": 5.0, "maker": 2.0}
RIDGE_ALPHAS = (1e2, 1e3, 1e4, 1e5, 1e6, 1e7)
RIDGE_CLIP = 5.0
SIZE_CAP = 2.0
FAMILIES = ("momentum", "best_feature", "ridge", "trees")
ONE_INPUT_FAMILIES = ("momentum", "best_feature")
POLICIES = ("expanding", "fixed", "rolling_3m")
VERSIONS = ("base", "gated", "sized")
DELAYS = (0, 1)
POOLED_T = 3.0
PER_COIN_T = 3.2
PAIRED_T = 2.0
DAYS_PER_YEAR = 365
ROWS_PER_LEAF_PER_HORIZON_BAR = 100
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Study:
    """Universe, time scale and thresholds of one analysis."""

    targets: tuple[str, ...] = ("hype", "trx", "doge", "uni", "aave")
    contexts: tuple[str, ...] = ("btc", "eth", "sol")
    pairs: tuple[tuple[str, str], ...] = ()
    first_bar: tuple[tuple[str, str], ...] = ()
    bar_seconds: int = 300
    grid_start: str = "2025-05-30 10:30:00"
    train_start: str = "2025-06-01 10:30:00"
    research_months: tuple[str, ...] = (
        "2025-12", "2026-01", "2026-02", "2026-03", "2026-04", "2026-05",
    )
    forward_months: tuple[str, ...] = ("2026-06", "2026-07", "2026-08")
    research_end: str = "2026-06-01 00:00:00"
    forward_end: str = "2026-09-01 00:00:00"
    event_window: tuple[str, str] = ("2025-10-10 00:00:00", "2025-10-12 00:00:00")
    lags: tuple[int, ...] = (4, 12, 36, 72)
    mean_windows: tuple[int, ...] = (12, 36, 72)
    long_window: int = 576
    flow_windows: tuple[int, ...] = (12, 36)
    excess_lags: tuple[int, ...] = (12, 36, 72)
    corr_window: int = 72
    beta_window: int = 288
    horizons: tuple[int, ...] = (4, 12, 36, 72)
    har_windows: tuple[int, ...] = (12, 72, 288)
    extreme_window: int = 576
    extreme_sigmas: float = 10.0
    seam_ratio: float = 1.3
    benchmark_days: int = 30
    benchmark_min_days: int = 20
    lead_lag: int = 6
    draws: int = 10_000
    mean_block: float = 5.0
    seed: int = 7
    block_rows: int = 100_000
    fees_bps: tuple[tuple[str, float], ...] = field(default=tuple(FEES_BPS.items()))

    @property
    def assets(self) -> tuple[str, ...]:
        return (*self.targets, *self.contexts)

    @property
    def benchmark(self) -> str:
        return self.contexts[0]

    @property
    def bars_per_day(self) -> float:
        return 86_400 / self.bar_seconds

    @property
    def periods(self) -> dict[str, tuple[tuple[str, ...], str]]:
        return {
            "research": (self.research_months, self.research_end),
            "forward": (self.forward_months, self.forward_end),
        }

    def with_changes(self, **changes) -> Study:
        return replace(self, **changes)
