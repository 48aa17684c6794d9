from __future__ import annotations

import numpy as np
import pandas as pd

from tapegrid.schema import BAR_FIELDS

BASE = 473_352  # bar number of 2024-01-01 00:00 at one hour


def make_bars(assets, bars, seed=7, gaps=0.02, halts=0.01, start=BASE, seconds=3_600):
    """Raw bars of a geometric walk with missing and zero-trade bars."""
    rng = np.random.default_rng(seed)
    frames = []
    for asset in assets:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, bars)))
        opened = close * np.exp(rng.normal(0, 0.004, bars))
        volume = rng.uniform(10, 100, bars)
        frame = pd.DataFrame(
            {
                "asset": asset,
                "pos": start + np.arange(bars),
                "open": opened,
                "high": np.maximum(opened, close) * 1.002,
                "low": np.minimum(opened, close) * 0.998,
                "close": close,
                "volume": volume,
                "quote_volume": volume * close,
                "count": rng.integers(1, 50, bars).astype(float),
                "taker_buy_volume": volume * rng.uniform(0.2, 0.8, bars),
                "taker_buy_quote_volume": volume * close * rng.uniform(0.2, 0.8, bars),
            }
        )
        frame.loc[rng.random(bars) < halts, "count"] = 0.0
        frame = frame[(rng.random(bars) >= gaps) | (frame.index == bars - 1)]
        frames.append(frame)
    table = pd.concat(frames, ignore_index=True)
    table["open_time"] = pd.to_datetime(table["pos"] * seconds, unit="s")
    return table


def gridded(raw, bars, start=BASE, seconds=3_600):
    """The same bars on the complete grid, as pandas."""
    out = {}
    for asset, frame in raw.groupby("asset"):
        traded = frame[frame["count"] > 0].set_index("pos")[list(BAR_FIELDS)]
        table = traded.reindex(range(start, start + bars))
        table.index = pd.to_datetime(table.index * seconds, unit="s")
        out[asset] = table
    return out


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def close_or_both_null(a, b, tolerance=1e-9):
    if a is None or (isinstance(a, float) and np.isnan(a)):
        return b is None or (isinstance(b, float) and np.isnan(b))
    if b is None or (isinstance(b, float) and np.isnan(b)):
        return False
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
