import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from helpers import BASE, close_or_both_null, gridded, make_bars
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import pair_order
from tapegrid.operators import grid, returns
from tapegrid.plans import studies
from tapegrid.plans.studies import EVENTS, LINES
from tapegrid.sources import derived, files, store
from tapegrid.streaming import ingest

FIVE = Study(bar_seconds=300)


def kline_lines(millis, close, count=50):
    return [f"{t},{c},{c},{c},{c},1,{t + 299_999},1,{count},1,1,0" for t, c in zip(millis, close)]


def write(path, lines, header=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    names = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"
    path.write_text("\n".join(([names] if header else []) + lines) + "\n")


START = 1_748_736_000_000  # 2025-06-01 00:00 UTC
UNIVERSE = [("btc", "BTCUSDT", None), ("hype", "HYPEUSDT", "2025-06-01 00:30:00")]


def test_headers_duplicates_and_first_bar(spark, tmp_path):
    times = [START + 300_000 * i for i in range(20)]
    for pair in ("BTCUSDT", "HYPEUSDT"):
        first = files.kline_path(str(tmp_path), pair, "2025-06")
        second = files.kline_path(str(tmp_path), pair, "2025-07")
        write(tmp_path.__class__(first), kline_lines(times[:12], range(12)), header=True)
        write(tmp_path.__class__(second), kline_lines(times[8:], range(100, 112)))
    rows = files.read_klines(spark, str(tmp_path), UNIVERSE, FIVE).toPandas()
    btc = rows[rows["asset"] == "btc"].sort_values("pos")
    assert btc["close"].tolist() == [*range(12), *range(104, 112)]
    hype = rows[rows["asset"] == "hype"].sort_values("pos")
    assert len(hype) == 14 and hype["open_time"].iloc[0] == pd.Timestamp("2025-06-01 00:30")


def test_jittered_funding_lands_on_the_grid(spark, tmp_path):
    path = tmp_path.__class__(files.funding_path(str(tmp_path), "BTCUSDT", "2025-06"))
    path.parent.mkdir(parents=True)
    settle = [START + 14_400_000 * i for i in range(4)]
    lines = [f"{t + j},4,{r}" for t, j, r in zip([*settle, settle[3]], [6, 0, 26, 3, 9], [1, 2, 3, 4, 5])]
    path.write_text("calc_time,funding_interval_hours,last_funding_rate\n" + "\n".join(lines) + "\n")
    rows = files.read_funding(spark, str(tmp_path), UNIVERSE, FIVE).orderBy("pos").collect()
    assert [r["pos"] * 300_000 for r in rows] == settle
    assert [r["rate"] for r in rows] == [1.0, 2.0, 3.0, 4.0]


def test_month_lists(spark):
    months = [r["month"] for r in files.month_range(spark, "2025-11", "2026-02").collect()]
    assert months == ["2025-11", "2025-12", "2026-01", "2026-02"]
    with pytest.raises(ValueError):
        files.month_range(spark, "2026-02", "2025-11")
    expected = files.months_for(
        files.month_range(spark, "2025-05", "2025-07"), [("a", "A", "2025-06-30"), ("b", "B", None)]
    )
    assert sorted((r["asset"], r["month"]) for r in expected.collect()) == [
        ("a", "2025-06"), ("a", "2025-07"), ("b", "2025-05"), ("b", "2025-06"), ("b", "2025-07"),
    ]


def test_present_files_and_digests(spark, tmp_path):
    for month in ("2025-06", "2025-08"):
        write(tmp_path.__class__(files.kline_path(str(tmp_path), "BTCUSDT", month)), kline_lines([START], [1]))
    present = files.present_months(spark, files.kline_path(str(tmp_path), "*", "*"))
    assert sorted(r["month"] for r in present.collect()) == ["2025-06", "2025-08"]
    expected = files.months_for(files.month_range(spark, "2025-06", "2025-08"), UNIVERSE[:1])
    flags = {r["month"]: r["present"] for r in files.coverage(expected, present).collect()}
    assert flags == {"2025-06": True, "2025-07": False, "2025-08": True}
    contents = spark.read.format("binaryFile").load(files.kline_path(str(tmp_path), "*", "*"))
    digests = contents.select("path", F.sha2("content", 256).alias("d"))
    manifest = digests.select("path", F.concat("d", F.lit("  name.zip")).alias("checksum"))
    assert files.digest_mismatches(contents, manifest).isEmpty()
    wrong = manifest.withColumn("checksum", F.lit("abc  name.zip"))
    assert files.digest_mismatches(contents, wrong).count() == 2


def test_only_new_files_are_ingested(spark, tmp_path):
    times = [START + 300_000 * i for i in range(6)]
    root = str(tmp_path / "in")
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    pattern = files.kline_path(root, "*", "*")
    write(tmp_path.__class__(files.kline_path(root, "BTCUSDT", "2025-06")), kline_lines(times[:4], range(4)), True)
    ingest.ingest_new_files(spark, pattern, table, mark)
    assert ingest.ingested_bars(spark, table, UNIVERSE, FIVE).count() == 4
    write(tmp_path.__class__(files.kline_path(root, "BTCUSDT", "2025-07")), kline_lines(times[3:], range(90, 93)))
    ingest.ingest_new_files(spark, pattern, table, mark)
    ingest.ingest_new_files(spark, pattern, table, mark)
    rows = ingest.ingested_bars(spark, table, UNIVERSE, FIVE).orderBy("pos").collect()
    assert [r["close"] for r in rows] == [0.0, 1.0, 2.0, 3.0, 91.0, 92.0]
    assert spark.read.schema(ingest.STORED).parquet(table).count() == 7


def test_store_round_trips(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.23456789), ("b", None)], "coin string, x double")
    store.write_table(table, str(tmp_path / "t"), 4)
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert {r["coin"]: r["x"] for r in back.collect()} == {"a": "1.2346", "b": None}
    store.write_choice(table.where("coin = 'a'"), str(tmp_path / "c"), 2)
    assert store.read_choice(spark, str(tmp_path / "c")).first().asDict() == {"coin": "a", "x": 1.23}
    store.save(table, str(tmp_path / "p"), ["coin"])
    assert store.load(spark, str(tmp_path / "p"), ["x"]).columns == ["x"]
    wanted = spark.createDataFrame([("a",), ("z",)], "coin string")
    assert [r["coin"] for r in store.missing_keys(wanted, table, ["coin"]).collect()] == ["z"]


def test_predictions_are_computed_once_per_key(spark, tmp_path):
    held = store.PredictionStore(spark, str(tmp_path / "pred"), ["coin", "horizon"])
    calls = []

    def wanted(*keys):
        return spark.createDataFrame(keys, "coin string, horizon int")

    def compute(missing):
        calls.append(sorted((r["coin"], r["horizon"]) for r in missing.collect()))
        return missing.select("*", F.lit(1).alias("pos"), F.lit(0.5).alias("pred"))

    for _ in range(2):
        found = held.get(wanted(("aa", 2)), compute).collect()
        assert [(r["coin"], r["horizon"], r["pred"]) for r in found] == [("aa", 2, 0.5)]
    found = held.get(wanted(("aa", 2), ("aa", 4), ("bb", 2), ("bb", 2)), compute).collect()
    assert sorted((r["coin"], r["horizon"]) for r in found) == [("aa", 2), ("aa", 4), ("bb", 2)]
    assert calls == [[("aa", 2)], [("aa", 4), ("bb", 2)]]


def test_a_failed_computation_leaves_no_finished_key(spark, tmp_path):
    held = store.PredictionStore(spark, str(tmp_path / "pred"), ["coin"])
    wanted = spark.createDataFrame([("aa",)], "coin string")

    def fails(missing):
        return missing.select("*", F.raise_error(F.lit("lost")).cast("double").alias("pred"))

    with pytest.raises(Exception, match="lost"):
        held.get(wanted, fails)
    good = held.get(wanted, lambda missing: missing.withColumn("pred", F.lit(1.0)))
    assert good.count() == 1


def test_alignment_and_audit(spark, study):
    raw = make_bars(("aa", "bb", "cc"), 1_200)
    short = raw[~((raw["asset"] == "bb") & (raw["pos"] > BASE + 1_099))]
    rows = spark.createDataFrame(short)
    aligned = grid.align_on_grid(rows, study).toPandas()
    end = short.groupby("asset")["pos"].max().min()
    assert len(aligned) == 3 * (end - BASE + 1)
    expected = gridded(short, end - BASE + 1)
    for asset, table in expected.items():
        mine = aligned[aligned["asset"] == asset].sort_values("pos")
        for field in ("close", "volume", "count"):
            np.testing.assert_allclose(mine[field].astype(float), table[field].astype(float))
    audit = grid.audit_bars(rows, study).toPandas().set_index(["asset", "month"]).sort_index()
    for asset, table in expected.items():
        frame = short[short["asset"] == asset].set_index("pos").reindex(range(BASE, end + 1))
        month = table.index.strftime("%Y-%m")
        logret = np.log(table["close"]).diff().dropna()
        spread = logret.rolling(24).std().shift()
        extreme = (logret.abs() > 4 * spread).reindex(table.index, fill_value=False)
        assert audit.loc[asset, "expected"].tolist() == pd.Series(1, month).groupby(level=0).sum().tolist()
        counts = frame["count"].set_axis(month)
        assert audit.loc[asset, "missing"].tolist() == counts.isna().groupby(level=0).sum().tolist()
        assert audit.loc[asset, "zero_trade"].tolist() == counts.eq(0).groupby(level=0).sum().tolist()
        assert audit.loc[asset, "extreme"].tolist() == extreme.set_axis(month).groupby(level=0).sum().tolist()


def test_a_planted_splice_is_a_seam(spark, study):
    def part(start, n, price, count=5.0):
        frame = make_bars(("pump",), n, gaps=0, halts=0, start=start)
        return frame.assign(close=price, count=count)

    raw = pd.concat([part(BASE, 12, 100.0), part(BASE + 12, 6, 100.0, 0.0), part(BASE + 21, 12, 11.5)])
    seams = grid.find_seams(spark.createDataFrame(raw), study)
    [row] = seams.collect()
    assert (row["bars_between"], row["price_ratio"]) == (9, pytest.approx(0.115))
    grid.require_no_late_seams(seams, study)
    with pytest.raises(ValueError):
        grid.require_no_late_seams(seams, study.with_changes(train_start="2024-01-01 05:00:00"))


def test_return_statistics(spark, study):
    n = 2_400
    raw = make_bars(("aa", "bb", "cc"), n, seed=9)
    tables = gridded(raw, n)
    rows = grid.align_on_grid(spark.createDataFrame(raw), study)
    moves = grid.log_returns(rows, study)
    r = pd.DataFrame({a: np.log(t["close"]).diff() for a, t in tables.items()})
    matrix = returns.return_correlation(moves, ("aa", "bb", "cc")).toPandas().set_index("asset")
    np.testing.assert_allclose(matrix.loc[["aa", "bb", "cc"]].to_numpy(), r.corr().to_numpy(), atol=1e-9)
    small = study.with_changes(benchmark_days=4, benchmark_min_days=2, lead_lag=3)
    rolled = returns.rolling_benchmark_correlation(moves, small).toPandas().set_index("day").sort_index()
    expected = r[["aa", "bb"]].rolling(96, min_periods=48).corr(r["cc"]).resample("1D").last().dropna(how="all")
    np.testing.assert_allclose(rolled[["aa", "bb"]].to_numpy(), expected.to_numpy(), atol=1e-8)
    event = (r.index >= "2024-02-10") & (r.index < "2024-02-12")
    calm = r.mask(event[:, None] & np.ones((1, 3), bool))
    lags = returns.lead_lag(moves, small).toPandas().sort_values("benchmark_lead_bars")
    want = [calm["aa"].corr(calm["cc"].shift(k)) for k in range(-3, 4)]
    np.testing.assert_allclose(lags["aa"], want, atol=1e-9)
    auto = returns.autocorrelation(moves, study).toPandas().set_index("asset")
    cut = r[~event]
    for a in r:
        assert auto.loc[a, "lag1"] == pytest.approx(r[a].autocorr())
        assert auto.loc[a, "lag1_without_event"] == pytest.approx(cut[a].autocorr())
        assert auto.loc[a, "lag1_rank_without_event"] == pytest.approx(cut[a].rank().autocorr())
    tails = returns.tail_table(moves, study, 0.01).toPandas().set_index("asset")
    for a in r:
        squares = r[a].dropna().pow(2).sort_values(ascending=False)
        share = squares.iloc[: round(0.01 * len(squares))].sum() / squares.sum()
        assert tails.loc[a, "kurtosis"] == pytest.approx(r[a].kurt())
        assert tails.loc[a, "top_share"] == pytest.approx(share)


def test_choice_json_is_one_object(spark, tmp_path):
    store.write_choice(spark.createDataFrame([("outer10", 0.1234567)], "rule string, t double"), str(tmp_path / "j"))
    [part] = list((tmp_path / "j").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"rule": "outer10", "t": 0.123457}
    assert close_or_both_null(None, None)


def test_bars_of_ticks_are_a_hash_aggregate_in_the_order_of_both_keys(spark):
    """Order keys of any size and sign, nulls first; no task sorts its ticks."""
    keys = [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1]
    numbers = [None, -(1 << 31), -1, 0, 1, (1 << 31) - 1]
    rows = [(a, b, float(i * len(numbers) + j)) for i, a in enumerate(keys) for j, b in enumerate(numbers)]
    table = spark.createDataFrame(rows[::-1], "a long, b int, v double")
    for both in (("a", "b", 64, 32), ("b", "a", 56, 64)):
        found = table.orderBy(pair_order(*both)).collect()
        assert found == table.orderBy(F.struct(*both[:2])).collect()
    day = dt.datetime(1996, 1, 1)
    lines = [(k, n, 1.0, 1000.0 * i, 0.05, "A", "F", day) for i, (k, n, _) in enumerate(rows)]
    lines = spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp")
    bars = derived.line_bars(lines.repartition(3), LINES)
    assert [r[:] for r in bars.select("open", "close", "count").collect()] == [(100.0, 135.0, 36.0)] * 2
    hours = [(None, 3.0), (9, 1.0), (-(1 << 63), 2.0)]
    events = [("view", day + dt.timedelta(hours=h, seconds=s), i, v, '{"k": 60}') for h in (0, 1) for s in (5, 7) for i, v in hours]
    events = spark.createDataFrame(events, "event_type string, ts timestamp, event_id long, value double, props string")
    timed = derived.event_bars(events, EVENTS)
    assert [r[:] for r in timed.select("open", "close", "count").collect()] == [(103.0, 101.0, 6.0)] * 2
    for made in (bars, timed):
        assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_more_order_lines_of_the_same_days_make_no_more_bars(spark, tmp_path):
    """All that follows the bars is bounded by the calendar, and nothing before them sorts the lines."""
    days = [dt.datetime(1996, 1, 1) + dt.timedelta(days=d) for d in range(20)]
    rows = [
        (k, 1, float(1 + k % 5), 1000.0 * (k % 97), (k % 11) / 100, (k % 9) / 100, "ANR"[k % 3], "FO"[k % 2], days[k % 20])
        for k in range(400)
    ]
    names = ("l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
             "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    once = spark.createDataFrame(rows, names)
    found = []
    for copies in (1, 5):
        many = once.crossJoin(spark.range(copies)).withColumn("l_orderkey", F.col("l_orderkey") + 400 * F.col("id"))
        many.drop("id").repartition(3).write.parquet(str(tmp_path / f"{copies}" / "lineitem.parquet"))
        lab = studies.lines_lab(spark, str(tmp_path / f"{copies}"))
        for made in (lab._raw, lab._funding):
            assert "Sort" not in made._jdf.queryExecution().executedPlan().toString()
        bars = lab.raw.orderBy("asset", "pos").collect()
        found.append((bars, lab.funding.count()))
    (bars, settled), (more, settled_more) = found
    assert len(bars) == len(more) and settled == settled_more
    for a, b in zip(bars, more, strict=True):
        assert [a[c] for c in ("asset", "pos", "open", "high", "low", "close")] == [
            b[c] for c in ("asset", "pos", "open", "high", "low", "close")
        ]
        assert b["volume"] == 5 * a["volume"] and b["count"] == 5 * a["count"]
