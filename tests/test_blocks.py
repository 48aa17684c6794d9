import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrid.operators import blocks, rolling
from tapegrid.session import settle, shared_folder


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows and a third of them share one value."""
    rng = np.random.default_rng(3)
    key = rng.choice(["hot", "a", "b", "c", "d"], 6_000, p=[0.36, 0.16, 0.16, 0.16, 0.16])
    value = np.where(rng.random(6_000) < 0.33, 0.0, np.round(rng.standard_normal(6_000), 2))
    frame = pd.DataFrame({"key": key, "pos": np.arange(6_000), "value": value})
    frame.loc[::37, "value"] = np.nan
    rows = spark.createDataFrame(frame).withColumn(
        "value", F.when(~F.isnan("value"), F.col("value"))
    )
    return frame, rows.repartition(7)


def test_average_ranks_and_their_spread(hot):
    frame, rows = hot
    ranked = blocks.standardised_ranks(rows, ["key"], "value", "z").toPandas().set_index("pos")
    ranks = frame.groupby("key")["value"].rank()
    expected = ranks.groupby(frame["key"]).transform(lambda r: (r - r.mean()) / r.std(ddof=0))
    np.testing.assert_allclose(ranked["z"].sort_index().to_numpy(), expected.to_numpy(), atol=1e-9)


def test_all_ties_have_no_ranks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "key string, value double")
    assert [r["z"] for r in blocks.standardised_ranks(rows, ["key"], "value", "z").collect()] == [None, None]


def test_quantiles_are_exact(hot):
    frame, rows = hot
    levels = {"q10": 0.1, "third": 1 / 3, "q50": 0.5, "q90": 0.9, "top": 1.0}
    found = blocks.quantiles(rows, ["key"], "value", levels).toPandas().set_index("key")
    for name, level in levels.items():
        expected = frame.groupby("key")["value"].quantile(level)
        np.testing.assert_allclose(found[name].sort_index(), expected.sort_index())


def test_spearman_matches_rank_correlation(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 900), "a": rng.integers(0, 40, 900) * 1.0})
    frame["b"] = frame["a"] + rng.integers(0, 60, 900)
    found = blocks.spearman(spark.createDataFrame(frame), ["k"], "a", "b", "rho").toPandas()
    for _, row in found.iterrows():
        part = frame[frame["k"] == row["k"]]
        assert row["rho"] == pytest.approx(part["a"].rank().corr(part["b"].rank()))


def test_slices_split_a_hot_key(hot, spark):
    _, rows = hot
    ordered = blocks.order_counts(rows, ["key"], "value").where("key = 'hot'")
    assert ordered.agg(F.sum("ties")).first()[0] == rows.where("key = 'hot' and value is not null").count()
    assert ordered.agg(F.max(F.col("below") + F.col("ties")) == F.max("n")).first()[0]


@pytest.mark.parametrize("size", [7, 40, 1_000])
def test_carry_sequence_and_previous_do_not_depend_on_the_block_size(hot, size):
    frame, rows = hot
    expected = frame.copy()
    expected["filled"] = expected.groupby("key")["value"].ffill()
    expected["seq"] = expected.groupby("key").cumcount() + 1
    expected["prev_pos"] = expected.groupby("key")["pos"].shift()
    found = blocks.carried_last(rows, ["key"], "pos", "value", "filled", size)
    found = blocks.sequenced(found, ["key"], "pos", "seq", size)
    found = blocks.with_previous(found, ["key"], "pos", ["pos"], size)
    found = found.toPandas().sort_values("pos").reset_index(drop=True)
    for column in ("filled", "seq", "prev_pos"):
        np.testing.assert_allclose(found[column].astype(float), expected[column].astype(float))


def test_borders_are_copied_and_dropped_again(spark):
    rows = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("pos"))
    copies = blocks.blocked(rows, "pos", before=12, after=3, block_rows=20)
    line = blocks.in_block(["key"], "pos")
    seen = copies.withColumns(
        {"back": F.lag("pos", 12).over(line), "ahead": F.lead("pos", 3).over(line)}
    )
    seen = blocks.owned(seen).toPandas().sort_values("pos")
    assert len(seen) == 100 and seen["pos"].is_unique
    assert (seen["pos"] - seen["back"]).dropna().eq(12).all() and seen["back"].isna().sum() == 12
    assert (seen["ahead"] - seen["pos"]).dropna().eq(3).all() and seen["ahead"].isna().sum() == 3


def test_running_moments_match_plain_frames(spark):
    rng = np.random.default_rng(5)
    n, size = 3_000, 576
    values = 50 + np.cumsum(rng.standard_normal(n))
    frame = pd.DataFrame({"key": "k", "pos": np.arange(n), "value": values})
    frame.loc[[5, 900, 2_100], "value"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    line = blocks.in_block(["key"], "pos")
    fast = rolling.add_running_sums(
        blocks.blocked(rows, "pos", before=size, block_rows=700), line, {"v": F.col("value")}
    )
    part = rolling.Trailing("v", size, line)
    fast = blocks.owned(fast.withColumns({"mean": part.mean, "std": part.std}))
    plain = Window.partitionBy("key").orderBy("pos").rowsBetween(-(size - 1), 0)
    whole = F.count("value").over(plain) == size
    slow = rows.withColumns(
        {
            "mean": F.when(whole, F.avg("value").over(plain)),
            "std": F.when(whole, F.stddev_pop("value").over(plain)),
        }
    )
    a, b = (df.toPandas().sort_values("pos") for df in (fast, slow))
    for column in ("mean", "std"):
        np.testing.assert_allclose(a[column].astype(float), b[column].astype(float), rtol=1e-9)
    assert a["std"].notna().sum() == n - (size - 1) - sum(
        min(size, n - p) for p in (900, 2_100)
    ) - 6


def test_a_constant_window_has_zero_spread(spark):
    values = [5.0] * 3 + [0.1] * 6 + [7.0]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, pos long, value double")
    line = blocks.in_block(["key"], "pos")
    rows = rolling.add_running_sums(blocks.blocked(rows, "pos", before=4), line, {"v": F.col("value")})
    found = blocks.owned(rows.withColumn("std", rolling.Trailing("v", 4, line).std)).orderBy("pos")
    std = [r["std"] for r in found.collect()]
    assert std[:3] == [None] * 3
    assert std[6] == std[7] == std[8] == 0.0
    assert std[3] > 0 and std[9] > 0


def test_settled_tables_are_broadcast_by_their_size(spark):
    """The engine decides: a settled table has a known size, whatever its row count."""
    other = spark.range(50).withColumn("x", F.lit(1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = []
    try:
        for limit in ("10485760", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plans.append(other.join(settle(spark.range(50)), "id")._jdf.queryExecution().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0]
    assert "BroadcastHashJoin" not in plans[1] and "SortMergeJoin" in plans[1]


def test_settled_folders_follow_the_keys(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, None, 4.0)], "x int, k string, y double")
    kept = settle(rows, partition_by=["k"])
    assert kept.columns == rows.columns and kept.schema == rows.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert len(kept.where("k = 'a'").inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull" in kept.where("k = 'a'")._jdf.queryExecution().toString()


class FakeSession:
    """A session with given settings, to test where shared tables go."""

    def __init__(self, settings, master="yarn", folder=None):
        self.conf = settings
        self.sparkContext = self
        self.master, self.getCheckpointDir = master, lambda: folder


def test_the_shared_folder_is_the_sessions():
    assert shared_folder(FakeSession({"spark.checkpoint.dir": "s3://shared"})) == "s3://shared"
    assert shared_folder(FakeSession({}, folder="hdfs://set/by/code")) == "hdfs://set/by/code"
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession({}))


def test_masked_ranks_are_the_ranks_of_each_set(spark):
    rng = np.random.default_rng(12)
    table = pd.DataFrame(
        {"k": rng.integers(0, 3, 400), "v": rng.integers(0, 60, 400).astype(float), "m": rng.integers(0, 8, 400), "w": rng.normal(size=400)}
    )
    table.loc[table["k"] == 2, "m"] &= 3  # a set without rows
    df = spark.createDataFrame(table).repartition(5)
    members = [F.col("m").bitwiseAND(F.lit(1 << i)) != 0 for i in range(3)]
    found = blocks.masked_ranks(df, ["k"], "v", members, [F.col("w")] * 3).collect()
    for i in range(3):
        inside = table[(table["m"] // 2**i) % 2 == 1]
        ranks = inside.groupby("k")["v"].rank()
        z = (ranks - ranks.groupby(inside["k"]).transform("mean")) / ranks.groupby(inside["k"]).transform("std", ddof=0)
        wanted = {(k, v): zs for k, v, zs in zip(inside["k"], inside["v"], z)}
        sums = inside.groupby(["k", "v"])["w"].sum().to_dict()
        known = {(r["k"], r["v"]): r for r in found if r["z"][i] is not None}
        assert set(known) == set(wanted)
        for key, r in known.items():
            assert abs(r["z"][i] - wanted[key]) < 1e-9 and abs(r["sums"][i] - sums[key]) < 1e-9
            assert r["n"][i] == (inside["k"] == key[0]).sum()
