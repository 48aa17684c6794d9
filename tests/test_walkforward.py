import numpy as np
import pandas as pd
import pytest
from helpers import BASE
from pyspark.sql import functions as F

from tapegrid.config import QUANTILES, RIDGE_ALPHAS, Study
from tapegrid.operators import fitting, folds, importance, scoring, trees, walkforward

INPUTS = ["x_trail_ret_2", "x_trail_ret_5", "cc_logret_1", "cc_count_z_24"]
MONTHS = ("2024-04", "2024-05")
END = "2024-06-01 00:00:00"
H = 5


@pytest.fixture(scope="module")
def panel(study):
    """Two coins of different scale with a planted signal, some missing inputs and labels."""
    rng = np.random.default_rng(7)
    index = pd.date_range("2024-01-01", "2024-06-02", freq="1h", inclusive="left")
    frames = []
    for coin, scale, centre in (("aa", 0.001, 0.02), ("bb", 1.0, -3.0)):
        z = rng.standard_normal((len(index), len(INPUTS)))
        frame = pd.DataFrame(centre + scale * z, columns=INPUTS)
        frame.insert(0, "coin", coin)
        frame.insert(1, "pos", BASE + np.arange(len(index)))
        frame.insert(2, "open_time", index)
        for h in study.horizons:
            move = 0.004 * (0.3 * z[:, 1] - 0.1 * z[:, 2] + rng.standard_normal(len(index)))
            move[-h:] = np.nan
            frame[f"fwd_logret_{h}"] = move
            frame[f"y_{h}"] = np.tanh(move / 0.004)
        frame.loc[rng.random(len(index)) < 0.01, INPUTS[0]] = np.nan
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, panel):
    rows = spark.createDataFrame(panel)
    return rows.select(
        *[
            F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n)
            for n, t in rows.dtypes
        ]
    ).cache()


def parts_of(panel, fold, coin, h=H, end=END):
    """The five row sets of a fold, by plain comparison of times."""
    rows = panel[panel["coin"] == coin].set_index("open_time")
    known = lambda stop: rows.index + pd.Timedelta(hours=h + 1) <= pd.Timestamp(stop)
    inputs = rows[INPUTS].notna().all(axis=1)
    full = inputs & rows[f"y_{h}"].notna()
    span = lambda a, b: (rows.index >= a) & (rows.index < b)
    early, late = span(fold.train_start, fold.valid_start), span(fold.valid_start, fold.train_end)
    train, valid = early & full & known(fold.valid_start), late & full & known(fold.train_end)
    test = span(fold.test_start, fold.test_end) & full & known(end)
    return {
        "train": rows[train], "valid": rows[valid], "refit": rows[train | valid],
        "threshold": rows[late & inputs], "test": rows[test],
    }


def ridge_by_hand(train, valid, refit, h=H):
    def fit(rows, alpha):
        mean, std = rows[INPUTS].mean(), rows[INPUTS].std(ddof=0)
        z = ((rows[INPUTS] - mean) / std).clip(-5, 5)
        y = rows[f"y_{h}"]
        zc, yc = (z - z.mean()).to_numpy(), (y - y.mean()).to_numpy()
        w = np.linalg.solve(zc.T @ zc + alpha * np.eye(len(INPUTS)), zc.T @ yc)
        return lambda X: y.mean() + (((X[INPUTS] - mean) / std).clip(-5, 5) - z.mean()).to_numpy() @ w

    errors = [np.mean((valid[f"y_{h}"] - fit(train, a)(valid)) ** 2) for a in RIDGE_ALPHAS]
    alpha = RIDGE_ALPHAS[int(np.argmin(errors))]
    return fit(train, alpha), fit(refit, alpha), f"alpha={alpha:.0e}"


def compare(found, panel, study, fit, policy="expanding"):
    for fold in folds.monthly_folds(MONTHS, study, policy):
        for coin in ("aa", "bb"):
            parts = parts_of(panel, fold, coin)
            inner, final, setting = fit(parts["train"], parts["valid"], parts["refit"])
            mine = found[(found["coin"] == coin) & (found["test_month"] == fold.test_month)]
            mine = mine.set_index("open_time").sort_index()
            assert mine.index.equals(parts["test"].index)
            np.testing.assert_allclose(mine["pred"], final(parts["test"]), rtol=1e-6, atol=1e-9)
            levels = np.quantile(final(parts["threshold"]), list(QUANTILES.values()))
            np.testing.assert_allclose(mine[list(QUANTILES)].iloc[0].astype(float), levels, rtol=1e-6, atol=1e-9)
            skill = pd.Series(inner(parts["valid"])).corr(
                parts["valid"][f"fwd_logret_{H}"].reset_index(drop=True), method="pearson"
            )
            ranks = pd.Series(inner(parts["valid"])).rank().corr(
                parts["valid"][f"fwd_logret_{H}"].reset_index(drop=True).rank()
            )
            assert mine["valid_ic"].iloc[0] == pytest.approx(ranks), skill
            assert set(mine["setting"]) == {setting}


def test_fold_dates(study):
    s = Study()
    [fold] = folds.monthly_folds(["2026-01"], s)
    assert (fold.train_start, fold.valid_start) == (s.train_start, "2025-12-01 00:00:00")
    assert fold.train_end == fold.test_start == "2026-01-01 00:00:00"
    assert folds.monthly_folds(["2026-03"], s, "rolling_3m")[0].train_start == "2025-12-01 00:00:00"
    fixed = folds.monthly_folds(s.research_months, s, "fixed")
    assert {f.window for f in fixed} == {"2025-06-01..2025-12"}
    forward = folds.monthly_folds(s.forward_months, s, "fixed")
    assert {f.train_end for f in forward} == {"2025-12-01 00:00:00"}
    with pytest.raises(ValueError):
        folds.monthly_folds(s.research_months, s, "rolling")


@pytest.mark.parametrize("policy", ["expanding", "rolling_3m", "fixed"])
def test_rows_per_role(frame, panel, study, policy):
    rows = folds.horizon_rows(frame, INPUTS, (H,))
    table = folds.monthly_folds(MONTHS, study, policy)
    found = folds.split_counts(rows, table, INPUTS, study, END).toPandas()
    for fold in table:
        for coin in ("aa", "bb"):
            mine = found[(found["coin"] == coin) & (found["test_month"] == fold.test_month)].iloc[0]
            for role, part in parts_of(panel, fold, coin).items():
                assert mine[f"{role}_rows"] == len(part), (policy, fold.test_month, role)


@pytest.mark.parametrize("policy", ["expanding", "rolling_3m", "fixed"])
def test_momentum_from_monthly_sums(frame, panel, study, policy):
    def fit(train, valid, refit):
        x = f"x_trail_ret_{H}"
        line = lambda rows: np.polyfit(rows[x], rows[f"y_{H}"], 1)
        inner, final = line(train), line(refit)
        return (
            lambda X: np.polyval(inner, X[x]),
            lambda X: np.polyval(final, X[x]),
            f"slope={final[0]:+.3g}",
        )

    found = walkforward.out_of_sample(
        frame, study, "momentum", INPUTS, policy, MONTHS, END, (H,)
    ).toPandas()
    compare(found, panel, study, fit, policy)


def test_best_feature(frame, panel, study):
    def choose(rows):
        rho = rows[INPUTS].rank().corrwith(rows[f"y_{H}"].rank()).abs()
        x = rho.idxmax()
        return x, np.polyfit(rows[x], rows[f"y_{H}"], 1)

    def fit(train, valid, refit):
        (a, inner), (b, final) = choose(train), choose(refit)
        return lambda X: np.polyval(inner, X[a]), lambda X: np.polyval(final, X[b]), b

    found = walkforward.out_of_sample(
        frame, study, "best_feature", INPUTS, "expanding", MONTHS, END, (H,)
    ).toPandas()
    compare(found, panel, study, fit)


def test_equal_inputs_are_chosen_in_listed_order(frame, study):
    doubled = frame.withColumn("x_copy", F.col("x_trail_ret_5"))
    table = folds.monthly_folds(MONTHS, study)
    for inputs in (["cc_logret_1", "x_trail_ret_5", "x_copy"], ["x_copy", "x_trail_ret_5"]):
        rows = folds.horizon_rows(doubled, inputs, (H,))
        rho = fitting.input_rank_correlations(rows, table, inputs, study)
        chosen = {r["input"] for r in fitting.most_correlated_input(rho).collect()}
        assert chosen == {next(n for n in inputs if n in ("x_trail_ret_5", "x_copy"))}


def test_ridge(frame, panel, study):
    found = walkforward.out_of_sample(
        frame, study, "ridge", INPUTS, "expanding", MONTHS, END, (H,)
    ).toPandas()
    compare(found, panel, study, ridge_by_hand)
    assert list(found.columns) == ["coin", "horizon", "pos", "open_time", *walkforward.OUTPUT]


def test_ridge_clips_far_inputs(spark):
    model = spark.createDataFrame(
        [(0.5, [2.0], [1.0], [3.0])],
        "intercept double, weights array<double>, centres array<double>, spreads array<double>",
    )
    far = model.crossJoin(spark.createDataFrame([(7.0,), (50.0,), (5_000.0,), (-900.0,)], "v double"))
    found = [r["p"] for r in far.select(fitting.predict_scores(F.array("v")).alias("p")).collect()]
    assert found == [0.5 + 2 * 2, 10.5, 10.5, -9.5]


def test_masks_are_the_roles_of_the_windows(frame, study):
    """Bits of a row against the rows of every window, at any number of windows a mask."""
    months = [f"2024-{m:02d}" for m in range(3, 7)]
    for policy in folds.RETRAINING:
        table = folds.monthly_folds(months, study, policy)
        rows = folds.horizon_rows(frame, INPUTS, (H,))
        wanted = {
            (r["coin"], r["pos"], r["window"], role)
            for r in folds.window_rows(rows, table, INPUTS, study).collect()
            for role, used in (("inner", r["train"]), ("refit", r["refit"]))
            if used
        }
        windows = folds.distinct_windows(table)
        masked = rows.withColumn("_mask", folds.role_mask(windows, INPUTS, study)).select("coin", "pos", "_mask")
        found = {
            (r["coin"], r["pos"], f.window, role)
            for r in masked.collect()
            for w, f in enumerate(windows)
            for i, role in enumerate(folds.ROLES)
            if r["_mask"] >> (2 * w + i) & 1
        }
        assert found == wanted and found


def test_more_windows_than_a_mask_holds(frame, study, monkeypatch):
    rows, table = folds.horizon_rows(frame, INPUTS, (H,)), folds.monthly_folds(MONTHS, study)

    def fits():
        rho = fitting.input_rank_correlations(rows, table, INPUTS, study).toPandas()
        ridge = fitting.fit_ridge(rows, table, INPUTS, study).toPandas()
        return [t.sort_values(k).reset_index(drop=True) for t, k in ((rho, ["coin", "window", "role", "place"]), (ridge, ["coin", "window", "role"]))]

    whole = fits()
    monkeypatch.setattr(folds, "WINDOWS_PER_MASK", 1)
    for a, b in zip(whole, fits(), strict=True):
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_pooled_model_with_one_coin_is_the_coins_own(frame, study):
    one = frame.where("coin = 'bb'")
    pooled = walkforward.pooled_out_of_sample(one, study, INPUTS, MONTHS, END, (H,))
    alone = walkforward.out_of_sample(one, study, "ridge", INPUTS, "expanding", MONTHS, END, (H,))
    a, b = (df.toPandas().sort_values("pos").reset_index(drop=True) for df in (pooled, alone))
    pd.testing.assert_frame_equal(a, b, rtol=1e-7)


def test_pooled_model_across_scales(frame, panel, study):
    found = walkforward.pooled_out_of_sample(frame, study, INPUTS, MONTHS, END, (H,)).toPandas()
    assert found.groupby("test_month")["setting"].nunique().eq(1).all()
    for fold in folds.monthly_folds(MONTHS, study):
        parts = {c: parts_of(panel, fold, c) for c in ("aa", "bb")}

        def scaled(name, by):
            out = []
            for c in parts:
                base = parts[c][by][INPUTS]
                rows = parts[c][name].copy()
                rows[INPUTS] = (rows[INPUTS] - base.mean()) / base.std(ddof=0)
                out.append(rows)
            return pd.concat(out)

        inner, _, _ = ridge_by_hand(scaled("train", "train"), scaled("valid", "train"), scaled("refit", "refit"))
        _, final, setting = ridge_by_hand(
            scaled("train", "train"), scaled("valid", "train"), scaled("refit", "refit")
        )
        mine = found[found["test_month"] == fold.test_month].sort_values(["coin", "pos"])
        np.testing.assert_allclose(mine["pred"], final(scaled("test", "refit")), rtol=1e-6, atol=1e-9)
        assert set(mine["setting"]) == {setting}


def test_har_recovers_least_squares(frame, panel, study):
    def fit(train, valid, refit):
        def solve(rows):
            design = np.column_stack([np.ones(len(rows)), rows[INPUTS]])
            return np.linalg.lstsq(design, rows[f"y_{H}"], rcond=None)[0]

        inner, final = solve(train), solve(refit)
        apply = lambda w: lambda X: w[0] + X[INPUTS].to_numpy() @ w[1:]
        return apply(inner), apply(final), "slopes=" + ",".join(f"{v:.2f}" for v in final[1:])

    found = walkforward.volatility_out_of_sample(
        frame, study, "har", INPUTS, INPUTS, MONTHS, END, (H,)
    ).toPandas()
    compare(found, panel, study, fit)
    for fold in folds.monthly_folds(MONTHS, study):
        mean = parts_of(panel, fold, "aa")["refit"][f"y_{H}"].mean()
        mine = found[(found["coin"] == "aa") & (found["test_month"] == fold.test_month)]
        assert mine["train_mean"].iloc[0] == pytest.approx(mean)


def test_shuffling_keeps_a_group_together(frame, study):
    rows = folds.horizon_rows(frame, INPUTS, (H,))
    tested = folds.test_rows(rows, folds.monthly_folds(MONTHS, study), INPUTS, study, END)
    groups = {"x": INPUTS[:2], "cc": INPUTS[2:]}
    keys = ["coin", "test_month"]
    before = tested.toPandas()
    after = importance.shuffled_inputs(tested, groups, INPUTS, 7).toPandas()
    for group, columns in groups.items():
        mine = after[after["group"] == group].merge(before, on=["coin", "pos"], suffixes=("", "_old"))
        assert len(mine) == len(before)
        kept = [c for c in INPUTS if c not in columns]
        assert (mine[kept].to_numpy() == mine[[f"{c}_old" for c in kept]].to_numpy()).all()
        assert (mine[columns[0]] != mine[f"{columns[0]}_old"]).mean() > 0.9
        for key, part in mine.groupby(keys):
            old = before[(before["coin"] == key[0]) & (before["test_month"] == key[1])]
            a = part[columns].sort_values(columns).to_numpy()
            b = old[columns].sort_values(columns).to_numpy()
            assert (a == b).all()


def test_importance_finds_the_group_that_matters(frame, study):
    found = importance.permutation_importance(
        frame, study, "ridge", INPUTS, {"x": INPUTS[:2], "cc": INPUTS[2:]}, MONTHS, END, (H,)
    ).toPandas()
    for _, part in found.groupby("coin"):
        drop = part.set_index("group")["ic_drop"]
        assert drop["x"] > 0.15 and drop["x"] > drop["cc"] + 0.05


def test_trees_find_a_planted_signal(frame, study):
    settings = trees.TreeSettings(rounds=12, leaves=8, step=0.2, rows_per_leaf_per_bar=5)
    found = trees.trees_out_of_sample(
        frame, study, INPUTS, "fixed", MONTHS, END, (H,), ["bb"], settings
    ).toPandas()
    assert list(found.columns) == ["coin", "horizon", "pos", "open_time", *walkforward.OUTPUT]
    assert found["pred"].rank().corr(found["y"].rank()) > 0.15
    assert (found["valid_ic"] > 0.1).all() and found["setting"].str.startswith("trees=").all()


def test_trees_that_never_split_predict_the_mean(frame, panel, study):
    settings = trees.TreeSettings(rounds=2, leaves=4, rows_per_leaf_per_bar=100_000)
    found = trees.trees_out_of_sample(
        frame, study, INPUTS, "fixed", MONTHS, END, (H,), ["aa"], settings
    ).toPandas()
    [fold] = folds.distinct_windows(folds.monthly_folds(MONTHS, study, "fixed"))
    assert set(found["setting"]) == {"trees=0"}
    assert found["pred"].to_numpy() == pytest.approx(parts_of(panel, fold, "aa")["refit"][f"y_{H}"].mean())
    assert scoring.daily_ic is not None


def test_users_add_families(frame, study):
    def fit(rows, table, inputs, s):
        both = fitting.fit_momentum(rows, table, inputs, s)
        return both.withColumn("intercept", F.lit(1.0)).withColumn("slope", F.lit(0.0))

    fitting.register_family("ones", fitting.Family(fit, fitting.predict_line))
    try:
        found = walkforward.out_of_sample(frame, study, "ones", INPUTS, "fixed", MONTHS, END, (H,))
        assert found.select("pred").distinct().collect()[0]["pred"] == 1.0
    finally:
        del fitting.FAMILIES["ones"]


def test_users_fit_on_plain_rows(frame, study):
    """A line fitted by a function on rows gives what the momentum family gives, inner and refit alike."""

    def plain_line(train, valid, inputs, horizon):
        def line(rows):
            slope, intercept = np.polyfit(rows[f"x_trail_ret_{horizon}"], rows["y"], deg=1)
            return {"intercept": intercept, "slope": slope}

        refit = line(pd.concat([train, valid]))
        return line(train), refit, f"slope={refit['slope']:+.3g}"

    def predict(known, rows):
        return known["intercept"] + known["slope"] * rows[f"x_trail_ret_{H}"].to_numpy()

    schema = "intercept: double, slope: double"
    walk = lambda name: walkforward.out_of_sample(
        frame, study, name, INPUTS, "expanding", MONTHS, END, (H,)
    ).toPandas().sort_values(["coin", "pos"])
    fitting.register_family("plain", fitting.rows_family(plain_line, predict, schema))
    fitting.register_family("tight", fitting.rows_family(plain_line, predict, schema, rows_limit=100))
    try:
        ours, known = walk("plain"), walk("momentum")
        assert len(ours) == len(known) > 0
        for column in ("pred", "q10", "q90", "valid_ic"):
            assert ours[column].to_numpy() == pytest.approx(known[column].to_numpy(), abs=1e-9)
        assert list(ours["setting"]) == list(known["setting"])
        with pytest.raises(ValueError, match="more than the limit of 100"):
            walk("tight")
    finally:
        del fitting.FAMILIES["plain"], fitting.FAMILIES["tight"]


def test_trees_go_on_after_a_noisy_round():
    errors = [1.0, 0.9, 0.95, 0.8, 0.85, 0.86, 0.7]
    assert trees.best_round(errors, 100) == 7
    assert trees.best_round(errors, 3) == 7
    assert trees.best_round(errors, 2) == 4
    assert trees.best_round(errors, 1) == 2
    assert trees.best_round([1.0], 100) == 1


def plain_booster(x, y, borders, checked_x, checked_y, settings, least):
    """Leaf-wise boosting on all rows and inputs, one split at a time: trees and validation errors."""
    trees_made, errors = [], []
    pred, checked = np.full(len(y), y.mean()), np.full(len(checked_y), y.mean())

    def candidate(rows, residual):
        best = (0.0, None)
        total = residual[rows].sum()
        for column in range(x.shape[1]):
            for border in borders[column]:
                left = rows[x[rows, column] <= border]
                if len(left) < least or len(rows) - len(left) < least:
                    continue
                a, b = residual[left].sum(), total - residual[left].sum()
                gain = a**2 / (len(left) + settings.penalty) + b**2 / (len(rows) - len(left) + settings.penalty)
                gain -= total**2 / (len(rows) + settings.penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, (column, border))
        return best

    for _ in range(settings.rounds):
        residual = y - pred
        leaves = [(np.arange(len(y)), [])]
        tests = [candidate(rows, residual) for rows, _ in leaves]
        while len(leaves) < settings.leaves and max(g for g, _ in tests) > 0:
            at = int(np.argmax([g for g, _ in tests]))
            column, border = tests[at][1]
            rows, path = leaves[at]
            below = x[rows, column] <= border
            parts = [(rows[below], [*path, (column, border, True)]), (rows[~below], [*path, (column, border, False)])]
            leaves[at : at + 1] = parts
            tests[at : at + 1] = [candidate(r, residual) for r, _ in parts]
        if len(leaves) == 1:
            break
        made = [(path, settings.step * residual[rows].sum() / (len(rows) + settings.penalty)) for rows, path in leaves]
        trees_made.append(made)
        pred, checked = pred + worth(made, x), checked + worth(made, checked_x)
        errors.append(((checked_y - checked) ** 2).mean())
        if len(errors) - 1 - int(np.argmin(errors)) >= settings.patience:
            break
    return y.mean(), trees_made, errors


def worth(tree, x):
    total = np.zeros(len(x))
    for path, value in tree:
        inside = np.ones(len(x), dtype=bool)
        for column, border, below in path:
            inside &= (x[:, column] <= border) == below
        total[inside] = value
    return total


@pytest.mark.parametrize("in_task", [8_192, 150])
def test_trees_equal_a_plain_booster(frame, panel, study, in_task):
    """Same trees, rounds and predictions with several models per job and a stop in training, whether a
    task grows whole trees or only small nodes."""
    settings = trees.TreeSettings(
        rounds=40, patience=3, leaves=5, step=0.3, row_share=1.0, column_share=1.0, bins=7,
        rows_per_leaf_per_bar=20, rows_per_block=300, rows_in_task=in_task, state_rounds=2,
    )
    found = trees.trees_out_of_sample(
        frame, study, INPUTS, "expanding", MONTHS, END, (H,), settings=settings
    ).toPandas()
    stops = []
    first = folds.monthly_folds(MONTHS, study, "expanding")[0]
    for fold in folds.monthly_folds(MONTHS, study, "expanding"):
        for coin in ("aa", "bb"):
            early = panel[(panel["coin"] == coin) & (panel["open_time"] >= first.train_start)]
            early = early[early["open_time"] < first.valid_start].dropna(subset=INPUTS)[INPUTS].to_numpy()
            ends = [-(-k * len(early) // settings.bins) - 1 for k in range(1, settings.bins + 1)]
            borders = [np.unique(np.sort(early[:, i])[ends]) for i in range(len(INPUTS))]
            part = parts_of(panel, fold, coin)
            data = {r: (part[r][INPUTS].to_numpy(), part[r][f"y_{H}"].to_numpy()) for r in ("train", "valid", "refit", "test")}
            least = settings.rows_per_leaf_per_bar * H
            _, _, errors = plain_booster(*data["train"], borders, *data["valid"], settings, least)
            best = int(np.argmin(errors)) + 1
            stops.append(len(errors) - best)
            mean, made, _ = plain_booster(*data["refit"], borders, *data["valid"], settings, least)
            expected = mean + sum(worth(tree, data["test"][0]) for tree in made[:best])
            ours = found[(found["coin"] == coin) & (found["test_month"] == fold.test_month)].sort_values("pos")
            assert set(ours["setting"]) == {f"trees={best}"}
            assert ours["pred"].to_numpy() == pytest.approx(expected, abs=1e-5)
    assert settings.patience in stops


def test_best_leaf_first_needs_no_order_of_the_answers():
    """Children that come late push known leaves out, never the other way round."""
    split = lambda gain: trees.Split(gain, 0, 0, 50, 1.0)
    growth = trees.Growth(leaves=4, least=10)
    growth.learn(0, 100, 0.0, split(5.0))
    growth.advance()
    assert growth.waiting == [1, 2]
    growth.learn(1, 50, 1.0, split(1.0))
    growth.learn(2, 50, -1.0, split(2.0))
    growth.advance()
    assert growth.chosen() == [0, 2, 1]
    late = growth.nodes[2].children[0]
    growth.learn(late, 50, 0.0, split(9.0))
    assert growth.chosen() == [0, 2, late]
    growth.advance()
    assert len(growth.table(lambda node: 0.0)[1]) == 7


def test_runs_leave_nothing_behind(spark):
    from pathlib import Path

    from tapegrid.session import Scratch, shared_folder

    base = Path(shared_folder(spark).removeprefix("file:")) / "tapegrid"
    count = lambda: len(list(base.glob("*"))) if base.exists() else 0
    before = count()
    with pytest.raises(RuntimeError), Scratch(spark) as scratch:
        kept, path = scratch.replace(spark.range(5).toDF("a"), None)
        later, _ = scratch.replace(kept.selectExpr("a + 1 AS a"), path)
        assert later.count() == 5 and count() == before + 1
        raise RuntimeError
    assert count() == before
