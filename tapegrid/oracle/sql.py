"""Common table expressions the checking queries are assembled from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tapegrid.config import EPS, RULES, Study
from tapegrid.schema import (
    asset_feature_names,
    excess_pairs,
    feature_names,
    har_inputs,
    label_names,
    model_inputs,
)

FIELDS = (
    "open", "high", "low", "close", "volume", "quote_volume", '"count"',
    "taker_buy_volume", "taker_buy_quote_volume",
)


class Query:
    """An ordered set of named expressions and a final select."""

    def __init__(self, parts: Mapping[str, str] | None = None):
        self.parts = dict(parts or {})

    def add(self, name: str, body: str) -> Query:
        return Query({**self.parts, name: body})

    def extend(self, other: Mapping[str, str]) -> Query:
        return Query({**self.parts, **other})

    def sql(self, final: str) -> str:
        named = ",\n".join(f"{n} AS ({b})" for n, b in self.parts.items())
        return f"WITH {named}\n{final}"

    def select(self, columns: str, source: str) -> str:
        """Final select; a column marked ``~`` is rounded to six digits."""
        return self.sql(f"SELECT {picks(columns)} FROM {source}")


def picks(columns: str, digits: int = 6) -> str:
    out = []
    for c in (c.strip() for c in columns.split(",")):
        out.append(f"round({c[1:]}, {digits}) + 0.0 AS {c[1:]}" if c.startswith("~") else c)
    return ", ".join(out)


def marked(names: Sequence[str]) -> str:
    return ", ".join(f"~{n}" for n in names)


# ---------------------------------------------------------------- bars

EVENT_TICKS = {
    "scale": "SELECT 3600::BIGINT AS w",
    "ticks": """SELECT event_type AS asset, (epoch_us(ts) // (w * 1000000))::BIGINT AS pos,
        value + 100 AS price, value AS qty,
        epoch_us(ts)::HUGEINT * 1000000000 + event_id AS ord,
        regexp_extract(props, '"k": *([0-9]+)', 1)::INT >= 10 AS traded,
        regexp_extract(props, '"k": *([0-9]+)', 1)::INT >= 50 AS bought
        FROM events, scale""",
}
LINE_TICKS = {
    "scale": "SELECT 86400::BIGINT AS w",
    "ticks": """SELECT unnest(['flag_' || lower(l_returnflag), 'status_' || lower(l_linestatus)])
        AS asset, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS pos,
        l_extendedprice / 1000 + 100 AS price, l_quantity AS qty,
        l_orderkey::HUGEINT * 1000 + l_linenumber AS ord,
        l_discount >= 0 AS traded, l_discount >= 0.05 AS bought FROM lineitem""",
}
RAW = """SELECT asset, pos, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, ord) AS close, sum(qty) AS volume, sum(qty * price) AS quote_volume,
    (count(*) FILTER (traded))::DOUBLE AS "count",
    coalesce(sum(qty) FILTER (bought), 0.0) AS taker_buy_volume,
    coalesce(sum(qty * price) FILTER (bought), 0.0) AS taker_buy_quote_volume
    FROM ticks GROUP BY asset, pos"""


def position(moment: str) -> str:
    return f"(epoch_us(TIMESTAMP '{moment}') // ((SELECT w FROM scale) * 1000000))"


def bars(ticks: Mapping[str, str], study: Study) -> Query:
    fields = ", ".join(f'CASE WHEN r."count" > 0 THEN r.{f} END AS {f}' for f in FIELDS)
    return Query(
        {
            **ticks,
            "raw": RAW,
            "places": f"""SELECT asset, unnest(range({position(study.grid_start)},
                (SELECT min(m) FROM (SELECT max(pos) AS m FROM raw GROUP BY asset)) + 1)) AS pos
                FROM (SELECT DISTINCT asset FROM raw)""",
            "bars": f"""SELECT p.asset, p.pos, make_timestamp(p.pos * w * 1000000) AS open_time,
                r."count" AS raw_count, {fields}
                FROM places p CROSS JOIN scale LEFT JOIN raw r ON r.asset = p.asset AND r.pos = p.pos""",
            "returns": """SELECT asset, pos, open_time, close,
                ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY pos)) AS r FROM bars""",
        }
    )


def extreme(study: Study, source: str = "returns") -> dict[str, str]:
    n = study.extreme_window
    return {
        "observed": f"""SELECT *, CASE WHEN count(*) OVER b = {n} THEN stddev_samp(r) OVER b END AS sd
            FROM {source} WHERE r IS NOT NULL
            WINDOW b AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)""",
        "extremes": f"SELECT * FROM observed WHERE abs(r) > {study.extreme_sigmas} * sd",
    }


AUDIT = {
    "audit": """SELECT b.asset, strftime(b.open_time, '%Y-%m') AS month, count(*) AS expected,
        count(raw_count) AS present, count(*) FILTER (raw_count IS NULL) AS missing,
        count(*) FILTER (raw_count = 0) AS zero_trade, count(e.pos) AS extreme
        FROM bars b LEFT JOIN extremes e ON e.asset = b.asset AND e.pos = b.pos
        GROUP BY 1, 2""",
}


def inside(window: tuple[str, str], time: str = "open_time") -> str:
    return f"({time} >= TIMESTAMP '{window[0]}' AND {time} < TIMESTAMP '{window[1]}')"


# ---------------------------------------------------------------- ranks and bootstrap


def ranks(source: str, keys: str, value: str, name: str, extra: str = "*") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    ties = f"PARTITION BY {keys}, {value}" if keys else f"PARTITION BY {value}"
    return f"""SELECT {extra}, rank() OVER ({part} ORDER BY {value})
        + (count(*) OVER ({ties}) - 1) / 2.0 AS {name} FROM {source}"""


def z(column: str, keys: str) -> str:
    return (
        f"({column} - avg({column}) OVER (PARTITION BY {keys})) / "
        f"nullif(stddev_pop({column}) OVER (PARTITION BY {keys}), 0)"
    )


def bootstrap(series: str, keys: str, value: str, study: Study, tag: str = "") -> dict[str, str]:
    """``resampled{tag}(keys, draw, mean, std)`` and ``se{tag}(keys, se)`` of a daily series."""

    def u(suffix: str = "") -> str:
        text = f"'{study.seed}|' || d || '|' || p" + (f" || '|{suffix}'" if suffix else "")
        return f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0"

    part = f"PARTITION BY {keys}" if keys else ""
    listed = f"{keys}, " if keys else ""
    return {
        f"numbered{tag}": f"""SELECT {listed}{value} AS v,
            row_number() OVER ({part} ORDER BY day) - 1 AS day_no,
            count(*) OVER ({part}) AS n FROM {series}""",
        f"draw_places{tag}": f"""SELECT n, d, unnest(range(n)) AS p FROM
            (SELECT DISTINCT n FROM numbered{tag}), range({study.draws}) t(d)""",
        f"starts{tag}": f"""SELECT n, d, p, CASE WHEN p = 0 OR {u()} < {1 / study.mean_block}
            THEN p END AS s, floor({u("first")} * n)::BIGINT AS f FROM draw_places{tag}""",
        f"picked{tag}": f"""SELECT n, d, (last_value(CASE WHEN s IS NOT NULL THEN f END IGNORE NULLS) OVER q
            + p - last_value(s IGNORE NULLS) OVER q) % n AS day_no FROM starts{tag}
            WINDOW q AS (PARTITION BY n, d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        f"resampled{tag}": f"""SELECT {listed}d, CASE WHEN min(v) = max(v) THEN min(v) ELSE avg(v) END AS mean,
            CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END AS std
            FROM picked{tag} JOIN numbered{tag} USING (n, day_no) GROUP BY {listed}d""",
        f"se{tag}": f"""SELECT {listed}CASE WHEN min(mean) = max(mean) THEN 0.0
            ELSE stddev_pop(mean) END AS se FROM resampled{tag} {f'GROUP BY {keys}' if keys else ''}""",
    }


def summary(series: str, keys: str, value: str, study: Study, tag: str = "", name: str = "ic") -> dict[str, str]:
    """``summary{tag}(keys, name, se, t, days)``."""
    means = f"""SELECT {f'{keys}, ' if keys else ''}avg({value}) AS m, count(*) AS days
        FROM {series} {f'GROUP BY {keys}' if keys else ''}"""
    join = f"JOIN se{tag} USING ({keys})" if keys else f"CROSS JOIN se{tag}"
    return {
        **bootstrap(series, keys, value, study, tag),
        f"summary{tag}": f"""SELECT {f'{keys}, ' if keys else ''}m AS {name}, se,
            CASE WHEN se > 1e-12 THEN m / se END AS t, days FROM ({means}) {join}""",
    }


# ---------------------------------------------------------------- features


def whole(aggregate: str, column: str, size: int) -> str:
    return f"CASE WHEN count({column}) OVER w{size} = {size} THEN {aggregate} OVER w{size} END"


def frames(sizes: Sequence[int], key: str) -> str:
    return ", ".join(
        f"w{n} AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in sorted(set(sizes))
    )


def features(query: Query, s: Study) -> Query:
    """Adds ``features(coin, pos, open_time, x_close, features, labels)``."""
    long = s.long_window
    line = "OVER (PARTITION BY asset ORDER BY pos)"
    first = [f"ln(close / (lag(close, 1) {line} + {EPS})) AS logret_1"]
    first += [f"ln(close / (lag(close, {n}) {line} + {EPS})) AS trail_ret_{n}" for n in s.lags]
    first += [f"ln(lead(close, {h}) {line} / (close + {EPS})) AS fwd_logret_{h}" for h in s.horizons]
    first += [
        f"taker_buy_volume / (volume + {EPS}) AS taker_buy_ratio_vol",
        f"taker_buy_quote_volume / (quote_volume + {EPS}) AS taker_buy_ratio_qv",
    ]
    second = [
        f"{whole('avg(logret_1)', 'logret_1', n)} AS roll_mean_logret_{n}" for n in s.mean_windows
    ]
    second += [
        f"{whole('stddev_pop(logret_1)', 'logret_1', long)} AS roll_vol_logret_{long}",
        f"(high - low) / (close + {EPS}) AS candle_range_pct",
        f"(close - open) / (close + {EPS}) AS candle_body_pct",
        f"(high - greatest(open, close)) / (close + {EPS}) AS upper_wick_pct",
        f"(least(open, close) - low) / (close + {EPS}) AS lower_wick_pct",
    ]
    for f in ("volume", "quote_volume", '"count"'):
        name = f.strip('"')
        second.append(f"ln(1 + {f}) AS {name}_log")
        mean, sd = whole(f"avg({f})", f, long), whole(f"stddev_pop({f})", f, long)
        second.append(f"({f} - ({mean})) / (({sd}) + {EPS}) AS {name}_z_{long}")
    for n in s.flow_windows:
        for k in ("vol", "qv"):
            c = f"taker_buy_ratio_{k}"
            second.append(f"{whole(f'avg({c})', c, n)} AS {c}_ma{n}")
    sizes = (*s.mean_windows, long, *s.flow_windows)
    labels = []
    for h in s.horizons:
        sigma = f"roll_vol_logret_{long} * sqrt({h})"
        labels += [
            f"{sigma} AS sigma_{h}",
            f"tanh(fwd_logret_{h} / ({sigma} + {EPS})) AS y_{h}",
        ]
    names = asset_feature_names(s)
    own = ", ".join(f"x.{n} AS x_{n}" for n in names)
    contexts = ", ".join(f"{c}.{n} AS {c}_{n}" for c in s.contexts for n in names)
    joins = " ".join(
        f"LEFT JOIN labelled {c} ON {c}.asset = '{c}' AND {c}.pos = x.pos" for c in s.contexts
    )
    targets = ", ".join(f"'{t}'" for t in s.targets)
    excess = [
        f"x_trail_ret_{n} - {c}_trail_ret_{n} AS x_minus_{c}_trail_ret_{n}"
        for c, n in excess_pairs(s)
    ]
    masked = [
        f"CASE WHEN {c}_logret_1 IS NOT NULL THEN x_logret_1 END AS _a_{c}, "
        f"CASE WHEN x_logret_1 IS NOT NULL THEN {c}_logret_1 END AS _b_{c}"
        for c in s.contexts
    ]
    moments = []
    for c in s.contexts:
        n = s.corr_window
        moments.append(
            f"CASE WHEN count(_a_{c}) OVER w{n} = {n} THEN covar_pop(_a_{c}, _b_{c}) OVER w{n} / "
            f"(stddev_pop(_a_{c}) OVER w{n} * stddev_pop(_b_{c}) OVER w{n} + {EPS}) END "
            f"AS corr_x_{c}_logret_{n}"
        )
        n = s.beta_window
        moments.append(
            f"CASE WHEN count(_a_{c}) OVER w{n} = {n} THEN covar_pop(_a_{c}, _b_{c}) OVER w{n} / "
            f"(stddev_pop(_b_{c}) OVER w{n} ** 2 + {EPS}) END AS beta_x_{c}_{n}"
        )
    everything = ", ".join([*feature_names(s), *label_names(s)])
    kept = ", ".join(f"x.{n}" for n in label_names(s))
    return query.extend(
        {
            "first_features": f"SELECT *, {', '.join(first)} FROM bars",
            "asset_features": f"""SELECT *, {', '.join(second)} FROM first_features
                WINDOW {frames(sizes, 'asset')}""",
            "labelled": f"SELECT *, {', '.join(labels)} FROM asset_features",
            "joined": f"""SELECT x.asset AS coin, x.pos, x.open_time, x.close AS x_close, {own},
                {contexts}, {kept} FROM labelled x {joins} WHERE x.asset IN ({targets})""",
            "paired": f"SELECT *, {', '.join(excess + masked)} FROM joined",
            "crossed": f"""SELECT *, {', '.join(moments)} FROM paired
                WINDOW {frames((s.corr_window, s.beta_window), 'coin')}""",
            "features": f"SELECT coin, pos, open_time, x_close, {everything} FROM crossed",
        }
    )


def volatility(query: Query, s: Study, horizons: Sequence[int]) -> Query:
    """Adds ``volatility(coin, pos, open_time, inputs, hour, log_rv, label per horizon)``."""
    sizes = (*s.har_windows, *horizons)
    sums = [f"{whole('sum(q)', 'q', n)} AS _s{n}" for n in sorted(set(sizes))]

    def half_log(n: int) -> str:
        return f"CASE WHEN _s{n} > 0 THEN 0.5 * ln(_s{n}) END"

    rv = [f"{half_log(n)} AS log_rv_{n}" for n in s.har_windows]
    ahead = [
        f"lead({half_log(h)}, {h}) OVER (PARTITION BY coin ORDER BY pos) AS _l{h}" for h in horizons
    ]
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*model_inputs(s), *har_inputs(s)])
    labels = ", ".join(f"CASE WHEN {known} THEN _l{h} END AS y_{h}" for h in horizons)
    inputs = ", ".join(["coin", "pos", "open_time", *model_inputs(s), "hour", *har_inputs(s)])
    return query.extend(
        {
            "steps": """SELECT *, (ln(x_close) - ln(lag(x_close) OVER
                (PARTITION BY coin ORDER BY pos))) ** 2 AS q FROM features""",
            "sums": f"SELECT *, {', '.join(sums)} FROM steps WINDOW {frames(sizes, 'coin')}",
            "trailed": f"""SELECT *, hour(open_time)::INT AS hour, {', '.join(rv + ahead)} FROM sums""",
            "volatility": f"SELECT {inputs}, {labels} FROM trailed",
        }
    )


# ---------------------------------------------------------------- walk-forward


def horizon_rows(source: str, inputs: Sequence[str], horizons: Sequence[int], realised: str) -> str:
    parts = [
        f"SELECT coin, {h} AS horizon, pos, open_time, {', '.join(inputs)}, y_{h} AS y, "
        f"{realised}_{h} AS fwd_logret FROM {source}"
        for h in horizons
    ]
    return " UNION ALL ".join(parts)


def folds(months: Sequence[str], s: Study, policy: str) -> str:
    rows = ", ".join(f"('{m}')" for m in months)
    start = f"TIMESTAMP '{s.train_start}'"
    end = "strptime(m || '-01', '%Y-%m-%d')"
    if policy == "fixed":
        end = f"TIMESTAMP '{min(months[0], s.research_months[0])}-01'"
    if policy == "rolling_3m":
        start = f"{end} - INTERVAL 3 MONTH"
    return f"""SELECT m AS test_month, {start} AS train_start, {end} - INTERVAL 1 MONTH AS valid_start,
        {end} AS train_end FROM (VALUES {rows}) t(m)"""


def known(end: str) -> str:
    return f"pos + horizon + 1 <= epoch_us({end}) // ((SELECT w FROM scale) * 1000000)"


def walk(
    query: Query,
    s: Study,
    inputs: Sequence[str],
    months: Sequence[str],
    end: str,
    policy: str = "expanding",
    source: str = "features",
    realised: str = "fwd_logret",
    horizons: Sequence[int] | None = None,
    tag: str = "",
) -> Query:
    """Adds ``rows``, ``folds``, ``fitting`` (with role flags) and ``tested``."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in inputs)
    listed = ", ".join(f"'{m}'" for m in months)
    return query.extend(
        {
            f"rows{tag}": horizon_rows(source, inputs, horizons or s.horizons, realised),
            f"folds{tag}": folds(months, s, policy),
            f"fitting{tag}": f"""SELECT f.test_month, r.*,
                open_time < valid_start AND y IS NOT NULL AND {known('valid_start')} AS train,
                open_time >= valid_start AND y IS NOT NULL AND {known('train_end')} AS valid,
                open_time >= valid_start AS threshold
                FROM rows{tag} r JOIN folds{tag} f ON open_time >= train_start AND open_time < train_end
                WHERE {complete}""",
            f"roles{tag}": f"""SELECT *, 'inner' AS role FROM fitting{tag} WHERE train
                UNION ALL SELECT *, 'refit' AS role FROM fitting{tag} WHERE train OR valid""",
            f"tested{tag}": f"""SELECT *, strftime(open_time, '%Y-%m') AS test_month FROM rows{tag}
                WHERE {complete} AND y IS NOT NULL AND {known(f"TIMESTAMP '{end}'")}
                AND strftime(open_time, '%Y-%m') IN ({listed})""",
        }
    )


def levels(model: str, predicted: str, tag: str = "") -> dict[str, str]:
    """Adds ``levels`` and ``predictions`` from a table ``model`` keyed by month and role."""
    key = "coin, horizon, test_month"
    return {
        f"scale_rows{tag}": f"""SELECT {key}, {predicted} AS pred FROM fitting{tag}
            JOIN {model} m USING ({key}) WHERE threshold AND role = 'refit'""",
        f"scales{tag}": f"""SELECT {key}, quantile_cont(pred, 0.1) AS q10, quantile_cont(pred, 0.3) AS q30,
            quantile_cont(pred, 0.5) AS q50, quantile_cont(pred, 0.7) AS q70,
            quantile_cont(pred, 0.9) AS q90 FROM scale_rows{tag} GROUP BY ALL""",
        f"valid_rows{tag}": f"""SELECT {key}, {predicted} AS pred, fwd_logret FROM fitting{tag}
            JOIN {model} m USING ({key}) WHERE valid AND role = 'inner'""",
        f"valid_a{tag}": ranks(f"valid_rows{tag}", key, "pred", "ra"),
        f"valid_b{tag}": ranks(f"valid_a{tag}", key, "fwd_logret", "rb"),
        f"skills{tag}": f"SELECT {key}, corr(ra, rb) AS valid_ic FROM valid_b{tag} GROUP BY ALL",
        f"predictions{tag}": f"""SELECT coin, horizon, pos, open_time, {predicted} AS pred, y, fwd_logret,
            test_month, q10, q30, q50, q70, q90, valid_ic, setting FROM tested{tag}
            JOIN {model} m USING ({key}) JOIN scales{tag} USING ({key}) LEFT JOIN skills{tag} USING ({key})
            WHERE role = 'refit'""",
    }


def momentum(query: Query, s: Study, tag: str = "") -> Query:
    cases = " ".join(f"WHEN {h} THEN x_trail_ret_{h}" for h in s.horizons)
    x = f"(CASE horizon {cases} END)"
    key = "coin, horizon, test_month, role"
    return query.extend(
        {
            f"model{tag}": f"""SELECT {key}, regr_slope(y, {x}) AS slope, regr_intercept(y, {x})
                AS intercept, 'slope=' || format('{{:+.3g}}', regr_slope(y, {x})) AS setting
                FROM roles{tag} GROUP BY ALL""",
            **levels(f"model{tag}", f"(intercept + slope * {x})", tag),
        }
    )


def best_feature(query: Query, s: Study, inputs: Sequence[str], tag: str = "") -> Query:
    listed = ", ".join(inputs)
    names = ", ".join(f"'{n}'" for n in inputs)
    key = "coin, horizon, test_month, role"
    return query.extend(
        {
            f"long{tag}": f"""SELECT {key}, y, unnest(range({len(inputs)})) AS place,
                unnest([{listed}]) AS x FROM roles{tag}""",
            f"long_a{tag}": ranks(f"long{tag}", f"{key}, place", "x", "rx"),
            f"long_b{tag}": ranks(f"long_a{tag}", f"{key}, place", "y", "ry"),
            f"rho{tag}": f"""SELECT {key}, place, CASE WHEN stddev_pop(rx) > 0 THEN corr(rx, ry) END
                AS spearman, regr_slope(y, x) AS slope,
                regr_intercept(y, x) AS intercept FROM long_b{tag} GROUP BY ALL""",
            f"model{tag}": f"""SELECT {key}, place, slope, intercept,
                list_extract([{names}], (place + 1)::BIGINT) AS setting FROM rho{tag}
                QUALIFY row_number() OVER (PARTITION BY {key}
                ORDER BY round(abs(spearman), 12) DESC NULLS LAST, place) = 1""",
            **levels(
                f"model{tag}",
                f"(intercept + slope * list_extract([{listed}], (place + 1)::BIGINT))",
                tag,
            ),
        }
    )


def har(query: Query, s: Study, tag: str = "") -> Query:
    """Three-input least squares by Cramer's rule on centred products."""
    a, b, c = har_inputs(s)
    key = "coin, horizon, test_month, role"
    pair = lambda p, q: f"covar_pop({p}, {q})"
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    one = f"((ay * (bb * cc - bc * bc) - ab * (bs * cc - bc * cy) + ac * (bs * bc - bb * cy)) / {det})"
    two = f"((aa * (bs * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bs * ac)) / {det})"
    three = f"((aa * (bb * cy - bs * bc) - ab * (ab * cy - bs * ac) + ay * (ab * bc - bb * ac)) / {det})"
    return query.extend(
        {
            f"products{tag}": f"""SELECT {key}, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc,
                avg(y) AS my, {pair(a, a)} AS aa, {pair(a, b)} AS ab, {pair(a, c)} AS ac,
                {pair(b, b)} AS bb, {pair(b, c)} AS bc, {pair(c, c)} AS cc, {pair(a, 'y')} AS ay,
                {pair(b, 'y')} AS bs, {pair(c, 'y')} AS cy FROM roles{tag} GROUP BY ALL""",
            f"solved{tag}": f"""SELECT *, {one} AS w1, {two} AS w2, {three} AS w3 FROM products{tag}""",
            f"model{tag}": f"""SELECT {key}, w1, w2, w3, my - w1 * ma - w2 * mb - w3 * mc AS intercept,
                'slopes=' || printf('%.2f,%.2f,%.2f', w1, w2, w3) AS setting FROM solved{tag}""",
            **levels(f"model{tag}", f"(intercept + w1 * {a} + w2 * {b} + w3 * {c})", tag),
        }
    )


# ---------------------------------------------------------------- scoring and strategies

CENTRED = "CASE WHEN q90 - q10 > 0 THEN (pred - q50) / (q90 - q10) END"


def centred(column: str) -> str:
    return f"CASE WHEN q90 - q10 > 0 THEN ({column} - q50) / (q90 - q10) END"


def daily_ic(source: str, keys: str, tag: str = "") -> dict[str, str]:
    """Adds ``products{tag}`` and ``daily{tag}(keys, day, ic)``."""
    return {
        f"signal{tag}": f"SELECT *, {CENTRED} AS s FROM {source}",
        f"pairs{tag}": f"SELECT * FROM signal{tag} WHERE s IS NOT NULL AND fwd_logret IS NOT NULL",
        f"rank_a{tag}": ranks(f"pairs{tag}", keys, "s", "ra"),
        f"rank_b{tag}": ranks(f"rank_a{tag}", keys, "fwd_logret", "rb"),
        f"products{tag}": f"SELECT *, {z('ra', keys)} * {z('rb', keys)} AS product FROM rank_b{tag}",
        f"daily{tag}": f"""SELECT {', '.join('d.' + k.strip() for k in keys.split(','))}, d.day,
            coalesce(p.ic, 0.0) AS ic
            FROM (SELECT DISTINCT {keys}, open_time::DATE AS day FROM {source}) d LEFT JOIN
            (SELECT {keys}, open_time::DATE AS day, avg(product) AS ic FROM products{tag} GROUP BY ALL) p
            USING ({keys}, day)""",
    }


def period_bars(s: Study, period: str, funding: str) -> dict[str, str]:
    months, end = s.periods[period]
    targets = ", ".join(f"'{t}'" for t in s.targets)
    return {
        "settled": funding,
        f"priced_{period}": f"""SELECT asset AS coin, pos, open_time, close,
            last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
            FROM bars WHERE asset IN ({targets})
            AND open_time >= TIMESTAMP '{months[0]}-01' AND open_time < TIMESTAMP '{end}'""",
        f"moves_{period}": f"""SELECT p.*, coalesce(filled / lag(filled) OVER
            (PARTITION BY coin ORDER BY p.pos) - 1, 0.0) AS bar_return, coalesce(rate, 0.0) AS rate
            FROM priced_{period} p LEFT JOIN settled f ON f.asset = p.coin AND f.pos = p.pos""",
        f"closes_{period}": f"""SELECT coin, open_time::DATE AS day, arg_max(filled, pos) AS close,
            FROM priced_{period} WHERE filled IS NOT NULL GROUP BY ALL""",
        f"hold_{period}": f"""SELECT coin, day, close / coalesce(lag(close) OVER
            (PARTITION BY coin ORDER BY day), (SELECT arg_min(filled, pos) FROM priced_{period} q
            WHERE q.coin = c.coin)) - 1 AS hold FROM closes_{period} c""",
    }


def rule_case(rule: str) -> str:
    low, high = RULES[rule]
    return (
        f"CASE WHEN {CENTRED} > {centred(high)} THEN 1 WHEN {CENTRED} < {centred(low)} THEN -1 ELSE 0 END"
    )


def strategy(
    source: str, s: Study, period: str, rules: Sequence[str], delays: Sequence[int], keys: str,
    horizons: Sequence[int], tag: str = "",
) -> dict[str, str]:
    """Adds ``pnl{tag}`` per bar and ``flows{tag}`` per day for every rule and delay."""
    cases = " ".join(f"WHEN '{r}' THEN {rule_case(r)}" for r in rules)
    listed = ", ".join(f"('{r}')" for r in rules)
    late = ", ".join(f"({d})" for d in delays)
    averaged = " ".join(
        f"WHEN {h} THEN sum(sig) OVER (PARTITION BY {keys}, rule ORDER BY pos "
        f"ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) / {h}.0"
        for h in horizons
    )
    configs = f"(SELECT DISTINCT {keys} FROM {source})"
    return {
        f"cells{tag}": f"""SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, m.pos,
            m.open_time, m.bar_return, m.rate, t.rule, CASE t.rule {cases} END AS sig
            FROM moves_{period} m JOIN {configs} c ON c.coin = m.coin
            CROSS JOIN (VALUES {listed}) t(rule)
            LEFT JOIN {source} p ON p.pos = m.pos AND
            {' AND '.join(f'p.{k.strip()} = c.{k.strip()}' for k in keys.split(','))}""",
        f"tranches{tag}": f"SELECT *, CASE horizon {averaged} END AS base FROM cells{tag}",
        f"delayed{tag}": f"""SELECT t.*, delay, coalesce(CASE delay WHEN 0 THEN base ELSE
            lag(base, 1) OVER (PARTITION BY {keys}, rule, delay ORDER BY pos) END, 0.0) AS position
            FROM tranches{tag} t CROSS JOIN (VALUES {late}) d(delay)""",
        f"held{tag}": f"""SELECT *, coalesce(lag(position) OVER q, 0.0) AS held,
            lead(pos) OVER q IS NULL AS is_last FROM delayed{tag}
            WINDOW q AS (PARTITION BY {keys}, rule, delay ORDER BY pos)""",
        f"pnl{tag}": f"""SELECT *, held * bar_return AS gross, held * rate AS funding,
            abs(position - held) + CASE WHEN is_last THEN abs(position) ELSE 0 END AS turnover
            FROM held{tag}""",
        f"flows{tag}": f"""SELECT {keys}, rule, delay, open_time::DATE AS day, sum(gross) AS gross,
            sum(funding) AS funding, sum(turnover) AS turnover, count(*) AS bars,
            count(*) FILTER (position <> 0) AS open_bars,
            sum(greatest(position, 0.0)) AS long_exposure, sum(abs(position)) AS exposure
            FROM pnl{tag} GROUP BY ALL""",
    }


def with_fees(flows: str, s: Study) -> str:
    rows = ", ".join(f"('{n}', {b})" for n, b in s.fees_bps)
    return f"""SELECT f.*, fee, bps / 1e4 * turnover AS fees,
        gross - bps / 1e4 * turnover - funding AS net FROM {flows} f CROSS JOIN (VALUES {rows}) t(fee, bps)"""


def stats(daily: str, keys: str, s: Study, tag: str = "") -> dict[str, str]:
    """Adds ``stats{tag}`` with the strategy statistics of a daily table."""
    return {
        **summary(daily, keys, "gross", s, f"{tag}_g", "g"),
        **bootstrap(daily, keys, "net", s, f"{tag}_n"),
        f"ratios{tag}": f"""SELECT {keys}, CASE WHEN std > 0 THEN sqrt(365) * mean / std
            WHEN mean > 0 THEN 'Infinity'::DOUBLE WHEN mean < 0 THEN '-Infinity'::DOUBLE END AS r
            FROM resampled{tag}_n""",
        f"ends{tag}": f"""SELECT {keys}, quantile_cont(r, 0.05) AS sharpe_low,
            quantile_cont(r, 0.95) AS sharpe_high FROM ratios{tag} GROUP BY ALL""",
        f"equity{tag}": f"""SELECT {keys}, day, sum(net) OVER q AS e FROM {daily}
            WINDOW q AS (PARTITION BY {keys} ORDER BY day)""",
        f"falls{tag}": f"""SELECT {keys}, greatest(max(e) OVER q, 0) - e AS fall FROM equity{tag}
            WINDOW q AS (PARTITION BY {keys} ORDER BY day)""",
        f"drawdown{tag}": f"SELECT {keys}, max(fall) AS max_drawdown FROM falls{tag} GROUP BY ALL",
        f"base{tag}": f"""SELECT {keys}, avg(gross) * 1e4 AS gross_bps_day, avg(net) * 1e4 AS net_bps_day,
            CASE WHEN stddev_samp(net) > 0 THEN sqrt(365) * avg(net) / stddev_samp(net) END AS sharpe,
            avg(turnover) AS turnover_day, CASE WHEN sum(turnover) > 0 THEN
            (sum(gross) - sum(funding)) / sum(turnover) * 1e4 END AS breakeven_bps
            FROM {daily} GROUP BY ALL""",
        f"stats{tag}": f"""SELECT b.*, g.t AS gross_t, sharpe_low, sharpe_high, max_drawdown
            FROM base{tag} b LEFT JOIN summary{tag}_g g USING ({keys}) LEFT JOIN ends{tag} USING ({keys})
            LEFT JOIN drawdown{tag} USING ({keys})""",
    }


STATS = (
    "~gross_bps_day, ~gross_t, ~net_bps_day, ~sharpe, ~sharpe_low, ~sharpe_high, ~max_drawdown, "
    "~turnover_day, ~breakeven_bps"
)
EXPOSURE = "~beta, ~buy_and_hold_bps_day, ~time_in_market, ~long_share"


def exposure(daily: str, hold: str, keys: str, tag: str = "") -> dict[str, str]:
    return {
        f"exposure{tag}": f"""SELECT {keys}, covar_samp(net, hold) / nullif(var_samp(hold), 0) AS beta,
            avg(hold) * 1e4 AS buy_and_hold_bps_day, sum(open_bars)::DOUBLE / sum(bars) AS time_in_market,
            sum(long_exposure) / nullif(sum(exposure), 0) AS long_share
            FROM {daily} LEFT JOIN {hold} USING (coin, day) GROUP BY ALL""",
    }
