"""Ingest, grid, return-statistic and feature queries over the event bars (and file-level checks)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid import schema
from tapegrid.functions.columns import between, month_of
from tapegrid.operators import features as feat
from tapegrid.operators import grid as gridding
from tapegrid.operators import returns as ret
from tapegrid.oracle import sql as o
from tapegrid.plans.catalog import query
from tapegrid.plans.studies import EVENTS, events_lab
from tapegrid.session import prepare, shared_folder
from tapegrid.sources import derived, files, store
from tapegrid.streaming import ingest

S = EVENTS
BARS = o.bars(o.EVENT_TICKS, S)
AUDITED = BARS.extend(o.extreme(S)).extend(o.AUDIT)
FEATURED = o.features(BARS, S)
TARGETS = ", ".join(f"'{t}'" for t in S.targets)
CALM = f"NOT {o.inside(S.event_window)}"
FUNDING_TEXT = """SELECT event_type AS asset, epoch_us(ts) // 28800000000 AS bucket,
    (epoch_us(ts) // 28800000000) * 28800000 + min(event_id) % 20 AS calc_time,
    (avg(value) - 50) / 9973 AS rate FROM events GROUP BY event_type, epoch_us(ts) // 28800000000"""
FUNDING = """SELECT asset, (calc_time // (w * 1000))::BIGINT AS pos, arg_min(rate, bucket) AS rate
    FROM (SELECT f.*, w FROM settlements f, scale) GROUP BY ALL"""


def day_close(source: str, condition: str = "true") -> str:
    return f"""SELECT asset, open_time::DATE AS day, arg_max(close, pos) FILTER (close IS NOT NULL) AS close
        FROM {source} WHERE {condition} GROUP BY ALL"""


DAILY_RETURNS = """SELECT asset, day, close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1 AS ret
    FROM day_closes"""


# ---------------------------------------------------------------- A: sources

UNIVERSE = [("flag_a", "A", None), ("flag_n", "N", "1996-03-10"), ("flag_r", "R", "1995-06-01")]
MONTHS = """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(
    date_trunc('month', (SELECT min(l_shipdate) FROM lineitem))::TIMESTAMP,
    date_trunc('month', (SELECT max(l_shipdate) FROM lineitem))::TIMESTAMP, INTERVAL 1 MONTH)) AS m)"""
EXPECTED = """SELECT asset, pair, month FROM months CROSS JOIN (VALUES ('flag_a', 'A', ''),
    ('flag_n', 'N', '1996-03'), ('flag_r', 'R', '1995-06')) t(asset, pair, first_month)
    WHERE month >= first_month"""


def ship_months(spark: SparkSession, folder: str) -> DataFrame:
    lines = derived.read(spark, folder, "lineitem")
    ends = lines.agg(
        month_of(F.min("l_shipdate")).alias("first"), month_of(F.max("l_shipdate")).alias("last")
    ).first()
    return files.month_range(spark, ends["first"], ends["last"])


@query("month_range", o.Query({"months": MONTHS}).sql("SELECT month FROM months"))
def _(spark, folder):
    prepare(spark)
    return ship_months(spark, folder)


@query("expected_months", o.Query({"months": MONTHS}).add("expected", EXPECTED).sql("SELECT * FROM expected"))
def _(spark, folder):
    prepare(spark)
    return files.months_for(ship_months(spark, folder), UNIVERSE)


@query(
    "month_coverage",
    o.Query({"months": MONTHS})
    .add("expected", EXPECTED)
    .sql("""SELECT e.*, p.pair IS NOT NULL AS present FROM expected e LEFT JOIN (SELECT DISTINCT
        l_returnflag AS pair, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem
        WHERE l_extendedprice > 104000) p ON p.pair = e.pair AND p.month = e.month"""),
)
def _(spark, folder):
    """Pair-months with at least one large line stand in for published files."""
    prepare(spark)
    present = (
        derived.read(spark, folder, "lineitem")
        .where(F.col("l_extendedprice") > 104_000)
        .select(F.col("l_returnflag").alias("pair"), month_of("l_shipdate").alias("month"))
        .distinct()
    )
    return files.coverage(files.months_for(ship_months(spark, folder), UNIVERSE), present)


@query(
    "digest_check",
    """SELECT doc_id::VARCHAR AS path, sha256(text) AS digest, expected FROM (SELECT doc_id, text,
        CASE WHEN lang = 'en' THEN sha256(text) ELSE sha256(text || 'x') END AS expected FROM documents)
        WHERE sha256(text) <> expected""",
)
def _(spark, folder):
    """Whole document texts against a manifest that is wrong for every other language."""
    prepare(spark)
    docs = derived.read(spark, folder, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    wrong = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("x")))
    manifest = docs.select(
        path, F.concat(F.sha2(wrong, 256), F.lit("  "), "source").alias("checksum")
    )
    contents = docs.select(path, F.col("text").cast("binary").alias("content"))
    return files.digest_mismatches(contents, manifest)


def event_kline_text(spark: SparkSession, folder: str, bar_seconds: int) -> DataFrame:
    """One raw kline line per event: bars repeat, and some lines are header lines."""
    events = derived.read(spark, folder, "events")
    opened = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bar_seconds * 1_000_000))
    k = F.get_json_object("props", "$.k").cast("int")
    millis = (opened * (bar_seconds * 1_000)).cast("long").cast("string")
    price = (F.col("value") + 100).cast("string")
    return events.select(
        F.when(k == 0, F.lit("open_time")).otherwise(millis).alias("open_time"),
        *[price.alias(f) for f in ("open", "high", "low", "close")],
        *[
            F.col("value").cast("string").alias(f)
            for f in schema.BAR_FIELDS
            if f not in ("open", "high", "low", "close")
        ],
        F.col("event_type").alias("pair"),
        F.struct("ts", "event_id").alias("_place"),
    )


@query(
    "kline_rows",
    o.Query({"scale": o.EVENT_TICKS["scale"]}).sql(
        """SELECT event_type AS asset, pos, make_timestamp(pos * w * 1000000) AS open_time,
        round(arg_min(value, ord) + 100, 6) + 0.0 AS close, round(arg_min(value, ord), 6) + 0.0 AS volume
        FROM (SELECT *, w, (epoch_us(ts) // (w * 1000000))::BIGINT AS pos,
        epoch_us(ts)::HUGEINT * 1000000000 + event_id AS ord FROM events, scale
        WHERE regexp_extract(props, '"k": *([0-9]+)', 1)::INT <> 0)
        WHERE event_type <> 'view' OR pos * w >= epoch(TIMESTAMP '2024-01-05')
        GROUP BY event_type, pos, w"""
    ),
)
def _(spark, folder):
    """Header lines dropped, first line per open time, one asset cut at its first bar."""
    lab = events_lab(spark, folder)
    text = event_kline_text(spark, folder, lab.study.bar_seconds)
    universe = [(a, a, "2024-01-05" if a == "view" else None) for a in lab.study.assets]
    rows = files.clean_klines(text, universe, lab.study)
    return rows.select("asset", "pos", "open_time", "close", "volume")


@query(
    "funding_rows",
    o.Query({"scale": o.EVENT_TICKS["scale"], "settlements": FUNDING_TEXT})
    .add("settled", FUNDING)
    .sql("""SELECT asset, pos, make_timestamp(pos * w * 1000000) AS open_time,
        round(rate * 10000, 5) + 0.0 AS bps FROM settled, scale"""),
)
def _(spark, folder):
    rows = events_lab(spark, folder).funding
    return rows.select("asset", "pos", "open_time", F.round(F.col("rate") * 10_000, 5).alias("bps"))


BAR_COLUMNS = (
    "asset, pos, ~open, ~high, ~low, ~close, ~volume, ~quote_volume, ~count, ~taker_buy_volume, "
    "~taker_buy_quote_volume"
)


def bar_columns(df: DataFrame) -> DataFrame:
    return df.select("asset", "pos", *schema.BAR_FIELDS)


def _quoted(columns: str) -> str:
    return o.picks(columns).replace("round(count, 6) + 0.0 AS count", 'round("count", 6) + 0.0 AS "count"')


@query("raw_bars", BARS.sql(f"SELECT {_quoted(BAR_COLUMNS)} FROM raw"))
def _(spark, folder):
    return bar_columns(events_lab(spark, folder).raw)


@query("kline_files", BARS.sql(f"SELECT {_quoted(BAR_COLUMNS)} FROM raw"))
def _(spark, folder):
    """Bars written as headerless text per pair and read back through the kline reader."""
    lab = events_lab(spark, folder)
    pairs = [(a, f"{a.upper()}USD") for a in lab.study.assets]
    root = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    path = files.write_kline_files(lab.raw, root, pairs)
    universe = [(a, p, None) for a, p in pairs]
    return bar_columns(files.read_partitioned_klines(spark, path, universe, lab.study))


@query("incremental_ingest", BARS.sql(f"SELECT {_quoted(BAR_COLUMNS)} FROM raw"))
def _(spark, folder):
    """The same files through the file stream."""
    lab = events_lab(spark, folder)
    pairs = [(a, f"{a.upper()}USD") for a in lab.study.assets]
    root = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    path = files.write_kline_files(lab.raw, root, pairs)
    ingest.ingest_new_files(spark, f"{path}/*", f"{root}/table", f"{root}/checkpoint")
    universe = [(a, f"pair={p}", None) for a, p in pairs]
    return bar_columns(ingest.ingested_bars(spark, f"{root}/table", universe, lab.study))


@query(
    "bars_before",
    BARS.sql(f"""SELECT {_quoted(BAR_COLUMNS)} FROM bars
        WHERE open_time < TIMESTAMP '2024-01-15'"""),
)
def _(spark, folder):
    """Filtered scan of stored bars."""
    lab = events_lab(spark, folder)
    path = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    store.save(lab.grid, path, ["asset"])
    return bar_columns(files.bars_before(spark, path, "2024-01-15"))


@query(
    "result_table",
    """SELECT o_orderpriority AS asset, strftime(o_orderdate, '%Y-%m') AS month,
        round(avg(o_totalprice), 2) + 0.0 AS mean_price, round(stddev_pop(o_totalprice), 2) + 0.0 AS spread
        FROM orders GROUP BY ALL""",
)
def _(spark, folder):
    """A rounded result table written as CSV and read back."""
    prepare(spark)
    table = (
        derived.read(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), month_of("o_orderdate").alias("month"))
        .agg(F.avg("o_totalprice").alias("mean_price"), F.stddev_pop("o_totalprice").alias("spread"))
    )
    path = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    store.write_table(table, path, 2)
    text = "asset string, month string, mean_price double, spread double"
    return spark.read.schema(text).csv(path, header=True)


# ---------------------------------------------------------------- B: grid and audit


@query("grid_bars", BARS.sql(f"SELECT {_quoted(BAR_COLUMNS)} FROM bars"))
def _(spark, folder):
    return bar_columns(events_lab(spark, folder).grid)


@query("traded_bars", BARS.sql(f'SELECT {_quoted(BAR_COLUMNS)} FROM raw WHERE "count" > 0'))
def _(spark, folder):
    return bar_columns(gridding.drop_halts(events_lab(spark, folder).raw))


SEAMS = BARS.extend(
    {
        "traded": 'SELECT *, make_timestamp(pos * w * 1000000) AS opened FROM raw, scale WHERE "count" > 0',
        "gaps": """SELECT asset, lag(opened) OVER q AS last_bar_before, opened AS first_bar_after,
            pos - lag(pos) OVER q - 1 AS bars_between, close / lag(close) OVER q AS price_ratio
            FROM traded WINDOW q AS (PARTITION BY asset ORDER BY pos)""",
        "seams": f"""SELECT * FROM gaps WHERE bars_between > 0
            AND (price_ratio > {S.seam_ratio} OR price_ratio < {1 / S.seam_ratio})""",
    }
)


@query("price_seams", SEAMS.select("asset, last_bar_before, first_bar_after, bars_between, ~price_ratio", "seams"))
def _(spark, folder):
    lab = events_lab(spark, folder)
    return gridding.find_seams(lab.raw, lab.study)


@query(
    "late_seams",
    SEAMS.select(
        "asset, last_bar_before, first_bar_after, bars_between, ~price_ratio",
        f"seams WHERE first_bar_after >= TIMESTAMP '{S.train_start}'",
    ),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return gridding.late_seams(gridding.find_seams(lab.raw, lab.study), lab.study)


@query("bar_audit", AUDITED.sql("SELECT * FROM audit"))
def _(spark, folder):
    lab = events_lab(spark, folder)
    return gridding.audit_bars(lab.raw, lab.study)


@query(
    "audit_totals",
    AUDITED.extend({k: v for k, v in SEAMS.parts.items() if k not in AUDITED.parts}).sql(
        """SELECT asset, sum(missing)::BIGINT AS missing, sum(zero_trade)::BIGINT AS zero_trade,
        sum(extreme)::BIGINT AS extreme, coalesce(any_value(n), 0) AS seams FROM audit LEFT JOIN
        (SELECT asset, count(*) AS n FROM seams GROUP BY asset) USING (asset) GROUP BY asset"""
    ),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    audit = gridding.audit_bars(lab.raw, lab.study)
    return gridding.audit_totals(audit, gridding.find_seams(lab.raw, lab.study))


@query("extreme_bars", AUDITED.sql("SELECT asset, pos, open_time, round(r, 6) + 0.0 AS log_return FROM extremes"))
def _(spark, folder):
    lab = events_lab(spark, folder)
    return gridding.extreme_returns(lab.returns, lab.study)


@query(
    "event_rows",
    BARS.sql(f"""SELECT asset, pos, round(close, 6) + 0.0 AS close FROM bars
        WHERE {o.inside(S.event_window)}"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return lab.grid.where(ret.in_event(lab.study)).select("asset", "pos", "close")


# ---------------------------------------------------------------- C: return statistics


@query("log_returns", BARS.sql("SELECT asset, pos, round(r, 6) + 0.0 AS log_return FROM returns"))
def _(spark, folder):
    return events_lab(spark, folder).returns.select("asset", "pos", "log_return")


def wide_sql(source: str, names, value: str, by: str, key: str = "asset") -> str:
    cells = ", ".join(f"max({value}) FILTER ({key} = '{n}') AS {n}" for n in names)
    return f"SELECT {by}, {cells} FROM {source} GROUP BY {by}"


def matrix_sql(source: str, names, label: str) -> str:
    lines = []
    for a in names:
        cells = ", ".join(
            f"1.0::DOUBLE AS {b}" if a == b else f"round(corr({a}, {b}), 6) + 0.0 AS {b}" for b in names
        )
        lines.append(f"SELECT '{a}' AS {label}, {cells} FROM {source}")
    return " UNION ALL ".join(lines)


WIDE = BARS.add("wide", wide_sql("returns", S.assets, "r", "pos, open_time"))


@query("return_correlation", WIDE.sql(matrix_sql("wide", S.assets, "asset")))
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.return_correlation(lab.returns, lab.study.assets)


def rolling_correlation_sql() -> str:
    m = S.benchmark
    width = f"(SELECT (86400 // w * {S.benchmark_days}) FROM scale)"
    least = f"(SELECT (86400 // w * {S.benchmark_min_days}) FROM scale)"
    masked = ", ".join(
        f"CASE WHEN {m} IS NOT NULL THEN {t} END AS a_{t}, CASE WHEN {t} IS NOT NULL THEN {m} END AS b_{t}"
        for t in S.targets
    )
    cells = ", ".join(
        f"CASE WHEN count(a_{t}) OVER q >= {least} THEN corr(a_{t}, b_{t}) OVER q END AS c_{t}"
        for t in S.targets
    )
    last = ", ".join(
        f"round(arg_max(c_{t}, pos) FILTER (c_{t} IS NOT NULL), 6) + 0.0 AS {t}" for t in S.targets
    )
    return (
        WIDE.add("masked", f"SELECT pos, open_time, {masked} FROM wide")
        .add(
            "rolled",
            f"""SELECT pos, open_time, {cells} FROM masked WINDOW q AS (ORDER BY pos
            RANGE BETWEEN ({width} - 1) PRECEDING AND CURRENT ROW)""",
        )
        .sql(
            f"""SELECT open_time::DATE AS day, {last} FROM rolled GROUP BY open_time::DATE
            HAVING {" OR ".join(f"count(c_{t}) > 0" for t in S.targets)}"""
        )
    )


@query("rolling_benchmark_correlation", rolling_correlation_sql())
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.rolling_benchmark_correlation(lab.returns, lab.study)


def lead_lag_sql() -> str:
    names = (*S.targets, S.benchmark)
    calm = ", ".join(f"CASE WHEN {CALM} THEN {n} END AS {n}" for n in names)
    shifts = range(-S.lead_lag, S.lead_lag + 1)

    def moved(s: int) -> str:
        call = f"lag({S.benchmark}, {s})" if s >= 0 else f"lead({S.benchmark}, {-s})"
        return f"{call} OVER (ORDER BY pos) AS m{s + S.lead_lag}"

    lines = " UNION ALL ".join(
        f"SELECT {s}::INT AS benchmark_lead_bars, "
        + ", ".join(f"round(corr({t}, m{s + S.lead_lag}), 6) + 0.0 AS {t}" for t in S.targets)
        + " FROM shifted"
        for s in shifts
    )
    return (
        WIDE.add("calm", f"SELECT pos, {calm} FROM wide")
        .add("shifted", f"SELECT *, {', '.join(moved(s) for s in shifts)} FROM calm")
        .sql(lines)
    )


@query("lead_lag", lead_lag_sql())
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.lead_lag(lab.returns, lab.study)


@query(
    "autocorrelation",
    BARS.extend(
        {
            "calm": f"SELECT * FROM returns WHERE {CALM}",
            "calm_ranks": f"""SELECT *, CASE WHEN r IS NOT NULL THEN
                rank() OVER (PARTITION BY asset ORDER BY r NULLS LAST)
                + (count(*) OVER (PARTITION BY asset, r) - 1) / 2.0 END AS k FROM calm""",
            "one": """SELECT asset, corr(r, b) AS v FROM (SELECT asset, r, lag(r) OVER
                (PARTITION BY asset ORDER BY pos) AS b FROM returns) GROUP BY asset""",
            "two": """SELECT asset, corr(r, b) AS v, corr(k, c) AS u FROM (SELECT asset, r, k, lag(r) OVER q
                AS b, lag(k) OVER q AS c FROM calm_ranks WINDOW q AS (PARTITION BY asset ORDER BY pos))
                GROUP BY asset""",
        }
    ).sql("""SELECT asset, round(one.v, 6) + 0.0 AS lag1, round(two.v, 6) + 0.0 AS lag1_without_event,
        round(u, 6) + 0.0 AS lag1_rank_without_event FROM one JOIN two USING (asset)"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.autocorrelation(lab.returns, lab.study)


@query(
    "daily_volatility",
    BARS.add(
        "spread",
        f"""SELECT asset, open_time::DATE AS day, stddev_samp(r) * sqrt(86400.0 / any_value(w)) AS v
        FROM returns, scale WHERE asset IN ({TARGETS}) GROUP BY ALL""",
    )
    .add("table1", wide_sql("spread", S.targets, "v", "day"))
    .sql(f"""SELECT day, {", ".join(f"round({t}, 6) + 0.0 AS {t}" for t in S.targets)} FROM table1
        WHERE {" OR ".join(f"{t} IS NOT NULL" for t in S.targets)}"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.daily_volatility(lab.returns, lab.study)


@query(
    "weekly_volatility",
    BARS.sql(f"""SELECT asset, (DATE '2024-01-01' + ((open_time::DATE - DATE '2024-01-01') // 7 * 7)::INT)::DATE
        AS week, round(stddev_samp(r) * 1e4, 6) + 0.0 AS volatility_bps FROM returns
        WHERE asset IN ({TARGETS}) GROUP BY 1, 2"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.weekly_volatility(lab.returns, lab.study)


WEEKS_HOURS = BARS.extend(
    {
        "weeks": f"""SELECT asset, (DATE '2024-01-01' + ((open_time::DATE - DATE '2024-01-01') // 7 * 7)::INT)::DATE
            AS week, stddev_samp(r) * 1e4 AS v FROM returns WHERE asset IN ({TARGETS}) GROUP BY 1, 2""",
        "hours": f"""SELECT asset, hour(open_time)::INT AS hour, stddev_samp(r) * 1e4 AS v FROM returns
            WHERE asset IN ({TARGETS}) AND {CALM} GROUP BY 1, 2""",
    }
)


@query(
    "hourly_volatility",
    WEEKS_HOURS.sql("SELECT asset, hour, round(v, 6) + 0.0 AS volatility_bps FROM hours"),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.hourly_volatility(lab.returns, lab.study)


@query(
    "volatility_summary",
    WEEKS_HOURS.sql("""SELECT asset, median_week_bps, highest_week_bps, highest_week, busiest_hour,
        busy_over_quiet FROM (SELECT asset, round(median(v), 1) AS median_week_bps,
        round(max(v), 1) AS highest_week_bps, arg_max(week, v) AS highest_week FROM weeks GROUP BY asset)
        JOIN (SELECT asset, arg_max(hour, v) AS busiest_hour, round(max(v) / nullif(min(v), 0), 2) AS busy_over_quiet
        FROM hours GROUP BY asset) USING (asset)"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.volatility_summary(
        ret.weekly_volatility(lab.returns, lab.study), ret.hourly_volatility(lab.returns, lab.study)
    )


TAIL_SHARE = 0.05


@query(
    "tail_table",
    BARS.extend(
        {
            "parts": f"""SELECT asset, r, 'all' AS part FROM returns WHERE r IS NOT NULL UNION ALL
                SELECT asset, r, 'calm' FROM returns WHERE r IS NOT NULL AND {CALM}""",
            "ordered": """SELECT *, row_number() OVER (PARTITION BY asset, part ORDER BY r * r DESC) AS k,
                count(*) OVER (PARTITION BY asset, part) AS n FROM parts""",
            "tails": f"""SELECT asset, part, kurtosis(r) AS kurt, sum(r * r) FILTER
                (k <= round_even({TAIL_SHARE} * n, 0)) / sum(r * r) AS top FROM ordered GROUP BY ALL""",
        }
    ).sql("""SELECT a.asset, round(a.kurt, 6) + 0.0 AS kurtosis, round(a.top, 6) + 0.0 AS top_share,
        round(c.kurt, 6) + 0.0 AS kurtosis_without_event, round(c.top, 6) + 0.0 AS top_share_without_event
        FROM tails a JOIN tails c ON a.asset = c.asset AND a.part = 'all' AND c.part = 'calm'"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.tail_table(lab.returns, lab.study, TAIL_SHARE)


@query(
    "benchmark_correlation",
    BARS.extend(
        {
            "day_closes": day_close(
                "bars", f"open_time >= TIMESTAMP '{S.train_start}' AND open_time < TIMESTAMP '2024-01-31'"
            ),
            "daily_returns": DAILY_RETURNS,
        }
    ).sql(f"""SELECT c.asset AS coin, round(corr(c.ret, b.ret), 6) + 0.0 AS benchmark_correlation
        FROM daily_returns c JOIN daily_returns b ON b.day = c.day AND b.asset = '{S.benchmark}'
        WHERE c.asset IN ({TARGETS}) AND c.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    study = lab.study.with_changes(research_months=("2024-02",))
    return ret.benchmark_correlation(
        lab.grid.where(between("open_time", None, "2024-01-31")), study
    )


@query(
    "realised_sigma",
    BARS.extend(
        {
            "logs": f"""SELECT asset, pos, open_time, ln(close) AS l FROM bars WHERE asset IN ({TARGETS})
                AND open_time >= TIMESTAMP '{S.train_start}' AND open_time < TIMESTAMP '2024-02-01'""",
            "ahead": " UNION ALL ".join(
                f"""SELECT asset AS coin, {h}::INT AS horizon, lead(l, {h}) OVER (PARTITION BY asset ORDER BY pos)
                - l AS f, open_time AS t, open_time + to_seconds({h} * w) AS e FROM logs, scale"""
                for h in S.horizons
            ),
        }
    ).sql(f"""SELECT coin, horizon, round(stddev_samp(f), 6) + 0.0 AS sigma FROM ahead
        WHERE NOT (e >= TIMESTAMP '{S.event_window[0]}' AND t < TIMESTAMP '{S.event_window[1]}')
        GROUP BY coin, horizon"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.realised_sigma(lab.grid, lab.study.with_changes(research_months=("2024-02",)))


FUNDED = BARS.extend({"settlements": FUNDING_TEXT, "settled": FUNDING})


@query(
    "funding_summary",
    FUNDED.extend(
        {
            "rates": """SELECT asset, pos, rate * 1e4 AS bps, w, (pos - lag(pos) OVER (PARTITION BY asset
                ORDER BY pos)) * w / 3600.0 AS hours FROM settled, scale""",
            "spacing": "SELECT asset, quantile_cont(hours, 0.5) AS spacing_hours FROM rates GROUP BY asset",
        }
    ).sql("""SELECT asset, spacing_hours, round(count(*) FILTER (round(bps, 6) = spacing_hours / 8)
        * 100.0 / count(*), 6) + 0.0 AS at_base_pct, round(count(*) FILTER (bps < 0) * 100.0 / count(*), 6)
        + 0.0 AS negative_pct, round(sum(bps) / 30.0, 6) + 0.0 AS mean_bps_day,
        round(min(bps), 6) + 0.0 AS lowest_bps, round(max(bps), 6) + 0.0 AS highest_bps,
        round(max(bps) FILTER (pos * w = epoch(TIMESTAMP '2024-01-11')), 6) + 0.0 AS bps_at
        FROM rates JOIN spacing USING (asset) GROUP BY asset, spacing_hours"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.funding_summary(
        lab.funding, lab.study, "2024-01-01", "2024-01-31", "2024-01-11 00:00:00"
    )


@query(
    "indexed_around_event",
    BARS.extend(
        {
            "around": """SELECT * FROM bars WHERE open_time >= TIMESTAMP '2024-01-10'
                AND open_time <= TIMESTAMP '2024-01-12'""",
            "first_close": """SELECT asset, max(close) AS base FROM around
                WHERE open_time = TIMESTAMP '2024-01-10' GROUP BY asset""",
            "indexed": """SELECT a.*, base FROM around a LEFT JOIN first_close USING (asset)""",
        }
    ).sql("""SELECT asset, round(min(close) * (100.0 / any_value(base)), 6) + 0.0 AS lowest_close,
        CASE WHEN any_value(base) IS NOT NULL THEN arg_min(open_time, close * 1e9 + pos / 1e6)
        FILTER (close IS NOT NULL) END AS lowest_close_at,
        round(min(low) * (100.0 / any_value(base)), 6) + 0.0 AS lowest_low,
        round(max(close) FILTER (open_time = TIMESTAMP '2024-01-12') * (100.0 / any_value(base)), 6) + 0.0
        AS last_close FROM indexed GROUP BY asset"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.indexed_around(lab.grid, lab.study, "2024-01-10", "2024-01-12")


@query(
    "coverage_and_liquidity",
    AUDITED.extend(
        {
            "day_values": """SELECT asset, open_time::DATE AS day, coalesce(sum(quote_volume), 0.0) AS v,
                count(close) AS n, count(*) FILTER (close IS NULL) AS g FROM bars GROUP BY ALL""",
        }
    ).sql("""SELECT asset, sum(n)::BIGINT AS bars, sum(g)::BIGINT AS missing,
        round(median(v), 6) + 0.0 AS median_daily_value, any_value(z)::BIGINT AS zero_trade FROM day_values
        JOIN (SELECT asset, sum(zero_trade) AS z FROM audit GROUP BY asset) USING (asset) GROUP BY asset"""),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.coverage(lab.grid, gridding.audit_bars(lab.raw, lab.study))


def correlation_change_sql() -> str:
    names = S.assets
    calm = f"NOT {o.inside(S.event_window, 'day')}"
    lines = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            lines.append(
                f"""SELECT '{a}' AS asset_a, '{b}' AS asset_b, round(corr({a}, {b}), 6) + 0.0 AS all_days,
                round(corr({a}, {b}) FILTER ({calm}), 6) + 0.0 AS without_event,
                round(corr({a}, {b}) - corr({a}, {b}) FILTER ({calm}), 6) + 0.0 AS change FROM complete"""
            )
    return (
        BARS.extend({"day_closes": day_close("bars"), "daily_returns": DAILY_RETURNS})
        .add("days", wide_sql("daily_returns", names, "ret", "day"))
        .add("complete", f"SELECT * FROM days WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}")
        .sql(" UNION ALL ".join(lines))
    )


@query("event_correlation_change", correlation_change_sql())
def _(spark, folder):
    lab = events_lab(spark, folder)
    return ret.event_correlation_change(lab.grid, lab.study, lab.study.assets)


# ---------------------------------------------------------------- D: features


def feature_query(columns) -> str:
    return FEATURED.select("coin, pos, " + o.marked(columns), "features")


@query("feature_table", feature_query([*schema.feature_names(S), *schema.label_names(S)]))
def _(spark, folder):
    lab = events_lab(spark, folder)
    names = [*schema.feature_names(S), *schema.label_names(S)]
    return lab.features.select("coin", "pos", *names)


def asset_block(name: str, columns) -> None:
    source = o.Query({k: v for k, v in FEATURED.parts.items()})
    listed = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)

    @query(name, source.sql(f"SELECT asset, pos, {listed} FROM labelled"))
    def _(spark, folder):
        lab = events_lab(spark, folder)
        return feat.asset_features(lab.grid, lab.study).select("asset", "pos", *columns)


asset_block("price_features", schema.formula_names(S, "price"))
asset_block("activity_features", schema.formula_names(S, "activity"))
asset_block("flow_features", schema.formula_names(S, "flow"))


@query("cross_features", feature_query(schema.cross_features(S)))
def _(spark, folder):
    return events_lab(spark, folder).features.select("coin", "pos", *schema.cross_features(S))


@query("labels", feature_query(schema.label_names(S)))
def _(spark, folder):
    return events_lab(spark, folder).features.select("coin", "pos", *schema.label_names(S))


@query("input_projection", feature_query(schema.own_inputs(S)))
def _(spark, folder):
    lab = events_lab(spark, folder)
    return feat.project_inputs(lab.features, schema.own_inputs(S)).drop("open_time")


@query(
    "volatility_inputs",
    o.volatility(FEATURED, S, S.horizons).select(
        "coin, pos, hour, " + o.marked([*schema.har_inputs(S), *[f"y_{h}" for h in S.horizons]]),
        "volatility",
    ),
)
def _(spark, folder):
    lab = events_lab(spark, folder)
    names = [*schema.har_inputs(S), *[f"y_{h}" for h in S.horizons]]
    return lab.volatility_frame.select("coin", "pos", "hour", *names)


LOOK_CUT = "2024-01-20"


def rewritten_features(lab):
    """Features after every bar from the cut on was rewritten."""
    late = F.col("open_time") >= F.lit(LOOK_CUT).cast("timestamp")
    changed = {f: F.when(late, F.col(f) * 3 + 1).otherwise(F.col(f)) for f in schema.BAR_FIELDS}
    return feat.build_features(lab.grid.withColumns(changed), lab.study)


@query("look_ahead_violations", FEATURED.sql("SELECT coin, pos FROM features WHERE false"))
def _(spark, folder):
    """Rewriting every bar after a moment must change no earlier feature."""
    lab = events_lab(spark, folder)
    cut = F.lit(LOOK_CUT).cast("timestamp")
    names = schema.feature_names(lab.study)
    return feat.look_ahead_violations(lab.features, rewritten_features(lab), cut, names).select("coin", "pos")


@query(
    "look_ahead_found",
    FEATURED.sql(
        f"""SELECT coin, pos FROM (SELECT coin, pos, open_time, lead(x_close) OVER (PARTITION BY coin ORDER BY pos)
        AS leak, lead(open_time) OVER (PARTITION BY coin ORDER BY pos) AS next_time FROM features)
        WHERE open_time < '{LOOK_CUT}' AND next_time >= '{LOOK_CUT}' AND leak IS NOT NULL"""
    ),
)
def _(spark, folder):
    """The same check with a feature that reads the next bar: its last row before the cut is found."""
    lab = events_lab(spark, folder)

    def leaking(frame):
        following = frame.select("coin", (F.col("pos") - 1).alias("pos"), F.col("x_close").alias("leak"))
        return frame.select("coin", "pos", "open_time").join(following, ["coin", "pos"], "left")

    cut = F.lit(LOOK_CUT).cast("timestamp")
    found = feat.look_ahead_violations(leaking(lab.features), leaking(rewritten_features(lab)), cut, ["leak"])
    return found.select("coin", "pos")
