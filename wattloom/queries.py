"""One query for each operator, on the driver's tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import faults as flt
from wattloom.operators import stats
from wattloom.operators.chunks import renumbered
from wattloom.operators.classify import channel_roles, fingerprint
from wattloom.operators.distributions import channel_statistics, distribution_fits, skew_range
from wattloom.operators.gaps import filled_grid, interpolate, longest_complete_run, longest_gap, regions
from wattloom.operators.lowpass import lowpass
from wattloom.operators.panel import grid, knots, median_interval, uniform_grid
from wattloom.operators.repair import clean_series, impute_missing, spline_flags
from wattloom.operators.rolling import flagged_long, hampel, robust_sd, rolling_mad, rolling_zscore
from wattloom.operators.scaling import excursions, fit, inverse, round_trip_error, transform
from wattloom.operators.screen import candidates, hits_by, ledger, replace_sentinels, scan, screen_range

Query = Callable[[SparkSession, str], DataFrame]
HOUR, SENTINEL, LIMIT, WINDOW, SIGMA, SHARE = 3600, 0.01, 4, 12, 2.5, 0.7
RANGE = (1.0, 400.0)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value", "event_id")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of events by type."""
    return grid(events(spark, sf_dir), "ts", "event_type", "value", HOUR)


def _rounded(name: str, digits: int) -> Column:
    """As SQL has it: the product as computed is rounded. F.round goes by the shortest decimal, so ties may part."""
    near = F.round(F.col(name) * 10.0**digits) / 10.0**digits
    return F.when(F.abs(near) < float("inf"), near).otherwise(F.col(name))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """The same for columns with dots in their names."""
    return df.toDF(*[c.replace(".", "\0") for c in df.columns]).transform(rounded, digits).toDF(*df.columns)


def with_sql(columns: str, tail: str = "", more: str = "") -> str:
    return f"WITH {PANEL}{', ' + more if more else ''} SELECT {columns} {tail}"


PANEL = """
    ev AS (SELECT event_type AS channel, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, value AS v FROM events),
    means AS (SELECT channel, slot, avg(v) AS value FROM ev GROUP BY ALL),
    edge AS (SELECT min(slot) AS a, max(slot) AS b FROM ev),
    cells AS (SELECT n.channel, s.slot, e.a FROM edge e, (SELECT DISTINCT channel FROM ev) n, LATERAL (SELECT unnest(range(e.a, e.b + 1)) AS slot) s),
    p AS (SELECT c.channel, c.slot - c.a AS pos, CAST(make_timestamp(c.slot * 3600000000) AS TIMESTAMP) AS ts, m.value FROM cells c LEFT JOIN means m USING (channel, slot))"""

FILLED = f"""
    nb AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
        first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np FROM p
        WINDOW b AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT channel, pos, ts, CASE WHEN value IS NOT NULL THEN value WHEN coalesce(pos - pp <= {LIMIT}, FALSE) OR coalesce(np - pos <= {LIMIT}, FALSE)
        THEN coalesce(pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0), pv, nv) END AS value, value IS NULL AND (coalesce(pos - pp <= {LIMIT}, FALSE) OR coalesce(np - pos <= {LIMIT}, FALSE)) AS filled FROM nb)"""


def frame(window: int) -> str:
    return f"PARTITION BY channel ORDER BY pos ROWS BETWEEN {window // 2} PRECEDING AND {window - 1 - window // 2} FOLLOWING"


ZSCORE = f"""
    z0 AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM p WINDOW w AS ({frame(WINDOW)})),
    z AS (SELECT channel, pos, ts, value, CASE WHEN n >= 6 THEN m END AS centre, CASE WHEN n >= 6 THEN {SIGMA} * s END AS threshold FROM z0),
    zf AS (SELECT *, coalesce(abs(value - centre) > threshold, FALSE) AS flagged FROM z)"""


@query(with_sql("channel, pos, ts, round(value, 6) AS value", "FROM p"))
def hourly_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query(with_sql("channel, pos, ts, round(value, 6) AS value, filled", "FROM f", FILLED))
def interpolate_limited(spark, sf_dir):
    return rounded(interpolate(panel(spark, sf_dir), LIMIT).select("channel", "pos", "ts", "value", "filled"))


@query(with_sql("pos, ts, round(CASE WHEN count(value) = count(*) THEN sum(value) END, 6) AS total", "FROM f GROUP BY pos, ts", FILLED))
def strict_total(spark, sf_dir):
    return rounded(stats.strict_total(interpolate(panel(spark, sf_dir), LIMIT)))


@query(with_sql("pos, ts, round(coalesce(sum(value), 0.0), 6) AS total", "FROM p GROUP BY pos, ts"))
def naive_total(spark, sf_dir):
    return rounded(stats.naive_total(panel(spark, sf_dir)))


RAW = "raw AS (SELECT event_type AS channel, event_id AS pos, ts, value FROM events)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events as readings, for sentinels."""
    return events(spark, sf_dir).select(F.col("event_type").alias("channel"), F.col("event_id").alias("pos"), "ts", "value")


@query(f"WITH {RAW} SELECT channel, pos, ts, CASE WHEN NOT coalesce(abs(value - {SENTINEL}) < 1e-6, FALSE) THEN value END AS value, coalesce(abs(value - {SENTINEL}) < 1e-6, FALSE) AS hit FROM raw")
def sentinel_replace(spark, sf_dir):
    return replace_sentinels(raw(spark, sf_dir), [SENTINEL]).select("channel", "pos", "ts", "value", "hit")


@query(f"WITH {RAW}, h AS (SELECT channel, count(*) FILTER (abs(value - {SENTINEL}) < 1e-6) AS hits, count(*) AS cells, count(*) FILTER (value IS NULL) AS missing FROM raw GROUP BY channel) SELECT CAST(sum(hits) AS BIGINT) AS n_hits, count(*) FILTER (hits > 0) AS n_channels, CAST(sum(cells) AS BIGINT) AS total_cells, round(sum(hits) / sum(cells), 6) AS fraction, CAST(sum(missing) AS BIGINT) AS n_missing FROM h")
def sentinel_scan(spark, sf_dir):
    return rounded(scan(raw(spark, sf_dir), [SENTINEL]))


@query(f"WITH {RAW}, e AS (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM raw) SELECT value, count(*) AS count FROM raw, e WHERE value <> 0 AND (value < lo OR value > hi) GROUP BY value HAVING count(*) >= 2 ORDER BY count(*) DESC, value LIMIT 5")
def sentinel_candidates(spark, sf_dir):
    return candidates(raw(spark, sf_dir), min_count=2)


@query(f"WITH {RAW} SELECT channel, count(*) AS hits FROM raw WHERE abs(value - {SENTINEL}) < 1e-6 GROUP BY channel")
def sentinel_hits_by_channel(spark, sf_dir):
    return hits_by(raw(spark, sf_dir), "channel", [SENTINEL])


@query(f"WITH {RAW} SELECT channel, pos, ts, CASE WHEN value BETWEEN {RANGE[0]} AND {RANGE[1]} THEN value END AS value, coalesce(value < {RANGE[0]} OR value > {RANGE[1]}, FALSE) AS hit FROM raw")
def valid_range_screen(spark, sf_dir):
    return screen_range(raw(spark, sf_dir), *RANGE).select("channel", "pos", "ts", "value", "hit")


@query(f"WITH {RAW} SELECT ts, channel, value AS before, CAST(NULL AS DOUBLE) AS after, 'sentinel code 0.01' AS reason FROM raw WHERE abs(value - {SENTINEL}) < 1e-6")
def change_ledger(spark, sf_dir):
    return ledger(replace_sentinels(raw(spark, sf_dir), [SENTINEL]), F.col("hit"), f"sentinel code {SENTINEL:g}", limit=None)


@query(with_sql("channel, pos, round(centre, 9) AS centre, round(threshold, 9) AS threshold, flagged", "FROM zf", ZSCORE))
def zscore_flags(spark, sf_dir):
    return rounded(rolling_zscore(panel(spark, sf_dir), WINDOW, SIGMA).select("channel", "pos", "centre", "threshold", "flagged"), 9)


@query(with_sql('ts AS "timestamp", channel AS household, round(value, 9) AS value, round(centre, 9) AS local_centre, round(threshold, 9) AS threshold, round(abs(value - centre), 9) AS deviation', "FROM zf WHERE flagged", ZSCORE))
def flagged_readings(spark, sf_dir):
    return rounded(flagged_long(rolling_zscore(panel(spark, sf_dir), WINDOW, SIGMA)), 9)


@query(with_sql("channel, pos, round(median(value) OVER w, 9) AS centre, round(1.4826 * mad(value) OVER w, 9) AS scale", f"FROM p WINDOW w AS ({frame(WINDOW)})"))
def rolling_mad_scale(spark, sf_dir):
    return rounded(rolling_mad(panel(spark, sf_dir), WINDOW).select("channel", "pos", "centre", "scale"), 9)


HAMPEL = f"""
    h0 AS (SELECT *, median(value) OVER w AS centre FROM p WINDOW w AS ({frame(WINDOW)})), h1 AS (SELECT *, abs(value - centre) AS d FROM h0),
    h AS (SELECT channel, pos, ts, value, centre, d, median(d) OVER w AS spread FROM h1 WINDOW w AS ({frame(WINDOW)}))"""


@query(with_sql(f"channel, pos, round(centre, 9) AS centre, round(spread, 9) AS spread, coalesce(d > {SIGMA} * 1.4826 * spread, FALSE) AS flagged", "FROM h", HAMPEL))
def hampel_flags(spark, sf_dir):
    return rounded(hampel(panel(spark, sf_dir), WINDOW, SIGMA).select("channel", "pos", "centre", "spread", "flagged"), 9)


@query(with_sql("channel, round(CASE WHEN mad(value) > 0 THEN 1.4826 * mad(value) ELSE stddev_pop(value) END, 6) AS robust_sd", "FROM p GROUP BY channel"))
def robust_sd_by_channel(spark, sf_dir):
    return rounded(robust_sd(panel(spark, sf_dir)))


RUNS = "g0 AS (SELECT channel, pos, pos - row_number() OVER (PARTITION BY channel, value IS NULL ORDER BY pos) AS island, value IS NULL AS gap FROM p), g AS (SELECT channel, gap, island, min(pos) AS start, max(pos) AS \"end\", count(*) AS length FROM g0 GROUP BY ALL)"


@query(with_sql('channel, start, "end", length', "FROM g WHERE gap", RUNS))
def gap_regions(spark, sf_dir):
    return regions(panel(spark, sf_dir), F.col("value").isNull())


@query(with_sql("n.channel, coalesce(max(length), 0) AS longest_gap", "FROM (SELECT DISTINCT channel FROM p) n LEFT JOIN (SELECT * FROM g WHERE gap) g USING (channel) GROUP BY n.channel", RUNS))
def longest_gap_by_channel(spark, sf_dir):
    return longest_gap(panel(spark, sf_dir))


@query(with_sql('channel, start, "end", length', "FROM g WHERE NOT gap QUALIFY row_number() OVER (PARTITION BY channel ORDER BY length DESC, start) = 1", RUNS))
def complete_run(spark, sf_dir):
    return longest_complete_run(panel(spark, sf_dir))


@query(with_sql("channel, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis", "FROM p GROUP BY channel"))
def moments(spark, sf_dir):
    return rounded(stats.moments(panel(spark, sf_dir)))


@query(with_sql(", ".join(["channel", *(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in stats.PERCENTILES), "round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"]), "FROM p GROUP BY channel"))
def percentiles(spark, sf_dir):
    return rounded(stats.percentiles(panel(spark, sf_dir)))


@query(with_sql("channel, round(mad(value), 6) AS mad", "FROM p GROUP BY channel"))
def mad_by_channel(spark, sf_dir):
    return rounded(stats.mad(panel(spark, sf_dir)))


HIST = "hx AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM p GROUP BY channel)"


@query(with_sql("channel, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS count", "FROM p JOIN hx USING (channel) WHERE value IS NOT NULL GROUP BY ALL", HIST))
def histogram(spark, sf_dir):
    return stats.histogram(panel(spark, sf_dir))


@query(with_sql("channel, round(avg(CAST(value <= lo + greatest(1e-9, 0.005 * (hi - lo)) AS DOUBLE)), 6) AS floor_mass, avg(CAST(value <= lo + greatest(1e-9, 0.005 * (hi - lo)) AS DOUBLE)) >= 0.2 AS inflated, abs(first(lo)) < greatest(1, 0.01 * abs(first(hi))) AS floor_is_zero", "FROM p JOIN hx USING (channel) WHERE value IS NOT NULL GROUP BY channel", HIST))
def floor_mass(spark, sf_dir):
    return rounded(stats.floor_mass(panel(spark, sf_dir)))


@query(with_sql("channel, round(sum(value) * 3600 / 3600, 6) AS energy_kwh", "FROM p GROUP BY channel"))
def energy_total(spark, sf_dir):
    return rounded(stats.energy_kwh(panel(spark, sf_dir), HOUR))


@query(with_sql("channel, count(value) AS n, count(*) FILTER (value IS NULL) AS n_missing, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 6) AS pct_missing, coalesce((SELECT max(length) FROM g WHERE g.gap AND g.channel = p.channel), 0) AS longest_gap", "FROM p GROUP BY channel", RUNS))
def coverage(spark, sf_dir):
    return rounded(stats.coverage(panel(spark, sf_dir)))


@query(with_sql("w.ts, missing, naive, round(total, 6) AS total", "FROM w JOIN t USING (pos)", FILLED + """,
    w AS (SELECT pos, ts, count(*) FILTER (value IS NULL) AS missing, round(coalesce(sum(value), 0.0), 6) AS naive FROM p GROUP BY pos, ts HAVING count(*) FILTER (value IS NULL) > 0 ORDER BY missing DESC, pos LIMIT 5),
    t AS (SELECT pos, CASE WHEN count(value) = count(*) THEN sum(value) END AS total FROM f GROUP BY pos)"""))
def worst_timestamps(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(stats.worst_timestamps(p, interpolate(p, LIMIT)))


SCALER = f"""
    nf AS (SELECT CAST(greatest(1, round_even((max(pos) + 1) * {SHARE}, 0)) AS BIGINT) AS n_fit FROM p),
    sc AS (SELECT channel, coalesce(min(value) FILTER (pos < n_fit), 0.0) AS data_min, coalesce(max(value) FILTER (pos < n_fit), 1.0) AS data_max, n_fit, coalesce(max(value) FILTER (pos < n_fit) - min(value) FILTER (pos < n_fit) < 1e-12, TRUE) AS constant FROM p, nf GROUP BY channel, n_fit),
    st AS (SELECT p.channel, pos, ts, CASE WHEN constant THEN CASE WHEN value IS NOT NULL THEN 0.0 END ELSE (value - data_min) / nullif(data_max - data_min, 0) END AS value, n_fit FROM p JOIN sc USING (channel))"""


@query(with_sql("channel, round(data_min, 6) AS data_min, round(data_max, 6) AS data_max, n_fit, constant", "FROM sc", SCALER))
def minmax_fit(spark, sf_dir):
    return rounded(fit(panel(spark, sf_dir), SHARE))


@query(with_sql("channel, pos, ts, round(value, 6) AS value", "FROM st", SCALER))
def minmax_transform(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(transform(p, fit(p, SHARE)))


@query(with_sql("channel, pos, ts, round(value, 6) AS value", "FROM p"))
def minmax_inverse(spark, sf_dir):
    p = panel(spark, sf_dir)
    scaler = fit(p, SHARE)
    return rounded(inverse(transform(p, scaler), scaler))


@query(with_sql("channel, count(*) FILTER (value < 0 OR value > 1) AS n_outside, round(100.0 * count(*) FILTER (value < 0 OR value > 1) / count(*), 6) AS pct_outside, round(min(value), 6) AS min_scaled, round(max(value), 6) AS max_scaled, round(max(greatest(value - 1, -value)), 6) AS worst_excursion", "FROM st WHERE pos >= n_fit AND value IS NOT NULL GROUP BY channel HAVING count(*) FILTER (value < 0 OR value > 1) > 0", SCALER))
def holdout_excursions(spark, sf_dir):
    p = panel(spark, sf_dir)
    scaler = fit(p, SHARE)
    return rounded(excursions(transform(p, scaler), scaler))


@query(with_sql("c.channel, c.n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(d.dark / c.n, 6) AS dark_fraction, lo < -5 AS has_negative, CAST(CASE WHEN c.n >= 288 THEN dark_hours ELSE 0 END AS BIGINT) AS dark_hours, CAST(CASE WHEN c.n >= 288 THEN lit_hours ELSE 0 END AS BIGINT) AS lit_hours", "FROM c JOIN d USING (channel)", """
    c AS (SELECT channel, count(*) AS n, min(value) AS lo, max(value) AS hi FROM p WHERE value IS NOT NULL GROUP BY channel),
    dh AS (SELECT p.channel, hour(ts) AS h, sum(CAST(value <= greatest(5, 0.02 * hi) AS INTEGER)) AS dark, count(*) AS n FROM p JOIN c USING (channel) WHERE value IS NOT NULL GROUP BY ALL),
    d AS (SELECT channel, sum(dark) AS dark, count(*) FILTER (dark / n >= 0.9) AS dark_hours, count(*) FILTER (dark / n <= 0.1) AS lit_hours FROM dh GROUP BY channel)"""))
def channel_fingerprint(spark, sf_dir):
    return rounded(fingerprint(panel(spark, sf_dir)))


NAME_ROLE = "CASE WHEN regexp_matches(channel, 'ghi|dni|dhi|irradian|insolat|solar[_ ]?rad|w[_ ]?m2|w/m', 'i') AND (NOT regexp_matches(channel, 'kwh?|k_?w|power|load|demand|active|total|household', 'i') OR regexp_matches(channel, 'ghi|dni|dhi|irradian|w[_ ]?m2|w/m', 'i')) THEN 'irradiance' WHEN regexp_matches(channel, 'ghi|dni|dhi|irradian|insolat|solar[_ ]?rad|w[_ ]?m2|w/m', 'i') THEN 'power' WHEN regexp_matches(channel, 'temp|t_?amb|ambient|deg[_ ]?c|°c', 'i') THEN 'temperature' WHEN regexp_matches(channel, 'kwh?|k_?w|power|load|demand|active|total|household', 'i') THEN 'power' END"
#: Names that the roles query gives the channels, by their order.
ROLE_NAMES = ("GHI", "solar_power_kw", "total_w_m2", "t_amb", "insolation load")


@query(with_sql("channel, coalesce(by_name, 'unknown') AS role, CASE WHEN by_name IS NULL THEN 0.0 ELSE CAST(0.9 AS DOUBLE) END AS confidence, '' AS note", f"FROM (SELECT channel, {NAME_ROLE} AS by_name FROM named)", f"named AS (SELECT concat_ws(' ', channel, ['{"', '".join(ROLE_NAMES)}'][row_number() OVER (ORDER BY channel)]) AS channel FROM (SELECT DISTINCT channel FROM p WHERE value IS NOT NULL))"))
def channel_role(spark, sf_dir):
    """Roles by name and values; the events' values are neither light nor air, so that names decide."""
    prints = fingerprint(panel(spark, sf_dir)).orderBy("channel")
    names = {r.channel: f"{r.channel} {ROLE_NAMES[k]}" if k < len(ROLE_NAMES) else r.channel for k, r in enumerate(prints.select("channel").collect())}
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return channel_roles(prints.withColumn("channel", pairs[F.col("channel")]))


@query(with_sql("median(step) AS interval_s, min(step) = max(step) AS regular", "FROM (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY pos)) AS step FROM (SELECT DISTINCT pos, ts FROM p)) WHERE step IS NOT NULL"))
def sampling_interval(spark, sf_dir):
    return median_interval(panel(spark, sf_dir))


OWN_GRID = "o AS (SELECT * FROM p WHERE value IS NOT NULL), b AS (SELECT channel, min(ts) AS a, max(ts) AS z FROM o GROUP BY channel), u AS (SELECT channel, a, unnest(range(0, CAST((epoch(z) - epoch(a)) / 1800 AS BIGINT) + 1)) AS pos FROM b)"


@query(with_sql("u.channel, u.pos, CAST(u.a + to_seconds(u.pos * 1800) AS TIMESTAMP) AS ts, round(o.value, 6) AS value", "FROM u LEFT JOIN o ON o.channel = u.channel AND o.ts = u.a + to_seconds(u.pos * 1800)", OWN_GRID))
def half_hour_grid(spark, sf_dir):
    return rounded(uniform_grid(panel(spark, sf_dir).where("value is not null"), HOUR // 2))


@query(with_sql("channel, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(stddev_samp(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max, round(skewness(d), 6) AS skew, round(kurtosis(d), 6) AS kurtosis", "FROM (SELECT channel, value - lag(value) OVER (PARTITION BY channel ORDER BY pos) AS d FROM p) WHERE d IS NOT NULL GROUP BY channel"))
def increment_moments(spark, sf_dir):
    return rounded(stats.increment_moments(panel(spark, sf_dir)))


@query(with_sql("channel, pos", """FROM (SELECT channel, pos, row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS k, ceil(count(*) OVER (PARTITION BY channel) / 100) AS stride FROM p WHERE value IS NOT NULL) WHERE k % stride = 0"""))
def stride_sample(spark, sf_dir):
    return stats.stride_sample(panel(spark, sf_dir), 100).select("channel", "pos")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the panel, with every 37th row of a channel taken as a fault of its own."""
    flags = rolling_zscore(panel(spark, sf_dir), WINDOW, SIGMA).where("value is not null")
    return flags.withColumn("fault", F.when(F.col("pos") % 37 == 0, (F.col("pos") / 37).cast("int"))).withColumn("magnitude", F.lit(1.0))


@query(with_sql("channel, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1", "FROM (SELECT channel, count(*) FILTER (flagged AND pos % 37 = 0) AS tp, count(*) FILTER (flagged AND pos % 37 <> 0) AS fp, count(*) FILTER (NOT flagged AND pos % 37 = 0) AS fn FROM zf WHERE value IS NOT NULL GROUP BY channel)", ZSCORE))
def fault_score(spark, sf_dir):
    return rounded(flt.point_scores(_scored(spark, sf_dir), ["channel"]))


@query(with_sql("round(coalesce(f / nullif(a, 0), 0), 6) AS fp_share, round(b / n, 6) AS base_share, round(coalesce(coalesce(f / nullif(a, 0), 0) / nullif(b / n, 0), 0), 6) AS enrichment", "FROM (SELECT count(*) FILTER (flagged AND pos % 37 <> 0 AND hour(ts) BETWEEN 17 AND 21) AS f, count(*) FILTER (flagged AND pos % 37 <> 0) AS a, count(*) FILTER (hour(ts) BETWEEN 17 AND 21) AS b, count(*) AS n FROM zf WHERE value IS NOT NULL)", ZSCORE))
def peak_hour_share(spark, sf_dir):
    return rounded(flt.peak_hour_share(_scored(spark, sf_dir)))


def load_series(spark: SparkSession, rows: int = 2016) -> DataFrame:
    """A week of five-minute load by formula, with a little deterministic noise."""
    h = F.col("pos") * 5 / 60
    noise = 4 * F.sin(F.col("pos") * 12.9898) * F.cos(F.col("pos") * 78.233)
    value = 100 + 40 * F.sin(2 * F.pi() * h / 24) + 15 * F.sin(4 * F.pi() * h / 24) + noise
    ts = F.timestamp_add("SECOND", F.col("pos") * 300, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return spark.range(rows).withColumnRenamed("id", "pos").select(F.lit("load").alias("channel"), "pos", ts.alias("ts"), value.alias("value"))


def load_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels' hourly total as one series without missing rows; gaps of any length are interpolated."""
    total = stats.strict_total(interpolate(panel(spark, sf_dir), None))
    return renumbered(total.select(F.lit("total").alias("channel"), "pos", "ts", F.col("total").alias("value")))


MOMENTS = "count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis"


@query(with_sql("channel, count(*) FILTER (value IS NULL) AS missing", "FROM p GROUP BY channel"))
def missing_by_channel(spark, sf_dir):
    return stats.missing_by_channel(panel(spark, sf_dir))


@query(f"WITH {PANEL}, {FILLED} SELECT channel, 'before' AS stage, {MOMENTS} FROM p GROUP BY channel UNION ALL SELECT channel, 'after', {MOMENTS} FROM f GROUP BY channel")
def interpolation_effect(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(stats.effect(p, interpolate(p, LIMIT)))


@query(f"WITH {PANEL}, {HIST}, s AS (SELECT channel, {MOMENTS}, round(mad(value), 6) AS mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_samp(value) / avg(value), 6) AS cv, round(sum(value), 6) AS energy_kwh FROM p GROUP BY channel) SELECT * FROM s")
def channel_profile(spark, sf_dir):
    full = stats.profile(panel(spark, sf_dir), HOUR)
    return rounded(full.select("channel", "n", "mean", "median", "std", "min", "max", "skew", "kurtosis", "mad", "iqr", "cv", "energy_kwh"))


@query(f"WITH {PANEL}, {ZSCORE}, r AS (SELECT channel, value - centre AS value FROM zf WHERE value IS NOT NULL AND centre IS NOT NULL) SELECT channel, {MOMENTS} FROM r GROUP BY channel")
def residual_moments(spark, sf_dir):
    p = panel(spark, sf_dir)
    smooth = rolling_zscore(p, WINDOW, SIGMA).select("channel", "pos", F.col("centre").alias("value"))
    return rounded(stats.residual_moments(p, smooth))


BACK = "abs(p.value - CASE WHEN constant THEN data_min ELSE data_min + {} * (data_max - data_min) END) / abs(nullif(p.value, 0))"
TRIP = "FROM p JOIN st USING (channel, pos) JOIN sc USING (channel)"


@query(with_sql("digits, count(e) AS n, count(*) FILTER (e < 1e-12) AS n_close, round(max(e), 9) AS max_error", f"FROM (SELECT -1 AS digits, {BACK.format('st.value')} AS e {TRIP} UNION ALL SELECT 4, {BACK.format('round(st.value, 4)')} {TRIP}) GROUP BY digits", SCALER))
def round_trip(spark, sf_dir):
    """Whole (-1) and with scaled values kept to 4 digits, of which the trip recovers few."""
    p = panel(spark, sf_dir)
    scaler = fit(p, SHARE)
    trip = lambda digits: round_trip_error(p, scaler, digits=None if digits < 0 else digits).withColumn("digits", F.lit(digits))
    return rounded(trip(-1).unionByName(trip(4)), 9)


@query(with_sql("channel, tp, fp, n_flagged, round(p_, 6) AS precision, round(r_, 6) AS recall_event, round(coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0), 6) AS f1, round(coalesce(1.25 * p_ * r_ / nullif(0.25 * p_ + r_, 0), 0), 6) AS f_half", "FROM (SELECT *, tp / nullif(n_flagged, 0) AS p_, coalesce(found, 0) AS r_ FROM (SELECT channel, count(*) FILTER (flagged AND pos % 37 = 0) AS tp, count(*) FILTER (flagged AND pos % 37 <> 0) AS fp, count(*) FILTER (flagged) AS n_flagged, avg(CASE WHEN pos % 37 = 0 THEN CAST(flagged AS INTEGER) END) AS found FROM zf WHERE value IS NOT NULL GROUP BY channel))", ZSCORE))
def event_score(spark, sf_dir):
    return rounded(flt.event_scores(_scored(spark, sf_dir), ["channel"]))


@query(with_sql("CAST(1 + pos % 3 AS DOUBLE) AS magnitude, round(avg(CAST(flagged AS INTEGER)), 6) AS recall, count(*) AS n", "FROM zf WHERE value IS NOT NULL AND pos % 37 = 0 GROUP BY 1", ZSCORE))
def recall_by_magnitude(spark, sf_dir):
    return rounded(flt.recall_by_magnitude(_scored(spark, sf_dir).withColumn("magnitude", (1 + F.col("pos") % 3).cast("double"))))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in values) + "]"


def _sql_draw(seed: int, what: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{what}', {', '.join(parts)})), 1, 8) AS BIGINT)"


#: The channels' hourly total without missing rows, numbered anew, and its length.
TOTAL = f"""{PANEL},
    nb AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
        first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np FROM p
        WINDOW b AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT channel, pos, ts, coalesce(value, pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0), pv, nv) AS value FROM nb),
    s0 AS (SELECT pos, ts, CASE WHEN count(value) = count(*) THEN sum(value) END AS value FROM f GROUP BY pos, ts),
    s AS (SELECT 'total' AS channel, row_number() OVER (ORDER BY pos) - 1 AS pos, ts, value FROM s0 WHERE value IS NOT NULL),
    size AS (SELECT count(*) AS n FROM s)"""


def _sql_faults(repeats: int) -> str:
    """The series of the first calibration, damaged once for each repetition."""
    rows = f"greatest(0, n - {2 * flt.MARGIN + flt.LONGEST})"
    key = ("rep", "fault")
    return f"""
    grid AS (SELECT greatest({flt.GAP}, {rows} // {flt.N_FAULTS}) AS width, least({flt.N_FAULTS}, {rows} // greatest({flt.GAP}, {rows} // {flt.N_FAULTS})) AS slots FROM size),
    d0 AS (SELECT rep, fault, width FROM grid, LATERAL (SELECT unnest(range(slots)) AS fault), (SELECT unnest(range({repeats})) AS rep)),
    d1 AS (SELECT *, {_sql_list(flt.KINDS)}[1 + {_sql_draw(42, "kind", *key)} % {len(flt.KINDS)}] AS kind, {flt.MARGIN} + fault * width + {_sql_draw(42, "place", *key)} % (width - {flt.GAP} + 1) AS position FROM d0),
    d AS (SELECT *, CASE WHEN kind = 'dropout' THEN 1 + {_sql_draw(42, "length", *key)} % {flt.LONGEST} ELSE 1 END AS length, CASE WHEN kind <> 'dropout' THEN {_sql_list(flt.MAGNITUDES)}[1 + {_sql_draw(42, "size", *key)} % {len(flt.MAGNITUDES)}] END AS magnitude FROM d1),
    hit AS (SELECT rep, fault, kind, magnitude, unnest(range(position, position + length)) AS pos FROM d),
    u0 AS (SELECT *, 1.4826 * mad(value) OVER (ORDER BY pos ROWS BETWEEN {flt.SCALE_WINDOW // 2} PRECEDING AND {flt.SCALE_WINDOW - 1 - flt.SCALE_WINDOW // 2} FOLLOWING) AS scale FROM s),
    u AS (SELECT channel, pos, ts, value, coalesce(CASE WHEN scale > 0 THEN scale END, (SELECT median(scale) FROM u0 WHERE scale > 0)) AS unit FROM u0),
    x AS (SELECT r.rep, u.channel, u.pos, u.ts, h.fault, h.kind, h.magnitude, CASE WHEN h.kind = 'dropout' THEN u.value * ({flt.LEFT_OVER} * ({_sql_draw(42, "left", "r.rep", "u.pos")} / 4294967296.0::DOUBLE))
        WHEN h.kind IS NOT NULL THEN greatest(0.0, u.value + CASE h.kind WHEN 'spike' THEN 1 ELSE -1 END * h.magnitude * u.unit) ELSE u.value END AS value
        FROM u JOIN (SELECT unnest(range({repeats})) AS rep) r ON TRUE LEFT JOIN hit h ON h.rep = r.rep AND h.pos = u.pos)"""


def _sql_frame(w: int, by: str) -> str:
    return f"(PARTITION BY {by} ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING)"


def _sql_calibration() -> str:
    both = "y AS (SELECT rep, pos, value, fault FROM x UNION ALL SELECT -1, pos, value, NULL FROM s)"
    windows = " UNION ALL ".join(f"SELECT {w} AS w, rep, fault, CASE WHEN count(value) OVER q >= {max(3, w // 2)} THEN abs(value - avg(value) OVER q) / nullif(stddev_samp(value) OVER q, 0) END AS z FROM y WINDOW q AS {_sql_frame(w, 'rep')}" for w in flt.WINDOWS)
    return f"""WITH {TOTAL}, {_sql_faults(flt.REPEATS)}, {both}, zs AS ({windows}),
    counts AS (SELECT w, sigma, rep, count(*) FILTER (fault IS NOT NULL) AS faults, count(*) FILTER (z > sigma AND fault IS NOT NULL) AS tp, count(*) FILTER (z > sigma AND fault IS NULL) AS fp FROM zs, (SELECT unnest({_sql_list(flt.SIGMAS)}) AS sigma) GROUP BY w, sigma, rep),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p_, coalesce(tp / nullif(faults, 0), 0) AS r_ FROM counts),
    g AS (SELECT CAST(w AS INTEGER) AS "window", sigma, avg(p_) FILTER (rep >= 0) AS precision, avg(r_) FILTER (rep >= 0) AS recall, avg(coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)) FILTER (rep >= 0) AS f1,
        stddev_pop(coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)) FILTER (rep >= 0) AS f1_std, max(fp) FILTER (rep < 0) AS baseline_flags, sigma < (w - 1) / sqrt(w) AS reachable FROM pr GROUP BY w, sigma)"""


def _sql_hampel(source: str, by: str, more: str) -> str:
    """(w, .., e): how many robust deviations each row lies from its rolling median, for each window of the tuner."""
    return " UNION ALL ".join(f"SELECT {w} AS w, {more} d / nullif(1.4826 * median(d) OVER {_sql_frame(w, by)}, 0) AS e FROM (SELECT *, abs(value - median(value) OVER {_sql_frame(w, by)}) AS d FROM {source})" for w in flt.TUNER_WINDOWS)


def _sql_tuning() -> str:
    rows, key, least = f"greatest(0, n - {2 * flt.APART})", ("rep", "fault"), flt.APART + flt.RUN[1]
    return f"""WITH {TOTAL},
    grid AS (SELECT greatest({least}, {rows} // {flt.TUNER_FAULTS}) AS width, least({flt.TUNER_FAULTS}, {rows} // greatest({least}, {rows} // {flt.TUNER_FAULTS})) AS slots FROM size),
    d0 AS (SELECT rep, fault, width FROM grid, LATERAL (SELECT unnest(range(slots)) AS fault), (SELECT unnest(range({flt.TUNER_REPEATS})) AS rep)),
    d1 AS (SELECT *, {_sql_list(flt.TUNER_KINDS)}[1 + {_sql_draw(0, "kind", *key)} % {len(flt.TUNER_KINDS)}] AS kind FROM d0),
    d2 AS (SELECT *, CASE WHEN kind = 'spike' THEN 1 ELSE {flt.RUN[0]} + {_sql_draw(0, "length", *key)} % {flt.RUN[1] - flt.RUN[0] + 1} END AS length FROM d1),
    d AS (SELECT *, {flt.APART} + fault * width + {_sql_draw(0, "place", *key)} % (width - {flt.APART} + 1 - length) AS position, {_sql_list(flt.TUNER_MAGNITUDES)}[1 + {_sql_draw(0, "size", *key)} % {len(flt.TUNER_MAGNITUDES)}] AS magnitude, CASE WHEN {_sql_draw(0, "sign", *key)} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM d2),
    hit AS (SELECT d.*, unnest(range(position, position + length)) AS pos, s.value AS first FROM d JOIN s ON s.pos = d.position),
    unit AS (SELECT CASE WHEN mad(value) > 0 THEN 1.4826 * mad(value) ELSE stddev_pop(value) END AS unit FROM s),
    x AS (SELECT r.rep, s.pos, h.fault, CASE h.kind WHEN 'flatline' THEN h.first WHEN 'dropout' THEN s.value * {flt.LEFT_OVER} ELSE s.value + coalesce(h.sign * h.magnitude * unit, 0) END AS value
        FROM s JOIN (SELECT unnest(range({flt.TUNER_REPEATS})) AS rep) r ON TRUE JOIN unit ON TRUE LEFT JOIN hit h ON h.rep = r.rep AND h.pos = s.pos),
    es AS ({_sql_hampel("x", "rep", "rep, fault,")}),
    by_fault AS (SELECT w, sigma, rep, fault, count(*) FILTER (e > sigma) AS hits FROM es, (SELECT unnest({_sql_list(flt.TUNER_SIGMAS)}) AS sigma) GROUP BY w, sigma, rep, fault),
    c AS (SELECT w, sigma, rep, coalesce(sum(hits) FILTER (fault IS NOT NULL), 0) AS tp, coalesce(sum(hits) FILTER (fault IS NULL), 0) AS fp, coalesce(avg(CAST(hits > 0 AS INTEGER)) FILTER (fault IS NOT NULL), 0) AS r_ FROM by_fault GROUP BY w, sigma, rep),
    q AS (SELECT *, tp / nullif(tp + fp, 0) AS p_ FROM c),
    m AS (SELECT *, coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0) AS f1, coalesce(1.25 * p_ * r_ / nullif(0.25 * p_ + r_, 0), 0) AS f_half FROM q)
    SELECT CAST(w AS INTEGER) AS "window", sigma, round(avg(tp), 6) AS tp, round(avg(fp), 6) AS fp, round(avg(p_), 6) AS precision, round(avg(r_), 6) AS recall_event, round(avg(f1), 6) AS f1, round(avg(f_half), 6) AS f_half, round(avg(tp + fp), 6) AS n_flagged, round(stddev_pop(f_half), 6) AS f_half_sd FROM m GROUP BY w, sigma"""


@query(f"WITH {TOTAL}, {_sql_faults(1)} SELECT CAST(rep AS INTEGER) AS rep, channel, pos, ts, round(value, 9) AS value, CAST(coalesce(fault, -1) AS INTEGER) AS fault, kind, magnitude FROM x")
def fault_injection(spark, sf_dir):
    series = load_total(spark, sf_dir)
    damaged = flt.apply_faults(flt.local_scale(series), flt.draw_faults(spark, series.count(), 42, repeats=1))
    return rounded(damaged.withColumn("fault", F.coalesce("fault", F.lit(-1))), 9)


@query(f"""{_sql_calibration()} SELECT "window", {", ".join(f'round(max(f1) FILTER (sigma = {s}), 6) AS "{s}"' for s in flt.SIGMAS)} FROM g GROUP BY "window" """)
def calibration_surface(spark, sf_dir):
    return rounded_all(flt.surface(flt.calibrate(load_total(spark, sf_dir)), "f1", flt.SIGMAS))


HOUSEHOLDS = PANEL.replace("SELECT event_type AS channel", "SELECT printf('Household_%05d', user_id) AS channel").replace("value AS v FROM events", "value AS v FROM events WHERE user_id IS NOT NULL")


def household_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    return found.select("ts", F.format_string("Household_%05d", "user_id").alias("channel"), "value")


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of events by user: channels grow with the tables."""
    return grid(household_events(spark, sf_dir), "ts", "channel", "value", HOUR)


def households_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, value): the cells of households() without most of the empty ones; every channel has a row."""
    return knots(household_events(spark, sf_dir), "ts", "channel", "value", HOUR).select("channel", "value")


def households_filled(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    return filled_grid(household_events(spark, sf_dir), "ts", "channel", "value", HOUR, limit)


@query(f"WITH {HOUSEHOLDS}, {FILLED} SELECT channel, pos, ts, round(value, 9) AS value, filled FROM f")
def household_panel_filled(spark, sf_dir):
    return rounded(households_filled(spark, sf_dir, LIMIT), 9)


@query(f"WITH {HOUSEHOLDS}, {FILLED} SELECT pos, ts, count(value) AS present, round(coalesce(sum(value), 0.0), 9) AS naive, round(CASE WHEN count(value) = count(*) THEN sum(value) END, 9) AS total FROM f GROUP BY pos, ts")
def household_totals(spark, sf_dir):
    filled = households_filled(spark, sf_dir, LIMIT)
    return rounded(stats.totals(filled).select("pos", "ts", "present", "naive", "total"), 9)


#: Filled without a limit, so that channels have rows enough to calibrate on.
FILLED_WHOLE = FILLED.split("f AS (")[0] + "f AS (SELECT channel, pos, ts, coalesce(value, pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0), pv, nv) AS value FROM nb)"
CHANNEL_WINDOWS, CHANNEL_SIGMAS, CHANNEL_REPEATS, CHANNEL_FAULTS = (12, 48), (2.0, 3.0, 4.0), 2, 20


def _sql_by_channel(detector: str) -> str:
    rows, key, draw = f"greatest(0, n - {2 * flt.MARGIN + flt.LONGEST})", ("channel", "rep", "fault"), lambda what, *parts: _sql_draw(42, what, *parts)
    z = "abs(value - avg(value) OVER q) / nullif(stddev_samp(value) OVER q, 0)"
    if detector == "zscore":
        zs = " UNION ALL ".join(f"SELECT {w} AS w, channel, rep, fault, CASE WHEN count(value) OVER q >= {max(3, w // 2)} THEN {z} END AS z FROM x WINDOW q AS {_sql_frame(w, 'channel, rep')}" for w in CHANNEL_WINDOWS)
    else:
        zs = " UNION ALL ".join(f"SELECT {w} AS w, channel, rep, fault, d / nullif(1.4826 * median(d) OVER {_sql_frame(w, 'channel, rep')}, 0) AS z FROM (SELECT *, abs(value - median(value) OVER {_sql_frame(w, 'channel, rep')}) AS d FROM x)" for w in CHANNEL_WINDOWS)
    return f"""WITH {HOUSEHOLDS}, {FILLED_WHOLE},
    s0 AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS pos, value FROM f WHERE value IS NOT NULL),
    size AS (SELECT channel, count(*) AS n FROM s0 GROUP BY channel HAVING count(*) >= {flt.CALIBRATION_ROWS}),
    s AS (SELECT s0.* FROM s0 JOIN size USING (channel)),
    d0 AS (SELECT channel, rep, fault, width FROM (SELECT channel, greatest({flt.GAP}, {rows} // {CHANNEL_FAULTS}) AS width, least({CHANNEL_FAULTS}, {rows} // greatest({flt.GAP}, {rows} // {CHANNEL_FAULTS})) AS slots FROM size), LATERAL (SELECT unnest(range(slots)) AS fault), (SELECT unnest(range({CHANNEL_REPEATS})) AS rep)),
    d1 AS (SELECT *, {_sql_list(flt.KINDS)}[1 + {draw("kind", *key)} % {len(flt.KINDS)}] AS kind, {flt.MARGIN} + fault * width + {draw("place", *key)} % (width - {flt.GAP} + 1) AS position FROM d0),
    d AS (SELECT *, CASE WHEN kind = 'dropout' THEN 1 + {draw("length", *key)} % {flt.LONGEST} ELSE 1 END AS length, CASE WHEN kind <> 'dropout' THEN {_sql_list(flt.MAGNITUDES)}[1 + {draw("size", *key)} % {len(flt.MAGNITUDES)}] END AS magnitude FROM d1),
    hit AS (SELECT channel, rep, fault, kind, magnitude, unnest(range(position, position + length)) AS pos FROM d),
    u0 AS (SELECT *, 1.4826 * mad(value) OVER (PARTITION BY channel ORDER BY pos ROWS BETWEEN {flt.SCALE_WINDOW // 2} PRECEDING AND {flt.SCALE_WINDOW - 1 - flt.SCALE_WINDOW // 2} FOLLOWING) AS scale FROM s),
    middle AS (SELECT channel, median(scale) AS m FROM u0 WHERE scale > 0 GROUP BY channel),
    u AS (SELECT u0.channel, pos, value, coalesce(CASE WHEN scale > 0 THEN scale END, m) AS unit FROM u0 LEFT JOIN middle USING (channel)),
    x AS (SELECT r.rep, u.channel, u.pos, h.fault, CASE WHEN h.kind = 'dropout' THEN u.value * ({flt.LEFT_OVER} * ({draw("left", "u.channel", "r.rep", "u.pos")} / 4294967296.0::DOUBLE))
        WHEN h.kind IS NOT NULL THEN greatest(0.0, u.value + CASE h.kind WHEN 'spike' THEN 1 ELSE -1 END * h.magnitude * u.unit) ELSE u.value END AS value
        FROM u JOIN (SELECT unnest(range(-1, {CHANNEL_REPEATS})) AS rep) r ON TRUE LEFT JOIN hit h ON h.channel = u.channel AND h.rep = r.rep AND h.pos = u.pos),
    zs AS ({zs}),
    counts AS (SELECT channel, w, sigma, rep, count(*) FILTER (fault IS NOT NULL) AS faults, count(*) FILTER (z > sigma AND fault IS NOT NULL) AS tp, count(*) FILTER (z > sigma AND fault IS NULL) AS fp FROM zs, (SELECT unnest({_sql_list(CHANNEL_SIGMAS)}) AS sigma) GROUP BY channel, w, sigma, rep),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p_, coalesce(tp / nullif(faults, 0), 0) AS r_ FROM counts)
    SELECT channel, CAST(w AS INTEGER) AS "window", sigma, round(avg(p_) FILTER (rep >= 0), 6) AS precision, round(avg(r_) FILTER (rep >= 0), 6) AS recall, round(avg(coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)) FILTER (rep >= 0), 6) AS f1,
        round(stddev_pop(coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)) FILTER (rep >= 0), 6) AS f1_std, max(fp) FILTER (rep < 0) AS baseline_flags, {"sigma < (w - 1) / sqrt(w)" if detector == "zscore" else "TRUE"} AS reachable FROM pr GROUP BY channel, w, sigma"""


def _by_channel(spark, sf_dir, detector):
    filled = interpolate(households(spark, sf_dir), None).select("channel", "pos", "ts", "value")
    return rounded(flt.calibrate_channels(filled, detector, 42, CHANNEL_WINDOWS, CHANNEL_SIGMAS, CHANNEL_REPEATS, CHANNEL_FAULTS))


@query(_sql_by_channel("zscore"))
def household_calibration(spark, sf_dir):
    """Every household's grid in one job."""
    return _by_channel(spark, sf_dir, "zscore")


@query(_sql_by_channel("hampel"))
def household_hampel_calibration(spark, sf_dir):
    return _by_channel(spark, sf_dir, "hampel")


@query(f"WITH {HOUSEHOLDS}, {RUNS} SELECT channel, start, \"end\", length FROM g WHERE gap")
def household_gaps(spark, sf_dir):
    return regions(households(spark, sf_dir), F.col("value").isNull())


@query(f"WITH {HOUSEHOLDS}, {ZSCORE} SELECT channel, count(*) FILTER (flagged) AS flagged, count(centre) AS judged FROM zf GROUP BY channel")
def household_flags(spark, sf_dir):
    flags = rolling_zscore(households(spark, sf_dir), WINDOW, SIGMA)
    return flags.groupBy("channel").agg(F.count_if("flagged").alias("flagged"), F.count("centre").alias("judged"))


@query()
def bspline_clean(spark, sf_dir):
    return clean_series(panel(spark, sf_dir), window=WINDOW, sigma=SIGMA)


@query()
def gap_fill(spark, sf_dir):
    return impute_missing(panel(spark, sf_dir), valid_range=(0.0, 1000.0))


@query()
def spline_band_flags(spark, sf_dir):
    return spline_flags(interpolate(panel(spark, sf_dir), None).select("channel", "pos", "ts", "value"))


@query()
def lowpass_filter(spark, sf_dir):
    return lowpass(panel(spark, sf_dir), HOUR, cutoff_min=360)


@query(f"""{_sql_calibration()} SELECT "window", sigma, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f1_std, 6) AS f1_std, baseline_flags, reachable FROM g""")
def calibration_grid(spark, sf_dir):
    return rounded(flt.calibrate(load_total(spark, sf_dir)))


@query(_sql_tuning())
def hampel_tuning(spark, sf_dir):
    return rounded(flt.tune_hampel(load_total(spark, sf_dir)))


@query(f"""WITH {TOTAL}, es AS ({_sql_hampel("s", "channel", "")}) SELECT CAST(w AS INTEGER) AS "window", sigma, count(*) FILTER (e > sigma) AS n_flagged, round(100.0 * count(*) FILTER (e > sigma) / count(*), 6) AS pct_flagged FROM es, (SELECT unnest({_sql_list(flt.TUNER_SIGMAS)}) AS sigma) GROUP BY w, sigma""")
def detector_stability(spark, sf_dir):
    return rounded(flt.stability(load_total(spark, sf_dir)))


@query()
def statistics_in_words(spark, sf_dir):
    return channel_statistics(panel(spark, sf_dir), HOUR)


@query(with_sql("round(min(skewness), 6) AS least, round(max(skewness), 6) AS most, round((SELECT skewness(total) FROM (SELECT CASE WHEN count(value) = count(*) THEN sum(value) END AS total FROM f GROUP BY pos)), 6) AS of_total", "FROM (SELECT skewness(value) AS skewness FROM p GROUP BY channel)", FILLED))
def skew_of_total(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(skew_range(p, stats.strict_total(interpolate(p, LIMIT))))


@query(f"""WITH {TOTAL}, {_sql_faults(flt.REPEATS)}, z AS (SELECT rep, pos, CASE WHEN count(value) OVER q >= 12 THEN abs(value - avg(value) OVER q) > 3.0 * stddev_samp(value) OVER q END AS flagged FROM x WINDOW q AS {_sql_frame(24, "rep")})
    SELECT CASE WHEN kind = 'dropout' THEN kind ELSE 'size' END AS kind, magnitude, CASE WHEN kind = 'dropout' THEN CAST(length AS BIGINT) END AS length, round(avg(CAST(coalesce(flagged, FALSE) AS INTEGER)), 6) AS recall, count(*) AS n
    FROM d JOIN z ON z.rep = d.rep AND z.pos = d.position GROUP BY 1, 2, 3""")
def recall_by_size(spark, sf_dir):
    return rounded(flt.recall_at(load_total(spark, sf_dir), 24, 3.0))


@query(f"WITH {HOUSEHOLDS} SELECT " + ", ".join(["channel", *(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in stats.PERCENTILES), "round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"]) + " FROM p GROUP BY channel")
def household_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(households_measured(spark, sf_dir)))


@query(f"WITH {HOUSEHOLDS}, m AS (SELECT channel, pos, value, median(value) OVER {_sql_frame(WINDOW, 'channel')} AS centre FROM p), h AS (SELECT *, abs(value - centre) AS away, median(abs(value - centre)) OVER {_sql_frame(WINDOW, 'channel')} AS spread FROM m) SELECT channel, count(*) FILTER (away > {SIGMA} * 1.4826 * spread) AS flagged, round(sum(spread), 6) AS spreads FROM h GROUP BY channel")
def household_hampel(spark, sf_dir):
    flags = hampel(households(spark, sf_dir), WINDOW, SIGMA)
    return rounded(flags.groupBy("channel").agg(F.count_if("flagged").alias("flagged"), F.sum("spread").alias("spreads")))


@query()
def distribution_families(spark, sf_dir):
    return distribution_fits(panel(spark, sf_dir))
