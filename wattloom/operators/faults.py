"""Synthetic faults, and how well detectors find them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.sliding import short_medians, short_zscores, sliding_median
from wattloom.operators.chunks import CHUNK, chunk_window, own_rows, renumbered, with_halo
from wattloom.operators.gaps import longest_complete_run
from wattloom.operators.order import exact_median
from wattloom.operators.rolling import DETECTORS, MAD_TO_SIGMA, hampel_excess, hampel_excesses, max_achievable_zscore, reach, rolling_mad

#: Grids, fault sizes and counts of the two calibrations.
WINDOWS, SIGMAS = (6, 12, 24, 36, 48, 72), (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
MAGNITUDES, N_FAULTS, REPEATS, KINDS = (3.0, 5.0, 8.0, 12.0), 120, 5, ("spike", "dip", "dropout")
TUNER_WINDOWS, TUNER_SIGMAS = (6, 12, 24, 48, 96, 144, 288), (2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 10.0)
TUNER_KINDS, TUNER_MAGNITUDES, TUNER_REPEATS, TUNER_FAULTS = ("spike", "dropout", "level_shift", "flatline"), (4.0, 6.0, 10.0), 3, 40
SCALE_WINDOW = 48
#: Fixed value: rows that a calibration needs.
CALIBRATION_ROWS = 500
#: Least distance of faults, rows left alone at the ends, rows of the longest dropout.
GAP, MARGIN, LONGEST = 20, 100, 3
#: The same of the tuner: distance, and least and most rows of a run.
APART, RUN = 60, (3, 9)
#: Rows of a dropout keep up to such a share of their value.
LEFT_OVER = 0.05


def draw(seed: int | Column, what: str, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 by a seeded hash of `parts`, the same wherever and whenever it is made."""
    text = F.concat_ws("|", *((F.lit(p) if isinstance(p, int) else p).cast("string") for p in (seed, F.lit(what), *parts)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _pick(values: Sequence, drawn: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (drawn % len(values)).cast("int"))


def slots(first: int, end: int, wanted: int, least: int) -> tuple[int, int]:
    """Width and number of equal slots in the rows first .. end - 1: as many as wanted, but none narrower than `least`."""
    rows = max(0, end - first)
    width = max(least, rows // max(1, wanted))
    return width, min(wanted, rows // width)


def _numbered(spark: SparkSession, repeats: int, n_slots: int) -> DataFrame:
    ids = spark.range(repeats * n_slots)
    return ids.select(F.expr(f"cast(id div {max(1, n_slots)} as int)").alias("rep"), (F.col("id") % max(1, n_slots)).cast("int").alias("fault"))


def draw_faults(spark: SparkSession, n: int, seed: int, repeats: int = REPEATS, n_faults: int = N_FAULTS, magnitudes: Sequence[float] = MAGNITUDES, kinds: Sequence[str] = KINDS, gap: int = GAP, margin: int = MARGIN, longest: int = LONGEST) -> DataFrame:
    """(rep, fault, kind, position, length, magnitude, sign): spikes, dips and dropouts for a series of n rows.

    The series is cut into slots, and each has one fault, so far from the slot's end that
    faults keep their distance. All is drawn by a seeded hash of repetition and slot.
    """
    width, n_slots = slots(margin, n - margin - longest, n_faults, gap)
    key = (F.col("rep"), F.col("fault"))
    out = _numbered(spark, repeats, n_slots).withColumn("kind", _pick(kinds, draw(seed, "kind", *key)))
    dropout = F.col("kind") == "dropout"
    place = F.lit(margin) + F.col("fault").cast("long") * width + draw(seed, "place", *key) % (width - gap + 1)
    length = F.when(dropout, 1 + draw(seed, "length", *key) % longest).otherwise(1)
    size = F.when(~dropout, _pick([float(m) for m in magnitudes], draw(seed, "size", *key)))
    sign = F.when(dropout, 0.0).when(F.col("kind") == "spike", 1.0).otherwise(-1.0)
    return out.select(*key, "kind", place.alias("position"), length.cast("long").alias("length"), size.alias("magnitude"), sign.alias("sign"), F.lit(seed).alias("seed"))


def draw_runs(spark: SparkSession, n: int, seed: int, repeats: int = TUNER_REPEATS, n_faults: int = TUNER_FAULTS, magnitudes: Sequence[float] = TUNER_MAGNITUDES, kinds: Sequence[str] = TUNER_KINDS, apart: int = APART) -> DataFrame:
    """The tuner's faults, in the same form: spikes, and runs of 3 to 9 rows, at least `apart` rows from each other and the ends."""
    width, n_slots = slots(apart, n - apart, n_faults, apart + RUN[1])
    key = (F.col("rep"), F.col("fault"))
    out = _numbered(spark, repeats, n_slots).withColumn("kind", _pick(kinds, draw(seed, "kind", *key)))
    out = out.withColumn("length", F.when(F.col("kind") == "spike", 1).otherwise(RUN[0] + draw(seed, "length", *key) % (RUN[1] - RUN[0] + 1)).cast("long"))
    place = F.lit(apart) + F.col("fault").cast("long") * width + draw(seed, "place", *key) % (F.lit(width - apart + 1) - F.col("length"))
    size = F.when(F.col("kind").isin("spike", "level_shift"), _pick([float(m) for m in magnitudes], draw(seed, "size", *key)))
    sign = F.when(draw(seed, "sign", *key) % 2 == 0, 1.0).otherwise(-1.0)
    return out.select(*key, "kind", place.alias("position"), "length", size.alias("magnitude"), sign.alias("sign"), F.lit(seed).alias("seed"))


def local_scale(readings: DataFrame, window: int = SCALE_WINDOW) -> DataFrame:
    """Adds `unit`: the rolling robust scale, or its median where that is 0 or missing."""
    scaled = rolling_mad(readings, window).withColumn("unit", F.when(F.col("scale") > 0, F.col("scale"))).drop("scale", "centre")
    middle = scaled.groupBy("channel").agg(F.percentile("unit", F.lit(0.5)).alias("_m"))
    return scaled.join(middle, "channel").withColumn("unit", F.coalesce("unit", "_m")).drop("_m")


def apply_faults(series: DataFrame, faults: DataFrame, tuner: bool = False) -> DataFrame:
    """(rep, channel, pos, ts, value, fault, kind, magnitude): the series once for each repetition, damaged. `series` has `unit`.

    Repetitions are a handful, so each row is copied by an array of them; faults, a few rows
    for each, meet their rows by an equi-join on (rep, pos).
    """
    reps = [r.rep for r in faults.select("rep").distinct().orderBy("rep").collect()]
    copies = series.withColumn("rep", F.explode(F.array(*map(F.lit, reps)) if reps else F.array().cast("array<int>")))
    rows = faults.withColumn("pos", F.explode(F.sequence("position", F.col("position") + F.col("length") - 1)))
    v = F.col("value")
    if tuner:
        first = series.select(F.col("pos").alias("position"), v.alias("first"))
        rows = rows.join(first, "position", "left").withColumn("left_over", F.lit(LEFT_OVER))
        damaged = F.when(F.col("kind") == "flatline", F.col("first")).when(F.col("kind") == "dropout", v * F.col("left_over")).otherwise(v + F.col("sign") * F.col("magnitude") * F.col("unit"))
    else:
        rows = rows.withColumn("left_over", LEFT_OVER * (draw(F.col("seed"), "left", F.col("rep"), F.col("pos")) / F.lit(float(2**32))))
        damaged = F.when(F.col("kind") == "dropout", v * F.col("left_over")).otherwise(F.greatest(v + F.col("sign") * F.col("magnitude") * F.col("unit"), F.lit(0.0)))
    out = copies.join(rows.drop("position", "length", "seed"), ["rep", "pos"], "left")
    return out.select("rep", "channel", "pos", "ts", F.when(F.col("fault").isNull(), v).otherwise(damaged).alias("value"), "fault", "kind", "magnitude")


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def point_scores(flags: DataFrame, by: Sequence[str] = ("rep",)) -> DataFrame:
    """precision, recall and f1 of rows; 0 where nothing is to divide by."""
    truth = F.col("fault").isNotNull()
    counts = flags.groupBy(*by).agg(F.count_if(F.col("flagged") & truth).alias("tp"), F.count_if(F.col("flagged") & ~truth).alias("fp"), F.count_if(~F.col("flagged") & truth).alias("fn"))
    scored = counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def event_scores(flags: DataFrame, by: Sequence[str] = ("rep",)) -> DataFrame:
    """tp, fp, n_flagged, precision of rows (missing if nothing is flagged), recall of events, f1 and the precision-heavy f_half."""
    truth = F.col("fault").isNotNull()
    rows = flags.groupBy(*by).agg(F.count_if(F.col("flagged") & truth).alias("tp"), F.count_if(F.col("flagged") & ~truth).alias("fp"), F.count_if("flagged").alias("n_flagged"))
    events = flags.where(truth).groupBy(*by, "fault").agg(F.max(F.col("flagged").cast("int")).alias("found")).groupBy(*by).agg(F.avg("found").alias("recall_event"))
    out = rows.join(events, list(by), "left").withColumn("recall_event", F.coalesce("recall_event", F.lit(0.0))).withColumn("precision", F.try_divide(F.col("tp"), F.col("n_flagged")))
    p, r = F.col("precision"), F.col("recall_event")
    return out.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("f_half", _ratio(1.25 * p * r, 0.25 * p + r))


def recall_by_magnitude(flags: DataFrame) -> DataFrame:
    """(magnitude, recall, n) of single-row faults."""
    return flags.where("fault is not null and magnitude is not null").groupBy("magnitude").agg(F.avg(F.col("flagged").cast("double")).alias("recall"), F.count("*").alias("n"))


def peak_hour_share(flags: DataFrame, first_hour: int = 17, last_hour: int = 21) -> DataFrame:
    """One row: the share of false alarms in peak hours, that of all rows, and their ratio."""
    peak, false = F.hour("ts").between(first_hour, last_hour), F.col("flagged") & F.col("fault").isNull()
    out = flags.agg(_ratio(F.count_if(false & peak), F.count_if(false)).alias("fp_share"), _ratio(F.count_if(peak), F.count("*")).alias("base_share"))
    return out.withColumn("enrichment", _ratio(F.col("fp_share"), F.col("base_share")))


def _as_channels(damaged: DataFrame) -> DataFrame:
    """Each repetition of a channel as a channel of its own."""
    return damaged.withColumn("channel", F.concat_ws("#", "channel", "rep"))


def calibrate(series: DataFrame, seed: int = 42, windows: Sequence[int] = WINDOWS, sigmas: Sequence[float] = SIGMAS, repeats: int = REPEATS, n_faults: int = N_FAULTS, magnitudes: Sequence[float] = MAGNITUDES) -> DataFrame:
    """(window, sigma, precision, recall, f1, f1_std, baseline_flags, reachable) of the rolling z-score on one channel.

    Mean and deviation are taken once a window; all sigmas are thresholds on them. Missing rows
    are dropped first, the rest renumbered. Needs 500 rows.
    """
    rows = renumbered(series)
    n = rows.count()
    if n < CALIBRATION_ROWS:
        raise ValueError(f"a calibration needs {CALIBRATION_ROWS} readings at least")
    scaled = local_scale(rows.select("channel", "pos", "ts", "value"))
    faults = draw_faults(series.sparkSession, n, seed, repeats, n_faults, magnitudes)
    damaged = _as_channels(apply_faults(scaled, faults))
    clean = rows.select(F.lit(-1).alias("rep"), F.concat_ws("#", "channel", F.lit("-1")).alias("channel"), "pos", "ts", "value", F.lit(None).cast("int").alias("fault"))
    both = damaged.select("rep", "channel", "pos", "ts", "value", "fault").unionByName(clean)
    return _grid(_zscores(both, windows), [], windows, sigmas, True)


def _zscores(readings: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Adds z<window> for each window: how many of its standard deviations a row lies from its mean."""
    before, after = max(reach(w)[0] for w in windows), max(reach(w)[1] for w in windows)
    haloed = with_halo(readings, before, after)
    for w in windows:
        b, a = reach(w)
        frame = chunk_window().rowsBetween(-b, a)
        z = F.abs(F.col("value") - F.avg("value").over(frame)) / F.nullif(F.stddev_samp("value").over(frame), F.lit(0.0))
        haloed = haloed.withColumn(f"z{w}", F.when(F.count("value").over(frame) >= max(3, w // 2), z))
    return own_rows(haloed)


def _grid(deviations: DataFrame, by: list[str], windows: Sequence[int], sigmas: Sequence[float], bounded: bool) -> DataFrame:
    """The calibration's grid for each of `by`, from rows with rep (-1: as it is), fault and z<window>; all cells are counted in one aggregate.

    `bounded` detectors can't reach every sigma in every window.
    """
    truth, sums = F.col("fault").isNotNull(), []
    for w, s in _cells(windows, sigmas):
        flagged = F.coalesce(F.col(f"z{w}") > s, F.lit(False))
        sums += [F.count_if(flagged & truth).alias(_named("tp", w, s)), F.count_if(flagged & ~truth).alias(_named("fp", w, s))]
    return _scores(deviations.groupBy(*by, "rep").agg(F.count_if(truth).alias("faults"), *sums), by, windows, sigmas, bounded)


def _cells(windows: Sequence[int], sigmas: Sequence[float]) -> list[tuple[int, float]]:
    return [(w, s) for w in windows for s in sigmas]


def _named(what: str, window: int, sigma: float) -> str:
    return f"{what}_{window}_{sigma:g}".replace(".", "_")


def _scores(counts: DataFrame, by: list[str], windows: Sequence[int], sigmas: Sequence[float], bounded: bool) -> DataFrame:
    """The grid from rows with rep, faults, and tp and fp of every cell."""
    cells = _cells(windows, sigmas)
    grid = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(float(s)).alias("sigma"), F.lit(bool(not bounded or s < max_achievable_zscore(w))).alias("reachable"), F.col(_named("tp", w, s)).alias("tp"), F.col(_named("fp", w, s)).alias("fp")) for w, s in cells])
    long = counts.select(*by, "rep", "faults", F.explode(grid).alias("g")).select(*by, "rep", "faults", "g.*")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("faults"))
    long = long.withColumn("p", p).withColumn("r", r).withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    own = F.col("rep") >= 0
    return long.groupBy(*by, "window", "sigma").agg(F.avg(F.when(own, F.col("p"))).alias("precision"), F.avg(F.when(own, F.col("r"))).alias("recall"), F.avg(F.when(own, F.col("f"))).alias("f1"), F.stddev_pop(F.when(own, F.col("f"))).alias("f1_std"), F.max(F.when(~own, F.col("fp"))).alias("baseline_flags"), F.first("reachable").alias("reachable"))


def draw_faults_by_channel(sizes: DataFrame, seed: int, repeats: int = REPEATS, n_faults: int = N_FAULTS, magnitudes: Sequence[float] = MAGNITUDES, kinds: Sequence[str] = KINDS, gap: int = GAP, margin: int = MARGIN, longest: int = LONGEST) -> DataFrame:
    """`draw_faults` for every (channel, n) of `sizes`, each with slots of its own; the channel's name takes part in the draws."""
    rows = F.greatest(F.lit(0), F.col("n") - 2 * margin - longest)
    slotted = sizes.withColumn("_w", F.greatest(F.lit(gap), F.floor(rows / n_faults))).withColumn("_s", F.least(F.lit(n_faults), F.floor(rows / F.col("_w"))))
    some = slotted.where("_s > 0").withColumn("rep", F.explode(F.array(*map(F.lit, range(repeats))))).withColumn("fault", F.explode(F.sequence(F.lit(0), F.col("_s").cast("int") - 1)))
    key = (F.col("channel"), F.col("rep"), F.col("fault"))
    out = some.withColumn("kind", _pick(kinds, draw(seed, "kind", *key)))
    dropout = F.col("kind") == "dropout"
    place = F.lit(margin) + F.col("fault").cast("long") * F.col("_w") + draw(seed, "place", *key) % (F.col("_w") - gap + 1)
    length = F.when(dropout, 1 + draw(seed, "length", *key) % longest).otherwise(1)
    size = F.when(~dropout, _pick([float(m) for m in magnitudes], draw(seed, "size", *key)))
    sign = F.when(dropout, 0.0).when(F.col("kind") == "spike", 1.0).otherwise(-1.0)
    return out.select(*key, "kind", place.alias("position"), length.cast("long").alias("length"), size.alias("magnitude"), sign.alias("sign"))


def calibrate_channels(readings: DataFrame, detector: str = "zscore", seed: int = 42, windows: Sequence[int] = WINDOWS, sigmas: Sequence[float] = SIGMAS, repeats: int = REPEATS, n_faults: int = N_FAULTS, magnitudes: Sequence[float] = MAGNITUDES) -> DataFrame:
    """(channel, window, sigma, precision, recall, f1, f1_std, baseline_flags, reachable): the grid of every channel, in one job.

    `detector` is zscore or hampel. Missing rows are dropped first and the rest renumbered; channels
    that then have fewer than 500 rows are left out.
    """
    if detector not in ("zscore", "hampel"):
        raise ValueError("the detector is zscore or hampel")
    # Read by the counts, the draws and the detectors, so that what is upstream runs once.
    readings = readings.where("value is not null").select("channel", "pos", "value").persist(StorageLevel.DISK_ONLY)
    rows = renumbered(readings)
    sizes = readings.groupBy("channel").agg(F.count("*").alias("n")).where(F.col("n") >= CALIBRATION_ROWS)
    faults = draw_faults_by_channel(sizes, seed, repeats, n_faults, magnitudes)
    hit = faults.withColumn("pos", F.explode(F.sequence("position", F.col("position") + F.col("length") - 1)))
    left = LEFT_OVER * (draw(seed, "left", F.col("channel"), F.col("rep"), F.col("pos")) / F.lit(float(2**32)))
    hit = hit.select("channel", "rep", "pos", F.when(F.col("kind") == "dropout", left).alias("left"), (F.col("sign") * F.col("magnitude")).alias("change"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > CHUNK:
        # Channels of several chunks know the median of their scales beforehand; others find it where they are judged.
        long = rows.join(sizes.where(F.col("n") > CHUNK).select("channel").hint("merge"), "channel", "left_semi")
        scales = rolling_mad(long, SCALE_WINDOW).select("channel", F.when(F.col("scale") > 0, F.col("scale")).alias("value"))
        sizes = sizes.join(exact_median(scales, "middle").hint("merge"), "channel", "left")
    else:
        sizes = sizes.withColumn("middle", F.lit(None).cast("double"))
    wide = 1 if detector == "zscore" else 2
    before, after = (wide * max(reach(w)[k] for w in windows) for k in (0, 1))
    around = reach(SCALE_WINDOW)
    heads = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    known = heads.withColumn("rep", F.lit(-1)).unionByName(with_halo(hit, before, after), allowMissingColumns=True).select(F.col("channel").alias("of"), "chunk", "rep", "pos", "left", "change", "n", "middle")
    judge = _judge(detector, windows, sigmas, repeats)
    schema = ", ".join(["channel string", "rep int", "faults long", *(f"{_named(what, *cell)} long" for cell in _cells(windows, sigmas) for what in ("tp", "fp"))])
    chunks = with_halo(rows, before + around[0], after + around[1]).groupBy("channel", "chunk").cogroup(known.groupBy("of", "chunk"))
    counts = chunks.applyInArrow(judge, schema)
    sums = counts.groupBy("channel", "rep").agg(*[F.sum(c).alias(c) for c in counts.columns if c not in ("channel", "rep")])
    return _scores(sums, ["channel"], windows, sigmas, detector == "zscore")


def _units(values: np.ndarray, at: np.ndarray, middle: float | None) -> np.ndarray:
    """The local scale of the rows `at`, or the median of all scales where it is 0; that of `values` unless it is known."""
    before, after = reach(SCALE_WINDOW)
    rows = values[at[:, None] + np.arange(-before, after + 1)]
    half = SCALE_WINDOW >> 1
    mid = lambda x: 0.5 * (x[:, (SCALE_WINDOW - 1) >> 1] + x[:, half])
    scale = MAD_TO_SIGMA * mid(np.sort(np.abs(rows - mid(np.sort(rows, axis=1))[:, None]), axis=1))
    if (scale > 0).all():
        return scale
    if middle is None:
        all_ = MAD_TO_SIGMA * sliding_median(values, before, after, deviation=True)[1]
        middle = np.median(all_[all_ > 0]) if (all_ > 0).any() else np.nan
    return np.where(scale > 0, scale, middle)


def _judge(detector: str, windows: Sequence[int], sigmas: Sequence[float], repeats: int):
    """Counts a chunk's found and false rows in every cell: (rows, its head and faults) -> a row for the series as it is and each repetition.

    A head has rep -1 and no pos; channels too short to be judged have none. Repetitions are rows of one array.
    """
    cells = _cells(windows, sigmas)

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        is_head = known["rep"].to_numpy() < 0
        names = ["channel", "rep", "faults", *(_named(what, *cell) for cell in cells for what in ("tp", "fp"))]
        if not is_head.any() or not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), *[pa.array([], pa.int64())] * (len(names) - 2)], names)
        head = known.filter(pa.array(is_head)).slice(0, 1).to_pylist()[0]
        rows, known = rows.sort_by("pos"), known.filter(pa.array(~is_head))
        pos, values = rows["pos"].to_numpy(), rows["value"].to_numpy()
        at, rep = known["pos"].to_numpy() - pos[0], known["rep"].to_numpy() + 1
        copies, truth = np.tile(values, (repeats + 1, 1)), np.zeros((repeats + 1, len(values)), bool)
        if len(at):
            left, change = known["left"].to_numpy(), known["change"].to_numpy()
            drop, unit = left == left, np.full(len(at), np.nan)
            if not drop.all():
                unit[~drop] = _units(values, at[~drop], head["middle"])
            # Without any scale a fault is 0.
            copies[rep, at] = np.where(drop, values[at] * left, np.fmax(values[at] + change * unit, 0.0))
            truth[rep, at] = True
        own = pos // CHUNK == head["chunk"]
        truth, out = truth[:, own], []
        for w in windows:
            before, after = reach(w)
            if detector == "zscore":
                x = short_zscores(copies, before, after, max(3, w // 2), int(pos[0]))
            else:
                away = np.abs(copies - _medians(copies, before, after))
                spread = MAD_TO_SIGMA * _medians(away, before, after)
                x = np.divide(away, spread, out=np.full(away.shape, np.nan), where=spread > 0)
            for s in sigmas:
                flagged = x[:, own] > s
                out += [(flagged & truth).sum(axis=1), (flagged & ~truth).sum(axis=1)]
        return pa.Table.from_arrays([pa.array([head["of"]] * (repeats + 1), pa.string()), pa.array(range(-1, repeats), pa.int32()), pa.array(truth.sum(axis=1), pa.int64()), *(pa.array(c, pa.int64()) for c in out)], names)

    return judge


#: Windows of more rows are cheaper as sorted lists.
SORTED_AT = 64


def _medians(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return short_medians(x, before, after) if before + after < SORTED_AT else np.stack([sliding_median(v, before, after)[0] for v in x])


def recall_at(series: DataFrame, window: int, sigma: float, seed: int = 42, repeats: int = REPEATS, n_faults: int = N_FAULTS, magnitudes: Sequence[float] = MAGNITUDES, detector: str = "zscore") -> DataFrame:
    """(kind, magnitude, length, recall, n) of a detector at one cell: the share of faults whose first row is flagged."""
    rows = renumbered(series)
    faults = draw_faults(series.sparkSession, rows.count(), seed, repeats, n_faults, magnitudes)
    damaged = _as_channels(apply_faults(local_scale(rows.select("channel", "pos", "ts", "value")), faults))
    flags = DETECTORS[detector](damaged, window, sigma).select("rep", "pos", "flagged")
    first = faults.select("rep", F.col("position").alias("pos"), F.when(F.col("kind") == "dropout", "dropout").otherwise("size").alias("kind"), "magnitude", F.when(F.col("kind") == "dropout", F.col("length")).alias("length"))
    return first.join(flags, ["rep", "pos"]).groupBy("kind", "magnitude", "length").agg(F.avg(F.col("flagged").cast("double")).alias("recall"), F.count("*").alias("n"))


#: Fixed value: how far recall may fall from the shortest to the longest dropout before it is remarked on.
FALL = 0.05


def run_note(recall: DataFrame) -> str:
    """What `recall_at` says of dropouts of several rows; empty where length makes no difference."""
    runs = [(r.length, r.recall) for r in recall.where("kind = 'dropout'").orderBy("length").collect()]
    if len(runs) < 2 or runs[0][1] - runs[-1][1] <= FALL:
        return ""
    shares = ", ".join(f"{100 * share:.0f}% at {n} row{'s' * (n > 1)}" for n, share in runs)
    return f"first rows of dropouts found: {shares}; bad rows in a row lie in each other's windows and widen the spread"


def best_cell(grid: DataFrame) -> DataFrame:
    """The reachable cell with the highest f1, the first of equals."""
    return grid.where("reachable").orderBy(F.desc("f1"), "window", "sigma").limit(1)


def near_best(grid: DataFrame, repeats: int, score: str = "f1", spread: str = "f1_std") -> DataFrame:
    """Cells within one standard error of the best."""
    top = grid.orderBy(F.desc(score), "window", "sigma").limit(1).select((F.col(score) - F.col(spread) / repeats**0.5).alias("bar"))
    return grid.withColumn("k", F.lit(1)).join(F.broadcast(top.withColumn("k", F.lit(1))), "k").where(F.col(score) >= F.col("bar")).drop("k", "bar")


def _name(what: str, k: int) -> str:
    return f"{what}_{k}"


def _by_sigma(counts: DataFrame, keys: Sequence[str], sigmas: Sequence[float], kinds: Sequence[str]) -> DataFrame:
    """One row a sigma from one column for each kind of count and sigma."""
    cells = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), *(F.col(_name(c, k)).alias(c) for c in kinds)) for k, s in enumerate(sigmas)])
    return counts.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def tune_hampel(series: DataFrame, seed: int = 0, windows: Sequence[int] = TUNER_WINDOWS, sigmas: Sequence[float] = TUNER_SIGMAS, repeats: int = TUNER_REPEATS, n_faults: int = TUNER_FAULTS, magnitudes: Sequence[float] = TUNER_MAGNITUDES) -> DataFrame:
    """(window, sigma, tp, fp, precision, recall_event, f1, f_half, n_flagged, f_half_sd) of the two-stage filter.

    Each window is filtered once: the largest excess of each fault, and counts of rows beyond
    every sigma, come from one aggregate.
    """
    n = series.count()
    centre = series.agg(F.percentile("value", F.lit(0.5))).first()[0]
    spread = series.agg(F.percentile(F.abs(F.col("value") - centre), F.lit(0.5)), F.stddev_pop("value")).first()
    unit = MAD_TO_SIGMA * spread[0] if spread[0] else spread[1]
    faults = draw_runs(series.sparkSession, n, seed, repeats, n_faults, magnitudes)
    damaged = _as_channels(apply_faults(series.select("channel", "pos", "ts", "value").withColumn("unit", F.lit(float(unit))), faults, tuner=True))
    excess = hampel_excess(damaged, windows)
    beyond = lambda s: F.coalesce(F.col("excess") > float(s), F.lit(False))
    truth = F.col("fault").isNotNull()
    # Rows of one fault first, then all of a repetition: both count every sigma at once.
    by_fault = excess.groupBy("rep", "window", "fault").agg(*[F.count_if(beyond(s)).alias(_name("hits", k)) for k, s in enumerate(sigmas)])
    sums = []
    for k in range(len(sigmas)):
        hits = F.col(_name("hits", k))
        sums += [F.sum(F.when(truth, hits).otherwise(0)).alias(_name("tp", k)), F.sum(F.when(~truth, hits).otherwise(0)).alias(_name("fp", k)), F.avg(F.when(truth, (hits > 0).cast("int"))).alias(_name("recall_event", k))]
    cells = _by_sigma(by_fault.groupBy("rep", "window").agg(*sums), ("rep", "window"), sigmas, ("tp", "fp", "recall_event"))
    cells = cells.withColumn("n_flagged", F.col("tp") + F.col("fp")).withColumn("recall_event", F.coalesce("recall_event", F.lit(0.0))).withColumn("precision", F.try_divide(F.col("tp"), F.col("n_flagged")))
    p, r = F.col("precision"), F.col("recall_event")
    cells = cells.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("f_half", _ratio(1.25 * p * r, 0.25 * p + r))
    means = [F.avg(c).alias(c) for c in ("tp", "fp", "precision", "recall_event", "f1", "f_half", "n_flagged")]
    return cells.groupBy("window", "sigma").agg(*means, F.stddev_pop("f_half").alias("f_half_sd"))


#: Fixed value: rows that the tuner needs.
TUNER_ROWS = 2000


def tunable(series: DataFrame) -> DataFrame:
    """The first of the longest runs without a gap, numbered from 0; an error below TUNER_ROWS rows."""
    best = longest_complete_run(series).orderBy(F.desc("length"), "channel").head()
    if best is None or best.length < TUNER_ROWS:
        raise ValueError(f"the longest run without a gap has {best.length if best else 0} rows; tuning needs {TUNER_ROWS}")
    own = series.where((F.col("channel") == best.channel) & F.col("pos").between(best.start, best.end))
    return own.withColumn("pos", F.col("pos") - F.lit(best.start))


def stability(series: DataFrame, windows: Sequence[int] = TUNER_WINDOWS, sigmas: Sequence[float] = TUNER_SIGMAS) -> DataFrame:
    """(window, sigma, n_flagged, pct_flagged) on the series as it is."""
    beyond = [F.count_if(F.coalesce(F.col("excess") > float(s), F.lit(False))).alias(_name("n_flagged", k)) for k, s in enumerate(sigmas)]
    counts = hampel_excess(series, windows).groupBy("window").agg(F.count("*").alias("n"), *beyond)
    long = _by_sigma(counts, ("window", "n"), sigmas, ("n_flagged",))
    return long.select("window", "sigma", "n_flagged", (100 * F.col("n_flagged") / F.col("n")).alias("pct_flagged"))


def sensitivity(grid: DataFrame, score: str = "f_half") -> DataFrame:
    """Adds `drop`: how far each cell lies below the best score."""
    top = grid.agg(F.max(score).alias("_top")).withColumn("k", F.lit(1))
    return grid.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").withColumn("drop", F.col("_top") - F.col(score)).drop("k", "_top")


def surface(grid: DataFrame, score: str, sigmas: Sequence[float]) -> DataFrame:
    """One row a window, one column a sigma."""
    return grid.groupBy("window").pivot("sigma", [float(s) for s in sigmas]).agg(F.first(score)).orderBy("window")

