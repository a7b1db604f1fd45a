"""Reading panels from files, and writing results."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.model import Dataset
from wattloom.operators.classify import classify, infer_kind
from wattloom.operators.panel import median_interval, minute_floor
from wattloom.operators.screen import numeric
from wattloom.sources.workbooks import read_workbook, write_workbook

SUFFIXES = (".csv", ".txt", ".parquet", ".xlsx")
#: Parts of the timestamp formats that are recognised. Fractions and zones may follow the seconds.
_CLOCKS = ("", " H:mm", " H:mm:ss[.SSSSSSSSS][XXX]", " h:mm a", " h:mm:ss a")
_YEAR_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd")
#: Day first and month first, by what stands between.
_EITHER = ("/", "-", ".")
YEAR_FIRST = tuple(f"{d}{c}" for d in _YEAR_FIRST for c in _CLOCKS) + tuple(f"{d}'T'{c.strip()}" for d in _YEAR_FIRST for c in _CLOCKS[1:3]) + ("d MMM yyyy", "d MMM yyyy H:mm", "d MMM yyyy H:mm:ss", "MMM d, yyyy", "MMM d, yyyy h:mm a")
DAY_FIRST = tuple(f"d{s}M{s}yyyy{c}" for s in _EITHER for c in _CLOCKS)
MONTH_FIRST = tuple(f"M{s}d{s}yyyy{c}" for s in _EITHER for c in _CLOCKS)
FORMATS = YEAR_FIRST + DAY_FIRST + MONTH_FIRST


def _parsed(text: F.Column, formats: tuple[str, ...]) -> F.Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in formats])


def _timestamp(text: F.Column) -> F.Column:
    return _parsed(text, FORMATS)


def time_format(texts: DataFrame, day_first: bool | None = None) -> str:
    """The one format in which a column `_t` of times is written: that which parses most of them, from one aggregate over all formats.

    Where all days of the column are below 13, day and month may change places; such a column is
    an error, unless both ways give the same times or `day_first` says which it is.
    """
    formats = [f for f in FORMATS if day_first is None or f not in (MONTH_FIRST if day_first else DAY_FIRST)]
    kinds = texts.select(F.trim(F.col("_t").cast("string")).alias("_t")).where("_t is not null and _t <> ''")
    counts = kinds.agg(*[F.count(F.try_to_timestamp("_t", F.lit(f))).alias(f"n{k}") for k, f in enumerate(formats)]).first()
    most = max(counts)
    best = [f for f, n in zip(formats, counts, strict=True) if n == most]
    rival = next((f for f in best[1:] if best[0] in DAY_FIRST and f in MONTH_FIRST), None)
    if most and rival:
        a, b = (F.try_to_timestamp("_t", F.lit(f)) for f in (best[0], rival))
        example = kinds.where(a != b).select("_t").first()
        if example:
            raise ValueError(f"{example[0]} and all other times of the column may be day first or month first; say which with day_first")
    return best[0]


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The file's cells as text, in file order where the source has one."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"{suffix or 'a file without suffix'} is not supported; use one of {', '.join(SUFFIXES)}")
    if suffix == ".parquet":
        found = spark.read.parquet(path)
        return found.select(*[F.col(c).cast("string").alias(c) for c in found.columns])
    if suffix == ".xlsx":
        return read_workbook(spark, path)
    return spark.read.csv(path, header=False, inferSchema=False)


def looks_like_header(spark: SparkSession, cell: str | None) -> bool:
    """Whether a first cell is no timestamp."""
    return spark.range(1).select(_timestamp(F.lit(cell)).isNull()).first()[0]


def load_readings(spark: SparkSession, path: str, dedupe: str = "keep", day_first: bool | None = None) -> tuple[DataFrame, bool]:
    """Readings of a wide file, and whether it had no header.

    Without a header the channels are Household_01 and so on. Times are floored to the minute
    and sorted; rows with equal times all stay with dedupe="keep", the first does with "first".
    All times are in one format, found by `time_format`; a row whose time is in another stops the
    load, as does a column that may be day first or month first without `day_first`. Empty rows are left out.
    """
    cells = _raw(spark, path)
    if len(cells.columns) < 2:
        raise ValueError("a panel needs a time column and one channel at least")
    first = cells.first()
    named = PurePosixPath(path).suffix.lower() == ".parquet"
    header = not named and first is not None and looks_like_header(spark, first[0])
    names = list(cells.columns[1:]) if named else [str(x) for x in first[1:]] if header else [f"Household_{k:02d}" for k in range(1, len(cells.columns))]
    # The channels of one file row stay together, so file order is known within it.
    wide = cells.toDF("_t", *[f"_v{k}" for k in range(len(names))]).withColumn("_row", F.monotonically_increasing_id())
    # A time that does not parse is an error that names it, unless the row is empty.
    empty = F.coalesce(*[F.col(c).cast("string") for c in cells.toDF("_t", *[f"_v{k}" for k in range(len(names))]).columns]).isNull()
    is_header = F.lit(header) & (F.col("_t").cast("string") == F.lit(None if first is None else str(first[0])))
    wide = wide.where(~empty & ~F.coalesce(is_header, F.lit(False)))
    wide = wide.withColumn("ts", minute_floor(_parsed(F.col("_t").cast("string"), (time_format(wide, day_first),))))
    wide = wide.withColumn("ts", F.when(F.col("ts").isNull(), F.raise_error(F.concat(F.lit("a time that does not parse: "), F.coalesce(F.col("_t").cast("string"), F.lit("none")))).cast("timestamp_ntz")).otherwise(F.col("ts")))
    if dedupe == "first":
        wide = wide.withColumn("_k", F.row_number().over(Window.partitionBy("ts").orderBy("_row"))).where("_k = 1").drop("_k")
    elif dedupe != "keep":
        raise ValueError("dedupe is keep or first")
    placed = with_positions(wide)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), numeric(F.col(f"_v{k}")).alias("value")) for k, n in enumerate(names)])).alias("c")
    return placed.select("pos", "ts", stacked).select("c.channel", "pos", "ts", "c.value"), not (header or named)


def with_positions(wide: DataFrame) -> DataFrame:
    """Add the dense row number by (ts, _row): ranks within days, and one sum over days."""
    day = wide.withColumn("_day", F.to_date("ts"))
    sizes = day.groupBy("_day").agg(F.count("*").alias("n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("ts", "_row")) - 1
    return day.withColumn("_k", inside).join(bases, "_day").withColumn("pos", (F.col("_base") + F.col("_k")).cast("long")).drop("_day", "_k", "_base")


def load_dataset(spark: SparkSession, path: str, dedupe: str = "keep", day_first: bool | None = None) -> Dataset:
    """Load and classify. Columns that are all called Household_… count as headerless."""
    readings, headerless = load_readings(spark, path, dedupe, day_first)
    names = {r.channel for r in readings.select("channel").distinct().collect()}
    headerless = headerless or all(n.startswith("Household_") for n in names)
    channels = classify(readings, headerless)
    interval = int(median_interval(readings).first().interval_s)
    return Dataset(readings, channels, infer_kind(channels), path, "Raw", interval, tuple(c.note for c in channels if c.note))


def load_series(spark: SparkSession, path: str, day_first: bool | None = None) -> DataFrame:
    """The first numeric column of a file, as readings."""
    readings, _ = load_readings(spark, path, day_first=day_first)
    counts = readings.groupBy("channel").agg(F.count("value").alias("n")).where("n > 0")
    order = {c: k for k, c in enumerate(dict.fromkeys(r.channel for r in readings.where("pos = 0").select("channel").collect()))}
    names = sorted((r.channel for r in counts.collect()), key=lambda c: order.get(c, 1 << 30))
    if not names:
        raise ValueError("no numeric column")
    return readings.where(F.col("channel") == names[0])


def wide(readings: DataFrame, names: list[str]) -> DataFrame:
    """One column a channel, for export."""
    return readings.groupBy("pos", "ts").pivot("channel", names).agg(F.first("value")).orderBy("pos").drop("pos")


def refuse_overwrite(source: str, target: str) -> None:
    if PurePosixPath(source) == PurePosixPath(target):
        raise ValueError("the input is never overwritten; choose another name")


def derived_name(source: str, what: str, suffix: str = ".csv") -> str:
    """<stem>_cleaned.csv and the like, next to the input."""
    p = PurePosixPath(source)
    return str(p.with_name(f"{p.stem}_{what}{suffix}"))


def write_table(df: DataFrame, source: str, target: str, header: bool = True) -> None:
    """CSV or Parquet by the suffix of `target`, as a folder of part files, or a workbook of one sheet."""
    refuse_overwrite(source, target)
    if target.endswith(".xlsx"):
        return write_workbook(df, target, header)
    if target.endswith(".parquet"):
        df.write.parquet(target)
    else:
        df.write.csv(target, header=header)


def write_report(text: str, source: str, target: str) -> None:
    """A small text file, written by the driver."""
    refuse_overwrite(source, target)
    with open(target, "w", encoding="utf-8") as f:
        f.write(text if text.endswith("\n") else text + "\n")
