"""Command line: python -m wattloom sentinels|interpolate|outliers|tune|calibrate|describe FILE [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wattloom.operators.distributions import channel_statistics
from wattloom.operators.faults import CALIBRATION_ROWS, REPEATS, TUNER_REPEATS, best_cell, calibrate_channels, near_best, recall_at, run_note, sensitivity, stability, tunable, tune_hampel
from wattloom.operators.rolling import DETECTORS, check_detector, flagged_long
from wattloom.operators.stats import coverage, moments
from wattloom.plans.reports import lines_of, report
from wattloom.plans.steps import AggregateStep, InterpolateStep, SentinelStep, run_chain
from wattloom.sources.files import derived_name, load_dataset, load_series, wide, write_report, write_table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wattloom", description=__doc__)
    parser.add_argument("command", choices=("sentinels", "interpolate", "outliers", "tune", "calibrate", "describe"))
    parser.add_argument("file")
    parser.add_argument("--codes", type=float, nargs="+", default=[-999.0])
    parser.add_argument("--max-gap", type=int, default=24)
    parser.add_argument("--method", choices=sorted(DETECTORS), default="zscore")
    parser.add_argument("--window", type=int, default=12)
    parser.add_argument("--sigma", type=float, default=3.0)
    parser.add_argument("--day-first", choices=("yes", "no"), help="which of 1/2/2024 is the day, where the file leaves it open")
    args = parser.parse_args(argv)
    day_first = None if args.day_first is None else args.day_first == "yes"
    spark = SparkSession.builder.appName("wattloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "tune":
        # On the longest run without a gap. With injected faults: the grid, how far each cell lies below the best, and the cells as good as it; as it is: counts of flags.
        series = tunable(load_series(spark, args.file, day_first)).persist()
        grid = sensitivity(tune_hampel(series)).persist()
        write_table(grid.orderBy("window", "sigma"), args.file, derived_name(args.file, "tuning"))
        best = near_best(grid, TUNER_REPEATS, "f_half", "f_half_sd").orderBy(F.desc("f_half"), "window", "sigma")
        flagged = stability(series).orderBy("window", "sigma")
        write_table(flagged, args.file, derived_name(args.file, "stability"))
        text = ["Tuning", "------", f"source: {args.file}", "", "As good as the best", *(f"  {x}" for x in lines_of(best)), "", "Flags on the file", *(f"  {x}" for x in lines_of(flagged, 63))]
        write_report("\n".join(text), args.file, derived_name(args.file, "tuning_report", ".txt"))
        return
    if args.command == "calibrate":
        # The grid on injected faults of the first series; at its best cell, recall by size and by the length of dropouts.
        series = load_series(spark, args.file, day_first).persist()
        grid = calibrate_channels(series, args.method).drop("channel").persist()
        best = best_cell(grid).first()
        if best is None:
            raise ValueError(f"a calibration needs {CALIBRATION_ROWS} readings at least")
        recall = recall_at(series, best.window, best.sigma, detector=args.method).persist()
        closed = grid.where("not reachable").count()
        notes = [f"{closed} of {grid.count()} cells lie beyond what the window can reach and were left out"] if closed else []
        notes += [x for x in (run_note(recall),) if x]
        write_table(grid.orderBy("window", "sigma"), args.file, derived_name(args.file, "calibration"))
        parts = [("Best cell", lines_of(best_cell(grid))), ("As good as the best", lines_of(near_best(grid.where("reachable"), REPEATS).orderBy(F.desc("f1"), "window", "sigma"))), ("Recall at the best cell", lines_of(recall.orderBy(F.desc("kind"), "magnitude", "length"))), ("Remarks", notes)]
        text = ["Calibration", "-----------", f"source: {args.file}", f"method: {args.method}", *(line for title, lines in parts if lines for line in ("", title, *(f"  {x}" for x in lines)))]
        write_report("\n".join(text), args.file, derived_name(args.file, "calibration_report", ".txt"))
        return
    ds = load_dataset(spark, args.file, day_first=day_first)
    if args.command == "describe":
        print(report("Dataset", ds, ds.notes, [("Coverage", lines_of(coverage(ds.readings))), ("Moments", lines_of(moments(ds.readings))), ("Statistics", lines_of(channel_statistics(ds.readings, ds.interval_s)))]))
    elif args.command == "outliers":
        check_detector(args.window, args.sigma)
        flags = flagged_long(DETECTORS[args.method](ds.readings, args.window, args.sigma))
        write_table(flags.orderBy("timestamp", "household"), args.file, derived_name(args.file, "outliers"))
        write_report(report("Outliers", ds, [f"method: {args.method}", f"window: {args.window}", f"sigma: {args.sigma:g}"], [("Per channel", lines_of(flags.groupBy("household").count().orderBy(F.desc("count"), "household")))]), args.file, derived_name(args.file, "outliers_report", ".txt"))
    else:
        steps = [SentinelStep(args.codes)] + ([InterpolateStep(args.max_gap)] if args.command == "interpolate" else [])
        result = run_chain(ds, steps)
        what = "cleaned" if args.command == "sentinels" else "interpolated"
        write_table(wide(result.dataset.readings, ds.names()), args.file, derived_name(args.file, what), header=False)
        write_table(result.ledger, args.file, derived_name(args.file, f"{what}_ledger"))
        if args.command == "interpolate":
            total = AggregateStep().run(result.dataset)
            write_table(total.dataset.readings.select(F.col("ts").alias("timestamp"), F.col("value").alias("total_active_power_kw")).orderBy("timestamp"), args.file, derived_name(args.file, "aggregate"))
        write_report(result.report, args.file, derived_name(args.file, f"{what}_report", ".txt"))


if __name__ == "__main__":
    main()
