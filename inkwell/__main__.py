"""Command line: python -m inkwell <command> (or give this file to spark-submit)."""

from __future__ import annotations

import argparse
import sys
import time

from inkwell.config import ConfigError, RunConfig, load_config


def _load(args) -> RunConfig:
    from inkwell.operators.transforms import load_transforms

    for source in args.transforms or []:
        load_transforms(source)
    return load_config(args.config)


def _session(config: RunConfig):
    from inkwell.session import build_session

    spark = build_session(config.job_name)
    spark.sparkContext.setLogLevel("WARN")
    return spark


def validate_config(args) -> int:
    load_config(args.config)
    print("configuration is valid")
    return 0


def validate_data(args) -> int:
    from inkwell.functions.sharding import check_shard
    from inkwell.operators.shard import select_shard, with_shard
    from inkwell.operators.transforms import apply_named
    from inkwell.operators.validate import preview, validate
    from inkwell.sources.inputs import load_configured

    config = _load(args)
    check_shard(args.shard, args.num_shards)
    rows = load_configured(_session(config), config)
    if args.shard is not None:
        rows = select_shard(with_shard(rows, args.num_shards, id_col=config.id_column_name), args.shard, args.num_shards)
    rows = apply_named(rows, config.apply_udf, config.apply_udf_kwargs)
    report = validate(
        rows, config.api_type, config.input_column_name, config.id_column_name,
        sample=args.sample, completions_kwargs=config.completions_kwargs,
    )
    _show(report)
    _show(preview(rows, args.show, config.input_column_name, config.id_column_name))
    return 1 if report.where("severity = 'error' AND bad_rows > 0").count() else 0


def run_command(args) -> int:
    from inkwell.operators.outcomes import IncompleteShardsError
    from inkwell.plans.run import BreakerTripped, run

    config = _load(args)
    try:
        print(
            run(
                _session(config),
                config,
                num_waves=args.waves,
                completion=args.completion,
                retry_failed=args.retry_failed,
                validate_sample=args.validate_sample,
                progress_path=args.log,
                progress_interval_s=args.interval,
                max_rows_per_file=args.max_rows_per_file,
                resume_index=not args.no_resume_index,
                ledger_path=args.ledger,
                shards=args.shards,
                shard_by=args.shard_by,
                check_unique=args.check_unique,
            )
        )
    except (BreakerTripped, IncompleteShardsError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def _show(rows) -> None:
    """Print all rows of a small table."""
    rows.show(max(1, rows.count()), truncate=False)


JOBS = "name string, job_id bigint, job_state string"


def status(args) -> int:
    from inkwell.functions.sharding import check_shards
    from inkwell.operators.ledger import completed_shards, shard_ledger, status_board
    from inkwell.operators.outcomes import request_log, shard_completion
    from inkwell.operators.progress import progress, status_rows
    from inkwell.operators.status import (
        current_throughput,
        run_summary,
        shard_board,
        shard_stats,
        summary_board,
        throughput_board,
    )
    from inkwell.plans.run import input_totals
    from inkwell.session import materialize
    from inkwell.sources.inputs import load_configured
    from inkwell.sources.ledgers import normalise_jobs, read_ledger
    from inkwell.sources.progress_log import read_progress
    from inkwell.sources.responses import read_results

    config = load_config(args.config)
    shards = check_shards(args.shards, config.num_shards) if args.shards else None
    spark = _session(config)
    # Small tables (a row per shard, or per shard and interval), used several times.
    if not (args.log and args.ledger):
        totals = materialize(input_totals(load_configured(spark, config), config), "totals")
        log = request_log(read_results(spark, config.output_path, config.api_type))
    if args.ledger:
        completed = read_ledger(spark, f"{args.ledger}/completed")
        board = status_board(config.num_shards, completed, normalise_jobs(spark.createDataFrame([], JOBS)))
        _show(board.select("shard", "completed").orderBy("shard"))
        _show(read_ledger(spark, f"{args.ledger}/failed", "failed").orderBy("failed_at", "shard"))
    else:
        ledger = materialize(shard_ledger(shard_completion(totals, log)), "ledger")
        completed = completed_shards(ledger)
        _show(ledger.orderBy("shard"))
    if args.detailed:
        cutoff = time.time() - args.recent_minutes * 60
        if args.log:
            rows = read_progress(spark, args.log)
        else:
            rows = status_rows(progress(log, totals, args.interval, num_shards=config.num_shards, fill_gaps=False))
        rows = materialize(rows, "status")
        if shards is not None:
            rows = rows.where(rows.shard.isin(shards))
        stats = shard_stats(rows, cutoff, shards, config.num_shards)
        _show(shard_board(stats, completed).orderBy("shard"))
        throughput_board(current_throughput(rows, cutoff)).show(truncate=False)
        summary_board(run_summary(rows, completed, cutoff, shards, config.num_shards)).show(truncate=False)
    return 0


def next_shards_command(args) -> int:
    from inkwell.plans.run import next_shards

    config = load_config(args.config)
    for row in next_shards(_session(config), config, args.ledger, args.limit).toLocalIterator():
        print(row.shard)
    return 0


def compact_command(args) -> int:
    from inkwell.sinks.compaction import compact

    config = load_config(args.config)
    print(compact(_session(config), config.output_path, args.max_files, args.target_mb, args.max_rows))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkwell")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, fn, text):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("--config", required=True, help="YAML run configuration")
        sub.add_argument("--transforms", action="append", help="module or .py file that registers transforms")
        sub.set_defaults(fn=fn)
        return sub

    add("validate-config", validate_config, "check a configuration file")
    data = add("validate-data", validate_data, "check the input table")
    data.add_argument("--shard", type=int)
    data.add_argument("--num-shards", type=int)
    data.add_argument("--sample", type=int, help="check only so many rows (default: all)")
    data.add_argument("--show", type=int, default=10, help="rows to print")
    work = add("run", run_command, "send requests for all rows without a response")
    work.add_argument("--waves", type=int, help="committed appends (default: one about every half hour)")
    work.add_argument("--no-resume-index", action="store_true", help="read all results to find what is done")
    work.add_argument("--completion", choices=("attempted", "succeeded"), default="attempted")
    work.add_argument("--retry-failed", action="store_true")
    work.add_argument("--validate-sample", type=int)
    work.add_argument("--log", help="folder for progress records")
    work.add_argument("--interval", type=int, default=60)
    work.add_argument("--ledger", help="folder for completed and failed shards")
    work.add_argument("--shard-by", choices=("hash", "contiguous", "file"), default="hash")
    work.add_argument("--check-unique", action="store_true", help="stop before the first request if an id repeats")
    work.add_argument("--shards", type=int, nargs="*", help="send rows of these shards only")
    work.add_argument("--max-rows-per-file", type=int)
    look = add("status", status, "show shards, throughput and progress")
    look.add_argument("--detailed", action="store_true")
    look.add_argument("--recent-minutes", type=float, default=5.0)
    look.add_argument("--shards", type=int, nargs="*")
    look.add_argument("--interval", type=int, default=60)
    look.add_argument("--log", help="progress records of the runs; without, all results are read")
    look.add_argument("--ledger", help="folder with the completed and failed shards of the runs")
    rest = add("next-shards", next_shards_command, "show shards that no run has completed")
    rest.add_argument("--ledger", required=True)
    rest.add_argument("--limit", type=int)
    merge = add("compact", compact_command, "merge small result files")
    merge.add_argument("--max-files", type=int, default=5)
    merge.add_argument("--target-mb", type=int, default=2000)
    merge.add_argument("--max-rows", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.fn(args)
    except (ConfigError, ValueError, FileNotFoundError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
