"""Command line: ``python -m colloquy.cli -i export.json -o out``."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from . import __version__
from .config import PipelineConfig
from .plans.pipeline import Pipeline
from .schema import AdapterKind, OutputFormat
from .sinks import write_all
from .sources import pick_adapter
from .sources.base import read_header, survey


def _format(text: str) -> OutputFormat:
    try:
        return OutputFormat.parse(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def _adapter(text: str) -> AdapterKind:
    try:
        return AdapterKind(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"unknown adapter: {text}") from None


def _days(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("days cannot be negative")
    return n


def _moment(text: str) -> datetime:
    out = datetime.fromisoformat(text)
    return out if out.tzinfo else out.replace(tzinfo=timezone.utc)


def parser() -> argparse.ArgumentParser:
    defaults = PipelineConfig.with_safe_defaults()
    p = argparse.ArgumentParser("colloquy", description="Compiles a chat export into a compact, clean message set.")
    p.add_argument("-i", "--input", required=True, help="export file, or a folder of them")
    p.add_argument("-o", "--output", required=True, help="output folder")
    p.add_argument("-f", "--format", type=_format, default=OutputFormat.JSONL, help="jsonl, markdown or both")
    p.add_argument("--adapter", type=_adapter, help="chatgpt, claude_web, gemini or claude_code; found from the file if not given")
    p.add_argument("--dedup-threshold", type=float, default=defaults.dedup_threshold)
    p.add_argument("--signal-min", type=float, default=defaults.signal_min)
    p.add_argument("--max-age-days", type=_days, default=defaults.max_thread_age_days)
    p.add_argument("--stats", action="store_true", help="print counters")
    p.add_argument("--dry-run", action="store_true", help="write nothing")
    p.add_argument("--info", action="store_true", help="print what this is and stop")
    p.add_argument("--now", type=_moment, help="moment from which ages count, ISO 8601; now if not given")
    p.add_argument("--version", action="version", version=f"colloquy {__version__}")
    return p


def _info() -> None:
    print(f"colloquy {__version__}")
    print("adapters: " + ", ".join(k.value for k in AdapterKind))
    print("readable: " + AdapterKind.CHATGPT.value)
    print("formats: " + ", ".join(f.value for f in OutputFormat))
    print("engine: Apache Spark")


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.info:
        _info()
        return 0
    config = PipelineConfig.with_safe_defaults(dedup_threshold=args.dedup_threshold, signal_min=args.signal_min, max_thread_age_days=args.max_age_days)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("colloquy").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _compile(spark, args, config)
    except Exception as e:
        _say(f"error: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        return 1


def _compile(spark, args: argparse.Namespace, config: PipelineConfig) -> int:
    path = args.input if "://" in args.input else os.path.abspath(args.input)
    root = args.output if "://" in args.output else os.path.abspath(args.output)
    sample, many = survey(spark, path)
    adapter = pick_adapter(args.adapter, read_header(spark, sample))
    if adapter is None:
        raise ValueError(f"no adapter for {args.adapter.value if args.adapter else args.input}")
    _say(f"detected adapter: {adapter.kind.value}")
    messages = adapter.read_many(spark, path) if many else adapter.read(spark, path)
    output = Pipeline(config).run(messages, args.now or datetime.now(timezone.utc))
    stats = output.stats.first()
    _say(f"parsed {stats['total_input']} messages")
    if args.stats:
        _say(f"stats: {output.one_line()}")
    if args.dry_run:
        _say("dry run: nothing written")
        return 0
    written = write_all(root, output.messages, args.format)
    for w in written:
        _say(f"wrote: {w}")
    _say(f"done: {len(written)} files written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
