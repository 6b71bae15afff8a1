"""Command line: python -m riverlog COMMAND [options] [file...]"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections.abc import Iterable, Iterator, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import anomaly, parse, series, stats
from .operators.filters import NAMES, RecordFilter
from .session import get_session
from .sources import document, export, report
from .sources.lines import read_lines, shared_path, spool
from .streaming import follow

COMMANDS = {
    "parse": "lines to records", "stats": "totals and top lists", "filter": "the records that pass all filters", "series": "counts by time bucket", "spikes": "anomalies of a series",
    "tailf": "follow a growing file, with alerts", "report": "a text, markdown or HTML report", "export": "records as JSON, NDJSON or CSV",
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riverlog", description="Log analytics on Spark")
    top.add_argument("--version", action="version", version=f"riverlog {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name, help=text) for name, text in COMMANDS.items()}
    for name, p in made.items():
        p.add_argument("files", nargs="*", default=["-"], help="paths that Spark reads; - or none for standard input")
        p.add_argument("--default-year", type=int)
        if name in ("filter", "series", "spikes", "report", "export"):
            for option in NAMES:
                p.add_argument(f"--{option.replace('_', '-')}", type=int if option.endswith("_bytes") else str)
        if name in ("series", "spikes", "report"):
            p.add_argument("--unit", default="minute" if name != "report" else "hour")
            p.add_argument("--value", choices=series.VALUES, default="count")
        if name in ("spikes", "report", "tailf"):
            p.add_argument("--window", type=int, default=30)
            p.add_argument("--sensitivity", default="medium")
            p.add_argument("--threshold", "--alert-threshold", type=float)
            p.add_argument("--mode", default="spikes")
            p.add_argument("--baseline", default="rolling")
            p.add_argument("--alpha", type=float, default=0.3)
        if name in ("parse", "filter"):
            p.add_argument("--limit", type=int)
            p.add_argument("--csv", action="store_true")
            p.add_argument("--no-raw", action="store_true")
            p.add_argument("--raw", action="store_true")
            p.add_argument("--count", action="store_true")
        if name in ("parse", "stats"):
            p.add_argument("--diag", action="store_true")
        if name not in ("export", "report", "tailf"):
            p.add_argument("--json", action="store_true")
        if name in ("stats", "report"):
            p.add_argument("--top", type=int, default=10)
        if name in ("report", "export"):
            p.add_argument("--format", default="text" if name == "report" else "json")
            p.add_argument("--output", default="-")
    made["series"].add_argument("--chart", action="store_true")
    made["series"].add_argument("--no-fill", action="store_true")
    made["report"].add_argument("--title", default="Log report")
    made["report"].add_argument("--no-series", action="store_true")
    made["report"].add_argument("--no-spikes", action="store_true")
    made["export"].add_argument("--compact", action="store_true")
    made["export"].add_argument("--fields")
    tail = made["tailf"]
    tail.add_argument("--from-start", action="store_true")
    tail.add_argument("--interval", type=float, default=0.25)
    tail.add_argument("--max-runtime", type=float)
    tail.add_argument("--checkpoint", help="folder that keeps the place and the alerts' history for the next start")
    tail.add_argument("--max-lines", type=int)
    tail.add_argument("--no-alert", action="store_true")
    tail.add_argument("--quiet", action="store_true")
    return top


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spool(spark, sys.stdin) if list(files) == ["-"] else read_lines(spark, files)


def _filter(a: argparse.Namespace) -> RecordFilter:
    return RecordFilter(**{n: v for n in NAMES if (v := getattr(a, n, None)) is not None})


def _detector(a: argparse.Namespace) -> anomaly.Detector:
    return anomaly.Detector(window=a.window, threshold=a.threshold, sensitivity=a.sensitivity, mode=a.mode, method=a.baseline, alpha=a.alpha)


def _shown(records: DataFrame, a: argparse.Namespace) -> Iterator[str]:
    """Records as the output options want them, a partition at a time."""
    if a.count:
        yield f"{records.count()}\n"
        return
    records = records.orderBy("line_no")
    records = records.limit(a.limit) if a.limit is not None else records
    if a.raw:
        yield from (f"{r[0]}\n" for r in records.select("raw").toLocalIterator())
    else:
        yield from (export.csv_lines(records) if a.csv else export.json_lines(records) if a.json else export.ndjson_lines(records))


def _diagnostics(spark: SparkSession, a: argparse.Namespace) -> str:
    parsed = parse.parse(_lines(spark, a.files), a.default_year, keep_unparsed=True).persist()
    counters = parse.parse_stats(parsed).first().asDict() | {"errors": [r.asDict() for r in parse.error_samples(parsed).collect()]}
    parsed.unpersist()
    return export.parse_stats_to_json(counters)


def _mounted(spark: SparkSession, folder: str) -> str:
    """The local path of a folder that all see under the same one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if not full.startswith("file:"):
        raise ValueError("standard input can be followed only where the shared folder is a mounted one (file:)")
    return full.removeprefix("file:").replace("///", "/")


def _spooled_stdin(folder: str) -> str:
    """Copies standard input to a file as it comes, so that it can be followed like any growing file; its end ends nothing."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/stdin"
    open(path, "wb").close()

    def copy() -> None:
        with open(path, "ab", buffering=0) as out:
            for line in getattr(sys.stdin, "buffer", sys.stdin):
                out.write(line if isinstance(line, bytes) else line.encode())

    threading.Thread(target=copy, daemon=True).start()
    return path


def _tailf(spark: SparkSession, a: argparse.Namespace) -> int:
    left = a.max_lines

    def show(batch: DataFrame) -> None:
        nonlocal left
        for row in batch.select(export.json_row(batch).alias("value")).toLocalIterator():
            if left == 0:
                return
            left = left if left is None else left - 1
            if not a.quiet:
                print(row[0], flush=True)

    def say(text: str) -> None:
        print(text, file=sys.stderr, flush=True)

    follower = follow.Follower(options={"default_year": a.default_year}, on_record=show, on_rotate=lambda n: say(f"ROTATED {n}"), on_truncate=lambda n: say(f"TRUNCATED {n}"))
    alert = None if a.no_alert else lambda point: say(f"ALERT {anomaly.describe_point(point)}")
    folder, is_input = a.checkpoint or shared_path(spark, "tailf"), a.files[0] == "-"
    files = [_spooled_stdin(_mounted(spark, folder))] if is_input else a.files
    queries = follow.follow(follow.line_stream(spark, files, a.from_start or is_input), alert, folder, follower, _detector(a), f"{int(a.interval * 1000)} milliseconds")
    waited = 0.0
    while (a.max_runtime is None or waited < a.max_runtime) and left != 0 and all(q.isActive for q in queries):
        queries[0].awaitTermination(min(1, a.max_runtime or 1))
        waited += min(1, a.max_runtime or 1)
    for q in queries:
        q.stop()
    say(" ".join(f"{k}={v:.0f}" for k, v in follower.stats.items()))
    return 0


def run(a: argparse.Namespace, spark: SparkSession) -> Iterable[str]:
    """The output of a command other than tailf, in parts."""
    if getattr(a, "diag", False):
        return [_diagnostics(spark, a)]
    keep_raw = not getattr(a, "no_raw", False)
    records = parse.parse(_lines(spark, a.files), a.default_year, keep_raw=keep_raw)
    if a.command in ("parse", "filter"):
        return _shown(_filter(a).apply(records), a)
    chosen = _filter(a)
    records = chosen.apply(records)
    if a.command == "stats":
        found = stats.summary(records, a.top)
        return [export.summary_to_json(found) if a.json else report.render_text({"title": "Summary", "source": ", ".join(a.files), "summary": found})]
    if a.command == "report":
        unit = None if a.no_series else a.unit
        text = report.render(a.format, report.report_context(records, a.title, ", ".join(a.files), str(chosen), a.top, unit, a.value, None if a.no_spikes else _detector(a)))
        return [export.write_file(a.output, text) or ""]
    if a.command == "export":
        fields = [a.fields.split(",")] if a.fields else []
        ordered = records.orderBy("line_no")
        makers = {"json": lambda: export.json_lines(ordered, not a.compact), "ndjson": lambda: export.ndjson_lines(ordered), "csv": lambda: export.csv_lines(ordered, *fields)}
        if a.format not in makers:
            raise ValueError(f"unknown export format '{a.format}'; known are {', '.join(makers)}")
        if a.output == "-":
            return makers[a.format]()
        if "://" in a.output or a.output.startswith("file:"):
            if a.format == "json" or a.output.endswith(f".{a.format}"):  # one file, joined from the tasks' parts
                one = {"json": lambda: document.write_json_document(ordered, a.output, not a.compact), "ndjson": lambda: document.write_ndjson_document(ordered, a.output), "csv": lambda: document.write_csv_document(ordered, a.output, *fields)}
                one[a.format]()
            else:  # a folder, each task its file
                (export.write_ndjson(records, a.output) if a.format == "ndjson" else export.write_csv(records, a.output, *fields))
            return []
        export.write_parts(a.output, makers[a.format]())
        return []
    buckets = series.bucketize(records, a.unit, a.value, fill=not getattr(a, "no_fill", False))
    if a.command == "series":
        rows = [r.asDict() for r in buckets.orderBy("epoch").collect()]
        totals = series.series_stats(buckets).first().asDict()
        if a.json:
            return [json.dumps({"series": rows, "stats": totals}, sort_keys=True, default=str) + "\n"]
        if a.chart:
            return [series.ascii_chart(rows, value=a.value) + "\n" + series.sparkline([r["value"] for r in rows], 60) + "\n"]
        return [export.series_to_csv(buckets, a.value)]
    found = anomaly.detect(buckets, _detector(a))
    if a.json:
        return [json.dumps(found, sort_keys=True, default=str) + "\n"]
    return ["\n".join([*map(anomaly.describe_event, found["events"]), f"{len(found['points'])} point(s), risk {found['risk']:.2f}"]) + "\n"]


def main(argv: Sequence[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if not a.files:
        a.files = ["-"]
    spark = SparkSession.getActiveSession() or get_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.command == "tailf":
            return _tailf(spark, a)
        for part in run(a, spark):
            sys.stdout.write(part)
    except (ValueError, OSError) as problem:
        print(f"riverlog: {problem}", file=sys.stderr)
        return 2
    except PySparkException as problem:  # a missing path, a grid of too many buckets
        print(f"riverlog: {str(problem).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
