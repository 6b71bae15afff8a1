"""Filters, summaries, series, anomalies, outputs and following on small fixtures."""

import csv
import io
import json
import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

from riverlog.__main__ import main
from riverlog.operators import anomaly, series, stats
from riverlog.operators.filters import RecordFilter, any_of
from riverlog.plans import queries
from riverlog.schema import RECORD
from riverlog.sources import document, export, report
from riverlog.sources.lines import read_lines, spool
from riverlog.streaming import follow

B = 1763460000  # 2025-11-18T10:00:00Z


def records(spark, rows):
    """Records from dicts; ts as epoch seconds."""
    fields = [*RECORD.fields, T.StructField("epoch", T.LongType())]
    df = spark.createDataFrame([(*(None if f.name == "ts" else r.get(f.name) for f in RECORD.fields), r.get("ts")) for r in rows], T.StructType(fields))
    return df.withColumn("ts", F.timestamp_seconds("epoch")).withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long"))).drop("epoch")


@pytest.fixture(scope="module")
def four(spark):
    return records(
        spark,
        [
            {"type": "combined", "ts": B, "ip": "203.0.113.9", "url": "/a?x=1", "path": "/a", "method": "GET", "status": 200, "bytes": 100},
            {"type": "combined", "ts": B + 60, "ip": "203.0.113.77", "url": "/b", "path": "/b", "method": "POST", "status": 404, "bytes": 200},
            {"type": "combined", "ts": B + 120, "ip": "10.0.0.1", "url": "/a/c", "path": "/a/c", "method": "GET", "status": 500, "bytes": 300, "level": "error"},
            {"type": "json", "ip": "host.example", "status": 200, "bytes": 5},
        ],
    ).persist()


@pytest.mark.parametrize(
    "options, n",
    [
        ({}, 4), ({"status": "5xx"}, 1), ({"status": "200,500"}, 3), ({"status": "4xx,5xx"}, 2), ({"exclude_status": "2xx"}, 2), ({"ip": "203.0.113.9,10.0.0.1"}, 2), ({"ip": "203.0.113.0/24"}, 2),
        ({"ip": "203.0.113.*"}, 2), ({"ip": r"^203\."}, 2), ({"url_regex": "^/a"}, 2), ({"url": "/b"}, 1), ({"method": "post"}, 1), ({"level": "err"}, 1), ({"min_bytes": 200}, 2), ({"max_bytes": 100}, 2),
        ({"status": "2xx", "ip": "203.0.113.0/24"}, 1), ({"since": "2025-11-18T10:01:00Z"}, 2), ({"since": "2025-11-18T10:00:30Z", "until": "2025-11-18T10:01:30Z"}, 1), ({"since": "2020-01-01"}, 3), ({"grep": "^$"}, 4),
    ],
)
def test_filters(four, options, n):
    assert RecordFilter(**options).count(four) == n


def test_filters_joined_by_or_and_own_ones(four):
    assert any_of(RecordFilter(status="5xx"), RecordFilter(method="post")).count(four) == 2
    assert any_of().count(four) == 4 and str(RecordFilter()) == "none"
    own = RecordFilter(status="2xx").add("small", F.col("bytes") < 50)
    assert own.count(four) == 1 and own.describe() == ["status in [2xx]", "small"]


@pytest.mark.parametrize("options", [{"status": "5xxs"}, {"url_regex": "("}, {"level": "shouting"}, {"since": "never"}, {"ip": "999.1.1.1"}, {"ip": "1.2.3.4/40"}, {"ip": "a,,b"}, {"odd": "1"}])
def test_wrong_filters(spark, options):
    with pytest.raises(ValueError):
        RecordFilter(**options)


def test_durations_latency_and_slowest(spark):
    rows = records(spark, [{"type": "json", "line_no": i, "duration_ms": 10 * i} for i in range(1, 21)])
    assert stats.durations(rows).first().asDict() == {"count": 20, "avg": 105.0, "p50": 105, "p95": 191, "p99": 198, "max": 200}
    two = [{"line_no": i, "path": "/report", "ip": "10.0.0.1", "duration_ms": 10 + i} for i in range(10)] + [{"line_no": 10 + i, "path": "/export", "ip": "10.0.0.2", "duration_ms": 500 + 20 * i} for i in range(10)]
    two = records(spark, two)
    got = stats.latency_by_path(two).collect()
    assert [r["path"] for r in got] == ["/export", "/report"] and got[0]["count"] == 10 and got[0]["p95"] >= 660 and got[0]["max"] == 680 and got[1]["p95"] <= 20
    slow = stats.slowest(two).collect()
    assert len(slow) == 10 and tuple(slow[0])[:3] == (680, "/export", "10.0.0.2")
    many = records(spark, [{"line_no": i, "path": "/p", "duration_ms": 1000 if i < 100 else 1} for i in range(612)])
    assert stats.latency_by_path(many).first()["max"] == 1  # the newest 512 only
    assert stats.summary(records(spark, [{"type": "json"}]))["durations"] is None


def test_top_lists(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1), ("e", 3)], "key string, n long")
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(stats.top(counts, 5)) == ["c", "a", "b", "e", "d"] and keys(stats.top(counts, 2)) == ["c", "a"]
    assert keys(stats.top(counts, 5, minimum=5)) == ["c", "a", "b"] and keys(stats.top(counts, 0)) == []


def test_series(spark):
    rows = records(spark, [{"ts": B + 30 * i, "bytes": 100, "status": 500 if i == 6 else 200} for i in range(12)])
    got = series.bucketize(rows, "minute").orderBy("epoch").collect()
    assert [r["count"] for r in got] == [2] * 6 and [r["errors"] for r in got] == [0, 0, 0, 1, 0, 0] and got[0]["label"] == "2025-11-18 10:00"
    s = series.series_stats(series.bucketize(rows, "minute")).first()
    assert (s["total"], s["buckets"], s["max"], s["mean"], s["peak_label"]) == (12, 6, 2, 2.0, "2025-11-18 10:00")
    wide = series.resample(series.bucketize(rows, "minute"), 3600).collect()
    assert len(wide) == 1 and (wide[0]["count"], wide[0]["bytes"]) == (12, 1200)
    gap = records(spark, [{"ts": B}, {"ts": B + 300}])
    assert [r["count"] for r in series.bucketize(gap, "minute").orderBy("epoch").collect()] == [1, 0, 0, 0, 0, 1]
    assert series.bucketize(gap, "minute", fill=False).count() == 2
    assert series.bucketize(gap, "minute", since=B - 600, until=B + 60).count() == 16
    assert series.bucketize(records(spark, [{"type": "json"}]), "minute").collect() == []
    with pytest.raises(PySparkException, match="200000"):
        series.bucketize(records(spark, [{"ts": 0}, {"ts": B}]), "second").collect()


@pytest.mark.parametrize("unit, seconds", [("minute", 60), ("hour", 3600), ("day", 86400), ("second", 1), ("900", 900)])
def test_units(unit, seconds):
    assert series.unit_seconds(unit) == seconds


@pytest.mark.parametrize("unit", ["fortnight", "0", ""])
def test_wrong_units(unit):
    with pytest.raises(ValueError):
        series.unit_seconds(unit)


def test_charts():
    assert series.sparkline([]) == "" and series.sparkline([5, 5, 5]) == "   "
    assert series.sparkline([0, 4, 8]) == " ▄█" and len(series.sparkline(list(range(100)), 20)) == 20
    lines = series.ascii_chart([{"label": "a", "value": 10}, {"label": "b", "value": 0}, {"label": "c", "value": 1}], bar_width=10).splitlines()
    assert [x.count("#") for x in lines] == [10, 0, 1]


FLAT = [50] * 40
UPDOWN = [45, 55] * 20


@pytest.mark.parametrize(
    "values, options, want",
    [
        ([*FLAT, 200, 55, 48], {}, [(40, 150.0)]), ([50] * 45, {}, []), ([*UPDOWN, 68], {}, [(40, 3.54)]), ([*UPDOWN, 68], {"sensitivity": "low"}, []), ([*FLAT, 0, 52], {}, []),
        ([*FLAT, 0, 52], {"mode": "dips"}, [(40, -50.0)]), ([*FLAT, 0, 200], {"mode": "both"}, [(40, -50.0), (41, 16.61)]), ([*FLAT, 120, 150, 90, 55], {}, [(40, 70.0), (41, 7.64)]),
        ([10] + [500] * 5, {}, []), ([10] * 10 + [100], {"min_history": 3}, [(10, 90.0)]), ([0] * 30 + [5, 0], {}, [(30, 5.0)]), ([], {}, []), ([*FLAT, 200, 55, 48], {"method": "ewma"}, [(40, 150.0)]),
        ([*range(10, 401, 10), 800], {"method": "ewma", "alpha": 1.0, "min_history": 3}, [(40, 40.0)]), ([*FLAT, 65, 80, 95], {}, [(40, 15.0), (41, 10.77), (42, 7.2)]),
        ([*FLAT, 65, 80, 95], {"method": "ewma", "alpha": 0.8}, [(40, 15.0)]),
    ],
)
def test_detection(spark, values, options, want):
    buckets = spark.createDataFrame([(B + 60 * i, f"m{i}", v) for i, v in enumerate(values)], "epoch long, label string, value long")
    got = anomaly.detect(buckets, anomaly.Detector(**options))
    assert [((p["epoch"] - B) // 60, p["zscore"]) for p in got["points"]] == want


def test_events_and_risk(spark):
    buckets = lambda values: spark.createDataFrame([(B + 60 * i, f"m{i}", v) for i, v in enumerate(values)], "epoch long, label string, value long")
    got = anomaly.detect(buckets([*FLAT, 120, 150, 90, 55]))
    assert [(e["start_label"], e["end_label"], e["buckets"], e["peak_value"], e["severity"]) for e in got["events"]] == [("m40", "m41", 2, 150, "critical")]
    assert len(anomaly.detect(buckets([*FLAT, 120, 50, 130, 55]))["events"]) == 2
    assert anomaly.risk_score(buckets([*FLAT, 300])) == 250 and anomaly.risk_score(buckets([])) == 0


@pytest.mark.parametrize("options", [{"sensitivity": "turbo"}, {"mode": "sideways"}, {"window": 1}, {"method": "kalman"}, {"alpha": 0}, {"alpha": 1.5}, {"alpha": -0.2}, {"threshold": 0}])
def test_wrong_detectors(options):
    with pytest.raises(ValueError):
        anomaly.Detector(**options)


def test_exports(spark, tmp_path):
    rows = records(spark, [{"type": "json", "line_no": 1, "ts": B, "ts_iso": "2025-11-18T10:00:00Z", "ip": "1.2.3.4", "status": 200, "message": 'a,"b"\nc', "data": {"shard": VariantVal.parseJson('"3"')}}, {"type": "common", "line_no": 2, "ip": "x"}])
    back = list(csv.DictReader(io.StringIO(export.records_to_csv(rows))))
    assert back[0]["message"] == 'a,"b"\nc' and back[1]["status"] == "" and list(back[0])[:3] == ["ts_iso", "type", "ip"]
    assert export.records_to_csv(rows, ["ip", "none"]).splitlines()[:2] == ["ip,none", "1.2.3.4,"]
    whole = json.loads(export.records_to_json(rows))
    assert whole["meta"]["count"] == 2 and whole["records"][0]["data"] == {"shard": "3"} and "message" not in whole["records"][1] and "raw" not in whole["records"][0]
    assert len(export.records_to_ndjson(rows).splitlines()) == 2
    export.write_ndjson(rows, f"file://{tmp_path}/nd")
    assert spark.read.json(f"file://{tmp_path}/nd").count() == 2
    assert export.write_file("-", "x") == "x" and export.write_file(str(tmp_path / "f"), "x") is None
    with pytest.raises(OSError):
        export.write_file(str(tmp_path / "no" / "f"), "x")
    assert export.series_to_csv(series.bucketize(rows, "hour")).splitlines()[0] == "label,epoch,value,count,bytes,errors"


@pytest.mark.parametrize("form, marks", [("text", ["OVERVIEW", "TOP IPS", "ANOMALIES"]), ("md", ["# T & <b>", "## Overview", "| 404 | 1 |"]), ("HTML", ["<h1>T &amp; &lt;b&gt;</h1>", "<table>", "</html>"])])
def test_reports(four, form, marks):
    text = report.render(form, report.report_context(four, "T & <b>", unit="minute"))
    assert all(m in text for m in marks)
    with pytest.raises(ValueError):
        report.render("pdf", {})


def log_line(epoch, status=200):
    return f'10.0.0.{epoch % 9} - - [{time.strftime("%d/%b/%Y:%H:%M:%S", time.gmtime(epoch))} +0000] "GET /p{epoch % 3} HTTP/1.1" {status} {epoch % 900}\n'


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "a.log"
    lines = [log_line(B + 60 * m + s) for m in range(20) for s in range(5)] + [log_line(B + 1200 + s % 60, 500) for s in range(90)] + [log_line(B + 1260)]
    path.write_text("".join(lines) + "garbage\n")
    return str(path)


@pytest.mark.parametrize(
    "argv, mark",
    [
        (["parse", "--limit", "3"], '"method":"GET"'), (["parse", "--diag"], '"skipped": 1'), (["stats", "--json"], '"total": 191'), (["stats"], "OVERVIEW"), (["filter", "--status", "5xx", "--count"], "90\n"),
        (["series", "--chart"], "#"), (["series", "--json"], '"total": 191'), (["spikes"], "2025-11-18 10:20"), (["spikes", "--json"], '"severity": "critical"'), (["report", "--format", "md"], "## Anomalies"), (["export", "--format", "csv", "--fields", "ip,status"], "ip,status\n"),
    ],
)
def test_commands(spark, capsys, log_file, argv, mark):
    assert main([*argv, f"file://{log_file}"]) == 0
    assert mark in capsys.readouterr().out


def test_wrong_command_options(spark, log_file):
    assert main(["filter", "--status", "9xx", f"file://{log_file}"]) == 2
    with pytest.raises(SystemExit):
        main(["fly"])


def test_export_to_a_folder_gives_the_rows_of_the_terminal(spark, capsys, tmp_path):
    log = tmp_path / "in.log"
    log.write_text("".join(f'{{"time":"2025-11-18T10:00:0{i}Z","level":"info","message":"a, \\"b\\" {i}"}}\n' for i in range(3)))
    assert main(["export", "--format", "ndjson", f"file://{log}"]) == 0
    want = capsys.readouterr().out
    assert main(["export", "--format", "ndjson", "--output", f"file://{tmp_path}/out", f"file://{log}"]) == 0
    got = [line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(got) == sorted(want.splitlines()) and len(got) == 3


def test_stream_counts_are_files(spark):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    found = follow.run_minute_counts(spark, follow.event_stream(spark, sf_dir))
    assert found.count() > 0 and found.inputFiles()


def test_follower_counts_and_hands_on(spark, tmp_path):
    line = '{"time":"2024-01-01T%s:00Z","msg":"m"}'
    batches = [[line % "10:00", '{"msg":"untimed"}', "garbage", ""], [line % "10:01", line % "09:00"], [line % "10:02"]]
    got = {"on_record": 0, "on_error": 0, "on_late": 0}

    def add(name):
        return lambda rows: got.__setitem__(name, got[name] + rows.count())

    follower = follow.Follower(**{name: add(name) for name in got})
    for i, rows in enumerate(batches):
        follower(spark.createDataFrame([(x,) for x in rows], "value string"), i)
    assert got == {"on_record": 5, "on_error": 2, "on_late": 1}
    want = {"lines": 7, "records": 5, "skipped": 2, "late": 1, "rotations": 0, "truncates": 0}
    assert {k: v for k, v in follower.stats.items() if k != "runtime"} == want and follower.stats["runtime"] > 0
    with pytest.raises(ValueError, match="unknown hooks: on_spike"):
        follow.Follower(on_spike=print)


def test_untimed_lines_do_not_close_the_minutes_of_an_older_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate((['{"time":"2024-01-01T10:00:00Z"}', '{"msg":"untimed"}'], ['{"time":"2024-01-01T10:01:00Z"}'], ['{"time":"2024-01-01T10:00:30Z"}', '{"time":"2024-01-01T10:09:00Z"}'])):
        (folder / f"{i}.log").write_text("\n".join(rows) + "\n")
        os.utime(folder / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    lines = spark.readStream.option("maxFilesPerTrigger", "1").text(f"file://{folder}")
    counts = follow.minute_counts(follow.record_stream(lines))
    query = counts.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["epoch"]: r["n"] for r in spark.read.schema(counts.schema).parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1704103200: 2, 1704103260: 1}


def test_standard_input_is_followed(spark, monkeypatch, capsys):
    lines = [b'{"time":"2024-01-01T10:00:0%dZ","msg":"m"}\n' % i for i in range(3)]
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"".join(lines) + b"no log line\n")))
    assert main(["tailf", "--no-alert", "--max-runtime", "20", "--max-lines", "3", "-"]) == 0
    shown = capsys.readouterr()
    assert len(shown.out.splitlines()) == 3 and "records=3" in shown.err and "skipped=1" in shown.err


def test_spooled_lines_are_numbered(spark):
    rows = spool(spark, (f"line {i}\n" for i in range(25)), step=10)
    assert sorted(map(tuple, rows.collect())) == [(i + 1, f"line {i}") for i in range(25)]
    assert spool(spark, []).collect() == []


def test_exports_to_files_and_folders(spark, log_file, tmp_path, capsys):
    for form in ("json", "csv"):
        assert main(["export", "--format", form, log_file]) == 0
        want = capsys.readouterr().out
        assert main(["export", "--format", form, "--output", f"{tmp_path}/one", log_file]) == 0
        assert (tmp_path / "one").read_text() == want
        if form == "json":
            found = json.loads(want)
            assert found["meta"]["count"] == len(found["records"]) and want == json.dumps(found, sort_keys=True, indent=3) + "\n"
    assert main(["export", "--format", "csv", "--output", f"file://{tmp_path}/many", log_file]) == 0
    got = [x for f in (tmp_path / "many").glob("part-*") for x in f.read_text().splitlines()[1:]]
    assert sorted(got) == sorted(want.splitlines()[1:])


@pytest.mark.parametrize("form", ["json", "ndjson", "csv"])
def test_one_file_of_many_tasks_is_what_the_terminal_shows(spark, log_file, tmp_path, capsys, form):
    assert main(["export", "--format", form, log_file]) == 0
    want = capsys.readouterr().out
    for _ in range(2):  # the second replaces the first
        assert main(["export", "--format", form, "--output", f"file://{tmp_path}/out.{form}", log_file]) == 0
        assert (tmp_path / f"out.{form}").read_text() == want
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith("out")] == [f"out.{form}"]


def test_documents_of_nothing_and_of_jobs_that_fail(spark, tmp_path):
    rows = spark.range(0, 40, 1, 8).select(F.col("id").alias("line_no"), F.lit("json").alias("type"))
    for some in (rows, rows.filter("line_no = 17"), rows.filter("line_no < 0"), spark.createDataFrame([], rows.schema)):
        for pretty in (True, False):
            document.write_json_document(some, f"file://{tmp_path}/d.json", pretty)
            assert (tmp_path / "d.json").read_text() == export.records_to_json(some, pretty)
    failing = rows.withColumn("type", F.when(F.col("line_no") == 39, F.raise_error(F.lit("no"))).otherwise("json"))
    with pytest.raises(PySparkException):
        document.write_json_document(failing, f"file://{tmp_path}/never.json")
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith("never")] == []


def test_documents_are_read_back_by_splits(spark, tmp_path):
    path, schema = f"file://{tmp_path}/d.json", "line_no long, message string, data map<string,string>"
    text = F.when(F.col("id") % 5 < 3, F.concat(F.lit('a\n      }\n      {}, "é" '), F.col("id").cast("string")))
    rows = spark.range(0, 4000, 1, 7).select(F.when(F.col("id") % 5 < 4, F.col("id")).alias("line_no"), text.alias("message"), F.when(F.col("id") % 5 == 1, F.create_map(F.lit("k"), F.lit("\n      {"))).alias("data"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (20_000, 20_011, 21_023):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            document.write_json_document(rows, path)
            back = document.read_json_document(spark, path, schema)
            assert spark.read.option("lineSep", document.CLOSE).text(path).rdd.getNumPartitions() > 10
            want = [(4000, i + 1, r["line_no"], r["message"], r["data"]) for i, r in enumerate(rows.collect())]
            assert back.orderBy("place").select("count", "place", "r.*").collect() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    document.write_json_document(rows.limit(0), path)
    assert document.read_json_document(spark, path, schema).collect() == []
    document.write_json_document(rows, path, pretty=False)
    with pytest.raises(ValueError, match="no indented JSON document"):
        document.read_json_document(spark, path, schema)


def test_csv_documents_are_read_back_by_splits(spark, tmp_path):
    path = f"file://{tmp_path}/d.csv"
    rows = spark.range(0, 4000, 1, 7).select(F.col("id").alias("line_no"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a, "é" '), F.col("id").cast("string"))).alias("ua"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (5_000, 5_003):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            document.write_csv_document(rows, path, ["line_no", "ua"])
            back = read_lines(spark, path)
            assert spark.read.text(path).rdd.getNumPartitions() > 10
            want = ["line_no,ua", *(f"{i}," + (f'"a, ""é"" {i}"' if i % 3 else "") for i in range(4000))]
            assert [tuple(r) for r in back.orderBy("line_no").collect()] == list(enumerate(want, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    document.write_csv_document(rows.limit(0), path, ["line_no", "ua"])
    assert [tuple(r) for r in read_lines(spark, path).collect()] == [(1, "line_no,ua")]


def test_export_json_document_is_read_by_splits(spark):
    plan = queries.queries()["export_json_document"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FileScan text" in plan and "FileScan json" not in plan  # of a JSON document as one value a task reads all


def test_parts_of_lost_attempts_are_left_out(tmp_path):
    writer = document.DocumentWriter(f"file://{tmp_path}/x.csv", "lines", "a,b", True)
    folder = tmp_path / writer.parts.rpartition("/")[2]
    folder.mkdir()
    made = []
    for name, text in (("00000001-x", "late\n"), ("00000000-y", "lost\n"), ("00000000-z", "first\n")):
        (folder / name).write_text(text)
        made.append(document.Part(int(name[:8]), 1, str(folder / name)))
    writer.commit([made[0], None, made[2]])
    assert (tmp_path / "x.csv").read_text() == "a,b\nfirst\nlate\n" and [f.name for f in tmp_path.iterdir()] == ["x.csv"]
