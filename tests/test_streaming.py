"""The tail source, minute totals, alerts and hooks."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from riverlog.operators.anomaly import Detector, points, scores
from riverlog.streaming import alerts, follow
from riverlog.streaming.tail import TailReader

B = 1763460000


def taken(reader, start):
    """The next offset and the lines up to it."""
    end = reader.latestOffset()
    return [row[0] for piece in reader.partitions(start, end) for row in reader.read(piece)], end


class Log:
    """A log file and a reader that is asked for more after each change."""

    def __init__(self, path, **options):
        self.path = str(path)
        self.reader = TailReader([self.path], **options)
        self.at = self.reader.initialOffset()

    def add(self, text, mode="a"):
        with open(self.path, mode) as f:
            f.write(text)
        return self

    def rotate(self, name):
        os.rename(self.path, f"{self.path}.{name}")
        return self

    def more(self):
        rows, self.at = taken(self.reader, self.at)
        return rows

    def all(self):
        out = []
        while rows := self.more():
            out += rows
        return out


@pytest.fixture
def log(tmp_path):
    (tmp_path / "live.log").write_text("old\n")
    return Log(tmp_path / "live.log")


def test_growth_truncation_and_rotation(log):
    assert log.add("one\nha").more() == ["one"] and log.add("lf\r\n").more() == ["half"]
    assert log.add("t\n", "w").more() == ["t"] and log.at["truncates"] == 1
    log.add("two\nlast without end").rotate(1).add("new file\n", "w")
    assert log.more() == ["two", "last without end", "new file"] and log.at["rotations"] == 1
    os.unlink(log.path)
    assert log.more() == []
    assert log.add("back\n").more() == ["back"] and log.more() == []


def test_two_rotations_between_polls_lose_nothing(log):
    log.add("a1\n").more()
    log.add("a2\n").rotate("a").add("b1\nb2\n", "w")
    os.utime(f"{log.path}.a", (1000, 1000))
    log.rotate("b").add("c1\n", "w")
    os.utime(f"{log.path}.b", (2000, 2000))
    assert log.more() == ["a2", "b1", "b2", "c1"] and log.at["rotations"] == 2
    log.add("c2\n").rotate("c")
    assert log.more() == ["c2"]  # before the new file is there
    assert log.add("d1\n", "w").more() == ["d1"] and log.at["rotations"] == 3


def test_files_that_stood_there_before_and_copies_are_not_read(tmp_path):
    (tmp_path / "live.log.1").write_text("before\n")
    (tmp_path / "live.log").write_text("x\n")
    log = Log(tmp_path / "live.log", from_start=True)
    assert log.more() == ["x"]
    (tmp_path / "live.log.copy").write_text("x\n")  # copied, and then cut
    assert log.add("y\n", "w").more() == [] and log.add("later\n").more() == ["later"]  # a file cut and filled to its old length looks the same
    log.rotate(9).add("z\n", "w")
    assert log.more() == ["z"]


def test_offsets_read_again_give_the_same_and_restarts_go_on(log):
    log.add("a1\n").more()
    start = log.at
    log.add("a2\n").rotate("a").add("b1\n", "w").rotate("b").add("c1\n", "w")
    rows = log.more()
    end = json.loads(json.dumps(log.at))
    anew = TailReader([log.path])
    assert [r[0] for p in anew.partitions(start, end) for r in anew.read(p)] == rows == ["a2", "b1", "c1"]
    log.add("c2\n").rotate("c").add("d1\n", "w")
    fresh = TailReader([log.path])  # after a restart the reader isn't told where it was
    assert taken(fresh, end)[0] == ["c2", "d1"]


@pytest.mark.parametrize("from_start", [True, False])
def test_large_old_files_come_in_bounded_batches(tmp_path, from_start):
    lines = [f"{i:06} {'x' * (i % 300)}" for i in range(4000)]
    log = Log(tmp_path / "live.log", from_start=from_start, max_bytes=50_000, task_bytes=7_000)
    log.add("\n".join(lines) + "\nno end").rotate(1).add("new\n", "w")
    if not from_start:  # the file wasn't there yet
        assert log.at["files"][log.path]["ino"] == 0
        log = Log(tmp_path / "live.log.1", from_start=True, max_bytes=50_000, task_bytes=7_000)
        log.path, log.reader.paths = str(tmp_path / "live.log"), [str(tmp_path / "live.log")]
        log.at = log.reader.last = {"files": {log.path: log.at["files"][f"{log.path}.1"]}, "rotations": 0, "truncates": 0}
    else:
        log.at["files"][log.path] = {"ino": os.stat(f"{log.path}.1").st_ino, "pos": 0, "done": []}
        log.reader.last = log.at
    got, sizes = [], []
    while True:
        start, end = log.at, log.reader.latestOffset()
        pieces = log.reader.partitions(start, end)
        assert all(p.high - p.low <= 7_000 for p in pieces)
        rows = [r[0] for p in pieces for r in log.reader.read(p)]
        if not rows:
            break
        sizes.append(sum(p.high - p.low for p in pieces))
        got, log.at = got + rows, end
    assert got == [*lines, "no end", "new"] and len(sizes) > 10 and max(sizes) <= 50_000


def test_lines_longer_than_a_batch_and_a_task(tmp_path):
    log = Log(tmp_path / "long.log", from_start=True, max_bytes=8, task_bytes=4)
    log.at = log.reader.initialOffset()
    log.add("x" * 50 + "\nnext\n" + "y" * 30)
    log.at = log.reader.last = {"files": {log.path: {"ino": os.stat(log.path).st_ino, "pos": 0, "done": []}}, "rotations": 0, "truncates": 0}
    assert log.all() == ["x" * 50, "next"]
    log.add("\n")
    assert log.all() == ["y" * 30]


def test_tasks_grow_with_a_batch_that_would_have_too_many(tmp_path):
    log = Log(tmp_path / "large.log", from_start=True, max_bytes=1 << 62, task_bytes=100)
    lines = [f"{i:07}" for i in range(100_000)]
    log.add("".join(f"{x}\n" for x in lines))
    log.at = log.reader.last = {"files": {log.path: {"ino": os.stat(log.path).st_ino, "pos": 0, "done": []}}, "rotations": 0, "truncates": 0}
    end = log.reader.latestOffset()
    pieces = log.reader.partitions(log.at, end)
    assert len(pieces) <= 257 and [r[0] for p in pieces for r in log.reader.read(p)] == lines
    assert log.reader._step(10_000) == 100 and log.reader._step(100 << 30) == 8 << 20


def test_several_files_in_one_stream(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(500)))
    paths = [str(tmp_path / f"{name}.log") for name in "ab"]
    rows = follow.line_stream(spark, paths, from_start=True, task_bytes=300)
    rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("path", "value").collect()))
    assert got == sorted((p, f"{n}{i}") for p, n in zip(paths, "ab", strict=True) for i in range(500))


def minutes(spark, folder, name, rows):
    """A file of a record for each of n seconds from a time on."""
    folder.mkdir(exist_ok=True)
    text = "".join(f'{{"ts":"{time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(e + i % 60))}"}}\n' for e, n in rows for i in range(n))
    (folder / name).write_text(text)
    at = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def stream(spark, folder):
    return spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", "1").json(f"file://{folder}")


def test_totals_count_rows_that_come_in_any_order(spark, tmp_path):
    for k, rows in enumerate(([(B, 3), (B + 600, 2)], [(B, 1), (B + 60, 4)], [(B + 6000, 1)], [(B, 2), (B + 600, 1), (B - 86400, 5)])):
        minutes(spark, tmp_path / "in", f"{k}.json", rows)

    def run():
        follow.write_totals(follow.minute_totals(stream(spark, tmp_path / "in")), f"file://{tmp_path}/out", availableNow=True).awaitTermination()
        return {r["epoch"]: (r["n"], r["versions"]) for r in follow.read_totals(spark, f"file://{tmp_path}/out").collect()}

    assert run() == {B: (6, 3), B + 600: (3, 2), B + 60: (4, 1), B + 6000: (1, 1), B - 86400: (5, 1)}
    minutes(spark, tmp_path / "in", "9.json", [(B + 60, 1)])
    assert run()[B + 60] == (5, 2)  # after a restart


def fired(spark, folder, tmp_path, name="alerts", **options):
    found = alerts.alerts(stream(spark, folder), **options)
    found.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return [r.asDict() for r in spark.read.schema(found.schema).parquet(f"file://{tmp_path}/{name}").orderBy("epoch").collect()]


def test_alerts_go_on_after_a_restart_and_fire_once(spark, tmp_path):
    folder = tmp_path / "in"
    minutes(spark, folder, "0.json", [(B + 60 * i, 10 + i % 3) for i in range(30)])
    assert fired(spark, folder, tmp_path, delay_seconds=0) == []
    minutes(spark, folder, "1.json", [(B + 60 * 30, 80), (B + 60 * 31, 10), (B + 60 * 32, 10)])
    want = [B + 1800]
    got = fired(spark, folder, tmp_path, delay_seconds=0)
    assert [p["epoch"] for p in got] == want and (got[0]["value"], got[0]["direction"], got[0]["severity"], got[0]["label"]) == (80, "up", "critical", time.strftime("%Y-%m-%d %H:%M", time.gmtime(B + 1800)))
    assert [p["epoch"] for p in fired(spark, folder, tmp_path, delay_seconds=0)] == want  # nothing new
    minutes(spark, folder, "2.json", [(B + 60 * 20, 50), (B + 60 * 33, 200), (B + 60 * 34, 1)])  # late rows correct a closed minute, which isn't scored again
    got = fired(spark, folder, tmp_path, delay_seconds=0)
    assert [p["epoch"] for p in got] == [*want, B + 1980]
    history = [10 + i % 3 + (50 if i == 20 else 0) for i in range(30)] + [80, 10, 10]
    mean, sd, z = alerts.score_next(history, 200, Detector())
    assert (got[1]["baseline_mean"], got[1]["baseline_sd"], got[1]["zscore"]) == (round(mean, 2), round(sd, 2), round(z, 2))


def test_open_minutes_wait_and_batches_add_up(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(2):
        minutes(spark, folder, f"{k}.json", [(B + 60 * i, 5) for i in range(12)] + [(B + 720, 30)])
    assert fired(spark, folder, tmp_path, delay_seconds=60) == []
    minutes(spark, folder, "2.json", [(B + 60 * 14, 1)])
    assert [(p["epoch"], p["value"]) for p in fired(spark, folder, tmp_path, delay_seconds=60)] == [(B + 720, 60)]


@pytest.mark.parametrize("detector", [Detector(), Detector(method="ewma", alpha=0.2, min_history=5), Detector(window=5, sensitivity="high", min_history=3)])
def test_scores_of_the_stream_are_those_of_a_series(spark, detector):
    values = [10 + i * 7 % 5 + (90 if i in (20, 77) else 0) for i in range(100)]
    series = spark.createDataFrame([(B + 60 * i, "", v) for i, v in enumerate(values)], "epoch long, label string, value long")
    want = {r["epoch"]: (r["baseline_mean"], r["baseline_sd"], r["zscore"]) for r in points(scores(series, detector)).collect()}
    got = {}
    for i, v in enumerate(values):
        s = alerts.score_next(values[:i], v, detector)
        if s and s[2] >= detector.limit:
            got[B + 60 * i] = tuple(s)
    assert set(got) == set(want) and want and all(got[k] == pytest.approx(want[k], abs=0.006) for k in want)


def test_alerts_by_key_and_gaps(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(k, B + 60 * i, 200 if (k, i) == ("b", 40) else 3) for k in "ab" for i in range(0, 60, 2)]
    (folder / "0.json").write_text("".join(json.dumps({"k": k, "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(e))}) + "\n" for k, e, n in rows for _ in range(n)))
    lines = spark.readStream.schema("k string, ts timestamp").json(f"file://{folder}")
    for fill in (False, True):
        found = alerts.alerts(lines, by=F.col("k"), delay_seconds=-60, fill_gaps=fill)
        out = f"file://{tmp_path}/out-{fill}"
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(found.schema).parquet(f"{out}/rows").collect()
        assert [(p["key"], p["epoch"]) for p in got] == [("b", B + 2400)] and got[0]["baseline_mean"] == pytest.approx(1.5 if fill else 3)


def test_alerts_and_hooks_on_a_growing_file(spark, tmp_path):
    path, spikes, seen, turned = tmp_path / "live.log", [], [], []
    line = lambda e: f'{{"time":"{time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(e))}","msg":"m"}}\n'
    path.write_text("".join(line(B + 60 * i) for i in range(20) for _ in range(90 if i == 15 else 4)))
    follower = follow.Follower(delay_seconds=0, on_record=lambda batch: seen.append(batch.count()), on_rotate=turned.append)
    queries = follow.follow(follow.line_stream(spark, str(path), from_start=True), spikes.append, f"file://{tmp_path}/state", follower, interval="100 milliseconds")

    def wait(done):
        for _ in range(150):
            if done():
                return
            assert all(q.isActive for q in queries), [q.exception() for q in queries]
            time.sleep(0.4)
        raise AssertionError((seen, spikes, turned))

    try:
        wait(lambda: sum(seen) == 166 and spikes)
        for k in range(3):
            os.rename(path, f"{path}.{k}")
            path.write_text(line(B + 60 * (20 + k)))
            wait(lambda k=k: sum(seen) == 167 + k)
        wait(lambda: len(turned) == 3)
    finally:
        for q in queries:
            q.stop()
    assert [p["epoch"] for p in spikes] == [B + 900] and turned == [1, 2, 3] and follower.stats["rotations"] == 3
