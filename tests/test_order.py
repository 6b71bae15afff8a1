"""Places, neighbours and fading sums by blocks, against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riverlog.operators import anomaly
from riverlog.operators.order import fading_sum, numbered, with_neighbours

N = 3000


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return [rng.randint(0, 50) * (100 if rng.random() < 0.01 else 1) for _ in range(N)]


@pytest.fixture(scope="module")
def placed(spark, values):
    rows = spark.createDataFrame([(1000 + 60 * i * i, float(v)) for i, v in enumerate(values)], "epoch long, value double")
    return numbered(rows.repartition(7, "value"), "epoch").persist()


def test_places(placed, values):
    assert [(r["place"], r["value"]) for r in placed.orderBy("epoch").collect()] == list(enumerate(values))
    assert placed.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("reach, block", [(1, 16), (30, 64), (64, 64), (100, 10)])
def test_windows_over_blocks(placed, values, reach, block):
    rows = with_neighbours(placed, reach, lambda w: {"n": F.count("value").over(w.rowsBetween(-reach, -1)), "mean": F.avg("value").over(w.rowsBetween(-reach, -1))}, block=block)
    got = {r["place"]: (r["n"], r["mean"]) for r in rows.collect()}
    assert len(got) == rows.count() == N
    for i in range(N):
        before = values[max(0, i - reach) : i]
        assert got[i][0] == len(before) and (got[i][1] == pytest.approx(statistics.fmean(before)) if before else got[i][1] is None)


@pytest.mark.parametrize("keep", [0.0, 1e-9, 0.05, 0.7, 0.99, 0.9999])
def test_fading_sums(placed, values, keep):
    for longest in (100_000, 50):
        rows = fading_sum(placed, F.col("value") * 2, keep, F.col("value"), "y", longest=longest)
        y, want = float(values[0]), []
        for v in values:
            want.append(y)
            y = keep * y + 2 * v
        assert [r["y"] for r in rows.orderBy("place").collect()] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("alpha", [0.02, 0.3, 1.0])
def test_weighted_baselines(spark, values, alpha):
    series = spark.createDataFrame([(60 * i, "", v) for i, v in enumerate(values)], "epoch long, label string, value long")
    got = anomaly.scores(series, anomaly.Detector(method="ewma", alpha=alpha)).orderBy("idx").collect()
    mean, var, want = float(values[0]), 0.0, []
    for v in values:
        want.append((mean, var**0.5))
        step = v - mean
        mean, var = mean + alpha * step, (1 - alpha) * var + alpha * step * step
    assert [r["idx"] for r in got] == list(range(11, N + 1))
    assert [r["mean"] for r in got] == pytest.approx([m for m, _ in want[10:]]) and [r["sd"] for r in got] == pytest.approx([s for _, s in want[10:]], abs=1e-6)


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.8])
def test_flat_stretches_are_never_flagged(spark, alpha):
    values = [50] * 3000 + [83] * 3000 + [7_000_000_001] * 3000
    series = spark.createDataFrame([(60 * i, "", v) for i, v in enumerate(values)], "epoch long, label string, value long")
    flagged = anomaly.scores(series, anomaly.Detector(method="ewma", alpha=alpha, mode="both", threshold=2.0)).filter("direction is not null").collect()
    mean, var, want = 50.0, 0.0, set()
    for i, v in enumerate(values):
        step = v - mean
        if i >= 10 and abs(step) > 1e-9 * v and abs(step / (var**0.5 if var > 0 else 1)) >= 2.0001:
            want.add(i + 1)
        mean, var = mean + alpha * step, (1 - alpha) * var + alpha * step * step
    got = {r["idx"] for r in flagged}
    assert want <= got and all(abs(i - 3001) < 5 or abs(i - 6001) < 5 or i in want for i in got) and got & {3001, 6001} == {3001, 6001}


def test_no_window_spans_a_series_and_no_python_runs(spark, placed):
    series = placed.select("epoch", F.lit("").alias("label"), "value")
    for method in ("rolling", "ewma"):
        scored = anomaly.scores(series, anomaly.Detector(method=method))
        plan = anomaly.events(anomaly.points(scored))._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan
        spans = [line for line in plan.splitlines() if "Window [" in line and not any(c in line.rsplit("], [", 2)[-2] for c in ("_block", "_task"))]
        assert all("_sum" in line or "_rows" in line or "_first" in line for line in spans), spans  # a row a block or a partition


def test_nothing_and_one_bucket(spark):
    for rows in ([], [(0, "a", 5)]):
        series = spark.createDataFrame(rows, "epoch long, label string, value long")
        for method in ("rolling", "ewma"):
            assert anomaly.scores(series, anomaly.Detector(method=method, min_history=0)).count() == len(rows)
            assert anomaly.detect(series, anomaly.Detector(method=method))["points"] == []
