"""Percentiles by counts, top lists and distinct counts by sketches, charts as rows, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverlog.operators import series, sketches, stats
from riverlog.operators.ranks import percentiles

PS = (0, 0.1, 25, 50, 95, 99, 100)


def plain(values, p):
    values = sorted(values)
    at = p / 100 * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


RNG = random.Random(8)
CASES = {
    "one": [7.0], "two": [1.0, 2.0], "equal": [5.0] * 300, "distinct": [RNG.random() for _ in range(3000)], "skewed": [10 ** RNG.uniform(-200, 200) for _ in range(2000)],
    "signs": [RNG.gauss(0, 1e6) for _ in range(2000)], "half equal": [3.0] * 1500 + [RNG.uniform(0, 6) for _ in range(1500)], "wide": [-1.7e308, 1.7e308, 0.0, 1e-320, 5e-324] * 30, "close": [1 + k * 2.0**-52 for k in range(500)],
    "zeros": [0.0, -0.0] * 100 + [1.0],
}


@pytest.mark.parametrize("case, fan, few", [*((c, 1024, 20_000) for c in CASES), *((c, 512, 3) for c in CASES), ("distinct", 4, 50)])
def test_percentiles(spark, case, fan, few):
    values = CASES[case]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    got = percentiles(rows, "v", PS, fan, few).first()
    assert got["n"] == len(values)
    for q, p in zip(got["q"], PS, strict=True):
        want = plain(values, p)
        assert q == want or q == pytest.approx(want, rel=1e-12) or (case == "wide" and not math.isfinite(want))


def test_percentiles_of_nothing(spark):
    got = percentiles(spark.createDataFrame([], "v double"), "v", PS).first()
    assert got["n"] == 0 and got["q"] == [None] * len(PS)
    assert stats.durations(spark.createDataFrame([], "duration_ms long")).first().asDict() == {"count": 0, "avg": None, "p50": None, "p95": None, "p99": None, "max": None}


@pytest.fixture(scope="module")
def hits(spark):
    """Addresses with a few frequent ones, paths all of which are alike, and methods."""
    rng = random.Random(2)
    rows = [(f"10.0.{int(rng.paretovariate(0.7)) % 3000}.1", f"/p/{i % 2000}", rng.choice(["GET", "", None]), i) for i in range(20_000)]
    return spark.createDataFrame(rows, "ip string, path string, method string, bytes long").persist()


@pytest.mark.parametrize("tracked, most", [(10_000, 1000), (200, 40), (20, 5)])
def test_top_lists_by_sketch_are_exact(hits, tracked, most):
    dims = ["ip", "url", "method"]
    key = lambda rows: sorted((r["dim"], r["rank"], r["key"], r["n"], r["bytes"]) for r in rows.collect())
    assert key(sketches.top_by_sketch(hits, 10, dims, tracked, most)) == key(stats.top_dimensions(hits, 10, dims).select("dim", "rank", "key", "n", "bytes"))


def test_what_a_sketch_may_miss_is_bounded(hits):
    for tracked, most in ((200, 40), (1000, 1000)):
        found, missed = sketches.candidates(hits, ["ip", "url"], tracked, most)
        for dim, column in (("ip", "ip"), ("url", "path")):
            left = hits.filter(~F.col(column).isin(found[dim])).groupBy(column).count().agg(F.max("count")).first()[0] or 0
            assert left <= missed[dim]


def test_distinct_sketches_add_up_over_days(spark):
    rows = spark.range(60_000).selectExpr("timestamp_seconds(1763460000 + id * 10) AS ts", "concat('a', id % 25000) AS ip", "'' AS path", "CAST(NULL AS STRING) AS ua", "1L AS bytes")
    by_day = sketches.distinct_sketches(rows)
    assert by_day.count() == 3 * rows.select(F.to_date("ts")).distinct().count()
    got = {r["dim"]: r["estimate"] for r in sketches.distinct_estimates(by_day).collect()}
    assert got["ip"] == pytest.approx(25_000, rel=0.03) and (got["url"], got["ua"]) == (0, 0)
    exact = {r["dim"]: r["n"] for r in sketches.distinct_counts(rows).collect()}
    assert exact == {"ip": 25_000}
    total = stats.overview(rows.withColumns({"status": F.lit(200), "level": F.lit("info")}))
    assert total.select("uniq_ips", "uniq_urls", "uniq_uas", "total").first()[:] == (25_000, 0, 0, 60_000)
    assert "Expand" not in total._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, rows, width", [(5, 48, 20), (100, 48, 42), (1000, 7, 10), (49, 48, 5), (1, 1, 3), (333, 100, 60)])
def test_chart_rows_draw_what_collected_buckets_do(spark, n, rows, width):
    values = [RNG.randint(0, 500) for _ in range(n)]
    buckets = spark.createDataFrame([(60 * i, f"label {i}", v, v, v, 0) for i, v in enumerate(values)], "epoch long, label string, value long, count long, bytes long, errors long").repartition(3)
    plain_rows = [r.asDict() for r in buckets.orderBy("epoch").collect()]
    drawn = series.chart_rows(buckets, rows, width)
    assert "\n".join(r["line"] for r in drawn.orderBy("row").collect()) == series.ascii_chart(plain_rows, rows, width)
    marks = series.spark_marks(buckets, rows)
    assert "".join(r["mark"] for r in marks.orderBy("at").collect()) == series.sparkline(values, rows)


def test_charts_of_nothing(spark):
    none = spark.createDataFrame([], "epoch long, label string, value long, count long, bytes long, errors long")
    assert series.chart_rows(none).count() == 0 and series.spark_marks(none, 10).count() == 0
