"""Operator 4: approximate nearest neighbours on shifted space-filling curves.

Each curve projects the vectors at random to a few dimensions, shifts the grid at random and orders the cells by Hilbert
key. Spark range-partitions and sorts each order, which gives every vector its place on every curve. A query looks at the
places within ``window`` of its own on each curve: blocks of the order meet the queries whose windows touch them,
distances there are exact, and only the best of each block go on to be merged over blocks and curves.

The grid is scaled by a bounded sample (``sample`` vectors); every vector is indexed. Equal vectors are one class that keeps
the least ``k + 1`` of its ids, which is all that an answer can hold of them. The window grows with the index (``share``), as
vectors without structure of few dimensions need it; recall is measured against brute force in the tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows
without id; vectors of another length are compared among themselves; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table


@dataclass(frozen=True)
class CurveSettings:
    k: int = 10
    curves: int = 16
    dims: int = 31
    bits: int = 2  # of each dimension; a key has dims * bits, at most 63
    window: int = 512  # places to either side, at least
    share: float = 0.04  # of the index, at least
    sample: int = 10_000
    block: int = 2048
    slice_rows: int = 1 << 18  # of an order, whose queries a task takes at once
    seed: int = 20240301


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of grid cells (rows, dims); the transpose form of the curve is built in place, a bit plane at a time."""
    x = [c.astype(np.uint64) for c in cells.T]
    for plane in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << plane), np.uint64((1 << plane) - 1)
        for i in range(len(x)):
            is_set = (x[i] & bit) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(is_set, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(plane)) & np.uint64(1) == 1, flip ^ np.uint64((1 << plane) - 1), flip)
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | (((c ^ flip) >> np.uint64(plane)) & np.uint64(1))
    return key.astype(np.int64)


def projections(size: int, s: CurveSettings) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of a size: matrices (curves, size, dims) and shifts (curves, dims), from the seed alone."""
    rng = np.random.default_rng([s.seed, size])
    return rng.normal(size=(s.curves, size, s.dims)), rng.uniform(0, 2, (s.curves, s.dims))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def distances(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences whose squares leave the range of a double are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        apart = rows - v
        out = np.sqrt((apart**2).sum(1))
        most = np.abs(apart).max(1)
        odd = np.flatnonzero(~np.isfinite(out) & np.isfinite(most) | (out < 1e-150) & (most > 0))
        if len(odd):
            out[odd] = most[odd] * np.sqrt(((apart[odd] / most[odd, None]) ** 2).sum(1))
    return out


def vector_classes(vectors: DataFrame, s: CurveSettings, scratch: Scratch) -> DataFrame:
    """(rep, v, ids, size): distinct valid vectors, least id, least k + 1 ids. A vector held by many rows is
    first cut to its least ids in salted groups."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(valid, F.lit(False))).withColumns({"p": F.xxhash64("v"), "q": F.xxhash64(F.lit(1), "v"), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(64))})
    least = F.dense_rank().over(Window.partitionBy("p", "q", "salt").orderBy("vec_id"))
    some = rows.withColumn("r", least).filter(F.col("r") <= s.k + 1)
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, s.k + 1)
    return scratch.table(some.groupBy("p", "q").agg(F.min("vec_id").alias("rep"), F.any_value("v").alias("v"), ids.alias("ids")).select("rep", "v", "ids", F.size("v").alias("size"), "p", "q"), "classes")


def ordered(classes: DataFrame, s: CurveSettings, scratch: Scratch) -> DataFrame:
    """(curve, place, rep, size): the place of every class on every curve of its size."""
    sample = classes.select("size", "v").orderBy(F.xxhash64("rep")).limit(s.sample).toPandas()
    scales = {}
    for size, part in sample.groupby("size"):
        low, middle, high = np.percentile(np.stack(part["v"].tolist()).astype(np.float64) @ projections(int(size), s)[0], [16, 50, 84], axis=1)
        scales[int(size)] = (middle, np.maximum((high - low) / 2, 1e-300))  # of outliers, however large, only the ranks count

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                matrices, shifts = projections(size, s)
                mean, sd = scales.get(size, (np.zeros((s.curves, s.dims)), np.ones((s.curves, s.dims))))
                data = _matrix(part.column("v"))
                for c in range(s.curves):
                    with np.errstate(over="ignore", invalid="ignore"):
                        at = np.nan_to_num(((data @ matrices[c] - mean[c]) / sd[c] + 3 + shifts[c]) / 9)
                    cells = np.floor(np.clip(at, 0, 1) * ((1 << s.bits) - 1e-9)).astype(np.int64)
                    n = len(data)
                    columns = [pa.array(np.full(n, size * s.curves + c)), pa.array(hilbert_keys(cells, s.bits)), part.column("rep"), part.column("size")]
                    yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "rep", "size"])

    rows = classes.select("rep", "v", "size").mapInArrow(keys, "curve long, key long, rep long, size int")
    order = rows.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    order = scratch.table(order.withColumn("i", F.monotonically_increasing_id()), "order")
    task = order.withColumn("task", F.shiftright("i", 33)).withColumn("row", F.col("i").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = task.groupBy("task").agg(F.count("*").alias("n"))  # one row a partition
    offsets = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("offset"))
    placed = task.join(F.broadcast(offsets), "task").withColumn("overall", F.col("offset") + F.col("row"))
    starts = placed.groupBy("curve").agg(F.min("overall").alias("start"))  # one row a curve
    return placed.join(F.broadcast(starts), "curve").select("curve", (F.col("overall") - F.col("start")).alias("place"), "rep", "size")


def search(vectors: DataFrame, is_query, settings: CurveSettings = CurveSettings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``vectors`` (vec_id, v) that is a query."""
    s, scratch = settings, Scratch(vectors.sparkSession, "curves")
    kind = "float" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(f"array<{kind}>").alias("v"))
    classes = vector_classes(vectors, s, scratch)
    asked = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("p"), F.xxhash64(F.lit(1), "v").alias("q")).distinct()
    asked = scratch.table(asked.join(classes.select("p", "q", F.col("rep").alias("query")), ["p", "q"]).select("query_id", "query"), "asked")
    queries = asked.select(F.col("query").alias("rep")).distinct().withColumn("asks", F.lit(True))
    sizes = classes.groupBy("size").agg(F.count("*").alias("n")).select("size", F.greatest(F.lit(s.window), F.ceil(F.col("n") * s.share)).cast("long").alias("window"))
    places = ordered(classes, s, scratch).join(F.broadcast(sizes), "size").join(classes.select("rep", "v"), "rep").join(queries, "rep", "left")
    places = scratch.table(places.select("curve", "place", "rep", "window", "v", F.coalesce("asks", F.lit(False)).alias("asks")), "places")
    block, first = F.floor(F.col("place") / s.block), F.col("place") - F.col("window")
    last = F.col("place") + F.col("window")
    part = lambda x: F.floor(F.greatest(F.lit(0), x) / s.slice_rows)
    # a block meets every slice of queries whose windows can reach it; a query goes to every block that its window touches
    low, high = block * s.block - F.col("window"), (block + 1) * s.block + F.col("window")
    index = places.withColumn("block", block).withColumn("slice", F.explode(F.sequence(part(low), part(high)))).withColumn("asks", F.lit(False))
    asking = places.filter("asks").withColumn("slice", part(F.col("place"))).withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), first) / s.block), F.floor(last / s.block))))
    names = ["curve", "block", "slice", "place", "rep", "window", "v", "asks"]

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = rows[~rows["asks"]], rows[rows["asks"]]
        out = [pd.DataFrame({"query": [], "rep": [], "score": []})]
        if len(ours) and len(theirs):
            data, reps, at = np.stack(ours["v"].tolist()).astype(np.float64), ours["rep"].to_numpy(), ours["place"].to_numpy()
            window = int(rows["window"].iloc[0])
            for query, place, v in zip(theirs["rep"], theirs["place"], theirs["v"], strict=True):
                near = np.flatnonzero(np.abs(at - place) <= window)
                score = distances(data[near], np.asarray(v, dtype=np.float64))
                top = np.lexsort((reps[near], score))[: s.k + 1]
                out.append(pd.DataFrame({"query": query, "rep": reps[near][top], "score": score[top]}))
        return pd.concat(out).astype({"query": "int64", "rep": "int64", "score": "float64"})

    found = index.select(*names).union(asking.select(*names)).groupBy("curve", "block", "slice").applyInPandas(best, "query long, rep long, score double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    merged = found.groupBy("query", "rep").agg(F.min("score").alias("score")).withColumn("r", nearest).filter(F.col("r") <= s.k + 1)
    members = scratch.table(merged.select("query", "rep", "score"), "merged").join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    members = scratch.table(members.withColumn("r", nearest).filter(F.col("r") <= s.k + 1).drop("r"), "members")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    answers = asked.join(members, "query").filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).filter(F.col("rank") <= s.k)
    return answers.select("query_id", "rank", "vec_id", "score")


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search(rows, F.col("vec_id") % 100 == 0)
