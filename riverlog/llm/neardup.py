"""Operator 3: MinHash near-dedup by bottom-k sketches.

One hash function orders the shingles of all documents; a document's sketch is its ``sketch`` least ones. Documents
of equal sets are one class from the start. The first ``indexed`` values of a sketch go to inverted lists, but only the
rarest of them that two documents of the wanted similarity must share, so common shingles make no lists. In
a list, members are compared with one member, never all with all: the union of both sketches estimates the similarity,
full sets confirm it, and components absorb the links. In the first round that member is the most central one, whose values
are held most often, as copies gather around their model; in further rounds, which look only at lists that still
hold several components and go on as long as they link enough, it is drawn at random. A member that all others of a list were compared with
leaves that list, so lists of two are done after one round and lists of three after two.

What is left then are members apart from the largest component of their list. Each is held against the list's
members of other components by a parity bitmap: two bitmaps never differ in more bits than the sets in elements, so a
pair whose bitmaps differ in too many can't be similar. A pair is handed on only from the first large list that both are in, so
near misses of a dense group give no rows, and no link between components is lost beyond the odds of ``loss`` at the
exact threshold. With ``loss`` 0, one shared value of the indexed ones is enough, which two sets at the threshold miss with
odds of 0.2 to the power of ``indexed``; sets of up to ``sketch`` elements together are then judged exactly. The comparisons of this last step (not
its rows) grow with the members that stay unlinked times their list.

Defined results: a null text or one without words has an empty set and is linked with nothing; a text of fewer words
than a shingle has its whole sequence as the one element; rows that share a doc_id are one node and have a
result each; a null doc_id takes no part (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts, read_table
from .graph import components

MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class NearSettings:
    words: int = 5  # of a shingle
    percent: int = 80  # similarity to link, as 100 * intersection / union
    sketch: int = 64
    indexed: int = 32
    loss: float = 1e-6
    worth: float = 0.01  # of a list's members, newly linked, for another round
    small: int = 16  # members of a list, up to which it may hand on pairs that another list hands on, too
    parity_words: int = 16  # of 64 bits
    chunk_bytes: int = 1_000_000


def floor_of(draws: int, percent: int, loss: float) -> int:
    """The most matches that a pair at the threshold has among ``draws``, but for odds of ``loss``."""
    p, tail = percent / 100, 0.0
    for hits in range(draws + 1):
        tail += math.comb(draws, hits) * p**hits * (1 - p) ** (draws - hits)
        if tail > loss:
            return max(1, hits)
    return draws


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes: the sorted distinct shingles of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z only, the blanks of the word pattern
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes, distinct = pd.factorize(np.array([w for x in split for w in x], dtype=object))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes] if len(codes) else np.empty(0, np.uint64)
    n = max(0, len(owner) - k + 1)
    acc = hashes[:n]
    for j in range(1, k):
        acc = _mixed(acc * MULTIPLIERS[0] + hashes[j : n + j])
    whole = owner[:n] == owner[k - 1 : n + k - 1] if n else np.empty(0, bool)
    short = [i for i in np.flatnonzero((sizes > 0) & (sizes < k))]
    own = np.concatenate([owner[:n][whole], np.array(short, dtype=np.int64)])
    values = np.concatenate([acc[whole], np.array([xxhash.xxh64_intdigest(b" ".join(split[i])) for i in short], dtype=np.uint64)]).view(np.int64)
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    own, values = own[first], values[first]
    return np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]), values


def _batches(batches: Iterator[pa.RecordBatch], s: NearSettings) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, offsets, hashes) of small parts of the batches."""
    for part in parts(batches, 1, s.chunk_bytes):
        yield part.column(0), *shingle_sets(part.column(1).to_pylist(), s.words)


def signatures(docs: DataFrame, s: NearSettings) -> DataFrame:
    """doc_id, n (size of the set), p and q (its 128-bit fingerprint), sketch, and the words o0, o1, ... of a parity bitmap."""
    names = _parity_names(s)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, values in _batches(batches, s):
            sizes, data = np.diff(offsets), values.view(np.uint64)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(_mixed(data ^ m))]) for m in MULTIPLIERS[:2]]
            prints = [(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in sums]
            inside = np.arange(len(values)) - np.repeat(offsets[:-1], sizes) < s.sketch
            kept = np.concatenate([[0], np.cumsum(np.minimum(sizes, s.sketch))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *map(pa.array, prints), pa.ListArray.from_arrays(kept, values[inside]), *map(pa.array, parity(offsets, data, s.parity_words).T)], ["doc_id", "n", "p", "q", "sketch", *names])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, p long, q long, sketch array<long>, " + ", ".join(f"{o} long" for o in names))


def _parity_names(s: NearSettings) -> list[str]:
    return [f"o{i}" for i in range(s.parity_words)]


def parity(offsets: np.ndarray, data: np.ndarray, words: int) -> np.ndarray:
    """Whether each bit is hit by an odd number of a set's elements; a row of 64-bit words for each set."""
    out = np.empty((len(offsets) - 1, words), np.int64)
    bit = (_mixed(data ^ MULTIPLIERS[2]) % np.uint64(64 * words)).astype(np.int64)
    for first in range(0, len(out), 2048):
        edge = offsets[first : first + 2049]
        owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        hits = np.bincount(owner * 64 * words + bit[edge[0] : edge[-1]], minlength=64 * words * (len(edge) - 1))
        out[first : first + 2048] = np.packbits((hits & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, words)
    return out


def full_sets(docs: DataFrame, s: NearSettings) -> DataFrame:
    """doc_id and its whole set as a sorted array."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, values in _batches(batches, s):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets.astype(np.int32), values)], ["doc_id", "full"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, full array<long>")


def inverted_lists(reps: DataFrame, s: NearSettings, scratch: Scratch) -> DataFrame:
    """(value, rep, n, central): of a sketch's first values, in order of how many documents hold them, those of which any
    similar document must hold one; values that nobody else holds are left out. central: how often a member's values are held."""
    values = reps.select("rep", "n", F.explode(F.slice("sketch", 1, s.indexed)).alias("value"))
    shared = scratch.table(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    own = F.least(F.col("n"), F.lit(s.indexed))
    must = F.least(F.lit(floor_of(s.indexed, s.percent, s.loss)), F.ceil(F.col("n") * s.percent / 100))
    by_rep = values.join(shared, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    take = F.greatest(F.lit(0), own - must + 1 - (own - F.size("held"))).cast("int")
    central = F.aggregate("held", F.lit(0).cast("long"), lambda a, v: a + v["df"])
    rows = by_rep.select("rep", "n", central.alias("central"), F.explode(F.slice("held", F.lit(1), take)).alias("v")).select("v.value", "rep", "n", "central")
    lists = scratch.table(rows, "lists")
    scratch.drop(shared)
    return lists


def _near_size(a: Column, b: Column, s: NearSettings) -> Column:
    return 100 * F.least(a, b) >= s.percent * F.greatest(a, b)


def _near_sketch(a: Column, b: Column, s: NearSettings) -> Column:
    """Whether two sketches allow the similarity: matches among the least values of their union. A union that is
    shorter than a sketch is exact."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, s.sketch)
    matches = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    least = F.when(F.size(union) < s.sketch, F.ceil(F.size(union) * s.percent / 100)).otherwise(floor_of(s.sketch, s.percent, s.loss))
    return matches >= least


class _Linker:
    """Confirms candidate pairs (a, b) on full sets, which it computes once for each document that is a candidate."""

    def __init__(self, docs: DataFrame, reps: DataFrame, s: NearSettings, scratch: Scratch):
        self.docs, self.reps, self.s, self.scratch = docs, reps, s, scratch
        self.sets: DataFrame | None = None

    def sketched(self, pairs: DataFrame) -> DataFrame:
        a = self.reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
        b = self.reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
        return pairs.join(a, "a").join(b, "b").filter(_near_sketch(F.col("sa"), F.col("sb"), self.s)).select("a", "b")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a table)."""
        s, ids = self.s, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = self.scratch.table(ids, "ids")
        if self.sets is None or not ids.isEmpty():
            new = self.scratch.table(full_sets(self.docs.join(ids, "doc_id", "left_semi"), s), "sets")
            self.sets = new if self.sets is None else self.sets.union(new)
        full = lambda end: self.sets.select(F.col("doc_id").alias(end), F.col("full").alias(f"full_{end}"))
        inter = F.size(F.array_intersect("full_a", "full_b"))
        both = F.size("full_a") + F.size("full_b")
        links = pairs.join(full("a"), "a").join(full("b"), "b").withColumn("i", inter).filter(100 * F.col("i") >= s.percent * (both - F.col("i")))
        return self.scratch.table(links.select("a", "b"), "confirmed")


def near_components(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row for each row of ``docs`` (doc_id, text)."""
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.table(signatures(docs, s), "signatures")
    known = rows.filter("n > 0 and doc_id is not null")
    reps = scratch.table(known.groupBy("p", "q", "n").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"), *[F.any_value(o).alias(o) for o in _parity_names(s)]), "reps")
    lists = inverted_lists(reps.select("rep", "n", "sketch"), s, scratch)
    linker = _Linker(docs, reps.select("rep", "sketch"), s, scratch)
    links = labels = None
    turn, members, is_last = 0, lists.withColumn("label", F.col("rep")), False
    while not is_last:
        order = F.struct(-F.col("central"), "rep") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "value", "rep"), "rep")
        drawn = members.groupBy("value").agg(F.min_by(F.struct("rep", "n", "label"), order).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        pivots = scratch.table(drawn.select("value", F.col("x.rep").alias("pivot"), F.col("x.n").alias("m"), F.col("x.label").alias("other")), "pivots")
        held = scratch.table(members.join(pivots, "value").filter("rep <> pivot"), "held")
        scratch.drop(members)
        pairs = held.filter((F.col("label") != F.col("other")) & _near_size(F.col("n"), F.col("m"), s))
        pairs = scratch.table(linker.sketched(pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()), "pairs")
        found = linker.confirm(pairs)
        n_found = found.count()
        if n_found:
            links = found if links is None else links.union(found)
            labels = components(links, scratch)
        is_last = n_found == 0 or bool(turn) and n_found < s.worth * held.select("rep").distinct().count()
        members = scratch.table(_labelled(held, labels), "members")
        scratch.drop(pivots, pairs, held)
        turn += 1
    pairs = scratch.table(linker.sketched(scratch.table(_apart(members, reps, s, scratch), "apart")), "pairs")
    scratch.drop(members)
    if not pairs.isEmpty():
        found = linker.confirm(pairs)
        if not found.isEmpty():
            labels = components(found if links is None else links.union(found), scratch)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    classes = reps.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("p", "q", "n", F.coalesce("label", "rep").alias("label"))
    classes = scratch.table(classes, "classes")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    out = rows.select("doc_id", "n", "p", "q").join(classes, ["p", "q", "n"], "left").withColumn("component_id", own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(value, rep, n, central, label): members of lists with the labels that they have now."""
    if labels is None:
        return members.select("value", "rep", "n", "central", F.col("rep").alias("label"))
    now = labels.select(F.col("node").alias("rep"), F.col("label").alias("now"))
    return members.drop("label").join(now, "rep", "left").select("value", "rep", "n", "central", F.coalesce("now", "rep").alias("label"))


def _apart(members: DataFrame, reps: DataFrame, s: NearSettings, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that share a list and may be similar, each from the first large list that both are
    in, or from each small one if they share no large one."""
    bits = _parity_names(s)
    several = members.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("value")
    members = scratch.table(members.join(several, "value", "left_semi"), "open")
    large = members.groupBy("value").agg(F.count("*").alias("size")).filter(F.col("size") > s.small).select("value")
    own = members.join(large, "value", "left_semi").groupBy("rep").agg(F.collect_set("value").alias("own"))  # at most ``indexed`` values
    ends = members.select("rep").distinct().join(reps.select("rep", *bits), "rep").join(own, "rep", "left")
    full = scratch.table(members.drop("central").join(scratch.table(ends, "ends"), "rep"), "full")
    # a pair across components has an end outside the list's largest one
    main = members.groupBy("value", "label").agg(F.count("*").alias("size")).groupBy("value").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    names = ("rep", "n", "label", "own", *bits)
    a = full.join(scratch.table(main, "main"), "value").filter("label != main").select("value", "main", *[F.col(c).alias(f"{c}_a") for c in names])
    b = full.select("value", *[F.col(c).alias(f"{c}_b") for c in names])
    differ = sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in bits), F.lit(0))
    # similar sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes
    allowed = (100 + s.percent) * differ <= (100 - s.percent) * (F.col("n_a") + F.col("n_b"))
    once = (F.col("label_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b"))
    across = (F.col("label_a") != F.col("label_b")) & once & _near_size(F.col("n_a"), F.col("n_b"), s)
    first = F.coalesce(F.array_min(F.array_intersect("own_a", "own_b")), F.col("value")) == F.col("value")
    pairs = a.join(b, "value").filter(across & allowed & first)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), NearSettings(words=2))
