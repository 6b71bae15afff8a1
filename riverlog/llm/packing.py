"""Operator 8: best-fit packing.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths goes
to the driver (at most ``capacity`` rows); best fit decreasing runs over its counts and yields slots: runs of ranks
within a length, with the sequences and offsets they get. Pieces take their slots by a join on length and
their rank within it. Ranks come from salted groups of a length, so one common length is no hot task.

Defined results: a null text is empty, and a document of no ids still has its end token; repeated rows are
pieces of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, read_table


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 2048
    end_id: int = 0
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str | None = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary, for the faster library
    salt_rows: int = 256
    max_salts: int = 4096
    chunk_bytes: int = 1_000_000


@lru_cache(4)
def encoder(tokenizer: str, ranks: str | None) -> Callable[[str], list[int]]:
    """ids of a text. The faster library serves Latin text, where both split words alike; special tokens, other
    scripts and long runs of blanks, on which its pattern overflows, go to the tokenizer file itself."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    slow = lambda text: exact.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t["content"] for t in json.loads(exact.to_str())["added_tokens"]]
    other = re.compile("|".join(["[^\\x00-ɏ‐-‧€]", r"\s{10000}", *map(re.escape, special)]))
    return lambda text: slow(text) if other.search(text) else fast.encode_ordinary(text)


def tokenised(docs: DataFrame, settings: PackSettings = PackSettings(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if wanted, ids. The first piece takes the odd rest."""
    s = settings

    columns = {"doc_id": pa.string(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        columns["ids"] = pa.list_(pa.int32())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(s.tokenizer, s.ranks)
        for part in parts(batches, 1, s.chunk_bytes):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), s.end_id], dtype="<u4")
                first = len(ids) % s.capacity or s.capacity
                edges = [0, *range(first, len(ids) + 1, s.capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype("int32")] if with_ids else [])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), columns.values())], list(columns))

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(pieces, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, count, first_sequence, each, offset) by best fit decreasing over counts.

    Item i of a slot goes to sequence first_sequence + i // each, at offset + (i % each) * length. Sequences
    of one free space are kept as runs, so the work follows the number of lengths, not of pieces.
    """
    free: list[int] = []  # free spaces in use, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> (first sequence, sequences)
    slots, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if not runs[space]:
                insort(free, space)
            runs[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del free[at]
            else:
                space, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - space))
                put(space - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if left and full < n:
                slots.append((length, rank, left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, n - full)
    return slots


def pack(docs: DataFrame, settings: PackSettings = PackSettings(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of ``tokenised`` with sequence_id and offset."""
    spark, s, scratch = docs.sparkSession, settings, Scratch(docs.sparkSession, "pack")
    pieces = scratch.table(tokenised(docs, s, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list] = defaultdict(list)
    for length, *slot in best_fit(histogram, s.capacity):
        by_length[length].append(tuple(slot))
    plan = [(length, min(s.max_salts, -(-n // s.salt_rows)), by_length[length]) for length, n in histogram.items()]
    plan = spark.createDataFrame(plan, "length long, salts int, slots array<struct<first_rank:long,count:long,first_sequence:long,each:long,base:long>>")
    salted = pieces.join(F.broadcast(plan.select("length", "salts")), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(counts.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower")), "starts")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(starts, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt"))).withColumn("rank", F.col("own") + F.col("lower"))
    slot = F.filter("slots", lambda x: (F.col("rank") >= x["first_rank"]) & (F.col("rank") < x["first_rank"] + x["count"]))[0]
    placed = ranked.join(F.broadcast(plan.select("length", "slots")), "length").withColumn("slot", slot)
    at = F.col("rank") - F.col("slot.first_rank")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return placed.select(*columns, (F.col("slot.first_sequence") + F.floor(at / F.col("slot.each"))).alias("sequence_id"), (F.col("slot.base") + at % F.col("slot.each") * F.col("length")).alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
