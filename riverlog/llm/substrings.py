"""Operator 9: suffix-array dedup with a depth-limited radix sort.

Suffixes are ordered only through their first ``window`` bytes, by passes from the most significant digit
on; a pass drops groups of one and hands the others to the next. Equal groups after the last pass are exactly the
repeated windows.

The first digits are chosen so that few suffixes enter. The first is the window's anchor: its ``anchor``-byte substring of
least hash (the leftmost, if equal), with its place in the window. Equal windows have equal anchors, and consecutive
windows mostly share one, so the pass sorts one row per anchor, about a hundredth of the bytes. Anchors that occur once
are dropped. The second digit is the whole stretch of bytes that an anchor's windows cover: stretches that occur again
are repeated as a whole, and one copy of each goes on. The last digits are the window's own bytes, eight at a time from the most significant on,
for each window of the stretches left that shares a fingerprint with another. Anchors with few stretches are sorted within a task, group by group. Those with more than
``split_over`` pass on: their stretches are cut into nodes, windows whose anchors stand at nearby places, and the next digit
is what all windows of a node have in common; nodes without an equal are dropped and repeated ones marked as a whole, as before. After the
narrowest nodes, windows of groups that are still large meet in a shuffle by digit, so no group is gathered whole.
Where bytes aren't compared (whole stretches, nodes, windows of large groups), rows meet by two fingerprints of 64 bits, that of the anchor and that of the
digit.

Defined results: null and empty texts have no bytes; texts shorter than the window lose nothing; rows are told apart
by doc_id and a hash of their text, those without id by 128 bits of hash, so repeated rows have a result each; copies of a text of the window's length or
more lose every byte; null ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts, read_table, with_row_key

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
BYTES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class WindowSettings:
    window: int = 200
    anchor: int = 32
    split_over: int = 4096  # stretches of one anchor that a task sorts by itself, about a megabyte
    nodes: tuple[int, ...] = (32, 4)  # places of the anchor that share a node, for larger groups
    chunk_bytes: int = 1_000_000
    sort_bytes: int = 2_000_000  # that a task sorts at once; whole groups


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Prints:
    """Fingerprints of any substrings of a byte array, from running sums of byte values times powers of BASE."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        steps = np.full(n + 1, BASE, np.uint64)
        back = np.full(n + 1, INVERSE, np.uint64)
        steps[0] = back[0] = 1
        powers, self.back = np.cumprod(steps), np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors_of(texts: list[bytes], s: WindowSettings) -> tuple[np.ndarray, ...]:
    """For runs of windows that share an anchor: text number, first and last window, bytes of the first before the anchor, and the prints of the anchor and of
    the stretch (with the places of both ends)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    w = s.window - s.anchor + 1  # anchors in a window
    n = len(data) - s.window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    prints = Prints(data)
    at = np.arange(len(data) - s.anchor + 1)
    low = np.uint64((1 << 32) - 1)  # ties of the upper half of the hash go to the left
    least = (prints.of(at, at + s.anchor) & ~low) | (at.astype(np.uint64) & low)
    span, have = 1, least
    while span * 2 <= w:  # minima over spans of powers of two, then of two such spans
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    have = np.minimum(have[:n], have[w - span : w - span + n]) if w > span else have[:n]
    place = (have & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.arange(n)
    valid = owner[:n] == owner[s.window - 1 :]
    starts, place = starts[valid], place[valid]
    if not len(starts):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    anchor = place[new]
    key = prints.of(anchor, anchor + s.anchor)
    stretch = _mixed(prints.of(first, last + s.window) ^ _mixed(((anchor - first) * s.window + (last - first)).astype(np.uint64) + MIX[1]))
    text = owner[first]
    return text, first - edge[text], last - edge[text], anchor - first, key, stretch


def _chunked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with the bytes of their second column."""
    for part in parts(batches, 1, limit):
        yield part, [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]


def _runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_digits(keys: list[int], stretches: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last digit: for each window its stretch, its start within it, and a digit that equal windows of an anchor share."""
    data = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.array([len(x) for x in stretches], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    row = np.repeat(np.arange(len(stretches)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    prints = Prints(data)
    at = base[row] + start
    return row, start, prints.of(at, at + window) ^ _mixed(np.array(keys, dtype=np.int64).view(np.uint64)[row])


def equal_windows(data: np.ndarray, at: np.ndarray, digit: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows at these places of ``data`` are equal to another one. Digits that differ part them at once; what
    is left is ordered by its bytes, eight at a time from the most significant on, and groups of one are dropped."""
    order = np.argsort(digit, kind="stable")
    group = np.concatenate([[0], np.cumsum(digit[order][1:] != digit[order][:-1])]) if len(order) else order
    for k in [*range(0, window - 8, 8), window - 8]:
        size = np.bincount(group)[group] if len(group) else group
        order, group = order[size > 1], group[size > 1]
        if not len(order):
            break
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at[order] + k]).view(">u8").ravel().astype(np.uint64)
        inside = group[1:] == group[:-1]
        if (eight[1:] != eight[:-1])[inside].any():
            by = np.lexsort((eight, group))
            order, group, eight = order[by], group[by], eight[by]
            group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (eight[1:] != eight[:-1]))])
        else:
            group = np.concatenate([[0], np.cumsum(~inside)])
    size = np.bincount(group)[group] if len(group) else group
    out = np.zeros(len(at), bool)
    out[order[size > 1]] = True
    return out


def _pass(rows: DataFrame, carried: list[str], s: WindowSettings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One radix pass over a table of (key, stretch, known, *carried): spans of the stretches that occur again, and what goes on,
    one copy of each stretch of the keys that have several, with ``split`` for keys of too many. known: already among the spans."""
    again = scratch.table(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "again")
    rows = scratch.table(rows.join(again, "key"), "pass")
    one = F.min(F.struct(*carried)).alias("x")
    stretches = scratch.table(rows.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.bool_or("known").alias("known"), one).select("key", "stretch", (F.col("known") | (F.col("n") > 1)).alias("known"), F.col("n").alias("copies"), "x.*"), "stretches")
    repeated = scratch.table(stretches.filter("copies > 1").select("key", "stretch"), "repeated")
    spans = rows.filter("not known").join(repeated, ["key", "stretch"]).select("doc_id", "print", F.col("first").alias("from"), (F.col("last") + s.window).alias("to"))
    several = scratch.table(stretches.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "several")
    return spans, stretches.join(several, "key").select("key", *carried, "known", (F.col("kinds") > s.split_over).alias("split"))


def _nodes(pieces: DataFrame, width: int, s: WindowSettings) -> DataFrame:
    """Stretches cut where the anchor's place in the window passes a multiple of ``width``; keys are what a node's windows share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "stretch", "known", "doc_id", "print", "first", "last", "left", "bytes"]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                prints = Prints(np.frombuffer(b"".join(r[7] for r in part), np.uint8))
                out, marks, base = [], [], 0
                for key, doc_id, mark, first, last, left, known, data in part:
                    low, high = left - (last - first), left  # of the anchor's place in the windows
                    for node in range(low // width, high // width + 1):
                        a, b = left - min(high, (node + 1) * width - 1), left - max(low, node * width)  # first and last window
                        core = left - node * width, left - (node + 1) * width + 1 + s.window
                        out.append((doc_id, mark, first + a, first + b, left - a, known, data[a : b + s.window]))
                        marks.append((key, node, base + core[0], base + core[1], base + a, base + b + s.window, (left - a) * s.window + b - a))
                    base += len(data)
                key, node, c0, c1, a, b, where = np.array(marks, dtype=np.int64).T
                keys = _mixed(prints.of(c0, c1) ^ _mixed(key.view(np.uint64) + node.view(np.uint64) * MIX[0]))
                stretch = _mixed(prints.of(a, b) ^ _mixed(where.view(np.uint64) + MIX[1]))
                doc_id, mark, first, last, left, known, data = zip(*out)
                columns = [pa.array(keys.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(known, pa.bool_()), pa.array(doc_id, pa.int64()), pa.array(mark, pa.int64()), *(pa.array(x, pa.int32()) for x in (first, last, left)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key long, stretch long, known boolean, doc_id long, print long, first int, last int, left int, bytes binary"
    return pieces.select("key", "doc_id", "print", "first", "last", "left", "known", "bytes").mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, settings: WindowSettings, scratch: Scratch) -> DataFrame:
    """(doc_id, print, spans): for texts with repeated windows, the intervals of bytes that these cover."""
    s = settings

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunked(batches, s.chunk_bytes):
            text, first, last, left, key, stretch = anchors_of(texts, s)
            columns = [batch.column(0).take(pa.array(text)), batch.column(2).take(pa.array(text)), *(pa.array(x.astype(np.int32)) for x in (first, last, left)), pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "first", "last", "left", "key", "stretch"])

    schema = "doc_id long, print long, first int, last int, left int, key long, stretch long"
    rows = scratch.table(docs.select("doc_id", "text", "print").mapInArrow(anchor_rows, schema).withColumn("known", F.lit(False)), "anchors")
    whole, left = _pass(rows, ["doc_id", "print", "first", "last", "left"], s, scratch)
    scratch.drop(rows)
    by_doc = scratch.table(left.groupBy("doc_id", "print").agg(F.collect_list(F.struct("key", "first", "last", "left", "known", "split")).alias("parts")), "by_doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "print", "first", "last", "left", "known", "split", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, mark, parts in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(p["key"], doc_id, mark, p["first"], p["last"], p["left"], p["known"], p["split"], raw[p["first"] : p["last"] + s.window]) for p in parts]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    cut_schema = "key long, doc_id long, print long, first int, last int, left int, known boolean, split boolean, bytes binary"
    texts = docs.join(by_doc, ["doc_id", "print"])
    pieces = scratch.table(texts.select("doc_id", "text", "print", "parts").mapInArrow(cut, cut_schema), "pieces")

    # large groups: nodes, each a narrower pass
    small, rest, spans = pieces.filter("not split"), pieces.filter("split"), [whole]
    for width in s.nodes:
        if rest.isEmpty():
            break
        found, left = _pass(scratch.table(_nodes(rest, width, s), "nodes"), ["doc_id", "print", "first", "last", "left", "bytes"], s, scratch)
        left = scratch.table(left, "left").select(*pieces.columns)
        small, rest, spans = small.union(left.filter("not split")), left.filter("split"), [*spans, found]

    # last pass, small groups: they lie together in a partition
    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, start, digit = window_digits([r[0] for r in held], [r[5] for r in held], s.window)
            sizes = np.array([len(r[5]) for r in held], dtype=np.int64)
            equal = equal_windows(np.frombuffer(b"".join(r[5] for r in held), np.uint8), (np.cumsum(sizes) - sizes)[row] + start, digit, s.window)
            row, start = row[equal], start[equal]
            edge = np.ones(len(row), bool)
            edge[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            head = np.flatnonzero(edge)
            tail = np.concatenate([head[1:] - 1, [len(row) - 1]]) if len(head) else head
            own, a, b = row[head], start[head], start[tail] + s.window
            keep = [i for i in range(len(own)) if not held[own[i]][4]]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[own[i]][1] for i in keep], pa.int64()), pa.array([held[own[i]][2] for i in keep], pa.int64()), pa.array([held[own[i]][3] + int(a[i]) for i in keep], pa.int32()), pa.array([held[own[i]][3] + int(b[i]) for i in keep], pa.int32())],
                ["doc_id", "print", "from", "to"],
            )

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size > s.sort_bytes and r[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield flush()

    span = "doc_id long, print long, `from` int, `to` int"
    few = small.select("key", "doc_id", "print", "first", "known", "bytes").repartition("key").sortWithinPartitions("key")
    within = few.mapInArrow(sort_groups, span)

    # last pass, large groups: a row a window, summed up before the shuffle
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for i in range(0, len(rows), 2000):
                part = rows[i : i + 2000]
                row, start, digit = window_digits([r[0] for r in part], [r[5] for r in part], s.window)
                key, doc_id, mark, known = (pa.array([r[c] for r in part], k).take(pa.array(row)) for c, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (4, pa.bool_())))
                at = np.array([r[3] for r in part], dtype=np.int64)[row] + start
                yield pa.RecordBatch.from_arrays([key, pa.array(digit.view(np.int64)), doc_id, mark, known, pa.array(at.astype(np.int32))], ["key", "digit", "doc_id", "print", "known", "at"])

    many = rest.select("key", "doc_id", "print", "first", "known", "bytes")
    all_windows = scratch.table(many.mapInArrow(windows, "key long, digit long, doc_id long, print long, known boolean, at int"), "windows")
    equal = scratch.table(all_windows.groupBy("key", "digit").agg(F.count("*").alias("n")).filter("n > 1").select("key", "digit"), "equal")
    across = all_windows.filter("not known").join(equal, ["key", "digit"]).select("doc_id", "print", F.col("at").alias("from"), (F.col("at") + s.window).cast("int").alias("to"))
    every = reduce(DataFrame.union, [*spans, within, across])
    return scratch.table(every.groupBy("doc_id", "print").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (the removed runs); a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "windows")
    marked = with_row_key(docs)
    spans = repeated_spans(marked, settings, scratch)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunked(batches, settings.chunk_bytes):
            runs = [_runs(np.array([x["from"] for x in r or []]), np.array([x["to"] for x in r or []])) for r in batch.column(2).to_pylist()]
            kept = [b"".join(t[a:b] for a, b in zip([0, *(y for _, y in r)], [*(x for x, _ in r), len(t)])) for t, r in zip(texts, runs)]
            n_bytes = [len(t) for t in texts]
            columns = [batch.column(0), batch.column(3), pa.array(n_bytes, pa.int64()), pa.array([n - len(k) for n, k in zip(n_bytes, kept)], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(kept, pa.binary())]
            columns.append(pa.array([[{"from": a, "to": b} for a, b in r] for r in runs], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "has_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = marked.join(spans, ["doc_id", "print"], "left").select("doc_id", "text", "spans", "has_id")
    out = joined.mapInArrow(removed, "doc_id long, has_id boolean, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<`from`:int,`to`:int>>")
    return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "spans")


def op9_radix_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
