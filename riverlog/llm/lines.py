"""Operator 2: substring dedup by line or paragraph hashing.

Texts are cut into lines, or into paragraphs. Units are normalised (A-Z lower-cased, runs of blanks as one space, outer blanks dropped), and
every unit with a word is grouped by 128-bit digest over the whole corpus. The earliest occurrence by (doc_id, place) stays, all later ones go. Original
offsets are kept. Two options find passages and spare chance repeats: ``unit="sentence"`` cuts lines again at sentence ends, so that a passage inside a
longer line is found, and ``run_words`` over 1 removes later occurrences only where neighbouring ones hold so many words together.
Digests are counted with partial sums; only repeated ones meet the units again, in a join that splits hot digests. Equal rows are counted
before they meet, so a row that is repeated any number of times goes to no single task.

Defined results: a null text has no units; units without a word are never removed and don't end a run; rows without id
come first; rows that share an id are ranked by a hash of their text; of equal rows one is the earliest, the others are later
in all units; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts, read_table, with_row_key

CHUNK = 1_000_000  # bytes of text held as objects at once

# Units cover the text: each takes the line end after it.
UNITS = {"line": r"[^\n]+\n?|\n", "sentence": r"[^\n.!?]+[.!?]*\n?|[.!?]+\n?|\n", "paragraph": r"(?:[^\n]|\n(?!\n))+\n*|\n+"}


@dataclass(frozen=True)
class LineSettings:
    unit: str = "line"
    run_words: int = 1


def _words(unit: str) -> list[bytes]:
    return unit.encode("utf-8", "surrogatepass").lower().split()


def units(docs: DataFrame, s: LineSettings) -> DataFrame:
    """(has_id, doc_id, print, start, end, number, words, p, q): units with a word by code point offsets, end exclusive, and their digests."""
    schema = "has_id boolean, doc_id long, print long, start int, `end` int, number int, words int, p long, q long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(UNITS[s.unit])
        for batch in parts(batches, 3, CHUNK):
            row, *found = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                number = 0
                for m in pattern.finditer(text or ""):
                    if words := _words(m[0]):
                        mark = xxhash.xxh3_128_digest(b" ".join(words))
                        row.append(i)
                        for column, value in zip(found, (m.start(), m.end(), number, len(words), int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True))):
                            column.append(value)
                        number += 1
            at = pa.array(row, pa.int32())
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *map(pa.array, found, kinds)], ["has_id", "doc_id", "print", "start", "end", "number", "words", "p", "q"])

    return docs.select("has_id", "doc_id", "print", "text").mapInArrow(cut, schema)


def _in_runs(later: list[dict], least: int) -> list[dict]:
    """Those of a text's later units (in order) that stand in runs of enough words."""
    out: list[dict] = []
    run: list[dict] = []
    for unit in [*later, None]:
        if run and (unit is None or unit["number"] != run[-1]["number"] + 1):
            if sum(x["words"] for x in run) >= least:
                out += run
            run = []
        if unit is not None:
            run.append(unit)
    return out


def remove_repeated_units(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, kept (the remaining text) and spans (of removed units); a row for each row of ``docs``."""
    s, scratch = settings, Scratch(docs.sparkSession, "lines")
    marked = with_row_key(docs)
    all_units = scratch.table(units(marked, s), "units")
    place = F.struct("has_id", "doc_id", "print", "start")
    repeated = scratch.table(all_units.groupBy("p", "q").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("p", "q", "first"), "repeated")
    later = all_units.join(repeated, ["p", "q"]).filter(place > F.col("first"))
    key = ["has_id", "doc_id", "print"]
    spans = scratch.table(later.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("number", "words", "start", "end"))).alias("later")), "spans")
    scratch.drop(all_units, repeated)
    copies = not marked.groupBy(*key).count().filter("count > 1").isEmpty()

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(UNITS[s.unit])
        for batch in parts(batches, 2, CHUNK):
            out: list[list] = [[], [], [], [], []]
            for text, later, copy in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                text, cut = text or "", list(pattern.finditer(text or ""))
                if copy > 1:
                    later = [{"number": i, "words": len(_words(m[0])), "start": m.start(), "end": m.end()} for i, m in enumerate(m for m in cut if _words(m[0]))]
                gone = _in_runs(later or [], s.run_words)
                kept = "".join(text[a:b] for a, b in zip([0, *(x["end"] for x in gone)], [*(x["start"] for x in gone), len(text)]))
                for column, value in zip(out, (len(cut), len(gone), len(text) - len(kept), kept, [{"start": x["start"], "end": x["end"]} for x in gone])):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], ["has_id", "doc_id", "n_units", "n_removed", "removed_chars", "kept", "spans"])

    if copies:  # equal rows as one, then as many again: the first keeps its units, of the others all are later
        counted = marked.groupBy(*key).agg(F.max("text").alias("text"), F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    else:
        counted = marked.withColumn("copy", F.lit(1))
    out = counted.join(spans, key, "left").select("has_id", "doc_id", "text", "later", "copy").mapInArrow(removed, "has_id boolean, doc_id long, n_units long, n_removed long, removed_chars long, kept string, spans array<struct<start:int,`end`:int>>")
    return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_units", "n_removed", "removed_chars", "kept", "spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_units(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_units", "n_removed", "removed_chars", F.sha2("kept", 256).alias("kept_sha256"), spans.alias("spans"))


OP2_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]+\n?|\n') AS parts FROM documents),
numbered AS (
  SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS place FROM cut),
placed AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal FROM numbered),
judged AS (
  SELECT *, normal <> '' AND row_number() OVER (PARTITION BY normal ORDER BY doc_id, place) > 1 AS gone FROM placed)
SELECT d.doc_id, count(j.place)::BIGINT AS n_units, count(*) FILTER (j.gone)::BIGINT AS n_removed,
  coalesce(sum(length(j.unit)) FILTER (j.gone), 0)::BIGINT AS removed_chars,
  sha256(coalesce(string_agg(j.unit, '' ORDER BY j.place) FILTER (NOT j.gone), '')) AS kept_sha256,
  coalesce(string_agg(concat(j.start, ':', j.start + length(j.unit)), ',' ORDER BY j.place) FILTER (j.gone), '') AS spans
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id
"""
