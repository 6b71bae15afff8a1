"""Sinks: records, series and summaries as JSON, NDJSON and CSV."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..schema import EXPORT_FIELDS, JSON_FIELDS

SERIES_FIELDS = ("label", "epoch", "value", "count", "bytes", "errors")


def csv_row(rows: DataFrame, fields: Sequence[str]) -> Column:
    """One CSV line; a field that the rows don't have is empty."""
    return F.concat_ws(",", *[csv_cell(F.col(f)) if f in rows.columns else F.lit("") for f in fields])


def json_row(rows: DataFrame, fields: Sequence[str] = JSON_FIELDS) -> Column:
    """One compact JSON object with sorted keys and without nulls; ``data`` stays nested."""
    names = sorted({*fields, "data"} if fields is JSON_FIELDS else fields)
    return F.to_json(F.struct(*[F.col(n) for n in names if n in rows.columns]))


def write_csv(rows: DataFrame, path: str, fields: Sequence[str] = EXPORT_FIELDS) -> None:
    """CSV files in a folder, each with a header."""
    cells = [csv_cell(F.col(f)).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields]
    rows.select(*cells).write.option("header", "true").option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_ndjson(rows: DataFrame, path: str, fields: Sequence[str] = JSON_FIELDS) -> None:
    rows.select(json_row(rows, fields).alias("value")).write.text(path)


def write_parquet(rows: DataFrame, path: str, by: Sequence[str] = ("type",)) -> None:
    """Parsed records by type, for scans that skip the others."""
    rows.write.partitionBy(*by).parquet(path)


def csv_lines(rows: DataFrame, fields: Sequence[str] = EXPORT_FIELDS) -> Iterator[str]:
    """Header and rows, a partition at a time."""
    yield ",".join(fields) + "\n"
    yield from (f"{r[0]}\n" for r in rows.select(csv_row(rows, fields)).toLocalIterator())


def ndjson_lines(rows: DataFrame) -> Iterator[str]:
    yield from (f"{r[0]}\n" for r in rows.select(json_row(rows)).toLocalIterator())


def document_frame(count: int, pretty: bool) -> tuple[str, str]:
    """What comes before and after the records of a JSON document."""
    head, tail = _dump({"meta": {"count": count, "format": "records"}, "records": []}, pretty).rsplit("[]", 1)
    return head + "[", ("\n   ]" if pretty and count else "]") + tail


def json_lines(rows: DataFrame, pretty: bool = True) -> Iterator[str]:
    """One JSON document, in the form that ``records_to_json`` has, a record at a time; records are counted first."""
    head, tail = document_frame(rows.count(), pretty)
    first = True
    for r in rows.select(json_row(rows)).toLocalIterator():
        one = _dump(json.loads(r[0]), pretty).rstrip("\n")
        yield (head if first else ",") + ("\n" + textwrap.indent(one, " " * 6) if pretty else one)
        first = False
    yield (head if first else "") + tail


def records_to_csv(rows: DataFrame, fields: Sequence[str] = EXPORT_FIELDS) -> str:
    """The lines as one text, for results that a terminal shows."""
    return "".join(csv_lines(rows, fields))


def records_to_ndjson(rows: DataFrame) -> str:
    return "".join(ndjson_lines(rows))


def records_to_json(rows: DataFrame, pretty: bool = True) -> str:
    return "".join(json_lines(rows, pretty))


def write_parts(path: str, parts: Iterable[str]) -> None:
    """Replaces a local file by the parts, one after another."""
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.writelines(parts)


def series_to_csv(buckets: DataFrame, value: str = "value") -> str:
    head = ["label", "epoch", value, "count", "bytes", "errors"]
    return "\n".join([",".join(head), *(r[0] for r in buckets.orderBy("epoch").select(csv_row(buckets, SERIES_FIELDS)).collect())]) + "\n"


def summary_to_json(summary: dict, pretty: bool = True) -> str:
    return _dump({"meta": {"format": "summary"}, "summary": summary}, pretty)


def parse_stats_to_json(stats: dict, pretty: bool = True) -> str:
    return _dump({"meta": {"format": "parse_stats"}, "stats": stats}, pretty)


def _dump(value: dict, pretty: bool) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True, default=str, **({"indent": 3} if pretty else {"separators": (",", ":")})) + "\n"


def write_file(path: str, text: str) -> str | None:
    """Replaces a local file; - gives the text back."""
    if path == "-":
        return text
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return None
