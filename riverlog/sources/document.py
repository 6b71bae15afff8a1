"""One file out of many tasks: a JSON document, a CSV file with one header, or NDJSON.

Tasks write parts beside the file, each under a name of its own; the commit joins those of the tasks that counted, in the order of the partitions, and moves the
whole into place. A task that is lost, or runs twice, leaves nothing in it, and a job that fails leaves no file. Parts are copied a block at
a time. Paths may have any scheme that pyarrow opens; executors and driver must see the same folder.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import textwrap
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..schema import EXPORT_FIELDS
from .export import csv_row, document_frame, json_row
from .lines import numbered_by_split

BLOCK = 1 << 20
OPEN, CLOSE, EMPTY = "\n      {\n", "\n      }", r"\n {6}\{\}"  # a record of an indented document; its own texts hold no line ends


class DocumentSource(DataSource):
    """``rows.write.format("document").option("path", p).option("form", f)`` for rows of one column, a line each; forms are lines (after an option
    ``header``), json and compact."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        made = DocumentWriter(self.options["path"], self.options.get("form", "lines"), self.options.get("header", ""), overwrite)
        made.prepare()
        return made


@dataclass
class Part(WriterCommitMessage):
    number: int
    rows: int
    path: str


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, form: str, header: str, overwrite: bool):
        self.path, self.form, self.header, self.overwrite = path, form, header, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def prepare(self) -> None:
        """Makes the folder of the parts. Tasks don't, so one that is still busy when its job is given up can't bring the folder back."""
        fs, folder = _opened(self.parts)
        fs.create_dir(folder, recursive=True)

    def _text(self, value: str) -> str:
        if self.form == "lines":
            return value + "\n"
        one = json.dumps(json.loads(value), sort_keys=True, ensure_ascii=True, **({"indent": 3} if self.form == "json" else {"separators": (",", ":")}))
        return "\n" + textwrap.indent(one, " " * 6) if self.form == "json" else one

    def _between(self) -> bytes:
        return b"" if self.form == "lines" else b","

    def write(self, iterator: Iterator[Row]) -> Part:
        number, n = TaskContext.get().partitionId(), 0
        fs, folder = _opened(self.parts)
        name = f"{folder}/{number:08}-{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as out:
            for row in iterator:
                out.write((self._between() if n else b"") + self._text(row[0]).encode())
                n += 1
        return Part(number, n, name)

    def _frame(self, rows: int) -> tuple[bytes, bytes]:
        if self.form == "lines":
            return (self.header + "\n").encode() if self.header else b"", b""
        return tuple(x.encode() for x in document_frame(rows, self.form == "json"))

    def commit(self, messages: list[Part | None]) -> None:
        fs, target = _opened(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        if not self.overwrite and fs.get_file_info(target).type != FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        head, tail = self._frame(sum(m.rows for m in parts))
        _, folder = _opened(self.parts)
        whole = f"{folder}/whole"
        with fs.open_output_stream(whole) as out:
            out.write(head)
            for k, part in enumerate(parts):
                out.write(self._between() if k else b"")
                with fs.open_input_stream(part.path) as piece:
                    while block := piece.read(BLOCK):
                        out.write(block)
            out.write(tail)
        fs.move(whole, target)
        fs.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = _opened(self.parts)
        for _ in range(3):  # a busy task may add a file meanwhile
            if fs.get_file_info(folder).type != FileType.Directory:
                return
            with contextlib.suppress(OSError):
                fs.delete_dir(folder)


def _write(lines: DataFrame, path: str, **options: str) -> None:
    lines.sparkSession.dataSource.register(DocumentSource)
    lines.write.format("document").options(path=path, **options).mode("overwrite").save()


def write_json_document(rows: DataFrame, path: str, pretty: bool = True) -> None:
    """The records as one JSON document, in the order of the rows' partitions."""
    _write(rows.select(json_row(rows).alias("value")), path, form="json" if pretty else "compact")


def write_csv_document(rows: DataFrame, path: str, fields: Sequence[str] = EXPORT_FIELDS) -> None:
    """The records as one CSV file with one header."""
    _write(rows.select(csv_row(rows, fields).alias("value")), path, header=",".join(fields))


def write_ndjson_document(rows: DataFrame, path: str) -> None:
    _write(rows.select(json_row(rows).alias("value")), path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """count (of the head), place (from 1) and r (of ``schema``) of each record of an indented document that ``write_json_document`` wrote. The
    file is read by input splits, as a record ends where a brace stands at its own depth; so no task reads it whole."""
    text = spark.read.option("lineSep", CLOSE).text(path).select(F.lit(0).alias("file"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")
    first = text.filter("block = 0").select("value").first()
    head = re.match(r'\{\n   "meta": \{\n      "count": (\d+),', first["value"] if first else "")
    if not head:
        raise ValueError(f"no indented JSON document: {path}")
    # up to the end of a record there may be empty ones, which end in their own line
    at = F.instr("value", OPEN)
    own = F.when(at > 0, F.array(F.concat(F.substr("value", at), F.lit(CLOSE)))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.array_repeat(F.lit("{}"), F.regexp_count("value", F.lit(EMPTY))), own)
    rows = text.select("file", "name", "block", F.explode(found).alias("one")).withColumn("i", F.monotonically_increasing_id())
    return numbered_by_split(rows).select(F.lit(int(head[1])).cast("long").alias("count"), F.col("line_no").alias("place"), F.from_json("one", schema).alias("r"))
