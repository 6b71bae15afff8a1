"""Operator 5: WARC archives, written by Spark and read back by a salvage reader.

Writing: a record per page, payload the html. Of equal payloads the page of the largest id is the response and the
others are revisits of it. Each record is one gzip member; the text writer stores them through Spark's own
committer, with an empty gzip member as line separator, so any file system that Spark writes to will do and a
lost task leaves nothing behind. Files are kept to about ``file_bytes``.

Reading: archives come as (path, content) rows, as Spark's binaryFile source gives them, compressed or not. Every
record is checked: version line, header block, length, closing blank line and payload digest. After a failed
check the reader searches for the next gzip member that inflates, or the next version line at which a whole
record stands, goes on from there, and reports the bytes between as quarantined. Of a damaged or cut member the whole records
before the damage are read, too. Members are inflated ``CHUNK`` bytes at a time and parsed as they come, whatever their size and wherever in them a
version line stands; held are the record being read and the ones before it up to ``HOLD`` bytes. An archive is one row: larger ones than a task's
memory are to be cut at member borders before.

Defined results: null html is an empty payload; a page without id counts as the least id; rows of equal id and payload
are alike (all response or all revisit); control characters in URLs are percent-encoded; an empty table writes no records and reads
none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
CHUNK, HOLD = 1 << 20, 1 << 26
RATIO = 1032  # deflate makes no more bytes out of one
HEAD_END = re.compile(rb"\r\n(?:(\r\n)|WARC/1\.[01]\r\n)")  # the blank line, or else the next version line
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@dataclass(frozen=True)
class WarcSettings:
    min_bytes: int = 0  # payloads from this size on are deduplicated
    file_bytes: int = 16_000_000  # payload bytes of an archive, about
    level: int = 6


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:riverlog:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    block = HTTP % len(payload)
    if not is_revisit:
        block += payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_responses(pages: DataFrame, settings: WarcSettings, scratch: Scratch) -> DataFrame:
    """page_id, url, html, refers_to, is_revisit. Only digests are grouped; payloads meet them in a join that splits hot digests."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n_bytes"))
    several = rows.filter(F.col("n_bytes") >= settings.min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).filter("n > 1 and response is not null").select("sha", "response")
    joined = rows.join(scratch.table(several, "several"), "sha", "left")
    return joined.select("page_id", "url", "html", F.col("response").alias("refers_to"), (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("is_revisit"))


def write_archives(pages: DataFrame, path: str, settings: WarcSettings, scratch: Scratch) -> None:
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["page_id"].astype(object), batch["url"], batch["html"], batch["refers_to"].astype(object), batch["is_revisit"], strict=True)
            out = []
            for page_id, url, html, refers_to, is_revisit in rows:
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                raw = record(ids[0], url, (html or "").encode("utf-8", "surrogatepass"), ids[1], bool(is_revisit))
                out.append(gzip.compress(raw, settings.level, mtime=0))
            yield pd.DataFrame({"member": out})

    rows = with_responses(pages, settings, scratch).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows = rows.repartition(max(1, -(-total // settings.file_bytes)))
    rows.mapInPandas(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _parse(data: bytes | bytearray, at: int, rest: int = 0) -> tuple[dict[str, str], bytes, int] | int | None:
    """Headers, block and end of the record at a place, or None if it fails a check. Where ``rest`` more bytes may come and are needed to
    tell, the least number of bytes in all instead."""
    version = VERSION.match(data, at)
    if version is None:
        return at + 10 if rest and len(data) < at + 10 else None
    blank = HEAD_END.search(data, version.end() - 2)
    if blank is None or blank[1] is None:
        return len(data) + 1 if rest and blank is None else None
    head_end = blank.start()
    headers: dict[str, str] = {}
    for line in bytes(data[version.end() : head_end]).split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and headers:  # a folded header goes on
            headers[list(headers)[-1]] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        return None
    start = head_end + 4
    end = start + int(headers["content-length"])
    if end + 4 > len(data):
        return end + 4 if end + 4 - len(data) <= rest else None
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = bytes(data[start:end])
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "").startswith("sha1:") and headers["warc-payload-digest"][5:] != digest(block.partition(b"\r\n\r\n")[2]):
        return None
    return headers, block, end + 4


class _Member:
    """A gzip member that is inflated bit by bit. place: where reading is; over: there is no more; whole: it ended as a member does."""

    def __init__(self, data: bytes, at: int):
        self.data, self.place, self.step, self.over, self.whole = data, at, 4096, False, False
        self.inflater = zlib.decompressobj(31)

    @property
    def rest(self) -> int:
        return 0 if self.over else (len(self.data) - self.place) * RATIO + CHUNK

    def more(self) -> bytes:
        while not self.over:
            feed, before = self.data[self.place : self.place + self.step], self.inflater.copy()
            try:
                out = self.inflater.decompress(feed, CHUNK)
            except zlib.error:
                if self.step == 1:
                    self.over = True
                self.inflater, self.step = before, max(1, self.step // 16)  # closer to the damage
                continue
            self.place += len(feed) - len(self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail)
            self.over = self.whole = self.inflater.eof
            if out:
                return out
            self.over = self.over or not feed
        return b""


Found = list[tuple[dict[str, str], bytes]]


def _read_member(data: bytes, at: int) -> Iterator[tuple[str, Found, int, bool]]:
    """What a gzip member holds, as (state, records, place, whether it holds other bytes, too): "part" for records that are
    handed on before its end; then "whole" with the member's end, or "damaged" with a place by which its last record was read."""
    member, content, pos, begin = _Member(data, at), bytearray(), 0, 0
    ends, held, size, other, last = [(0, at)], [], 0, False, 0

    def fill(upto: int) -> None:
        while len(content) < upto and not member.over:
            content.extend(member.more())
            ends.append((begin + len(content), member.place))

    while True:
        fill(pos + 10)
        if pos >= len(content):
            break
        found = _parse(content, pos, member.rest)
        while isinstance(found, int):
            fill(found)
            found = _parse(content, pos, member.rest)
        if found:
            held.append(found[:2])
            size += len(found[1])
            pos, last = found[2], begin + found[2]
            if size > HOLD:
                yield "part", held, member.place, other
                held, size = [], 0
        else:  # on to the next version line
            other, pos = True, pos + 1
            while (version := VERSION.search(content, pos)) is None and not member.over:
                pos = max(pos, len(content) - 9)
                del content[:pos]
                begin, pos = begin + pos, 0
                fill(len(content) + 1)
            pos = version.start() if version else len(content)
        if pos > CHUNK:
            del content[:pos]
            begin, pos = begin + pos, 0
    if member.whole:
        yield "whole", held, member.place, other
    else:
        yield "damaged", held, ends[min(bisect_left(ends, (last, 0)), len(ends) - 1)][1], other


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes]]:
    """("record" or "gap", start, end, headers, block) in order of place; gaps are the quarantined bytes. Offsets are
    those of the archive as stored; a record has those of its member, or of the part of it that was read by then."""
    at, gap = 0, None
    next_member = next_version = -1  # the first ones after ``at``, searched anew only when passed
    while at < len(data):
        found: Found = []
        end, gap_from, passed = None, None, False
        if data.startswith(MEMBER, at):
            for state, found, place, other in _read_member(data, at):
                if state == "part":
                    if gap is not None:
                        yield "gap", gap, at, None, b""
                        gap = None
                    passed = True
                    for headers, block in found:
                        yield "record", at, place, headers, block
                elif state == "whole":
                    end = place
                    if other:
                        gap = at if gap is None else gap
                elif found or passed:  # read up to the damage; the next member may begin before the place where inflating failed
                    gap_from = place
        elif one := _parse(data, at):
            found, end = [one[:2]], one[2]
        if end is None and gap_from is None:
            gap = at if gap is None else gap
        elif gap is not None:
            yield "gap", gap, at if gap < at else end or gap_from, None, b""
            gap = None
        for headers, block in found:
            yield "record", at, end or gap_from, headers, block
        if end is None:
            gap = gap_from if gap_from is not None else gap
            if next_member <= at:
                next_member = data.find(MEMBER, at + 1)
                next_member = len(data) if next_member < 0 else next_member
            if next_version <= at:
                version = VERSION.search(data, at + 1)
                next_version = version.start() if version else len(data)
            at = min(next_member, next_version)
            gap = min(gap, at)
        else:
            at = end
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data), None, b""


RECORDS = "path string, kind string, start long, `end` long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of (path, content) rows, columns RECORDS. A revisit's payload_bytes are those its own HTTP head states."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0].strip("`") for c in RECORDS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for kind, start, end, h, block in salvage(bytes(content)):
                    if kind == "gap":
                        out.append((path, kind, start, end, *[None] * 7))
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    is_revisit = h["warc-type"] == "revisit"
                    size = int(stated[1]) if is_revisit and stated else len(payload)
                    mark = h.get("warc-payload-digest", "").partition(":")[2] or digest(payload)
                    out.append((path, kind, start, end, h["warc-type"], h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), mark, size, payload if with_payload else None))
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns).astype({"payload_bytes": "Int64"})

    return archives.select("path", "content").mapInPandas(rows, RECORDS)


def round_trip(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads those back: columns RECORDS."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages.select("page_id", "url", "html"), path, settings, scratch)
    # the session's own listing of the folder: one archive is one row of bounded size
    return read_archives(spark.read.format("binaryFile").load(path), with_payload=False)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:riverlog:page:(-?[0-9]+|none)>$", 1), F.lit("none")).cast("long")
    records = round_trip(read_table(spark, sf_dir, "pages")).filter("kind = 'record'")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))


# Base32 is read off the 160 bits of the digest, five at a time.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS response FROM p),
b AS (SELECT *, array_to_string([lpad(bin(('0x' || sha[i:i])::INT), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || bits[i * 5 + 1 : i * 5 + 5])::INT + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM b
"""
