"""Operator 7: secret scans.

One Aho-Corasick pass over each whole text finds the keywords that can begin a secret; the anchored pattern
of a kind is tried at its hits only. Runs of hex digits have no keyword: one pass of a character-class pattern finds
them. Tokens that carry a checksum count only if it is right.

Defined results: null and empty texts have no secrets; offsets count code points, end exclusive; rows that repeat
keep a result each; an empty table gives an empty result; an existing column named like the added one gives way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read_table, slices

CHUNK = 1_000_000  # bytes of text held as objects at once
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# Key words of assignments, and the prefixes of tokens that end in a checksum.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
HEX = re.compile(r"[0-9a-f]{24,}")


@lru_cache(1)
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word(ACCESS_WORD, ("access", len(ACCESS_WORD)))
    for word in CHECKED_WORDS:
        found.add_word(word, ("checked", len(word)))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """Whether the last six of a token's 36 characters are the CRC-32 of the thirty before them in base 62."""
    body, tail = token[-36:-6], token[-6:]
    value = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        value, at = divmod(value, 62)
        digits = BASE62[at] + digits
    return digits == tail


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start and then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    plain = len(raw) == len(text)
    hits = [(at - size + 1, kind) for at, (kind, size) in _keywords().iter(raw.lower().decode("latin-1"))]
    out, done = [], {}
    seen_bytes = seen_chars = 0
    for at, kind in sorted(hits):
        if not plain:  # from bytes to code points, moving on from the last hit
            seen_chars += len(raw[seen_bytes:at].decode("utf-8", "surrogatepass"))
            seen_bytes, at = at, seen_chars
        if at < done.get(kind, 0):
            continue
        match = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, at)
        if match:
            done[kind] = match.end()
            if kind == "assign" and len(match[2]) >= 6 or kind == "access" and match.end() - at >= 20:
                out.append((kind, at, match.end()))
            elif kind == "checked" and checksum_holds(match[0]):
                out.append((CHECKED_WORDS[match[0][:4]], at, match.end()))
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate(BASE_KINDS + CHECKED_KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    out: list[list[dict]] = []
    for a, b in slices(texts, CHUNK):
        out += [[{"kind": k, "start": x, "end": y} for k, x, y in find(t)] for t in texts[a:b].to_pylist()]
    return pa.array(out, SPANS_ARROW)


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact(t) for a, b in slices(texts, CHUNK) for t in texts[a:b].to_pylist()], pa.string())


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret, or run of overlapping secrets, replaced by a mark."""
    out, at = [], 0
    for _, start, end in find(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with a column of spans, array<struct<kind, start, end>>."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out_col, _spans(F.col(text_col)))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of the text column replaced by a mark."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(text_col, _redacted(F.col(text_col)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, spans: str, kinds: tuple[str, ...], is_base: Callable[[Column], Column] = lambda s: F.lit(True)) -> DataFrame:
    """doc_id, a count by base kind, base_sha256 and spans from a column of spans; counts and hash take the base spans of these kinds alone."""
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds) & is_base(s))
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "secrets", BASE_KINDS)


