"""Operator 6: personal data.

A character tagger (bidirectional LSTM under CRF transitions, trained in numpy from labelled spans) reads
overlapping windows of the whole text. Each place takes its scores from the window in which it stands most centrally; the joined
scores of all neighbouring windows are decoded in one pass, so tags are reconciled over the text and not window by window. All four kinds need a
digit or an at sign, so windows that are too far from any such character to bear on a span are left out; nothing else is skipped. The plain
patterns of the kinds always count; the tagger adds what they miss, if it is sure of every character and the span passes its kind's check.

Defined results: null and empty texts have no spans; offsets count code points, end exclusive; repeated rows have a
result each; an empty table gives an empty result; an existing column named like the added one gives way.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read_table, slices
from .secrets import SPANS, digest
from .tagger import KINDS, Tagger, TaggerSettings, char_ids, luhn, spans_of, trained

MARKED_SPANS = T.ArrayType(T.StructType([*SPANS.elementType.fields, T.StructField("added", T.BooleanType())]))
CHUNK = 1_000_000  # bytes of text held as objects at once
SURE = 0.9  # least probability of each character of an added span to belong to one

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a later start within the digits ends alike
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the plain patterns."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # each match has one at sign: the run of local characters before it, from the last match on
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            out.append(("email", start, match.end()))
        done = match.end() if match else at + 1
        at = text.find("@", done)
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d := x.lstrip("0")) <= 3 and int(d or "0") <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits(m)) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return out


def plausible(kind: str, span: str) -> bool:
    """Whether what the tagger found can be of its kind."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", span) is not None
    if kind == "ip":
        parts = re.split(r"\[?\.\]?", span)
        return len(parts) == 4 and all(p.isascii() and p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", span) is not None and 14 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"[+(0-9][0-9 ().-]+[0-9]", span) is not None and 10 <= len(digits) <= 15 and re.search(r"[ ().-]", span) is not None


def _windows(text: str, s: TaggerSettings) -> list[int]:
    """Numbers of the windows that decide on places within half a window of a digit or at sign."""
    half, edge = s.window // 2, (s.window - s.stride) // 2
    out: set[int] = set()
    last = max(0, -(-(len(text) - s.window) // s.stride))
    for m in MARK.finditer(text):
        low, high = max(0, m.start() - half - edge) // s.stride, max(0, m.start() + half - edge) // s.stride
        out.update(range(min(low, last), min(high, last) + 1))
    return sorted(out)


def tagged_spans(texts: list[str], tagger: Tagger, everywhere: bool = False) -> list[list[tuple[str, int, int]]]:
    """Sure and plausible spans of each text: scores of overlapping windows, joined and decoded as one sequence for each stretch of
    neighbouring windows. ``everywhere`` reads all windows."""
    s = tagger.s
    edge = (s.window - s.stride) // 2
    every = lambda t: range(max(0, -(-(len(t) - s.window) // s.stride)) + 1)
    where = [(i, k) for i, t in enumerate(texts) for k in (every(t) if everywhere else _windows(t, s)) if t]
    stretches: list[tuple[int, int, list[np.ndarray]]] = []  # text, start, scores
    before = (-1, -1)
    for first in range(0, len(where), 1024):
        part = where[first : first + 1024]
        pieces = [texts[i][k * s.stride : k * s.stride + s.window] for i, k in part]
        scores, _ = tagger.forward(np.stack([char_ids(p.ljust(s.window)) for p in pieces]))
        for n, ((i, k), piece) in enumerate(zip(part, pieces, strict=True)):
            low = 0 if k == 0 else edge
            high = len(piece) if (k * s.stride + s.window) >= len(texts[i]) else edge + s.stride
            if before != (i, k - 1):
                stretches.append((i, k * s.stride + low, []))
            stretches[-1][2].append(scores[low:high, n])
            before = i, k
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, start, _), (tags, outside) in zip(stretches, tagger.decode([np.concatenate(x[2]) for x in stretches]), strict=True):
        for kind, a, b in spans_of(tags) if tags.any() else []:
            if outside[a:b].max() <= 1 - SURE and plausible(kind, texts[i][start + a : start + b]):
                out[i].append((kind, start + a, start + b))
    return out


def find_marked(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text by start and kind, with whether they are added: the base ones, and those of the tagger that touch none of these."""
    plain = [t or "" for t in texts]
    order = {k: i for i, k in enumerate(KINDS)}
    out = []
    marked = [t if MARK.search(t) else "" for t in plain]
    for text, more in zip(marked, tagged_spans(marked, tagger), strict=True):
        base = base_spans(text)
        by_start = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))
        before = [bisect_left(starts, x[2]) for x in more]  # base spans that begin before the end of each
        added = [x for x, k in zip(more, before, strict=True) if not k or reach[k - 1] <= x[1]]
        both = [(*x, False) for x in base] + [(*x, True) for x in added]
        out.append(sorted(both, key=lambda x: (x[1], order[x[0]])))
    return out


def find_all(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """The spans of ``find_marked`` without their marks."""
    return [[x[:3] for x in spans] for spans in find_marked(texts, tagger)]


def personal_spans(text: Column, tagger: Tagger) -> Column:
    """A column of spans, array<struct<kind, start, end, added>>. The tagger goes along with the tasks."""

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    @F.arrow_udf(MARKED_SPANS)
    def of(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for a, b in slices(texts, CHUNK):
            out += [[{"kind": k, "start": x, "end": y, "added": more} for k, x, y, more in spans] for spans in find_marked(texts[a:b].to_pylist(), tagger)]
        return pa.array(out, kind)

    return of(text)


def find_personal(docs: DataFrame, text_col: str = "text", out_col: str = "personal", settings: TaggerSettings = TaggerSettings()) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.withColumn(out_col, personal_spans(F.col(text_col), trained(docs.sparkSession, settings)))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "personal", KINDS, lambda s: ~s["added"])
