"""Predicates over records, checked when they are made and joined by AND into one boolean column."""

from __future__ import annotations

import re
import time
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_network, ipv4_value, normalize_level
from ..functions.times import epoch_iso, parse_datetime
from ..schema import LEVEL_SYNONYMS, SEVERITIES

NAMES = ("status", "exclude_status", "ip", "url", "url_regex", "method", "level", "since", "until", "host", "user", "referer_regex", "grep", "min_bytes", "max_bytes")


def _surely(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(text: str, name: str) -> list[str]:
    """Parts of a comma list; a trailing comma is allowed, an empty part is not."""
    parts = [p.strip() for p in re.sub(",+$", "", text).split(",")]
    if "" in parts:
        raise ValueError(f"invalid {name} filter '{text}'")
    return parts


def checked_pattern(pattern: str, name: str) -> str:
    """The pattern with line feeds as the only line ends, if Java compiles it."""
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as problem:
        raise ValueError(f"invalid pattern for {name}: {pattern}") from problem
    return f"(?d){pattern}"


class RecordFilter:
    """``RecordFilter(status="5xx", ip="10.0.0.0/8")``; ``apply`` keeps the records that pass everything."""

    def __init__(self, now: float | None = None, **options):
        if unknown := set(options) - set(NAMES):
            raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
        self.parts: list[tuple[str, Column]] = []
        now = time.time() if now is None else now
        for name in NAMES:
            if (value := options.get(name)) is not None and value != "":
                getattr(self, f"_{name}")(value, now)

    def add(self, label: str, condition: Column) -> RecordFilter:
        self.parts.append((label, _surely(condition)))
        return self

    def _statuses(self, spec: str) -> tuple[Column, str]:
        classes, codes = set(), set()
        for p in _list(spec, "status"):
            if re.fullmatch(r"[1-5]xx", p, re.IGNORECASE):
                classes.add(int(p[0]))
            elif re.fullmatch(r"\d{3}", p):
                codes.add(int(p))
            else:
                raise ValueError(f"invalid status filter '{p}' (want NNN or Nxx)")
        shown = ",".join([f"{c}xx" for c in sorted(classes)] + [f"{c:03d}" for c in sorted(codes)])
        return F.col("status").isin(*codes) | F.floor(F.col("status") / 100).isin(*classes), shown

    def _status(self, spec: str, now: float) -> None:
        hit, shown = self._statuses(spec)
        self.add(f"status in [{shown}]", hit)

    def _exclude_status(self, spec: str, now: float) -> None:
        hit, shown = self._statuses(spec)
        self.add(f"status not in [{shown}]", F.col("status").isNotNull() & ~hit)

    def _ip(self, spec: str, now: float) -> None:
        ip, any_of = F.col("ip"), []
        for p in _list(spec, "ip"):
            if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}/\d{1,2}", p):
                any_of.append(in_network(ip, p))
            elif re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", p):
                if ipv4_value(p) is None:
                    raise ValueError(f"invalid IP literal '{p}'")
                any_of.append(ip == p)
            elif re.search(r"[*?]", p):
                glob = "".join({"*": "[^ ]*", "?": "."}.get(c, re.escape(c)) for c in p)
                any_of.append(ip.rlike(f"(?d)^{glob}$"))
            else:
                any_of.append(ip.rlike(checked_pattern(p, "ip")))
        self.add(f"ip in [{spec}]", (ip != "") & reduce(or_, map(_surely, any_of)))

    def _url(self, part: str, now: float) -> None:
        self.add(f"url contains '{part}'", _surely(F.col("url").contains(part)) | _surely(F.col("path").contains(part)))

    def _url_regex(self, pattern: str, now: float) -> None:
        pattern = checked_pattern(pattern, "url_regex")
        self.add(f"url =~ {pattern[4:]}", _surely(F.col("url").rlike(pattern)) | _surely(F.col("path").rlike(pattern)))

    def _method(self, spec: str, now: float) -> None:
        names = [p.upper() for p in _list(spec, "method")]
        self.add(f"method in [{','.join(names)}]", F.col("method").isin(*names))

    def _level(self, spec: str, now: float) -> None:
        names = []
        for p in map(str.lower, _list(spec, "level")):
            if p not in SEVERITIES and p not in LEVEL_SYNONYMS:
                raise ValueError(f"unknown level '{p}'")
            names.append(p if p == "notif" else LEVEL_SYNONYMS.get(p, p))
        level = F.lower("level")
        own = F.when(level == "notif", level).otherwise(F.coalesce(normalize_level(level), level))
        self.add(f"level in [{','.join(names)}]", own.isin(*names))

    def _when(self, text: str, now: float, name: str) -> float:
        if (epoch := parse_datetime(text, now)) is None:
            raise ValueError(f"invalid {name} time '{text}'")
        return epoch

    def _since(self, text: str, now: float) -> None:
        epoch = self._when(text, now, "since")
        self.add(f"since {epoch_iso(epoch)}", F.col("ts") >= F.timestamp_micros(F.lit(round(epoch * 1e6))))

    def _until(self, text: str, now: float) -> None:
        epoch = self._when(text, now, "until")
        self.add(f"until {epoch_iso(epoch)}", F.col("ts") <= F.timestamp_micros(F.lit(round(epoch * 1e6))))

    def _host(self, spec: str, now: float) -> None:
        names = [p.lower() for p in _list(spec, "host")]
        self.add(f"host in [{','.join(names)}]", F.lower("host").isin(*names))

    def _user(self, spec: str, now: float) -> None:
        names = _list(spec, "user")
        self.add(f"user in [{','.join(names)}]", F.col("user").isin(*names))

    def _referer_regex(self, pattern: str, now: float) -> None:
        self.add(f"referer =~ {pattern}", F.col("referer").rlike(checked_pattern(pattern, "referer_regex")))

    def _grep(self, pattern: str, now: float) -> None:
        self.add(f"grep {pattern}", F.coalesce("raw", F.lit("")).rlike(checked_pattern(pattern, "grep")))

    def _min_bytes(self, n: int, now: float) -> None:
        self.add(f"bytes >= {int(n)}", F.col("bytes") >= int(n))

    def _max_bytes(self, n: int, now: float) -> None:
        self.add(f"bytes <= {int(n)}", F.col("bytes") <= int(n))

    @property
    def condition(self) -> Column:
        return reduce(and_, [c for _, c in self.parts], F.lit(True))

    def apply(self, records: DataFrame) -> DataFrame:
        return records.filter(self.condition) if self.parts else records

    def count(self, records: DataFrame) -> int:
        return self.apply(records).count()

    def describe(self) -> list[str]:
        return [label for label, _ in self.parts]

    def __str__(self) -> str:
        return "; ".join(self.describe()) or "none"


def any_of(*filters: RecordFilter) -> RecordFilter:
    """A filter that passes what one of the filters passes; without filters, everything."""
    out = RecordFilter()
    return out.add(" OR ".join(f"({f})" for f in filters), reduce(or_, [f.condition for f in filters])) if filters else out
