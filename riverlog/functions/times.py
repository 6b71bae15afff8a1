"""Log times as epoch seconds: columns for the parsers, plain Python for what a user types."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTHS

# Parts of the time formats, by the letter that stands for them in a layout. A captured part is a group in the order of the layout.
PARTS = {
    "Y": r"(\d{4})", "m": r"(\d{2})", "d": r"(\d{2})", "D": r"(\d{1,2})", "b": r"([A-Za-z]{3})", "a": r"[A-Za-z]{3}",
    "H": r"(\d{2})", "M": r"(\d{2})", "S": r"(\d{2})", "f": r"(?:\.\d+)?", "o": r"([+-]\d{4})?", "O": r"(Z|z|[+-]\d{2}:?\d{2})?", "t": "[Tt ]", "_": r"\s+", "~": r"\s*",
}
LAYOUTS = {"clf": "D/b/Y:H:M:S~o", "iso": "Y-m-dtH:M:SfO", "syslog": "b_D_H:M:S", "apache": "a_b_D_H:M:S_Y"}
FIELDS = {letter: name for name, letters in (("year", "Y"), ("month", "mb"), ("day", "dD"), ("hour", "H"), ("minute", "M"), ("second", "S"), ("offset", "oO")) for letter in letters}


def layout_pattern(layout: str) -> tuple[str, list[str]]:
    """The pattern of a layout and the names of its groups."""
    return "".join(PARTS.get(c, re.escape(c)) for c in layout), [FIELDS[c] for c in layout if c in FIELDS]


def month_number(name: Column) -> Column:
    """1 to 12 for a name of which the first three letters count, else null."""
    names = F.lit("".join(MONTHS))
    at = F.instr(names, F.lower(F.substring(name, 1, 3)))
    return F.when((at % 3 == 1) & (F.length(name) >= 3), ((at + 2) / 3).cast("int"))


def civil_epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Epoch seconds by Spark's calendar. Years are counted from March, and months, days and clock are added to its first day, so
    days and clock may run over; of months over 14 the remainder by twelve counts."""
    march = F.make_date(year - F.when(month <= 2, 1).otherwise(0), F.lit(3), F.lit(1))
    first = F.add_months(march, F.pmod(month + 9, F.lit(12)).cast("int"))
    return (F.unix_date(first) + day - 1).cast("long") * 86400 + hour * 3600 + minute * 60 + second


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of Z, nothing, +HH, +HHMM or +HH:MM; 0 for anything else."""
    digits = F.regexp_replace(text, ":", "")
    size = F.substring(digits, 2, 2).try_cast("int") * 3600 + F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).try_cast("int"), F.lit(0)) * 60
    signed = F.when(text.startswith("-"), -size).otherwise(size)
    return F.when(text.rlike(r"^[+-]\d{2}(:?\d{2})?$"), signed).otherwise(0)


def layout_epoch(text: Column, layout: str, year: int | None = None) -> Column:
    """Epoch seconds of a text in a layout, of a given year if the layout has none; null without a match."""
    pattern, names = layout_pattern(layout)
    pattern = f"(?d)^{pattern}$"
    groups = F.split(F.regexp_replace(text, pattern, ",".join(f"${i + 1}" for i in range(len(names)))), ",")

    def built(groups: Column) -> Column:
        part = {n: groups[i] for i, n in enumerate(names)}
        number = lambda n: part[n].try_cast("int")
        month = month_number(part["month"]) if "b" in layout else number("month")
        at = civil_epoch(F.lit(year) if year is not None else number("year"), month, number("day"), number("hour"), number("minute"), number("second"))
        return at - offset_seconds(part["offset"]) if "offset" in part else at

    return F.when(text.rlike(pattern), F.transform(F.array(groups), built)[0])


def combined_epoch(text: Column) -> Column:
    return layout_epoch(text, LAYOUTS["clf"])


def iso_epoch(text: Column) -> Column:
    return layout_epoch(text, LAYOUTS["iso"])


def apache_epoch(text: Column) -> Column:
    """Time of an error log, as in Mon Nov 18 03:07:12 2025."""
    return layout_epoch(text, LAYOUTS["apache"])


def syslog_epoch(text: Column, now: float, default_year: int | None = None) -> Column:
    """A time without a year: the given year, or the current one unless that lies over a day ahead, then the one before."""
    if default_year is not None:
        return layout_epoch(text, LAYOUTS["syslog"], default_year)
    year = datetime.fromtimestamp(now, UTC).year
    this, last = (layout_epoch(text, LAYOUTS["syslog"], y) for y in (year, year - 1))
    return F.when(this > F.lit(now + 86400), last).otherwise(this)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bucket_label(epoch: Column, unit: str) -> Column:
    """Label of a bucket; units other than second, minute and hour show the day only."""
    form = {"second": "yyyy-MM-dd HH:mm:ss", "minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00"}.get(unit, "yyyy-MM-dd")
    return F.date_format(F.timestamp_seconds(epoch), form)


# What a user may type: parts by name, and what an absent one is taken from (the day of `now`, or zero).
CLOCK = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?"
TYPED = (
    ("date", r"(?P<year>\d{4})-(?P<month>\d{2})-(?P<day>\d{2})"),
    ("slashes", rf"(?P<year>\d{{4}})/(?P<month>\d{{1,2}})/(?P<day>\d{{1,2}})(?:\s+{CLOCK})?"),
    ("today", CLOCK),
    *((name, re.sub(r"\((?!\?)", lambda _, n=iter(layout_pattern(LAYOUTS[name])[1]): f"(?P<{next(n)}>", layout_pattern(LAYOUTS[name])[0])) for name in ("iso", "clf")),
)
STEP = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_datetime(text: str | None, now: float | None = None) -> float | None:
    """Epoch seconds of what a user gives: now, -2h, dates, ISO and CLF times, Y/M/D h:m, h:m today; None if it is none of these."""
    now, text = time.time() if now is None else now, (text or "").strip()
    if text.lower() == "now" or (ago := re.fullmatch(r"-(\d+)([smhdw])", text, re.IGNORECASE | re.ASCII)):
        return now if text.lower() == "now" else now - int(ago[1]) * timedelta(**{STEP[ago[2].lower()]: 1}).total_seconds()
    found = next((m.groupdict() for _, pattern in TYPED if (m := re.fullmatch(pattern, text, re.ASCII))), None)
    if found is None:
        return None
    month = found.get("month") or ""
    if month.isalpha():
        if month.lower() not in MONTHS:
            return None
        found["month"] = str(MONTHS.index(month.lower()) + 1)
    if "year" not in found:
        found |= dict(zip(("year", "month", "day"), datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%d").split("-")))
    part = {k: int(found.get(k) or 0) for k in ("year", "month", "day", "hour", "minute", "second")}
    year, month = part["year"] - (part["month"] <= 2), (part["month"] + 9) % 12 + 3  # as in civil_epoch
    if not 1 <= year < 9998:
        return None
    at = datetime(year + (month > 12), (month - 1) % 12 + 1, 1, tzinfo=UTC) + timedelta(days=part["day"] - 1, hours=part["hour"], minutes=part["minute"], seconds=part["second"])
    return int(at.timestamp()) - _typed_offset(found.get("offset"))


def _typed_offset(text: str | None) -> int:
    if text is None or text in "Zz":
        return 0
    clock = text[1:].replace(":", "").ljust(4, "0")
    return (-1 if text[0] == "-" else 1) * (int(clock[:2]) * 3600 + int(clock[2:]) * 60)


def epoch_iso(epoch: float | None) -> str | None:
    return None if epoch is None else datetime.fromtimestamp(int(epoch), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
