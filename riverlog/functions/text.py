"""Scalar helpers as columns, and the same for the renderers that run on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ERROR_LEVELS, LEVEL_SYNONYMS, SEVERITIES

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _one_decimal(x: Column) -> Column:
    """A double of 0 to 8192 with one decimal, ties to even by its exact binary value as C has it (format_string rounds half up)."""
    whole = F.floor(x)
    part = ((x - whole) * float(1 << 59)).cast("long") * 10  # exact from 2 ** -7 on, and less than that is 0.0
    tenths, rest = F.shiftright(part, 59), part.bitwiseAND(F.lit((1 << 59) - 1))
    up = (rest > 1 << 58) | ((rest == 1 << 58) & (tenths % 2 == 1))
    total = whole * 10 + tenths + up.cast("long")
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal; whole bytes below that; 0 B for null."""
    size, out = F.abs(n).cast("double"), None
    for i, unit in enumerate(SIZE_UNITS):
        shown = F.format_string("%d " + unit, F.floor(size)) if i == 0 else F.concat(_one_decimal(size / F.lit(float(1024**i))), F.lit(f" {unit}"))
        fits = size < float(1024 ** (i + 1))
        out = F.when(fits, shown) if out is None else out.when(fits, shown) if i < len(SIZE_UNITS) - 1 else out.otherwise(shown)
    return F.when(n.isNull(), "0 B").otherwise(F.concat(F.when(n < 0, "-").otherwise(""), out))


def human_num(n: Column) -> Column:
    """Rounded half up, with commas; 0 for null."""
    return F.coalesce(F.format_number(F.round(n), 0), F.lit("0"))


def pct(part: Column, total: Column, digits: int = 1) -> Column:
    """A share in percent; like ``_one_decimal`` of the double's exact value, ties to even."""
    value = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(part, F.lit(0)) * 100.0 / F.nullif(total, F.lit(0)))
    return _one_decimal(value) if digits == 1 else F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("~"))).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("unknown")


def normalize_level(level: Column) -> Column:
    """One of the eight severities, or null."""
    name = F.lower(trimmed(level))
    known = F.when(name.isin(*SEVERITIES), name)
    for other, meant in LEVEL_SYNONYMS.items():
        known = known.when(name == other, meant)
    return known


def is_error(status: Column, level: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False)) | F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as an integer, null for anything else."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255), number)


def ipv4_value(ip: str) -> int | None:
    parts = ip.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return None
    return sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts))


def in_network(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a.b.c.d/n (32 without /n); null if it is none."""
    net, _, bits = cidr.partition("/")
    size = int(bits) if bits else 32
    value = ipv4_value(net)
    if value is None or not 0 <= size <= 32:
        raise ValueError(f"invalid CIDR network '{cidr}'")
    mask = (0xFFFFFFFF << (32 - size)) & 0xFFFFFFFF
    return ipv4_number(ip).bitwiseAND(F.lit(mask)) == F.lit(value & mask)


def csv_cell(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; empty for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_text(value: Column) -> Column:
    out = value.cast("string")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


# --- the same on the driver, for the few values that a report shows ---


def size_text(n: float | None) -> str:
    if n is None:
        return "0 B"
    size, unit = abs(n), 0
    while size >= 1024 and unit < len(SIZE_UNITS) - 1:
        size, unit = size / 1024, unit + 1
    return f"{'-' if n < 0 else ''}{int(size) if unit == 0 else f'{size:.1f}'} {SIZE_UNITS[unit]}"


def num_text(n: float | None) -> str:
    if n is None:
        return "0"
    return f"{'-' if n < 0 else ''}{math.floor(abs(n) + 0.5):,}"


def cut_text(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "~"
