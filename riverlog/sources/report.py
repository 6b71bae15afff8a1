"""Reports as text, markdown or HTML.

A report is first a list of sections, each of tables, lines and charts; the three renderers only differ in how they
draw those. All values come collected and bounded from ``summary``, ``series_of`` and ``detect``.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..functions.text import cut_text, num_text, size_text
from ..operators.anomaly import Detector, describe_event, detect
from ..operators.series import ascii_chart, bar, bucketize, series_stats
from ..operators.stats import summary

WIDTH = 78
NAMED_TOPS = (("Browsers", "browser"), ("Operating systems", "os"), ("Devices", "device"), ("Agent kinds", "kind"), ("Methods", "method"), ("Levels", "level"), ("Referers", "referer"), ("Hosts", "host"), ("Users", "user"), ("Programs", "program"))


@dataclass(frozen=True)
class Table:
    """Columns are (title, whether numbers, greatest width or 0)."""

    columns: Sequence[tuple[str, bool, int]]
    rows: Sequence[Sequence[object]]


@dataclass(frozen=True)
class Chart:
    text: str


@dataclass
class Section:
    title: str
    parts: list[Table | Chart | str] = field(default_factory=list)


def report_context(records: DataFrame, title: str = "Log report", source: str = "-", filters: str = "none", top: int = 10, unit: str | int | None = "hour", value: str = "count", detector: Detector | None = Detector()) -> dict:
    """What a report shows: the summary, and the series and its anomalies if a unit and a detector are given."""
    out = {"title": title, "source": source, "filter": filters, "generated": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "summary": summary(records, top)}
    if unit is not None:
        buckets = bucketize(records, unit, value).persist()
        out["series"] = {"unit": unit, "value": value, "buckets": [r.asDict() for r in buckets.orderBy("epoch").collect()], "stats": series_stats(buckets).first().asDict()}
        if detector is not None:
            out["anomalies"] = detect(buckets, detector)
        buckets.unpersist()
    return out


def _share(n: float, total: float) -> str:
    return f"{100 * n / total if total else 0:.1f}%"


def _overview(o: dict) -> Section:
    types = ", ".join(f"{k}={n}" for k, n in sorted(o["types"].items())) or "-"
    rows = [
        ("Requests", num_text(o["total"])), ("Types", types), ("Bandwidth", f"{o['bytes_human']} (avg {size_text(o['bytes_avg'])}, max {size_text(o['bytes_max'])})"),
        ("Unique IPs", num_text(o["uniq_ips"])), ("Unique URLs", num_text(o["uniq_urls"])), ("Unique agents", num_text(o["uniq_uas"])), ("Errors", f"{num_text(o['errors'])} ({o['error_rate']}%)"),
    ]
    if o.get("first_iso"):
        rows.append(("Span", f"{o['first_iso']} to {o['last_iso']} ({num_text(o['span_seconds'])} s, {o['rps_avg']} per second)"))
    rows += [(name, f"{o[key]['label']} ({num_text(o[key]['n'])} requests)") for name, key in (("Peak minute", "peak_minute"), ("Peak hour", "peak_hour")) if o.get(key)]
    return Section("Overview", [Table([("Metric", False, 0), ("Value", False, 0)], rows)])


def _summary_sections(s: dict) -> list[Section]:
    total, tops, out = s["overview"]["total"], s["top"], [_overview(s["overview"])]
    if s["status_codes"]:
        classes = [(c, num_text(n), _share(n, total)) for c, n in sorted(s["status_classes"].items())]
        codes = sorted(s["status_codes"].items(), key=lambda x: (-x[1], str(x[0])))[:10]
        drawn = [(c, num_text(n), _share(n, total), bar(n, codes[0][1], 30)) for c, n in codes]
        columns = [("Class", False, 0), ("Count", True, 0), ("Share", True, 0)]
        out.append(Section("Status", [Table(columns, classes), Table([("Code", False, 0), *columns[1:], ("Distribution", False, 0)], drawn)]))
    for title, key, name, most in (("Top IPs", "ip", "IP", 0), ("Top URLs", "url", "Path", 44)):
        if rows := tops[key]:
            cells = [(i, r["key"], num_text(r["n"]), size_text(r["bytes"]), bar(r["n"], rows[0]["n"], 16)) for i, r in enumerate(rows, 1)]
            out.append(Section(title, [Table([("#", True, 0), (name, False, most), ("Requests", True, 0), ("Bytes", True, 0), ("Load", False, 0)], cells)]))
    if s["days"]:
        cells = [(d["day"], num_text(d["n"]), size_text(d["bytes"]), size_text(d["bytes"] // d["n"] if d["n"] else 0)) for d in s["days"]]
        out.append(Section("Bandwidth by day", [Table([("Day", False, 0), ("Requests", True, 0), ("Bytes", True, 0), ("Per request", True, 0)], cells)]))
    for title, key in NAMED_TOPS:
        if rows := tops.get(key):
            out.append(Section(title, [Table([("Name", False, 44), ("Count", True, 0), ("Share", True, 0)], [(r["key"], num_text(r["n"]), _share(r["n"], total)) for r in rows])]))
    if d := s["durations"]:
        cells = [(num_text(d["count"]), *(num_text(d[k]) for k in ("avg", "p50", "p95", "p99", "max")))]
        out.append(Section("Durations (ms)", [Table([(k, True, 0) for k in ("Count", "Avg", "p50", "p95", "p99", "Max")], cells)]))
    if s["latency"]:
        cells = [(r["path"], num_text(r["count"]), *(num_text(r[k]) for k in ("avg", "p50", "p95", "max"))) for r in s["latency"]]
        slow = [(num_text(r["duration_ms"]), r["path"] or "-", r["ip"] or "-") for r in s["slowest"]]
        out.append(Section("Latency by path (ms)", [Table([("Path", False, 34), *((k, True, 0) for k in ("Timed", "Avg", "p50", "p95", "Max"))], cells), "Slowest requests", Table([("ms", True, 0), ("Path", False, 34), ("IP", False, 0)], slow)]))
    return out


def _anomaly_section(a: dict) -> Section:
    c = a["config"]
    out = Section("Anomalies", [f"window {c['window']} buckets, threshold {c['threshold']:.2f}, mode {c['mode']}, risk {a['risk']:.2f}"])
    if not a["points"]:
        out.parts.append("none found at this sensitivity")
        return out
    cells = [(p["label"], num_text(p["value"]), f"{p['baseline_mean']:.2f}", f"{p['zscore']:.2f}", p["direction"], p["severity"]) for p in a["points"]]
    out.parts.append(Table([("Bucket", False, 0), ("Value", True, 0), ("Mean", True, 0), ("z", True, 0), ("Direction", False, 0), ("Severity", False, 0)], cells))
    out.parts += ["Incidents", *(f"- {describe_event(e)}" for e in a["events"])]
    return out


def sections(context: dict, chart_rows: int = 40, chart_width: int = 36) -> list[Section]:
    out = _summary_sections(context["summary"]) if context.get("summary") else []
    if (s := context.get("series")) and s["buckets"]:
        st = s["stats"]
        line = f"{num_text(st['buckets'])} buckets, total {num_text(st['total'])}, mean {st['mean']:.2f}, sd {st['stddev']:.2f}, peak " + (f"{num_text(st['peak'])} at {st['peak_label']}" if st["peak_label"] else "-")
        out.append(Section(f"Series ({s['unit']}, {s['value']})", [Chart(ascii_chart(s["buckets"], chart_rows, chart_width, s["value"])), line]))
    if a := context.get("anomalies"):
        out.append(_anomaly_section(a))
    return out


def _text_table(t: Table) -> list[str]:
    cells = [[str("" if x is None else x) for x in row] for row in t.rows]
    wide = [min([max([len(title), *(len(r[i]) for r in cells)]), *([most] if most else [])]) for i, (title, _, most) in enumerate(t.columns)]
    line = lambda row: "  " + "  ".join(cut_text(x, w).rjust(w) if c[1] else cut_text(x, w).ljust(w) for x, w, c in zip(row, wide, t.columns, strict=True)).rstrip()
    return [line([c[0] for c in t.columns]), line(["-" * w for w in wide]), *map(line, cells)]


def _meta(context: dict) -> list[tuple[str, str]]:
    return [(name, str(context.get(name.lower()) or "-")) for name in ("Source", "Generated", "Filter")]


def render_text(context: dict) -> str:
    title = context.get("title") or "Log report"
    out = ["=" * WIDTH, title.center(WIDTH).rstrip(), "=" * WIDTH, *(f"{k:<10}: {v}" for k, v in _meta(context))]
    for s in sections(context):
        out += ["", s.title.upper(), "-" * len(s.title)]
        for i, part in enumerate(s.parts):
            out += [""] if i and not isinstance(part, str) else []
            out += _text_table(part) if isinstance(part, Table) else [part.text if isinstance(part, Chart) else part]
    return "\n".join([*out, "", "=" * WIDTH]) + "\n"


def render_markdown(context: dict) -> str:
    cell = lambda x: html.escape(str("" if x is None else x), quote=False).replace("|", "\\|").replace("\n", " ")
    out = [f"# {context.get('title') or 'Log report'}", "", *(f"- **{k}:** {v}" for k, v in _meta(context)), ""]
    for s in sections(context):
        out += [f"## {s.title}", ""]
        for part in s.parts:
            if isinstance(part, Table):
                row = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
                out += [row([c[0] for c in part.columns]), "|" + "|".join("---:" if c[1] else "---" for c in part.columns) + "|", *map(row, part.rows), ""]
            else:
                out += ["```", part.text, "```", ""] if isinstance(part, Chart) else [part, ""]
    return "\n".join(out)


STYLE = "body{font:15px sans-serif;max-width:60rem;margin:2rem auto}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:left}.n{text-align:right}pre{overflow-x:auto}"


def render_html(context: dict) -> str:
    esc = lambda x: html.escape(str("" if x is None else x))
    title = esc(context.get("title") or "Log report")
    out = [f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body>', f"<h1>{title}</h1>", *(f"<p>{k}: {esc(v)}</p>" for k, v in _meta(context))]
    for s in sections(context, chart_width=40):
        out.append(f"<h2>{esc(s.title)}</h2>")
        for part in s.parts:
            if isinstance(part, Table):
                row = lambda tag, cells: "<tr>" + "".join(f"<{tag}{' class=n' if c[1] else ''}>{esc(x)}</{tag}>" for x, c in zip(cells, part.columns, strict=True)) + "</tr>"  # noqa: B023, E731
                out += ["<table>", row("th", [c[0] for c in part.columns]), *(row("td", r) for r in part.rows), "</table>"]
            else:
                out.append(f"<pre>{esc(part.text)}</pre>" if isinstance(part, Chart) else f"<p>{esc(part)}</p>")
    return "\n".join([*out, "</body></html>"]) + "\n"


RENDERERS: dict[str, Callable[[dict], str]] = {"text": render_text, "txt": render_text, "markdown": render_markdown, "md": render_markdown, "html": render_html, "htm": render_html}


def render(form: str, context: dict) -> str:
    if form.lower() not in RENDERERS:
        raise ValueError(f"unknown report format '{form}'; known are text, markdown and html")
    return RENDERERS[form.lower()](context)
