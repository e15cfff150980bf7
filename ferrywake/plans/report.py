"""The Markdown report: bounded result frames rendered on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame

from ..functions.text import REDACTIONS

_PYTHON = [(re.compile(p.replace("*+", "*").replace("++", "+")), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in REDACTIONS]


def redact(text: str | None) -> str:
    """As functions.text.redacted, for values that are already on the driver."""
    out = text or ""
    for pattern, to in _PYTHON:
        out = pattern.sub(to, out)
    return out


def cell(value: object) -> str:
    """A value for a table: redacted, on one line, with bars escaped; decimals to three places without trailing zeros."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return decimal(value)
    if isinstance(value, (list, tuple)):
        return cell("; ".join(map(str, value)))
    return redact(str(value)).replace("\r", " ").replace("\n", " ").replace("|", "\\|")


def decimal(value: float) -> str:
    text = str(Decimal(repr(value)).quantize(Decimal("0.001"), ROUND_HALF_UP))
    return text.rstrip("0").rstrip(".") if "." in text else text


def moment(ms: int | None) -> str:
    """ISO time in UTC; milliseconds only where there are any."""
    if ms is None:
        return ""
    t = datetime.fromtimestamp(ms // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return f"{t}.{ms % 1000:03d}Z" if ms % 1000 else f"{t}Z"


def file_name(name: str) -> str:
    """A name safe for a download, of at most 80 characters."""
    return (re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("._") or "report")[:80]


class Aliases:
    """Numbers remote hosts by their first use in the report."""

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}

    def __call__(self, host: str | None) -> str:
        host = host or "unknown"
        return host if host == "unknown" else self.seen.setdefault(host, f"client-{len(self.seen) + 1}")


def table(heads: Iterable[str], rows: Iterable[Iterable[object]]) -> list[str]:
    heads = list(heads)
    out = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
    return [*out, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""]


def _frame(title: str, df: DataFrame | None, columns: list[str] | None = None, times: tuple[str, ...] = (), alias: Aliases | None = None, level: int = 3) -> list[str]:
    out = [f"{'#' * level} {title}", ""]
    if df is None:
        return [*out, "Not recorded for this analysis.", ""]
    columns = columns or df.columns
    rows = df.select(*columns).collect()  # every frame of the report has a limit
    if not rows:
        return [*out, "None.", ""]
    shown = [[moment(v) if c in times else alias(v) if alias and c == "remote" else v for c, v in zip(columns, r)] for r in rows]
    return [*out, *table(columns, shown)]


STAT = ["n", "total_ms", "avg_ms", "min_ms", "max_ms", "response_bytes", "cpu_nanos"]


def render(title: str, files: list[str], summary: dict[str, DataFrame], diagnostics: dict[str, DataFrame] | None) -> str:
    """The report of an analysis. Sections whose frames are missing say so instead of showing zeros."""
    alias, s, d = Aliases(), summary, diagnostics or {}
    out = [f"# {cell(title)}", "", "## Overview", ""]
    span = s["time_range"].first()
    counts, totals = s["line_counts"].first(), s["totals"].first()
    out += table(["measure", "value"], [["files", len(files)], ["lines", counts["total"]], ["first entry", moment(span["first_ms"])], ["last entry", moment(span["last_ms"])], ["slow queries", totals["slow_queries"]], ["heartbeat failures", totals["heartbeat_failures"]]])
    out += ["### Files", "", *(f"- {cell(f)}" for f in files), ""]
    out += ["## Slow queries", ""]
    out += table(["measure", "value"], [["count", totals["slow_queries"]], ["total ms", totals["total_ms"]], ["CPU recorded", totals["cpu_available"]], *[[c, counts[c]] for c in ("success", "partial", "skipped", "failed")]])
    out += _frame("Parse errors", s["parse_errors"])
    out += _frame("Durations", s["duration_histogram"], ["label", "n", "percent", "total_ms", "avg_ms", "max_ms"])
    out += _frame("Clients", s["by_remote"], ["remote", *STAT], alias=alias)
    for name, key in (("Operations", "operation"), ("Namespaces", "namespace"), ("Plans", "plan_summary")):
        out += _frame(name, s[f"by_{key.removesuffix('_summary')}"], [key, *STAT])
    out += _frame("Response bytes by namespace", s["namespace_bytes"])
    out += _frame("CPU by operation and namespace", s["cpu_by_operation_namespace"], ["operation_namespace", "n", "cpu_nanos"])
    out += _frame("CPU share of duration", s["cpu_ratio_histogram"])
    out += _frame("Connections by hour", s["connections_by_hour"], times=("hour_ms",))
    out += _frame("Query patterns", s["pattern_stats"], ["namespace", "operation", "query_pattern", "n", "avg_ms", "max_ms", "plans"])
    out += _frame("Slowest of each pattern", s["pattern_stats"], ["query_pattern", "slowest_ts_ms", "slowest_query_id"], times=("slowest_ts_ms",))
    out += _frame("Slowest queries", s["slowest"], ["query_id", "ts_ms", "duration_ms", "namespace", "operation", "plan_summary", "remote", "query_pattern"], times=("ts_ms",), alias=alias)
    out += ["## Diagnostics", ""]
    if not diagnostics:
        out += ["This analysis has no diagnostics.", ""]
    else:
        out += _frame("Totals", d["overview"])
        out += _frame("Data quality", d["quality"]) + _frame("Out of order", d["out_of_order"]) + _frame("Field coverage", d["coverage"])
        out += _frame("Abnormal events", d["abnormal"], ["key", "severity", "message", "n", "first_ms", "last_ms"], times=("first_ms", "last_ms"))
        out += _frame("Samples of abnormal events", d["abnormal"].selectExpr("key", "transform(samples, s -> s.message) AS samples"))
        out += _frame("Timeline", d["timeline"], times=("bucket_ms",))
        out += _frame("Connections", d["connections"]) + _frame("Names", d["frequent_names"])
        out += _frame("Replication and network", d["replication"], times=("first_ms", "last_ms"))
        out += _frame("Efficiency signals", d["signal_table"]) + _frame("Distinct query shapes", d["shapes"])
        out += _frame("Queries with signals", d["insights"], ["ts_ms", "namespace", "operation", "duration_ms", "docs_examined", "keys_examined", "returned", "docs_ratio", "keys_ratio", "reasons"], times=("ts_ms",))
    out += ["## Limits", "", "- Statistics cover all entries; ranked lists are cut at their stated lengths.", "- A missing value is left out, not counted as zero.", ""]
    return "\n".join(out)
