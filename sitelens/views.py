"""Display projections: rows, tooltips, banners and summaries as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T

FIELD_LABELS = {f: f.replace("_", " ").capitalize() for f in C.FIELDS}
LAYER_LABELS = {x: x.replace("_", " ").capitalize() for x in C.LAYERS}
SEVERITY = {s: "info" if s in C.FETCHED else "warning" if s in C.SKIPPED else "error" for s in C.FETCHED + C.SKIPPED + C.FAILED}


def _of(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def best_layer(provenance: Column) -> Column:
    """The layer of most authority among provenance entries."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(C.LAYERS) for x in (name, i)])
    best = F.array_min(F.transform(provenance, lambda p: F.struct(F.element_at(ranks, p["extraction_layer"]).alias("r"), p["extraction_layer"].alias("layer"))))
    return best["layer"]


def finding_rows(found: DataFrame) -> DataFrame:
    """Cells and tooltip of each finding; keyed by field and value."""
    layer = best_layer(F.col("provenance"))
    extra = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("\n"), e["key"], F.lit(": "), e["value"]))
    label = _of(F.col("field"), FIELD_LABELS)
    tooltip = F.concat(
        label, F.lit(": "), "value", F.lit("\nExtraction: "), _of(layer, LAYER_LABELS), F.lit(" ("), layer, F.format_string(", confidence %.2f)", "extraction_confidence"),
        F.format_string("\nSeen on %d page(s), %d observation(s)\nFirst seen: %s", "page_support", "occurrence_count", "first_seen_url"), F.array_join(extra, ""),
    )
    return found.select("field", label.alias("field_label"), "value", layer.alias("extraction"), F.col("page_support").alias("pages"), F.col("first_seen_url").alias("first_seen"), tooltip.alias("tooltip"))


def page_rows(log: DataFrame) -> DataFrame:
    """Cells, severity and tooltip of each page log row (with `number`)."""
    lines = F.concat_ws(
        "\n", "url", F.concat(F.lit("Status: "), "status"), F.concat(F.lit("Depth: "), F.col("depth").cast("string")), F.concat(F.lit("HTTP status: "), F.col("http_status").cast("string")),
        F.concat(F.lit("Content-Type: "), F.nullif("content_type", F.lit(""))), F.concat(F.lit("Findings on this page: "), F.col("findings_count").cast("string")), F.nullif("detail", F.lit("")),
    )
    return log.select("number", "depth", "status", "url", F.coalesce("detail", F.lit("")).alias("detail"), _of(F.col("status"), SEVERITY).alias("severity"), lines.alias("tooltip"))


def run_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "run_id", "target_host", T.rfc3339(F.col("created_at")).alias("created"), "pages_fetched", "findings_count", T.format_size(F.col("size_bytes")).alias("size"),
        T.retention_text(F.col("days_remaining"), F.col("expired")).alias("retention"),
    )


def progress_text(fetched: Column, budget: Column, elapsed: Column) -> Column:
    return F.format_string("%d/%d pages, %d%%, %s", fetched, budget, T.percent(fetched, budget), T.format_elapsed(elapsed))


def status_line(state: Column, fetched: Column, budget: Column, findings: Column) -> Column:
    """One line for the state of a run."""
    return (
        F.when(state == "idle", "Idle")
        .when(state == "starting", "Starting: reading robots.txt of the target")
        .when(state == "stopping", "Stopping: waiting for requests in flight")
        .when(state == "running", F.format_string("Crawling: %d/%d pages", fetched, budget))
        .otherwise(F.concat(F.format_string("Completed: %d finding", findings), F.when(findings == 1, "").otherwise("s")))
    )


def compliance_line(agent: str, interval: float, scope: str, subdomains: bool) -> str:
    return f"User-Agent: {agent} · robots.txt: honored on every request and hop · interval: {max(interval, C.INTERVAL_FLOOR):.1f} s (floor {C.INTERVAL_FLOOR:.1f} s) · scope: {scope}{' +subdomains' if subdomains else ''}"


def summary(log: DataFrame, run_id: str, findings: int, requests: int) -> DataFrame:
    """A finished run in one sentence; what is neither fetched nor failed was skipped."""
    s = F.col("status")
    counts = log.agg(F.count("*").alias("n"), F.count_if(s.isin(*C.FETCHED)).alias("f"), F.count_if(s.isin(*C.FAILED)).alias("x"))
    text = F.format_string(f"Run {run_id} · {findings} findings · %d pages fetched, %d skipped, %d failed · {requests} requests", "f", F.col("n") - F.col("f") - F.col("x"), "x")
    return counts.select(text.alias("summary"))


def sorted_by(rows: DataFrame, column: str, descending: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """By one column: text without case, numbers as numbers; rows that are equal there by their text and the columns of `then`."""
    kind = rows.schema[column].dataType.simpleString()
    key = F.lower(column) if kind == "string" else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc(), column, *then)


def statuses_seen(log: DataFrame) -> DataFrame:
    """(status): those that a page log has so far, sorted."""
    return log.select("status").where("status IS NOT NULL").distinct().orderBy("status")


def of_status(rows: DataFrame, status: str | None) -> DataFrame:
    """Page log rows of one status; of every status where none is chosen."""
    return rows if status is None else rows.where(F.col("status") == status)
