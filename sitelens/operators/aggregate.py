"""From candidates to findings: layer policy, validation, grouping, provenance, total order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import dims
from sitelens.functions import text as T
from sitelens.functions import validate as V
from sitelens.storage import stored

#: Every key that an extractor or validator may set.
METADATA_KEYS = ["email_kind", "number_type", "scheme", "platform", "role", "obfuscated_as", "source"]


def layer_policy(candidates: DataFrame) -> DataFrame:
    """Candidates whose layer may yield their field (28 pairs, broadcast)."""
    return candidates.join(F.broadcast(dims.allowed(candidates.sparkSession)), ["field", "extraction_layer"], "left_semi")


def validate(candidates: DataFrame, region: str = C.DEFAULT_REGION, more: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds struct `validated`, null where the value is rejected; only names pass through fold(), and only addresses beyond ASCII through international_email().

    more: validators of other fields or in place of the built-in ones, from the raw value to validate.VALIDATED.
    """
    names = F.when(F.col("field").isin("person_name", "organization_name"), F.col("raw_value"))
    beyond = F.when((F.col("field") == "email") & F.col("raw_value").rlike(V.BEYOND_ASCII), F.col("raw_value"))
    rows = candidates.withColumn("_folded", T.fold(names)).withColumn("_international", V.international_email(beyond))
    result = V.validated(F.col("field"), F.col("raw_value"), F.col("metadata"), F.col("_folded"), region, F.col("_international"))
    for field, validator in (more or {}).items():
        result = F.when(F.col("field") == field, validator(F.col("raw_value"))).otherwise(result)
    return rows.withColumn("validated", result).drop("_folded", "_international")


def accepted(candidates: DataFrame, region: str = C.DEFAULT_REGION, more: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Candidates that policy and validator accept, with value, dedup_value and merged metadata."""
    rows = validate(layer_policy(candidates), region, more).where("validated IS NOT NULL")
    kept = F.map_filter("metadata", lambda k, v: ~F.map_contains_key("validated.metadata", k))
    return rows.select(
        "field", F.col("validated.value").alias("value"), F.col("validated.dedup_value").alias("dedup_value"), "source_url", "collected_at",
        "extraction_layer", F.left("raw_value", F.lit(C.MAX_RAW)).alias("raw_value"), F.map_concat(kept, "validated.metadata").alias("metadata"), "seq",
    )


def rejected(candidates: DataFrame, region: str = C.DEFAULT_REGION) -> DataFrame:
    """The other side of accepted(), for audits."""
    policy = candidates.join(F.broadcast(dims.allowed(candidates.sparkSession)), ["field", "extraction_layer"], "left_anti").withColumn("why", F.lit("layer"))
    invalid = validate(layer_policy(candidates), region).where("validated IS NULL").drop("validated").withColumn("why", F.lit("validator"))
    return policy.unionByName(invalid)


def findings(accepted_rows: DataFrame, store: bool = True) -> DataFrame:
    """One row for each (field, dedup_value).

    Counts and provenance are two aggregations, so the accepted rows are stored first: pages are parsed once.

    Counts are exact. Provenance is cut to its first ten by rank before it is collected: Spark applies the limit on
    the map side too, so a value that is on a third of all pages sends ten rows from each task.
    """
    spark = accepted_rows.sparkSession
    if store:
        accepted_rows = stored(accepted_rows, "accepted")
    rows = accepted_rows.join(F.broadcast(dims.layers(spark)), "extraction_layer")
    order = F.struct("layer_ord", "source_url", "collected_at", "seq")
    keys = ["field", "dedup_value"]
    merged = [F.min_by(F.element_at("metadata", k), F.when(F.map_contains_key("metadata", k), order)).alias(f"_m_{k}") for k in METADATA_KEYS]
    counted = rows.groupBy(keys).agg(
        F.min_by("value", F.struct("layer_ord", "source_url", "value")).alias("value"),
        F.max("confidence").alias("extraction_confidence"),
        F.count_distinct("source_url").cast("int").alias("page_support"),
        F.count("*").cast("int").alias("occurrence_count"),
        F.min("source_url").alias("first_seen_url"),
        *merged,
    )
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_m_{k}").alias("value")) for k in METADATA_KEYS]), lambda e: e["value"].isNotNull())
    counted = counted.withColumn("metadata", F.map_from_entries(entries)).drop(*[f"_m_{k}" for k in METADATA_KEYS])
    first = Window.partitionBy(keys).orderBy("source_url", "collected_at", "extraction_layer", "seq")
    top = rows.select(*keys, "source_url", "collected_at", "extraction_layer", "raw_value", "seq").withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= C.MAX_PROVENANCE)
    entry = F.struct("source_url", "collected_at", "extraction_layer", "raw_value")
    ranked = F.array_sort(F.collect_list(F.struct("_rank", entry.alias("entry"))))
    top = top.groupBy(keys).agg(F.transform(ranked, lambda x: x["entry"]).alias("provenance"))
    return counted.join(top.hint("merge"), keys)  # both are dealt by the keys already; provenance is never broadcast


def total_order(found: DataFrame) -> DataFrame:
    """Field, confidence and support falling, value: never arrival order."""
    rows = found.join(F.broadcast(dims.fields(found.sparkSession)), "field")
    return rows.orderBy("field_ord", F.desc("extraction_confidence"), F.desc("page_support"), "value").drop("field_ord")


def flatten(found: DataFrame) -> DataFrame:
    """A row for each finding and provenance entry."""
    return found.select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url", "metadata", F.inline("provenance"))


def provenance_fault(found: DataFrame) -> Column:
    """What makes a finding unattributable, else null: no provenance, more than is kept, or an entry without URL or time."""
    n = F.coalesce(F.size("provenance"), F.lit(0))
    return (
        F.when(n < 1, "no provenance")
        .when(n > C.MAX_PROVENANCE, "too many provenance entries")
        .when(F.exists("provenance", lambda p: F.coalesce(F.trim(p["source_url"]), F.lit("")) == ""), "no source URL")
        .when(F.exists("provenance", lambda p: p["collected_at"].isNull()), "no time")
    )


def audited(found: DataFrame) -> DataFrame:
    """The findings as they are; one that nobody could attribute fails the job that reads it."""
    fault = provenance_fault(found)
    error = F.raise_error(F.concat_ws(": ", F.lit("unattributable finding"), "field", "value", fault))
    return found.withColumn("provenance", F.when(fault.isNull(), F.col("provenance")).otherwise(error.cast(found.schema["provenance"].dataType)))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Live table against a snapshot, keyed by (field, dedup_value): appended, updated, unchanged or kept."""
    keys = ["field", "dedup_value"]
    others = [c for c in new.columns if c not in keys]
    o, n = old.select(*keys, F.struct(*others).alias("_old")), new.select(*keys, F.struct(*others).alias("_new"))
    both = o.join(n, keys, "full")
    change = F.when(F.col("_old").isNull(), "append").when(F.col("_new").isNull(), "keep").when(F.to_json("_old") == F.to_json("_new"), "unchanged").otherwise("update")
    return both.select(*keys, change.alias("change"), F.coalesce("_new", "_old").alias("_row")).select(*keys, "change", "_row.*")
