"""Small fixed tables as DataFrames, each a few rows: safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens import constants as C


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows: known to the optimizer, broadcast without a job."""

    def literal(x: object) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)

    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({', '.join(names)})")


def fields(spark: SparkSession) -> DataFrame:
    return _values(spark, [(f, i) for i, f in enumerate(C.FIELDS)], "field string, field_ord int")


def layers(spark: SparkSession) -> DataFrame:
    return _values(spark, [(x, i, c) for i, (x, c) in enumerate(C.LAYERS.items())], "extraction_layer string, layer_ord int, confidence double")


def allowed(spark: SparkSession) -> DataFrame:
    return _values(spark, [(f, x) for f, xs in C.ALLOWED_LAYERS.items() for x in xs], "field string, extraction_layer string")


def statuses(spark: SparkSession) -> DataFrame:
    rows = [(s, kind, s in C.UNHEALTHY, s in C.ATTEMPTED) for kind, names in (("fetched", C.FETCHED), ("skipped", C.SKIPPED), ("failed", C.FAILED)) for s in names]
    return _values(spark, rows, "status string, class string, unhealthy boolean, attempted boolean")


def outcomes(spark: SparkSession) -> DataFrame:
    return _values(spark, list(C.OUTCOMES.items()), "outcome string, aborted boolean")


def purposes(spark: SparkSession) -> DataFrame:
    return _values(spark, [(p,) for p in C.PURPOSES], "purpose_category string")


def platforms(spark: SparkSession) -> DataFrame:
    return _values(spark, [(h, p, i) for i, (h, p) in enumerate(C.PLATFORMS.items())], "host string, platform string, ord int")


def vat_formats(spark: SparkSession) -> DataFrame:
    return _values(spark, [(k, f"^(?:{v})$") for k, v in C.VAT_FORMATS.items()], "country string, format string")


def roles(spark: SparkSession) -> DataFrame:
    return _values(spark, [(r,) for r in C.ROLE_LOCAL_PARTS], "local_part string")


def dropped_parameters(spark: SparkSession) -> DataFrame:
    return _values(spark, [(p, p in C.SESSION_PARAMETERS) for p in C.DROPPED_PARAMETERS], "name string, session boolean")


def extensions(spark: SparkSession) -> DataFrame:
    return _values(spark, [(e,) for e in C.SKIPPED_EXTENSIONS], "extension string")


def schema_org(spark: SparkSession) -> DataFrame:
    return _values(spark, [(t, p, f) for t, ps in C.SCHEMA_ORG.items() for p, f in ps.items()], "type string, property string, field string")


def hcard_classes(spark: SparkSession) -> DataFrame:
    return _values(spark, list(C.HCARD_CLASSES.items()), "class string, field string")


def robots_reasons(spark: SparkSession) -> DataFrame:
    return _values(spark, [(r,) for r in C.ROBOTS_REASONS], "reason string")
