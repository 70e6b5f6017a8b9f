"""One-row evaluation of column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def each(spark, values, expression, kind="string"):
    """expression(col) for each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]
