"""Extraction, validation and health as SQL functions of a session.

After `sql.register(spark)`:

    SELECT url, x.* FROM (SELECT url, html, map_entries(headers) AS headers FROM pages), LATERAL extracted(html, headers) AS x
    SELECT validated(field, raw_value, metadata, fold(raw_value)) FROM candidates
    SELECT valid_email(raw), valid_phone(raw), deobfuscated(text), platform(url), email_kind(local) FROM ...
    SELECT * FROM run_health(TABLE(log) PARTITION BY run_id ORDER BY seq)

`parse_page` and `fold` are the vectorised UDFs that the library uses; all other scalar functions and `extracted` are SQL functions whose bodies are the library's own
column expressions, so they stay in the JVM and one definition of each rule exists. `run_health` is a table function that takes a run's rows one after the other and
holds five numbers. Further extractors are any query that gives `field, raw_value, extraction_layer, metadata, seq`; further validators any function to `VALIDATED`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions import validate as V
from sitelens.functions.html import PARSED
from sitelens.functions.html import parsed as parse_page
from sitelens.operators import extract, inline
from sitelens.operators.health import Tally
from sitelens.storage import ship

_MAP = "MAP<STRING, STRING>"
#: Operators as a column's text writes them, before their arguments; quoted, they are names of functions. Texts in quotes are passed over.
_OPERATORS = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(and|or|not|in|<=>|>=|<=|<>|!=|=|!|>|<|\+|-|\*|/|%)(?=\()")


def text_of(column: Column) -> str:
    """A column expression as SQL."""
    return _OPERATORS.sub(lambda m: m[1] or f"`{m[2]}`", column._jc.node().sql())


class RunHealth:
    """Rows of a run in, its first abort out."""

    def __init__(self) -> None:
        self.tally, self.done = Tally(), False

    def eval(self, row: Row) -> Iterator[tuple]:
        if not self.done and (outcome := self.tally.step(row["status"], row["retry_after"])):
            self.done = True
            yield str(row["run_id"]), outcome, int(row["seq"]), self.tally.attempted


def validators(region: str = C.DEFAULT_REGION) -> dict[str, tuple[str, Column]]:
    """Parameters and body of the validator of each field."""
    raw, metadata, folded = F.col("raw"), F.col("metadata"), F.col("folded")
    return {
        "email": ("raw STRING", V.email(raw)),
        "phone": ("raw STRING", V.phone(raw, region)),
        "postal_address": ("raw STRING", V.postal_address(raw)),
        "person_name": ("raw STRING, folded STRING", V.person_name(raw, folded)),
        "organization_name": ("raw STRING, folded STRING", V.organization_name(raw, folded)),
        "social_profile": ("raw STRING", V.social_profile(raw)),
        "pgp_key_url": ("raw STRING", V.pgp_key_url(raw)),
        "company_identifier": (f"raw STRING, metadata {_MAP}", V.company_identifier(raw, metadata)),
        "technology": ("raw STRING", V.technology(raw)),
    }


def register(spark: SparkSession, region: str = C.DEFAULT_REGION) -> None:
    """Make the functions known to the session; done again, it replaces them."""
    ship(spark)

    def scalar(name: str, parameters: str, kind: str, body: Column) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text_of(body)}")

    spark.udf.register("parse_page", parse_page)
    spark.udf.register("fold", T.fold)
    spark.udf.register("international_email", V.international_email)
    for field, (parameters, body) in validators(region).items():
        scalar(f"valid_{field}", parameters, V.VALIDATED, body)
    scalar("validated", f"field STRING, raw STRING, metadata {_MAP}, folded STRING", V.VALIDATED, V.validated(F.col("field"), F.col("raw"), F.col("metadata"), F.col("folded"), region))
    allowed = F.create_map(*[x for f, layers in C.ALLOWED_LAYERS.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in sorted(layers)]))])
    scalar("layer_allowed", "field STRING, layer STRING", "BOOLEAN", F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("field")), F.col("layer")), F.lit(False)))
    confidence = F.create_map(*[F.lit(x) for pair in C.LAYERS.items() for x in pair])
    scalar("layer_confidence", "layer STRING", "DOUBLE", F.try_element_at(confidence, F.col("layer")).cast("double"))
    scalar("layer_rank", "layer STRING", "INT", F.array_position(F.array(*[F.lit(x) for x in C.LAYERS]), F.col("layer")).cast("int"))
    scalar("deobfuscated", "candidate STRING", "STRING", extract.deobfuscate(F.col("candidate")))
    scalar("platform", "url STRING", "STRING", U.platform(F.col("url")))
    scalar("email_kind", "local STRING", "STRING", V.email_kind(F.col("local")))
    scalar("candidates_of", f"parsed {_sql_type(PARSED)}, headers {_MAP}", inline.CANDIDATES, inline.candidates_of(F.col("parsed"), F.col("headers")))
    columns = inline.CANDIDATES.removeprefix("array<struct<").removesuffix(">>")
    # a generator over nothing but the arguments: any select below it makes a lateral call join the pages to themselves by their text
    found = text_of(inline.candidates_of(F.expr("parse_page(html)"), F.expr("map_from_entries(headers)")))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION extracted(html STRING, headers ARRAY<STRUCT<key STRING, value STRING>>) RETURNS TABLE({columns}) "
        f"RETURN SELECT field, raw_value, extraction_layer, metadata, seq FROM inline({found})"
    )
    spark.udtf.register("run_health", F.udtf(RunHealth, returnType="run_id string, outcome string, seq long, attempted long"))


def _sql_type(kind: StructType) -> str:
    return kind.simpleString()
