"""Candidates from pages: one parse, then six extractors as filters and joins over what it found.

Order of extractors, which breaks ties between candidates of a page: JSON-LD, microdata, semantic HTML, technology,
text, rewritten text. `seq` carries it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import dims
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions.html import with_parsed
from sitelens.storage import stored

_EMPTY = "CAST(map() AS map<string,string>)"
CANDIDATE = ["field", "raw_value", "source_url", "collected_at", "extraction_layer", "metadata", "seq"]


def parse_pages(pages: DataFrame, markup: str = "text") -> DataFrame:
    """Pages with their parse: url, fetched_at, headers and struct `parsed`."""
    return with_parsed(pages, F.col(markup))


def is_html(content_type: Column) -> Column:
    """Accepted media type; a missing one is tolerated."""
    media = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (media == "") | media.isin(*C.HTML_TYPES)


def page_status(parsed: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Adds status parse_error where the document is no HTML or has no element."""
    bad = ~is_html(F.col(content_type)) | (F.col("parsed.n_elements") == 0)
    return parsed.withColumn("status", F.when(bad, "parse_error"))


def _stamped(rows: DataFrame, layer: str | Column, offset: int) -> DataFrame:
    layer = F.lit(layer) if isinstance(layer, str) else layer
    return rows.select(
        "field",
        "raw_value",
        F.col("url").alias("source_url"),
        F.col("fetched_at").alias("collected_at"),
        layer.alias("extraction_layer"),
        F.coalesce(F.col("metadata"), F.expr(_EMPTY)).alias("metadata"),
        (F.col("seq") + offset).cast("int").alias("seq"),
    )


def facts(parsed: DataFrame) -> DataFrame:
    return parsed.select("url", "fetched_at", F.explode("parsed.facts").alias("f")).select("url", "fetched_at", "f.*")


def structured_data(found: DataFrame) -> DataFrame:
    """JSON-LD and microdata: properties that schema.org types give us, addresses, profiles."""
    spark = found.sparkSession
    role = F.when((F.col("field") == "person_name") & (F.col("role") != ""), F.create_map(F.lit("role"), F.col("role")))
    named = found.where(F.col("kind").isin("jsonld", "micro"))
    named = named.withColumn("type", F.split_part("name", F.lit("."), F.lit(1))).withColumn("property", F.expr("substring(name, instr(name, '.') + 1)"))
    named = named.join(F.broadcast(dims.schema_org(spark)), ["type", "property"]).withColumn("metadata", role).withColumn("raw_value", T.strip_scheme(F.col("value")))
    addresses = found.where(F.col("kind").isin("jsonld_address", "micro_address")).select("*", F.lit("postal_address").alias("field"), F.col("value").alias("raw_value"), F.expr(_EMPTY).alias("metadata"))
    same = found.where(F.col("kind").isin("jsonld_same", "micro_same")).withColumn("platform", U.platform(F.col("value"))).where("platform IS NOT NULL")
    same = same.select("url", "fetched_at", "seq", F.lit("social_profile").alias("field"), F.col("value").alias("raw_value"), F.create_map(F.lit("platform"), F.col("platform")).alias("metadata"))
    columns = ["url", "fetched_at", "seq", "field", "raw_value", "metadata"]
    return _stamped(named.select(columns).unionByName(addresses.select(columns)).unionByName(same.select(columns)), "structured_data", 0)


def semantic_html(found: DataFrame) -> DataFrame:
    """Links by scheme, address elements, h-cards, authorship, profiles, keys, site name."""
    spark = found.sparkSession
    href = F.col("value")
    scheme = F.lower(F.regexp_extract(href, "^(?i)(mailto|tel):", 1))
    target = F.trim(F.split_part(F.regexp_replace(href, "^(?i)(mailto|tel):", ""), F.lit("?"), F.lit(1)))
    rel = F.split("name", " ")
    anchors = found.where("kind = 'href_a'")
    links = found.where("kind IN ('href_a', 'href_link')")
    of = lambda rows, field, raw, metadata=None: rows.select(
        "url", "fetched_at", "seq", F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"), raw.alias("raw_value"), (F.expr(_EMPTY) if metadata is None else metadata).alias("metadata")
    )
    parts = [
        of(anchors.where(scheme.isin("mailto", "tel") & (target != "")), F.when(scheme == "mailto", "email").otherwise("phone"), target),
        of(found.where("kind = 'address'"), "postal_address", F.col("value")),
        of(found.where("kind = 'hcard'").join(F.broadcast(dims.hcard_classes(spark)), F.col("name") == F.col("class")), F.col("field"), F.col("value")),
        of(found.where("kind = 'meta_name' AND name = 'author' AND value <> ''"), "person_name", F.col("value")),
        of(links.where(F.array_contains(rel, "author") & (scheme == "mailto")), "email", target),
        of(links.where(F.array_contains(rel, "pgpkey")), "pgp_key_url", href),
        of(anchors.where(F.lower(href).rlike(r"\.(asc|gpg|pgp)$")), "pgp_key_url", href),
        of(found.where("kind = 'meta_property' AND name = 'og:site_name' AND value <> ''"), "organization_name", F.col("value")),
    ]
    profiles = links.where((F.col("kind") == "href_a") | F.array_contains(rel, "me")).withColumn("platform", U.platform(href)).where("platform IS NOT NULL")
    first = profiles.groupBy("url", "fetched_at", "value").agg(F.min("seq").alias("seq"), F.first("platform").alias("platform"))
    parts.append(of(first, "social_profile", F.col("value"), F.create_map(F.lit("platform"), F.col("platform"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _stamped(rows, "semantic_html", 1 << 20)


def technology(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """What the page or the server says it was made with."""
    generator = found.where("kind = 'meta_name' AND name = 'generator' AND value <> ''").select(
        "url", "fetched_at", "seq", F.col("value").alias("raw_value"), F.lit("meta:generator").alias("source")
    )
    wanted = F.array(*[F.lit(h) for h in C.TECHNOLOGY_HEADERS])
    pairs = F.filter(F.map_entries("headers"), lambda e: F.array_contains(wanted, F.lower(e["key"])) & (F.trim(e["value"]) != ""))
    ranked = F.array_sort(F.transform(pairs, lambda e: F.struct(F.array_position(wanted, F.lower(e["key"])).alias("rank"), e["key"].alias("key"), e["value"].alias("value"))))
    headers = parsed.select("url", "fetched_at", F.posexplode(ranked).alias("seq", "pair")).select(
        "url", "fetched_at", "seq", F.trim("pair.value").alias("raw_value"), F.concat(F.lit("header:"), F.lower("pair.key")).alias("source")
    )
    rows = generator.unionByName(headers).withColumn("field", F.lit("technology")).withColumn("metadata", F.create_map(F.lit("source"), F.col("source")))
    return _stamped(rows, "semantic_html", 2 << 20)


_MATCH = "array<struct<seq int, field string, raw_value string, metadata map<string,string>>>"
#: Once inside a run of address characters that no address begins, later starts in the run cannot match either, so
#: matching starts at the run's first character or where the last match ended, and never gives a character back.
_START = rf"(?:\G|(?<!{C.LOCAL_PART[:-1]}))"


def _from_run_start(pattern: str) -> str:
    """The same matches as `pattern`, which begins with a local part, found in linear time."""
    return _START + C.LOCAL_PART + "+" + pattern.removeprefix(C.LOCAL_PART)


def _found(text: Column, field: str, pattern: str, group: int, offset: int, metadata: Column | None = None, only_if: Column | None = None) -> Column:
    """All matches of a pattern as structs; where only_if is false there are none, and none are looked for."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if only_if is not None:
        values = F.when(only_if, values).otherwise(F.array().cast("array<string>"))
    of = F.expr(_EMPTY) if metadata is None else metadata
    return F.transform(values, lambda x, i: F.struct((i + offset).alias("seq"), F.lit(field).alias("field"), x.alias("raw_value"), of.alias("metadata"))).cast(_MATCH)


def text_heuristics(rows: DataFrame, text: str = "visible_text") -> DataFrame:
    """What prose may yield because it validates itself: emails, phones, company identifiers. One pass over the text."""
    return _exploded(rows, text_matches(F.col(text)), text, "text_heuristic", 3 << 20)


def text_matches(t: Column) -> list[Column]:
    """The arrays of text_heuristics(), one for each pattern."""
    block = 1 << 16
    return [
        _found(t, "email", _from_run_start(C.EMAIL), 0, 0, only_if=t.contains("@")),
        _found(t, "phone", C.PHONE, 0, block, only_if=t.rlike("[0-9]")),
        _found(t, "company_identifier", C.RCS, 1, 2 * block, F.create_map(F.lit("scheme"), F.lit("rcs")), only_if=t.rlike("(?i)rcs")),
        _found(t, "company_identifier", C.SIRET, 0, 3 * block, only_if=t.rlike("[0-9]{3}")),
        _found(t, "company_identifier", C.SIREN, 0, 4 * block, only_if=t.rlike("[0-9]{3}")),
        _found(t, "company_identifier", C.VAT, 0, 5 * block),
    ]


def emails_in_text(rows: DataFrame, text: str = "visible_text") -> DataFrame:
    """The emails of text_heuristics() alone."""
    return _exploded(rows, [_found(F.col(text), "email", _from_run_start(C.EMAIL), 0, 0)], text, "text_heuristic", 3 << 20, F.col(text).contains("@"))


def _exploded(rows: DataFrame, parts: list[Column], text: str, layer: str, offset: int, where: Column | None = None) -> DataFrame:
    found = rows.where(F.col(text).isNotNull() if where is None else where)
    found = found.select("url", "fetched_at", F.explode(F.concat(*parts)).alias("m")).select("url", "fetched_at", "m.*")
    return _stamped(found, layer, offset)


def deobfuscate(candidate: Column) -> Column:
    """The address that a spelled-out one stands for; null if it is none or was not spelled out."""
    plain = F.regexp_replace(candidate, rf"\s*{C.AT}\s*", "@")
    plain = F.regexp_replace(plain, rf"\s*{C.DOT}\s*", ".")
    plain = F.regexp_replace(plain, r"^[ .]+|[ .]+$", "")
    ok = ~candidate.contains("@") & (F.regexp_count(plain, F.lit("@")) == 1) & plain.rlike(f"^(?:{C.EMAIL})$")
    return F.when(ok, plain)


_SPELLED = r"(?i:[\[(]\s*at\s*[\])])|\sAT\s|[＠﹫]"


def spelled_matches(t: Column) -> Column:
    """The addresses that a text spells out, with how it does, as one array."""
    found = _found(t, "email", _from_run_start(C.OBFUSCATED), 0, 0, only_if=t.rlike(_SPELLED))
    plain = F.transform(found, lambda m: F.struct(m["seq"].alias("seq"), m["field"].alias("field"), deobfuscate(m["raw_value"]).alias("raw_value"), F.create_map(F.lit("obfuscated_as"), F.left(F.trim(m["raw_value"]), F.lit(C.MAX_RAW))).alias("metadata")))
    return F.filter(plain, lambda m: m["raw_value"].isNotNull())


def deobfuscated(rows: DataFrame, text: str = "visible_text") -> DataFrame:
    t = F.col(text)
    spelled = t.rlike(_SPELLED)
    found = rows.where(spelled).select("url", "fetched_at", F.explode(_found(t, "email", _from_run_start(C.OBFUSCATED), 0, 0)).alias("m")).select("url", "fetched_at", "m.*")
    found = found.withColumn("metadata", F.create_map(F.lit("obfuscated_as"), F.left(F.trim("raw_value"), F.lit(C.MAX_RAW))))
    found = found.withColumn("raw_value", deobfuscate(F.col("raw_value"))).where("raw_value IS NOT NULL")
    return _stamped(found, "text_heuristic_deobfuscated", 4 << 20)


def all_extractors(parsed: DataFrame, more: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """UNION ALL of the six extractors over one parse, which callers have stored: every branch reads it again.

    more: further extractors, functions from the parse to candidates (schemas.CANDIDATE).
    """
    found = facts(parsed)
    text = parsed.select("url", "fetched_at", F.col("parsed.visible_text").alias("visible_text"))
    out = structured_data(found)
    for part in (semantic_html(found), technology(parsed, found), text_heuristics(text), deobfuscated(text)):
        out = out.unionByName(part)
    for extractor in more:
        out = out.unionByName(extractor(parsed).select(CANDIDATE))
    return barrier(out.select(CANDIDATE))


def candidates(pages: DataFrame, markup: str = "text", more: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """All candidates of pages (url, text, fetched_at, headers). Pages are parsed once; the parse is stored."""
    return all_extractors(stored(parse_pages(pages, markup), "parsed"), more)


def barrier(rows: DataFrame) -> DataFrame:
    """Keep Catalyst from copying what follows into every branch of the union below.

    The partition id is nondeterministic to the optimizer, so neither projections nor filters pass it.
    """
    return rows.withColumn("_at", F.spark_partition_id()).where("_at >= 0").drop("_at")
