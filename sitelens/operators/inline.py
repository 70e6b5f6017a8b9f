"""Candidates of a page as one expression over its parse: what operators.extract says with joins and unions, for one pass and for SQL.

The parse's facts are filtered and mapped as arrays, fixed tables are literal maps, and all candidates of a page come out of one `inline`. Nothing is stored and the
parse is read once; the joins of operators.extract fit where an extractor is used alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions.html import parsed as parse_page
from sitelens.operators import extract

CANDIDATES = "array<struct<field string, raw_value string, extraction_layer string, metadata map<string,string>, seq int>>"
_NONE = "CAST(map() AS map<string,string>)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _candidate(field: Column | str, raw: Column, layer: str, metadata: Column | None, seq: Column, offset: int) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(
        field.alias("field"), raw.alias("raw_value"), F.lit(layer).alias("extraction_layer"), (F.expr(_NONE) if metadata is None else metadata).alias("metadata"), (seq + F.lit(offset)).cast("int").alias("seq")
    )


def _kept(facts: Column, which: Callable[[Column], Column], to: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(facts, which), to).cast(CANDIDATES)


def structured_data(facts: Column) -> Column:
    fields = _map({f"{t}.{p}": f for t, ps in C.SCHEMA_ORG.items() for p, f in ps.items()})
    known = lambda f: F.try_element_at(fields, f["name"])
    role = lambda f: F.when((known(f) == "person_name") & (f["role"] != ""), F.create_map(F.lit("role"), f["role"])).otherwise(F.expr(_NONE))
    layer = "structured_data"
    return F.concat(
        _kept(facts, lambda f: f["kind"].isin("jsonld", "micro") & known(f).isNotNull(), lambda f: _candidate(known(f), T.strip_scheme(f["value"]), layer, role(f), f["seq"], 0)),
        _kept(facts, lambda f: f["kind"].isin("jsonld_address", "micro_address"), lambda f: _candidate("postal_address", f["value"], layer, None, f["seq"], 0)),
        _profiles(F.filter(facts, lambda f: f["kind"].isin("jsonld_same", "micro_same")), layer, 0),
    )


def _profiles(facts: Column, layer: str, offset: int) -> Column:
    """Those whose link is one of a platform."""
    named = F.transform(facts, lambda f: F.struct(f["value"].alias("value"), f["seq"].alias("seq"), U.platform(f["value"]).alias("platform")))
    return _kept(named, lambda f: f["platform"].isNotNull(), lambda f: _candidate("social_profile", f["value"], layer, F.create_map(F.lit("platform"), f["platform"]), f["seq"], offset))


def semantic_html(facts: Column) -> Column:
    layer, offset = "semantic_html", 1 << 20
    of = lambda which, field, raw: _kept(facts, which, lambda f: _candidate(field(f) if callable(field) else field, raw(f), layer, None, f["seq"], offset))
    scheme = lambda f: F.lower(F.regexp_extract(f["value"], "^(?i)(mailto|tel):", 1))
    target = lambda f: F.trim(F.split_part(F.regexp_replace(f["value"], "^(?i)(mailto|tel):", ""), F.lit("?"), F.lit(1)))
    rel = lambda f, name: F.array_contains(F.split(f["name"], " "), name)
    link = lambda f: f["kind"].isin("href_a", "href_link")
    value, classes = lambda f: f["value"], _map(C.HCARD_CLASSES)
    said = lambda kind, name: lambda f: (f["kind"] == kind) & (f["name"] == name) & (f["value"] != "")
    # the first link to each profile: links sorted by value and place, of which those that differ from the one before stay
    linked = F.array_sort(F.transform(F.filter(facts, lambda f: (f["kind"] == "href_a") | (f["kind"] == "href_link") & rel(f, "me")), lambda f: F.struct(f["value"].alias("value"), f["seq"].alias("seq"))))
    none = F.array(F.lit(None).cast("struct<value string, seq int>"))
    beside = F.zip_with(linked, F.concat(none, linked), lambda own, before: F.struct(own.alias("own"), before.alias("before")))
    first = F.transform(F.filter(beside, lambda x: x["own"].isNotNull() & ~F.equal_null(x["own"]["value"], x["before"]["value"])), lambda x: x["own"])
    return F.concat(
        of(lambda f: (f["kind"] == "href_a") & scheme(f).isin("mailto", "tel") & (target(f) != ""), lambda f: F.when(scheme(f) == "mailto", "email").otherwise("phone"), target),
        of(lambda f: f["kind"] == "address", "postal_address", value),
        of(lambda f: (f["kind"] == "hcard") & F.try_element_at(classes, f["name"]).isNotNull(), lambda f: F.try_element_at(classes, f["name"]), value),
        of(said("meta_name", "author"), "person_name", value),
        of(lambda f: link(f) & rel(f, "author") & (scheme(f) == "mailto"), "email", target),
        of(lambda f: link(f) & rel(f, "pgpkey"), "pgp_key_url", value),
        of(lambda f: (f["kind"] == "href_a") & F.lower(f["value"]).rlike(r"\.(asc|gpg|pgp)$"), "pgp_key_url", value),
        of(said("meta_property", "og:site_name"), "organization_name", value),
        _profiles(first, layer, offset),
    )


def technology(facts: Column, headers: Column) -> Column:
    layer, offset = "semantic_html", 2 << 20
    made = lambda raw, source, seq: _candidate("technology", raw, layer, F.create_map(F.lit("source"), source), seq, offset)
    wanted = F.array(*[F.lit(h) for h in C.TECHNOLOGY_HEADERS])
    entries = F.filter(F.map_entries(headers), lambda e: F.array_contains(wanted, F.lower(e["key"])) & (F.trim(e["value"]) != ""))
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(F.array_position(wanted, F.lower(e["key"])).alias("rank"), e["key"].alias("key"), e["value"].alias("value"))))
    generator = _kept(facts, lambda f: (f["kind"] == "meta_name") & (f["name"] == "generator") & (f["value"] != ""), lambda f: made(f["value"], F.lit("meta:generator"), f["seq"]))
    told = F.transform(ranked, lambda e, i: made(F.trim(e["value"]), F.concat(F.lit("header:"), F.lower(e["key"])), i)).cast(CANDIDATES)
    return F.concat(generator, F.coalesce(told, F.array().cast(CANDIDATES)))


def prose(text: Column) -> Column:
    """What the visible text states, and what it spells out."""
    of = lambda layer, offset: lambda m: F.struct(m["field"].alias("field"), m["raw_value"].alias("raw_value"), F.lit(layer).alias("extraction_layer"), m["metadata"].alias("metadata"), (m["seq"] + F.lit(offset)).cast("int").alias("seq"))
    stated = F.transform(F.concat(*extract.text_matches(text)), of("text_heuristic", 3 << 20))
    spelled = F.transform(extract.spelled_matches(text), of("text_heuristic_deobfuscated", 4 << 20))
    return F.coalesce(F.concat(stated.cast(CANDIDATES), spelled.cast(CANDIDATES)), F.array().cast(CANDIDATES))


def candidates_of(parsed: Column, headers: Column) -> Column:
    """All candidates of a page, as CANDIDATES."""
    facts = parsed["facts"]
    return F.concat(structured_data(facts), semantic_html(facts), technology(facts, headers), prose(parsed["visible_text"]))


def candidates(pages: DataFrame, markup: str = "text") -> DataFrame:
    """As extract.candidates(), in one pass over pages (url, text, fetched_at, headers)."""
    rows = pages.select(F.col("url").alias("source_url"), F.col("fetched_at").alias("collected_at"), "headers", parse_page(F.col(markup)).alias("parsed"))
    found = rows.select("source_url", "collected_at", F.inline(candidates_of(F.col("parsed"), F.col("headers"))))
    return found.select(extract.CANDIDATE)
