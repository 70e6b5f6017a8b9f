"""Round trips: pages are rendered from table rows inside the query, and what is extracted must be those rows again.

The driver's pages state no structured data, so this is how the extractors meet an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.operators import aggregate, extract
from sitelens.plans.documents import COLLECTED
from sitelens.plans.registry import query
from sitelens.sources import discovery
from sitelens.storage import table

HOST = "'s' || s_suppkey || '.example.com'"
#: A name of letters for each key: digits are not allowed in person names.
PERSON = "'Ann ' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghij')"
_BASE = "lpad((10000000 + s_suppkey * 7919 % 80000000)::VARCHAR, 8, '8')"
_DIGITS = "+".join(f"(substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) % 10 + (substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) // 10" for i in range(1, 9))
#: Suppliers with a number that holds its checksum: columns host, person, siren and those of the tables.
SUPPLIERS = f"""base AS (SELECT *, {HOST} AS host, {PERSON} AS person, {_BASE} AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
suppliers AS (SELECT *, b || ((10 - ({_DIGITS}) % 10) % 10)::VARCHAR AS siren FROM base)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("host", F.concat(F.lit("s"), key, F.lit(".example.com")))
    rows = rows.withColumn("person", F.concat(F.lit("Ann "), F.translate(key, "0123456789", "abcdefghij")))
    rows = rows.withColumn("b", F.lpad((10_000_000 + F.col("s_suppkey") * 7919 % 80_000_000).cast("string"), 8, "8"))
    checks = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(F.col("b"), c.cast("string")))
    return rows.withColumn("siren", F.element_at(F.filter(checks, lambda x: F.call_function("luhn_check", x)), 1))


def as_pages(rows: DataFrame, body: Column, headers: Column | None = None) -> DataFrame:
    """Rows as fetched pages of their host."""
    none = F.expr("CAST(map() AS map<string,string>)")
    return rows.select(
        F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url"), body.alias("text"), F.expr(COLLECTED).alias("fetched_at"),
        (none if headers is None else headers).alias("headers"),
    )


def _html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _values(pages: DataFrame, *fields: str) -> DataFrame:
    found = aggregate.findings(aggregate.accepted(extract.candidates(pages)))
    return found.where(F.col("field").isin(*fields)).select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")



def _flat(select: str) -> str:
    return f"WITH {SUPPLIERS} SELECT field, value, confidence::DOUBLE AS extraction_confidence, 1::INT AS page_support, n::INT AS occurrence_count, 'https://' || host || '/' AS first_seen_url FROM ({select})"


@query(_flat("SELECT 'organization_name' AS field, s_name AS value, 0.9 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'company_identifier', siren, 0.9, 1, host FROM suppliers"))
def jsonld_org_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _html('<html><script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":["Organization"],"name":"', F.col("s_name"), '","taxID":"', F.col("siren"), '"}]}</script><p>x</p></html>')
    return _values(as_pages(suppliers(spark, sf_dir), body), "organization_name", "company_identifier")


@query(_flat("SELECT 'postal_address' AS field, s_suppkey || ' Main Street, 75001, ' || n_name AS value, 0.9 AS confidence, 2 AS n, host FROM suppliers"))
def jsonld_address_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same address as JSON-LD components and as microdata components."""
    street = F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main Street"))
    body = _html(
        '<script type="application/ld+json">[{"@type":"LocalBusiness","address":{"@type":"PostalAddress","addressCountry":"', F.col("n_name"), '","postalCode":"75001","streetAddress":"', street, '"}}]</script>',
        '<div itemscope itemtype="https://schema.org/PostalAddress"><b itemprop="streetAddress">', street, '</b><i itemprop="postalCode">75001</i><meta itemprop="addressCountry" content="', F.col("n_name"), '"></div>',
    )
    return _values(as_pages(suppliers(spark, sf_dir), body), "postal_address")


@query(_flat("SELECT 'person_name' AS field, person AS value, 0.9 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'email', 'p@' || host, 0.9, 1, host FROM suppliers"))
def microdata_person_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _html('<div itemscope itemtype="http://schema.org/Person"><span itemprop="name">', F.col("person"), '</span><a itemprop="email" href="MAILTO:p@', F.col("host"), '">w</a><div itemscope itemtype="http://schema.org/Thing"><span itemprop="name">Other</span></div></div>')
    rows = as_pages(suppliers(spark, sf_dir), body)
    found = aggregate.findings(aggregate.accepted(extract.structured_data(extract.facts(extract.parse_pages(rows)))))
    return found.select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(_flat("SELECT 'email' AS field, 'contact@' || host AS value, 0.75 AS confidence, 2 AS n, host FROM suppliers UNION ALL SELECT 'phone', '+331' || lpad(s_suppkey::VARCHAR, 8, '40000000'), 0.75, 1, host FROM suppliers"))
def semantic_links_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two addresses of one mailbox merge; the telephone link is in the region's national form."""
    number = F.lpad(F.col("s_suppkey").cast("string"), 8, "40000000")
    body = _html('<p><a href="mailto:Contact@', F.col("host"), '?subject=hi">mail</a> or contact@', F.col("host"), ' <a href="tel:01', number, '">call</a></p>')
    return _values(as_pages(suppliers(spark, sf_dir), body), "email", "phone")


@query(_flat("""SELECT 'email' AS field, 'büro' || s_suppkey || '@' || host AS value, 0.75 AS confidence, 1 AS n, host FROM suppliers
UNION ALL SELECT 'email', 'k' || s_suppkey || '@münchen.' || host, 0.75, 2, host FROM suppliers
UNION ALL SELECT 'email', '窓口' || s_suppkey || '@例え.example.com', 0.75, 1, host FROM suppliers
UNION ALL SELECT 'email', 'o''neil+' || s_suppkey || '@' || host, 0.75, 1, host FROM suppliers"""))
def emails_of_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes and domains in any script: an encoded domain and its Unicode form are one; quoted, doubled and special-use ones are none."""
    key, host = F.col("s_suppkey").cast("string"), F.col("host")
    link = lambda *parts: [F.lit('<a href="mailto:'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('">m</a>')]
    good = [*link("Bu\u0308ro", key, "@", F.upper(host)), *link("k", key, "@M\u00dcNCHEN.", host), *link("K", key, "@xn--mnchen-3ya.", host), *link("窓口", key, "@例え。example.com"), *link("O'Neil+", key, "@", host)]
    bad = [*link("&quot;a b&quot;@", host), *link("a..b@", host), *link(".a@", host), *link("a@b_c.example.com"), *link("a@", host, ".test"), *link("a@localhost"), *link("a@xn--zzzzzz.example.1"), *link("a@-ü.example.com"), *link("a\u200b@", host)]
    return _values(as_pages(suppliers(spark, sf_dir), _html("<p>", *good, *bad, "</p>")), "email")


@query(_flat("SELECT 'person_name' AS field, person AS value, 0.75 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'organization_name', s_name, 0.75, 2, host FROM suppliers"))
def hcard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _html('<meta property="og:site_name" content=" ', F.col("s_name"), '"><div class="x VCard"><span class="fn">', F.col("person"), '</span> <span class="org other">', F.col("s_name"), "</span></div><span class='fn'>Outside</span>")
    return _values(as_pages(suppliers(spark, sf_dir), body), "person_name", "organization_name")


@query(_flat("SELECT 'social_profile' AS field, 'https://github.com/S' || s_suppkey AS value, 0.75 AS confidence, 2 AS n, host FROM suppliers"))
def social_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of a profile are one; a bare platform root and other hosts are none."""
    name = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    body = _html('<a rel="me" href="https://www.GitHub.com/', name, '/?utm_source=x">a</a><a href="https://github.com/', name, '">b</a><a href="https://github.com/">c</a><a href="https://notgithub.com/', name, '">d</a>')
    return _values(as_pages(suppliers(spark, sf_dir), body), "social_profile")


@query("SELECT p_brand AS value, count(*)::INT AS page_support, count(*)::INT AS occurrence_count FROM part GROUP BY p_brand UNION ALL SELECT 'server/' || p_size, count(*)::INT, count(*)::INT FROM part GROUP BY p_size")
def tech_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators and server headers of one page for each part; values are shared by many pages."""
    rows = table(spark, sf_dir, "part").withColumn("host", F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".example.com")))
    headers = F.create_map(F.lit("Server"), F.concat(F.lit("server/"), F.col("p_size").cast("string")), F.lit("Date"), F.lit("x"))
    pages = as_pages(rows, _html('<meta name="Generator" content="', F.col("p_brand"), '"><p>x</p>'), headers)
    parsed = extract.parse_pages(pages)
    found = aggregate.findings(aggregate.accepted(extract.technology(parsed, extract.facts(parsed))))
    return found.select("value", "page_support", "occurrence_count")


@query(_flat("SELECT 'pgp_key_url' AS field, 'https://' || host || '/Key.asc' AS value, 0.75 AS confidence, 2 AS n, host FROM suppliers"))
def pgp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key link is found by its relation and by its suffix; a relative one is rejected."""
    body = _html('<a rel="PGPkey nofollow" href="HTTPS://', F.upper("host"), '/Key.asc">k</a><a href="/other.gpg">r</a>')
    return _values(as_pages(suppliers(spark, sf_dir), body), "pgp_key_url")


@query(f"WITH {SUPPLIERS} SELECT 'mail@' || host AS value, 'mail [at] ' || replace(host, '.', ' (dot) ') AS obfuscated_as FROM suppliers")
def doc_obfuscated_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.concat(F.lit("mail [at] "), F.replace("host", F.lit("."), F.lit(" (dot) ")))
    rows = as_pages(suppliers(spark, sf_dir), _html("Write to ", spelled, " today. Meet Paul at Example.com")).select("url", "fetched_at", F.col("text").alias("visible_text"))
    found = aggregate.findings(aggregate.accepted(extract.deobfuscated(rows)))
    return found.select("value", T.metadata_get(F.col("metadata"), "obfuscated_as").alias("obfuscated_as"))


ALL_FIELDS = """SELECT 'email' AS field, 'contact@' || host AS value, 0.9 AS confidence, 3 AS n, host FROM suppliers
UNION ALL SELECT 'phone', '+331' || lpad(s_suppkey::VARCHAR, 8, '40000000'), 0.9, 1, host FROM suppliers
UNION ALL SELECT 'postal_address', s_suppkey || ' Main Street, ' || n_name, 0.9, 1, host FROM suppliers
UNION ALL SELECT 'person_name', person, 0.75, 1, host FROM suppliers
UNION ALL SELECT 'organization_name', s_name, 0.9, 1, host FROM suppliers
UNION ALL SELECT 'social_profile', 'https://github.com/S' || s_suppkey, 0.9, 2, host FROM suppliers
UNION ALL SELECT 'pgp_key_url', 'https://' || host || '/key.asc', 0.75, 2, host FROM suppliers
UNION ALL SELECT 'company_identifier', siren, 0.5, 1, host FROM suppliers"""


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier that states all nine fields."""
    key = F.col("s_suppkey").cast("string")
    body = _html(
        '<html><head><title>T</title><meta name="generator" content="Builder ', F.col("s_nationkey"), '"><script type="application/ld+json">{"@type":"Organization","name":"', F.col("s_name"),
        '","email":"mailto:contact@', F.col("host"), '","telephone":"+33 1 ', F.lpad(key, 8, "40000000"), '","address":{"streetAddress":"', key, ' Main Street","addressCountry":"', F.col("n_name"),
        '"},"sameAs":["https://github.com/S', key, '","https://elsewhere.example.org/x"]}</script></head><body><a href="mailto:contact@', F.col("host"), '">contact@', F.col("host"),
        '</a><div class="h-card"><span class="p-name">', F.col("person"), '</span></div><a href="https://github.com/S', key, '/">profile</a><a rel="pgpkey" href="https://', F.col("host"),
        '/key.asc">key</a><p>SIREN ', F.col("siren"), "</p></body></html>",
    )
    return as_pages(suppliers(spark, sf_dir), body)


@query(f"""WITH {SUPPLIERS}, found AS ({ALL_FIELDS}), rows AS (
  SELECT field, value, confidence::DOUBLE AS extraction_confidence, 1::INT AS page_support, n::INT AS occurrence_count, 'https://' || host || '/' AS first_seen_url FROM found
  UNION ALL SELECT 'technology', 'Builder ' || s_nationkey, 0.75, count(*)::INT, count(*)::INT, min('https://' || host || '/') FROM suppliers GROUP BY s_nationkey
) SELECT * FROM rows""")
def all_fields_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages to findings of all nine fields, in total order."""
    found = aggregate.findings(aggregate.accepted(extract.candidates(supplier_pages(spark, sf_dir))))
    return aggregate.total_order(found).select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(f"WITH {SUPPLIERS} SELECT 'technology' AS field, 'text_heuristic' AS extraction_layer, count(*) AS rejected FROM suppliers UNION ALL SELECT 'person_name', 'text_heuristic', count(*) FROM suppliers WHERE s_suppkey % 2 = 0 HAVING count(*) > 0")
def layer_policy_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that come from a layer which may not yield their field."""
    rows = suppliers(spark, sf_dir).select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("source_url"), "person", "s_suppkey")
    made = rows.select("source_url", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(x).alias("extraction_layer"), F.lit(k).alias("k")) for k, (f, x) in enumerate([("technology", "text_heuristic"), ("person_name", "text_heuristic"), ("email", "well_known"), ("technology", "semantic_html")])])), "s_suppkey")
    made = made.where("k <> 1 OR s_suppkey % 2 = 0").select("field", F.lit("x").alias("raw_value"), "source_url", F.expr(COLLECTED).alias("collected_at"), "extraction_layer", F.expr("CAST(map() AS map<string,string>)").alias("metadata"), F.lit(0).alias("seq"))
    return aggregate.rejected(made).where("why = 'layer'").groupBy("field", "extraction_layer").agg(F.count("*").alias("rejected"))


@query("""SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, 'https://shop.example.com/order?id=' || o_orderkey || '&v=1' AS url
FROM orders QUALIFY pos < 500""")
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each customer, of their orders; at most 500 locations of each."""
    loc = F.concat(F.lit("<url><loc>\n https://shop.example.com/order?id="), F.col("o_orderkey").cast("string"), F.lit("&amp;v=1 </loc></url>"))
    # sitemaps are documents by definition: one row each, built from the few orders of a customer
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", loc.alias("loc")))), lambda x: x["loc"]), "").alias("body"))
    docs = docs.withColumn("text", F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</urlset>")))
    return discovery.sitemap_locations(docs).where("status IS NULL").select("o_custkey", F.posexplode("locations").alias("pos", "url"))


@query(f"""WITH {SUPPLIERS} SELECT 'email' AS field, 'sec@' || host AS raw_value, 'https://' || host || '/' AS source_url FROM suppliers
UNION ALL SELECT 'phone', '+331' || lpad(s_suppkey::VARCHAR, 8, '40000000'), 'https://' || host || '/' FROM suppliers
UNION ALL SELECT 'social_profile', 'https://x.com/S' || s_suppkey, 'https://' || host || '/' FROM suppliers
UNION ALL SELECT 'pgp_key_url', 'https://' || host || '/key.asc', 'https://' || host || '/' FROM suppliers""")
def security_txt_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    body = _html("# comment\nContact: mailto:sec@", F.col("host"), "\r\ncontact : tel:+331", F.lpad(key, 8, "40000000"), "\nContact: https://x.com/S", key, "\nContact: https://", F.col("host"), "/form\nEncryption: https://", F.col("host"), "/key.asc\nExpires: never\n")
    return discovery.security_txt(as_pages(suppliers(spark, sf_dir), body)).select("field", "raw_value", "source_url")


@query(_flat("SELECT 'person_name' AS field, person AS value, 0.75 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'organization_name', s_name, 0.75, 1, host FROM suppliers UNION ALL SELECT 'postal_address', s_suppkey || ' Main Street ' || n_name, 0.75, 1, host FROM suppliers UNION ALL SELECT 'email', 'a@' || host, 0.75, 2, host FROM suppliers"))
def broken_pages_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that end in the middle, with stray and crossed end tags, bare attributes, comments that stay open and references without an end."""
    body = _html(
        "</p></div><ul><li class=vcard><b class=fn>", F.col("person"), "</i></b><li><em><strong>x</em></strong><!-- <a href='mailto:no@", F.col("host"), "'> --><address>", F.col("s_suppkey").cast("string"), "\n Main Street<br>", F.col("n_name"),
        "</section></address><meta property=og:site_name content='", F.col("s_name"), "'><td><a href=mailto:a@", F.col("host"), ">a&#64;", F.col("host"), "<p>open<a href='/x' <p <!-- never closed <b class=vcard>",
    )
    return _values(as_pages(suppliers(spark, sf_dir), body), "person_name", "organization_name", "postal_address", "email")
