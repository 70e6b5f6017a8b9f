"""Extractors, aggregation, total order: our own pages."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sitelens import schemas
from sitelens.functions.html import read_page
from sitelens.operators import aggregate, extract

AT = datetime.datetime(2024, 1, 1)


def pages(spark, *bodies, headers=None):
    return spark.createDataFrame([(f"https://e.org/{i}", 200, "text/html", b, AT, headers or {}) for i, b in enumerate(bodies)], schemas.FETCHED_PAGE)


def found(spark, body, layer=None, headers=None):
    rows = extract.candidates(pages(spark, body, headers=headers)).orderBy("seq")
    rows = rows.where(F.col("extraction_layer") == layer) if layer else rows
    return [(r["field"], r["raw_value"]) for r in rows.collect()]


def test_visible_text_and_links():
    n, text, links, _ = read_page("<title>T</title><p>a<b>b</b>&amp;<!-- no --></p><script>no</script><style>no</style><template><i>no</i></template><a href=' /x '>l</a><a>m</a><a href=''>n</a><p>open")
    assert (n, text, links) == (11, "T a b & l m n open", ["/x"])
    assert read_page("")[:3] == (0, "", []) and read_page(None)[0] == 0 and read_page('{"json": 1}')[0] == 0


def test_json_ld(spark):
    body = """<script type="application/ld+json">{broken</script><script type="application/ld+json">
    {"@graph":[{"@type":"Person","name":"Zoé  M","jobTitle":"CEO","email":"mailto:z@e.org","telephone":["","tel:+33123456789"]},
    {"@type":["LocalBusiness"],"name":"ACME","vatID":"FR44732829320","address":"1 Rue X","sameAs":["https://x.com/acme","https://e.org/y"],
     "founder":{"@type":"Person","name":"Deep"},"contactPoint":{"@type":"ContactPoint","email":"no@e.org"}},{"@type":"Thing","name":"No"}]}</script>"""
    rows = extract.candidates(pages(spark, body)).where("extraction_layer = 'structured_data'").orderBy("seq").collect()
    assert [(r["field"], r["raw_value"]) for r in rows] == [
        ("person_name", "Zoé M"), ("email", "z@e.org"), ("phone", "+33123456789"), ("organization_name", "ACME"), ("company_identifier", "FR44732829320"),
        ("postal_address", "1 Rue X"), ("social_profile", "https://x.com/acme"), ("person_name", "Deep")]
    assert rows[0]["metadata"] == {"role": "CEO"} and rows[1]["metadata"] == {} and rows[6]["metadata"] == {"platform": "x"}


def test_microdata(spark):
    body = """<div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">ACME</b><b itemprop="name">Second</b>
    <div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><i itemprop="postalCode">75001</i><i itemprop="streetAddress">1 Rue X</i></div>
    <div itemscope itemtype="https://schema.org/Person"><i itemprop="name">Zoé</i><i itemprop="jobTitle">Boss</i></div>
    <link itemprop="sameAs" href="https://github.com/acme"><time itemprop="telephone" datetime="+33123456789">call</time></div>"""
    assert sorted(found(spark, body, "structured_data")) == [("organization_name", "ACME"), ("person_name", "Zoé"), ("phone", "+33123456789"), ("postal_address", "1 Rue X, 75001"), ("social_profile", "https://github.com/acme")]


def test_semantic_html(spark):
    body = """<meta name="Author" content=" Zoé "><meta property="OG:site_name" content="Site"><address>1 Rue <b>X</b></address>
    <a href="MAILTO:a@e.org?subject=x">m</a><a href="tel:+33 1 23">t</a><a rel="author" href="mailto:b@e.org">b</a><link rel="pgpkey" href="/k"><a href="https://e.org/K.ASC">k</a>
    <a href="https://github.com/me">g</a><a href="https://github.com/me">again</a><link rel="me" href="https://x.com/me">
    <div class="vcard"><div class="h-card"><span class="fn org">N</span></div></div><span class="email">outside@e.org</span>"""
    got = sorted(found(spark, body, "semantic_html"))
    assert got == sorted([("person_name", "Zoé"), ("organization_name", "Site"), ("postal_address", "1 Rue X"), ("email", "a@e.org"), ("phone", "+33 1 23"), ("email", "b@e.org"), ("email", "b@e.org"),
                          ("pgp_key_url", "/k"), ("pgp_key_url", "https://e.org/K.ASC"), ("social_profile", "https://github.com/me"), ("social_profile", "https://x.com/me"),
                          ("person_name", "N"), ("organization_name", "N"), ("person_name", "N"), ("organization_name", "N")])


def test_technology_and_text(spark):
    body = '<meta name="generator" content="Gen 1"><p>Write to info@e.org. or x [AT] e (dot) org, RCS Paris 732 829 320; VAT FR44732829320; call +33 1 23 45 67 89</p>'
    rows = extract.candidates(pages(spark, body, headers={"Server": "nginx", "x-powered-by": "PHP", "Date": "d"})).orderBy("seq").collect()
    got = [(r["field"], r["raw_value"], r["extraction_layer"]) for r in rows]
    assert [g[:2] for g in got if g[0] == "technology"] == [("technology", "Gen 1"), ("technology", "PHP"), ("technology", "nginx")]
    text = [g[:2] for g in got if g[2] == "text_heuristic"]
    assert ("email", "info@e.org") in text and ("phone", "+33 1 23 45 67 89") in text and ("company_identifier", "FR44732829320") in text
    assert text.count(("company_identifier", "732 829 320")) == 2
    assert [g[:2] for g in got if g[2] == "text_heuristic_deobfuscated"] == [("email", "x@e.org")]


def found_in_text(spark, field, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, visible_text string").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    got = aggregate.accepted(extract.text_heuristics(rows).where(F.col("field") == field), "US").select("source_url", "value", "extraction_layer").collect()
    return [sorted(r["value"] for r in got if r["source_url"] == str(i)) for i in range(len(texts))]


def test_octets_are_no_company_identifiers(spark):
    texts = ["from 17.252.227.210 vioution", "228.100.194.7", "at 101.228.100.194.", "9.8.228.100 194.7.6.5", "SIREN 228.100.194.", "2.732.829.320", "SIRET 732.829.320.00074 and 732 829 320"]
    assert found_in_text(spark, "company_identifier", texts) == [[], [], [], [], ["228100194"], ["732829320"], ["732829320", "732829320", "73282932000074"]]


def test_a_phone_ends_before_the_next_number(spark):
    texts = ["call +1 (908) 555-5112 3. Neither", "+1 (908) 555-5112\n4.0.", "+1 (908) 555-5112 99.225.144.112", "+1 (120) 555-3652 3.", "+1 (908) 555-51123", "+1 (908) 555-5112€", "+1 908 555 5112"]
    assert found_in_text(spark, "phone", texts) == [["+19085555112"]] * 3 + [[], [], [], ["+19085555112"]]


def test_page_status(spark):
    rows = spark.createDataFrame([("a", "text/html; charset=x", "<p>x"), ("b", "application/json", "<p>x"), ("c", None, "plain"), ("d", "", "<p>x")], "url string, content_type string, text string")
    got = {r["url"]: r["status"] for r in extract.page_status(extract.parse_pages(rows)).collect()}
    assert got == {"a": None, "b": "parse_error", "c": "parse_error", "d": None}


def candidate(field, raw, url, layer, metadata=None, seq=0, day=1):
    return (field, raw, url, datetime.datetime(2024, 1, day), layer, metadata or {}, seq)


def findings(spark, rows):
    return aggregate.total_order(aggregate.findings(aggregate.accepted(spark.createDataFrame(rows, schemas.CANDIDATE))))


def test_three_layers_on_one_page_are_one_finding(spark):
    rows = [candidate("email", "Info@E.org", "https://e.org/", x) for x in ("structured_data", "semantic_html", "text_heuristic")]
    (r,) = findings(spark, rows).collect()
    assert (r["value"], r["extraction_confidence"], r["page_support"], r["occurrence_count"], len(r["provenance"])) == ("info@e.org", 0.9, 1, 3, 3)
    assert r["metadata"] == {"email_kind": "role"}


def test_provenance_is_capped_and_ordered(spark):
    rows = [candidate("email", "x@e.org", f"https://e.org/{i:02}", "text_heuristic") for i in reversed(range(40))]
    (r,) = findings(spark, rows).collect()
    assert (r["page_support"], r["occurrence_count"], r["first_seen_url"]) == (40, 40, "https://e.org/00")
    assert [p["source_url"] for p in r["provenance"]] == [f"https://e.org/{i:02}" for i in range(10)]


def test_preferred_spelling_metadata_and_policy(spark):
    rows = [
        candidate("organization_name", "ACME", "https://e.org/b", "structured_data"), candidate("organization_name", "Acmé", "https://e.org/a", "semantic_html"),
        candidate("person_name", "Zoé", "https://e.org/b", "structured_data", {"role": "late"}), candidate("person_name", "ZOE", "https://e.org/a", "structured_data", {"role": "first"}),
        candidate("technology", "x", "https://e.org/a", "text_heuristic"), candidate("email", "bad", "https://e.org/a", "semantic_html"),
        candidate("email", "y" * 3 + "@e.org" + " " * 300, "https://e.org/a", "semantic_html"),
    ]
    got = {r["field"]: r for r in findings(spark, rows).collect()}
    assert got["organization_name"]["value"] == "ACME" and got["organization_name"]["first_seen_url"] == "https://e.org/a"
    assert got["person_name"]["value"] == "ZOE" and got["person_name"]["metadata"] == {"role": "first"}
    assert set(got) == {"organization_name", "person_name", "email"} and len(got["email"]["provenance"][0]["raw_value"]) == 200
    why = sorted((r["field"], r["why"]) for r in aggregate.rejected(spark.createDataFrame(rows, schemas.CANDIDATE)).collect())
    assert why == [("email", "validator"), ("technology", "layer")]


def test_order_never_depends_on_arrival(spark):
    rows = [candidate(f, v, f"https://e.org/{i % 3}", x, seq=i) for i, (f, v, x) in enumerate([("phone", "+33123456789", "semantic_html"), ("email", "b@e.org", "text_heuristic"), ("email", "a@e.org", "text_heuristic"), ("email", "c@e.org", "semantic_html"), ("email", "b@e.org", "text_heuristic")])]
    want = [tuple(r) for r in findings(spark, rows).drop("provenance", "metadata").collect()]
    assert [w[2] for w in want] == ["c@e.org", "a@e.org", "b@e.org", "+33123456789"]
    mixed = aggregate.accepted(spark.createDataFrame(rows[::-1], schemas.CANDIDATE).repartition(7))
    assert [tuple(r) for r in aggregate.total_order(aggregate.findings(mixed)).drop("provenance", "metadata").collect()] == want


def test_upsert(spark):
    rows = [candidate("email", f"{x}@e.org", "https://e.org/", "text_heuristic") for x in "abc"]
    old = aggregate.findings(aggregate.accepted(spark.createDataFrame(rows[:2], schemas.CANDIDATE)))
    new = aggregate.findings(aggregate.accepted(spark.createDataFrame([rows[1], rows[2], rows[2]], schemas.CANDIDATE)))
    got = {r["dedup_value"]: r["change"] for r in aggregate.upsert(old.drop("metadata"), new.drop("metadata")).collect()}
    assert got == {"a@e.org": "keep", "b@e.org": "unchanged", "c@e.org": "append"}
