"""Text, URL and validation functions against tables of expected values."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from helpers import each
from sitelens import constants as C
from sitelens import dims
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions import validate as V

LONG = "https://example.org/" + "/".join(f"s{i}" for i in range(21))


def test_dimension_sizes(spark):
    sizes = {f.__name__: f(spark).count() for f in (dims.fields, dims.layers, dims.allowed, dims.statuses, dims.outcomes, dims.purposes, dims.platforms, dims.vat_formats, dims.roles, dims.dropped_parameters)}
    assert sizes == {"fields": 9, "layers": 5, "allowed": 28, "statuses": 17, "outcomes": 8, "purposes": 6, "platforms": 17, "vat_formats": 28, "roles": 32, "dropped_parameters": 27}
    assert len(C.RUN_KEYS) == 26 and len(C.FINDING_COLUMNS) == 20 and len(C.PAGE_COLUMNS) == 8 and len(C.COMPLIANCE_KEYS) == 10 and len(C.ROBOTS_REASONS) == 11


def test_text(spark):
    assert each(spark, [" a  b\n c ", "", None], T.collapse) == ["a b c", "", None]
    assert each(spark, ["  Noé DUPONT ", "ÅNGSTRÖM", None, "ﬁn"], T.fold) == ["noe dupont", "angstrom", None, "fin"]
    assert each(spark, ["12, Rue de l'Été!"], T.address_key) == ["12 rue de l t"]
    assert each(spark, ["MAILTO:a@b", " tel:+1 ", "mailto", "x mailto:"], T.strip_scheme) == ["a@b", "+1", "mailto", "x mailto:"]
    assert each(spark, ["https://schema.org/Person", "x#Name ", "A"], T.normalize_property) == ["person", "name", "a"]
    assert each(spark, ["=1", "+1", "-1", "@x", "\tx", "\rx", "x=1", ""], T.formula_guard) == ["'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "x=1", ""]
    assert each(spark, ["a|b\\c`<d>[e]\nf\r\ng\n"], T.markdown_cell) == ["a\\|b\\\\c\\`&lt;d&gt;\\[e\\] f g"]
    assert each(spark, ["a\tb\r\nc"], T.tsv_cell) == ["a b  c"]
    assert each(spark, [0.0, 59.9, 61.0, 3600.0, 36061.0], lambda c: T.format_elapsed(c), "double") == ["00:00", "00:59", "01:01", "1:00:00", "10:01:01"]
    assert each(spark, [0, 1023, 1536, 3 << 20, 5 << 30], T.format_size, "long") == ["0 B", "1023 B", "1.5 KiB", "3.0 MiB", "5.0 GiB"]
    assert each(spark, [0, 1, 25, 45, 400], lambda c: T.percent(c, F.lit(200)), "long") == [0, 0, 12, 22, 100]
    assert each(spark, [5], lambda c: T.percent(c, F.lit(0)), "long") == [0]
    assert each(spark, ["A  b a", ""], T.css_classes) == [["a", "b"], []]
    assert each(spark, [-1.0, 0.7, 99.0], lambda c: T.clamp(c, 0.5, 60.0), "double") == [0.5, 0.7, 60.0]
    assert all(len(r) == 10 and r.startswith("r-") for r in each(spark, ["x"], lambda c: T.new_run_id()))
    assert each(spark, ["x/1 (+y)", "Mozilla/5.0", "x applewebkit"], T.is_honest_agent) == [True, False, False]
    assert T.user_agent("t", "1", "https://p.example", "a@b.example") == "t/1 (+https://p.example; contact: a@b.example)"
    with pytest.raises(ValueError):
        T.user_agent("Chrome", "1", "u", "c")


def test_retention(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS c, d FROM VALUES (1), (2), (3), (4) AS t(d)")
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    days, gone = T.days_remaining(F.col("c"), F.col("d"), now), T.is_expired(F.col("c"), F.col("d"), now)
    got = [tuple(r) for r in rows.select("d", days, gone, T.retention_text(days, gone)).orderBy("d").collect()]
    assert got == [(1, -2, True, "expired"), (2, -1, True, "expired"), (3, 0, False, "0 days left"), (4, 1, False, "1 day left")]


CANONICAL = [
    ("https://example.org", "https://example.org/"),
    ("HTTPS://EXAMPLE.org/Ab", "https://example.org/Ab"),
    ("https://example.org/a#part", "https://example.org/a"),
    ("https://example.org:443/a", "https://example.org/a"),
    ("http://example.org:80/a", "http://example.org/a"),
    ("https://example.org:8080/a", "https://example.org:8080/a"),
    ("https://example.org/x/./y/../z", "https://example.org/x/z"),
    ("https://example.org/../../z/..", "https://example.org/"),
    ("https://example.org//a////b", "https://example.org/a/b"),
    ("https://example.org/a/", "https://example.org/a/"),
    ("https://example.org/a?utm_medium=m&c=3", "https://example.org/a?c=3"),
    ("https://example.org/a?SID=1", "https://example.org/a"),
    ("https://example.org/a?z=1&b=2&b=1", "https://example.org/a?b=1&b=2&z=1"),
    ("https://example.org./a", "https://example.org/a"),
]
CANONICAL_UDF = [
    ("https://bücher.example/", "https://xn--bcher-kva.example/"),
    ("https://example.org/%7Eme/%c3%a9", "https://example.org/~me/%C3%A9"),
    ("https://example.org/a b/é", "https://example.org/a%20b/%C3%A9"),
    ("https://example.org/a?q=a+b&r=%41", "https://example.org/a?q=a%20b&r=A"),
    ("https://example.org/a?empty=&x", "https://example.org/a?empty=&x="),
]


def test_canonical_udf(spark):
    got = each(spark, [raw for raw, _ in CANONICAL + CANONICAL_UDF], lambda c: U.canonicalize(c, F.lit(None).cast("string"))["url"])
    assert got == [want for _, want in CANONICAL + CANONICAL_UDF]


def test_built_in_twin_agrees(spark):
    assert each(spark, [raw for raw, _ in CANONICAL], U.canonical_ascii) == [want for _, want in CANONICAL]


def test_rejections(spark):
    rows = ["mailto:a@b.example", "javascript:void(0)", "https://u:p@example.org/a?x=1", "https://example.org:99999/", "https:///path", "", None, LONG,
            "https://example.org/a/a/a/a/a", "https://example.org/?" + "&".join(f"p{i}=1" for i in range(11)), "https://example.org/" + "x" * 2100, "http://[::1"]
    got = each(spark, rows, lambda c: U.canonicalize(c, F.lit(None).cast("string")))
    assert [r["reason"] for r in got] == ["unsupported_scheme"] * 2 + ["credentials_in_url"] + ["url_rejected_shape"] * 9
    assert got[2]["url"] == "https://example.org/a?x=1"
    assert each(spark, [LONG, "https://example.org/a/a/a/a/a", rows[9], rows[10], "https://example.org/a"], U.shape_problem) == ["segments", "repeats", "parameters", "length", None]


def test_relative_links_and_targets(spark):
    base = F.lit("https://example.org/a/b?c#d")
    assert each(spark, ["../x", "?y=1", "//other.example/z", "#top", "/r"], lambda c: U.canonicalize(c, base)["url"]) == ["https://example.org/x", "https://example.org/a/b?y=1", "https://other.example/z", "https://example.org/a/b?c=", "https://example.org/r"]
    assert each(spark, ["example.org", " http://example.org/a "], lambda c: U.normalize_target(c)["url"]) == ["https://example.org/", "http://example.org/a"]
    assert U.target_url("example.org") == "https://example.org/"
    for bad in ("", "ftp://example.org", "  "):
        with pytest.raises(ValueError):
            U.target_url(bad)


@pytest.mark.parametrize(
    ("scope", "sub", "url", "inside"),
    [
        ("example.org", True, "https://blog.example.org/a", True),
        ("example.org", False, "https://blog.example.org/a", False),
        ("example.org", False, "https://www.example.org/a", True),
        ("example.org", True, "https://example.net/a", False),
        ("example.org", True, "https://myexample.org/a", False),
        ("docs.example.org", True, "https://example.org/a", False),
        ("example.org", True, "https://example.org:8443/a", False),
        ("example.org", True, "http://example.org:80/a", True),
        ("example.org", True, "ftp://example.org/a", False),
    ],
)
def test_scope(spark, scope, sub, url, inside):
    assert each(spark, [url], lambda c: U.in_scope(c, scope, sub)) == [inside]


def test_url_predicates(spark):
    assert each(spark, ["https://e.org/a/b.PDF", "https://e.org/a.b/c", "https://e.org/x.html", "https://e.org/y.tar.gz?z=.pdf"], U.has_skipped_extension) == [True, False, False, True]
    assert each(spark, ["https://e.org/fr/Équipe", "https://e.org/blog", "https://e.org/Mentions-Légales/"], lambda c: U.is_high_value(T.fold(U.path(c)))) == [True, False, True]
    assert [U.is_high_value_url(u) for u in ("https://e.org/contact", "https://e.org/x?contact")] == [True, False]
    assert each(spark, ["https://www.E.org:8080/A/b//?x", "http://e.org"], U.dedup_url) == ["e.org:8080/a/b", "e.org"]
    assert each(spark, ["https://www.GitHub.com/Me/?utm_source=x&b=1&a=2#f"], U.normalize_profile) == ["https://github.com/Me?a=2&b=1"]
    assert each(spark, ["https://gist.github.com/me", "https://github.com/", "https://notgithub.com/me", "mailto:x", "https://x.com/a", "http://t.me/b"], U.platform) == ["github", None, None, None, "x", "telegram"]
    assert each(spark, ["HTTPS://E.org/Key.ASC", "/rel.asc", "https:///x"], U.normalize_key_url) == ["https://e.org/Key.ASC", None, None]
    assert each(spark, ["https://u@e.org/x"], U.without_userinfo) == ["https://e.org/x"]
    assert each(spark, ["https://E.org:1/x"], U.robots_url) == ["https://e.org:1/robots.txt"]
    assert each(spark, [None, 0.1, 3.0], lambda c: U.effective_interval(c, F.lit(1.0)), "double") == [1.0, 1.0, 3.0]


def value_of(spark, values, f):
    return [r and (r["value"], r["dedup_value"], r["metadata"]) for r in each(spark, values, f)]


def test_emails(spark):
    good = value_of(spark, [" Contact@Example.ORG ", "a.b+c@x-y.example", "sales-team@e.org", "jean@e.org"], V.email)
    assert good == [("contact@example.org", "contact@example.org", {"email_kind": "role"}), ("a.b+c@x-y.example", "a.b+c@x-y.example", {"email_kind": "other"}),
                    ("sales-team@e.org", "sales-team@e.org", {"email_kind": "role"}), ("jean@e.org", "jean@e.org", {"email_kind": "other"})]
    assert value_of(spark, ["a@b", ".a@e.org", "a..b@e.org", "a@-e.org", "a@e.123", "a b@e.org", "x" * 65 + "@e.org", "a@@e.org", ""], V.email) == [None] * 9


def test_phones(spark):
    french = lambda c: V.phone(c, "FR")
    assert value_of(spark, ["+33 1 23 45 67 89", "01.23.45.67.89", "0033612345678", "(01) 23 45 67 89", "+49 30 123456"], french) == [
        ("+33123456789", "+33123456789", {"number_type": "FIXED_LINE"}), ("+33123456789", "+33123456789", {"number_type": "FIXED_LINE"}),
        ("+33612345678", "+33612345678", {"number_type": "MOBILE"}), ("+33123456789", "+33123456789", {"number_type": "FIXED_LINE"}),
        ("+4930123456", "+4930123456", {"number_type": "FIXED_LINE"})]
    assert value_of(spark, ["12345", "01 23", "+999 1234567", "call 0123456789", "0023456789"], french) == [None] * 5
    assert value_of(spark, ["(212) 555-0123", "+1 212 555 0123"], lambda c: V.phone(c, "US"))[0] == ("+12125550123", "+12125550123", {"number_type": "FIXED_LINE_OR_MOBILE"})


def test_names_and_addresses(spark):
    assert value_of(spark, [" 1, Rue  X ", "12345", "abc", "12 345 6", "x" * 301], V.postal_address) == [("1, Rue X", "1 rue x", {}), None, None, None, None]
    named = lambda c: V.person_name(c, T.fold(c))
    assert value_of(spark, ["Zoé  Martin", "R2D2", "", "...", "x" * 81], named) == [("Zoé Martin", "zoe martin", {}), None, None, None, None]
    organisation = lambda c: V.organization_name(c, T.fold(c))
    assert value_of(spark, [" ACME 2 ", " ", "x" * 201], organisation) == [("ACME 2", "acme 2", {}), None, None]
    assert value_of(spark, [" WordPress 6 ", "", "y" * 101], V.technology) == [("WordPress 6", "wordpress 6", {}), None, None]


def test_company_identifiers(spark):
    none = F.expr("CAST(map() AS map<string,string>)")
    f = lambda c: V.company_identifier(c, none)
    got = value_of(spark, ["732 829 320", "732.829.320.00074", "FR 44 732829320", "DE123456789", "NL123456789B01"], f)
    assert got == [("732829320", "siren:732829320", {"scheme": "siren"}), ("73282932000074", "siret:73282932000074", {"scheme": "siret"}),
                   ("FR44732829320", "vat_eu:FR44732829320", {"scheme": "vat_eu"}), ("DE123456789", "vat_eu:DE123456789", {"scheme": "vat_eu"}), ("NL123456789B01", "vat_eu:NL123456789B01", {"scheme": "vat_eu"})]
    assert value_of(spark, ["732829321", "73282932000075", "FR45732829320", "DE12345", "ZZ123456789", "12345", "words", ""], f) == [None] * 8
    hinted = lambda c: V.company_identifier(c, F.create_map(F.lit("scheme"), F.lit("rcs")))
    assert value_of(spark, ["732 829 320"], hinted) == [("732829320", "rcs:732829320", {"scheme": "rcs"})]
    assert value_of(spark, ["https://github.com/A/", "https://example.org/a"], V.social_profile) == [("https://github.com/A", "https://github.com/a", {"platform": "github"}), None]
    assert value_of(spark, ["https://www.E.org/K.asc", "k.asc"], V.pgp_key_url) == [("https://www.e.org/K.asc", "e.org/k.asc", {}), None]


def test_phones_of_all_calling_codes(spark):
    plan = V.numbering_plan()
    assert len(plan) > 195 and all(len(c) + least >= 6 and len(c) + most <= 15 for c, (least, most) in plan.items())
    assert not [(a, b) for a in plan for b in plan if a != b and b.startswith(a)], "no code begins another"
    pattern = re.compile(V.prefix_pattern(plan))
    assert all(pattern.fullmatch(c) for c in plan) and not any(pattern.fullmatch(str(c)) for c in range(1000) if str(c) not in plan)
    raw = {
        "+420 601 123 456": "+420601123456", "00420601123456": "+420601123456", "+7 (912) 345-67-89": "+79123456789", "+39 06 1234 5678": "+390612345678", "+225 07 12 34 56 78": "+2250712345678",
        "+420 060 112 345": None, "+420 601 123": None, "+999 123456789": None, "+290 1234": "+2901234", "+290 12345": None, "+86 138 0013 8000": "+8613800138000", "01.02.2024": None, "2024-01-02": None, "2024/11/12 10": None,
    }
    got = each(spark, list(raw), lambda c: V.phone(c, "FR")["value"])
    assert dict(zip(raw, got, strict=True)) == raw
    assert each(spark, ["0601 123 456", "601123456", "+33612345678"], lambda c: V.phone(c, "420")["value"]) == ["+420601123456", "+420601123456", "+33612345678"]
    assert each(spark, ["+420601123456", "+33612345678"], lambda c: V.phone(c, "FR")["metadata"]["number_type"]) == ["UNKNOWN", "MOBILE"]


def test_numbers_in_prose(spark):
    from sitelens.operators import extract

    rows = spark.createDataFrame([(1, "Call +420 601 123 456, or 0041 44 668 18 00. Pay +33140000000\u20ac, $0033140000000, +81 3-1234-5678% or +33140000000x")], "i int, visible_text string")
    rows = rows.selectExpr("'u' AS url", "CAST(NULL AS timestamp) AS fetched_at", "visible_text")
    found = [r["raw_value"] for r in extract.text_heuristics(rows).where("field = 'phone'").orderBy("seq").collect()]
    assert found == ["+420 601 123 456", "0041 44 668 18 00"]


def test_addresses_beyond_ascii():
    kept = {
        "Bu\u0308ro@e.org": "b\u00fcro@e.org", "a@xn--mnchen-3ya.de": "a@m\u00fcnchen.de", "a@M\u00dcNCHEN.de": "a@m\u00fcnchen.de", "\u7a93\u53e3@\u4f8b\u3048\u3002jp": "\u7a93\u53e3@\u4f8b\u3048.jp", "\u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.\u0440\u0444": "\u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.\u0440\u0444",
    }
    for raw, want in kept.items():
        assert V.international_address(raw) == want
    for raw in ("\u00fc@", "@\u00fc.de", "\u00fc@de", "\u00fc..a@e.org", "\u00fc@e.test", "\u00fc@-e.org", "\u00fc@e.123", "\u00fc\u200b@e.org", "\u00fc a@e.org", "a@-\u00fc.org", "\u0301a@e.org", "\u00fc" * 65 + "@e.org", "\u00fc@" + "a" * 64 + ".org", "\u00fc@" + ".".join(["a" * 60] * 5) + ".org", "a@xn--abc.org" + "\u00fc" * 0, None, ""):
        assert V.international_address(raw) is None, raw


def test_ascii_addresses(spark):
    raw = {"A.B@E.org": "a.b@e.org", "a@e.test": None, "a@e.local": None, "a@ab--c.org": None, "a@e.c0": None, "\"a\"@e.org": None, "a@xn--mnchen-3ya.de": None, "a@sub.test.org": "a@sub.test.org", "a" * 65 + "@e.org": None}
    assert dict(zip(raw, each(spark, list(raw), lambda c: V.email(c)["value"]), strict=True)) == raw
