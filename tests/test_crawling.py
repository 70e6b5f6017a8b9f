"""Crawl modes, robots, discovery, snapshot sources, health."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import each
from sitelens import constants as C
from sitelens import schemas
from sitelens.operators import crawl, health, robots
from sitelens.operators.settings import Purpose, Settings, Target
from sitelens.sources import discovery, snapshot

BASE = "https://example.org"


def site(spark):
    bodies = {
        "/": ["/a", "/b", "/contact", "https://other.example/x", "/file.pdf", "mailto:x@e.org", "https://u:p@example.org/s"],
        "/a": ["/", "/a/1", "/a/2"], "/b": ["/b/1", "/a"], "/contact": ["/contact/team"], "/a/1": ["/deep/1"], "/deep/1": ["/deep/2"], "/contact/team": [],
    }
    rows = [(BASE + p, "".join(f'<a href="{h}">x</a>' for h in hs) + "<p>x</p>") for p, hs in bodies.items()]
    return spark.createDataFrame(rows, "url string, html string")


def test_link_table(spark):
    rows = {(r["src"], r["at"]): (r["dst"], r["reason"]) for r in crawl.link_table(site(spark)).collect()}
    assert rows[BASE + "/", 0] == (BASE + "/a", None) and rows[BASE + "/", 5][1] == "unsupported_scheme"
    assert rows[BASE + "/", 6] == (BASE + "/s", "credentials_in_url")


def test_waves(spark):
    links = crawl.link_table(site(spark))
    log = {r["url"].removeprefix(BASE): (r["depth"], r["status"]) for r in crawl.waves(links, Target(BASE), Settings(max_depth=2)).collect()}
    assert log == {"/": (0, "fetch"), "/a": (1, "fetch"), "/b": (1, "fetch"), "/contact": (1, "fetch"), "https://other.example/x": (1, "skipped_off_scope"), "/file.pdf": (1, "skipped_extension"),
                   "/s": (1, "credentials_in_url"), "/a/1": (2, "fetch"), "/a/2": (2, "fetch"), "/b/1": (2, "fetch"), "/contact/team": (2, "fetch"), "/deep/1": (3, "skipped_depth")}
    few = {r["url"].removeprefix(BASE): r["status"] for r in crawl.waves(links, Target(BASE), Settings(max_depth=2), budget=3).collect()}
    assert few["/contact"] == few["/a"] == few["/"] == "fetch" and few["/b"] == "skipped_budget"
    assert sum(s == "fetch" for s in few.values()) == 3


def test_reachable(spark):
    links = crawl.link_table(site(spark))
    got = {r["url"].removeprefix(BASE): r["depth"] for r in crawl.reachable(links, spark.createDataFrame([(BASE + "/a",)], "url string"), 2).collect()}
    assert got == {"/a": 0, "/": 1, "/a/1": 1, "/a/2": 1, "/b": 2, "/contact": 2, "https://other.example/x": 2, "/file.pdf": 2, "/deep/1": 2}


def ok_pages(spark, **other):
    rows = [(BASE + p, other.get(p, "ok")) for p in ("/", "/a", "/b", "/contact", "/a/1", "/a/2", "/b/1", "/contact/team", "/deep/1", "/deep/2")]
    return spark.createDataFrame(rows, "url string, status string")


def test_exact_mode_order_budget_and_outcomes(spark):
    links = crawl.link_table(site(spark))
    run = crawl.exact(links, ok_pages(spark), Target(BASE), Settings(max_depth=10))
    assert run.outcome == "completed"
    fetched = [u.removeprefix(BASE) for u, _, s, _ in run.log if s == "ok"]
    assert fetched == ["/", "/contact", "/contact/team", "/a", "/b", "/a/1", "/a/2", "/b/1", "/deep/1", "/deep/2"]
    assert crawl.exact(links, ok_pages(spark), Target(BASE), Settings(max_depth=1)).outcome == "depth_exhausted"
    short = crawl.exact(links, ok_pages(spark), Target(BASE), Settings(max_pages=3))
    assert short.outcome == "budget_exhausted" and short.request_slots == 3
    assert sum(s == "ok" for _, _, s, _ in short.log) == 3 and any(s == "skipped_budget" for _, _, s, _ in short.log)
    with pytest.raises(ValueError):
        crawl.exact(links, ok_pages(spark, **{"/": "http_error"}), Target(BASE), Settings())
    denied = crawl.exact(links, ok_pages(spark), Target(BASE), Settings(), frozenset({BASE + "/a"}))
    assert (BASE + "/a", 1, "skipped_robots", None) in denied.log
    limited = crawl.exact(links, ok_pages(spark, **{p: "rate_limited" for p in ("/a", "/contact", "/contact/team", "/b")}), Target(BASE), Settings())
    assert limited.outcome == "aborted_rate_limited"


def test_settings_and_purpose():
    for bad in ({"max_pages": 0}, {"max_pages": 2001}, {"max_depth": 11}, {"request_interval_seconds": 0.4}, {"concurrent_requests": 5}, {"retention_days": 0}, {"phone_region": "fr"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    used, moved = Settings.clamped(max_pages=5000, max_depth=2)
    assert used.max_pages == 2000 and moved == [("max_pages", 5000, 2000)]
    with pytest.raises(ValueError):
        Purpose("other", "short")
    with pytest.raises(ValueError):
        Purpose("unknown")
    assert Purpose("other", "a note that is long").category == "other"
    assert (Target("www.Example.org:8443").scope_host, Target("www.Example.org:8443").scope_port) == ("example.org", 8443)


BODY = b"User-agent: *\nDisallow: /private\nCrawl-delay: 3\nSitemap: https://example.org/s.xml\n"
DECISIONS = [
    ("https://a.example/x", (200, b"User-agent: *\nAllow: /\n", None), True, "robots_allow_rule"),
    ("https://b.example/private/x", (200, BODY, None), False, "robots_disallow"),
    ("https://c.example/x", (401, b"", None), False, "robots_refused_401"),
    ("https://d.example/x", (403, b"", None), False, "robots_refused_403"),
    ("https://e.example/x", (404, b"", None), True, "robots_absent_404"),
    ("https://f.example/x", (410, b"", None), True, "robots_absent_4xx"),
    ("https://g.example/x", (500, b"", None), False, "robots_unreachable_5xx"),
    ("https://h.example/x", (200, b"x" * (C.MAX_ROBOTS + 1), None), False, "robots_body_too_large"),
    ("https://i.example/x", (200, b"\xff\xfe\x00bad", None), False, "robots_undecodable"),
    ("https://j.example/x", (None, None, "transport"), False, "robots_unreachable_transport"),
    ("https://k.example/x", (None, None, "too_many_redirects"), False, "robots_too_many_redirects"),
    ("https://b.example/open", None, True, "robots_allow_rule"),
    ("https://nowhere.example/x", None, False, "robots_unreachable_transport"),
]


def test_robots_decisions(spark):
    at = datetime.datetime(2024, 1, 1)
    policy = spark.createDataFrame([(u.rsplit("/", 2)[0] if "private" in u else u.rsplit("/", 1)[0], *r, at) for u, r, _, _ in DECISIONS if r], schemas.ROBOTS)
    urls = spark.createDataFrame([(u,) for u, *_ in DECISIONS], "url string")
    got = {r["url"]: (r["robots_allowed"], r["robots_reason"], r["robots_delay"]) for r in robots.decide(urls, policy).collect()}
    assert {u: g[:2] for u, g in got.items()} == {u: (allowed, why) for u, _, allowed, why in DECISIONS}
    assert got["https://b.example/open"][2] == 3.0
    stale = robots.decide(urls, policy, now=F.lit("2024-01-03").cast("timestamp")).where("robots_allowed").count()
    assert stale == 0
    assert each(spark, [BODY.decode(), "x"], robots.sitemaps) == [["https://example.org/s.xml"], []]


def test_fetch_status_and_helpers(spark):
    rows = [(200, "text/html", 10, None), (429, "text/html", 1, None), (404, "x/y", 1, None), (200, "image/png", 1, None), (200, None, 1, None), (200, "TEXT/HTML; a", C.MAX_BODY + 1, None), (None, None, None, "redirects"), (None, None, None, "other")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, t string, n int, e string")
    status = crawl.fetch_status(F.col("s"), F.col("t"), F.col("n"), F.col("e"), C.HTML_TYPES)
    assert [r[0] for r in df.orderBy("i").select(status).collect()] == [None, "rate_limited", "http_error", "skipped_content_type", None, "too_large", "too_many_redirects", "transport_error"]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert each(spark, ["120", "-5", "Mon, 01 Jan 2024 00:01:00 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "soon"], lambda c: crawl.retry_after(c, now)) == [120.0, 0.0, 60.0, 0.0, 0.0]


def test_redirects(spark):
    routes = spark.createDataFrame(
        [(f"{BASE}/h{i}", 302, f"/h{i + 1}") for i in range(8)] + [(f"{BASE}/a", 301, "b?utm_source=x"), (f"{BASE}/b", 200, None), (f"{BASE}/off", 302, "https://else.example/"), (f"{BASE}/none", 302, None), (f"{BASE}/loop", 302, "/loop")],
        "url string, status int, location string",
    )
    asked = spark.createDataFrame([(f"{BASE}/{x}",) for x in ("a", "b", "h0", "h3", "off", "none", "loop", "missing")], "url string")
    got = {r["url"].rsplit("/", 1)[1]: (r["final_url"].removeprefix(BASE), r["hops"], r["error"]) for r in crawl.resolve_redirects(asked, routes, Target(BASE)).collect()}
    assert got == {"a": ("/b", 1, None), "b": ("/b", 0, None), "h0": ("/h5", 5, "redirects"), "h3": ("/h8", 5, None), "off": ("/off", 0, "off_scope"), "none": ("/none", 0, "transport"), "loop": ("/loop", 5, "redirects"), "missing": ("/missing", 0, None)}


def test_snapshot_pages(spark):
    rows = [("HTTPS://Example.org:443/a#x", "é".encode(), 200, "text/html; charset=utf-8", None, {"Server": "n", "server": "m", "X": "1"}),
            (BASE + "/b", b"\xe9", 200, "text/html", None, None), (BASE + "/c", b"x", 503, "text/html", None, {}), (BASE + "/d", b"x" * 50, 200, "text/html", None, {})]
    got = {r["url"].rsplit("/", 1)[1]: r for r in snapshot.fetched(spark.createDataFrame(rows, schemas.ROUTE), cap=40).collect()}
    assert (got["a"]["url"], got["a"]["text"], got["a"]["headers"]) == (BASE + "/a", "é", {"server": "m", "x": "1"})
    assert (got["b"]["text"], got["c"]["status"], got["c"]["text"], got["d"]["status"]) == ("é", "http_error", None, "too_large")
    attempts = spark.sql("SELECT array(named_struct('status', 503, 'k', 1), named_struct('status', 200, 'k', 2), named_struct('status', 200, 'k', 3)) AS a, array(named_struct('status', 503, 'k', 1), named_struct('status', 500, 'k', 2)) AS b")
    assert tuple(attempts.select(snapshot.last_attempt(F.col("a"))["k"], snapshot.last_attempt(F.col("b"))["k"]).first()) == (2, 2)


def test_sitemaps(spark):
    urlset = "<urlset><url><loc> https://example.org/a&amp;b </loc></url><url><loc></loc></url><url><LOC>/c</LOC>"
    index = "<?xml version='1.0'?><s:sitemapindex xmlns:s='x'><s:sitemap><s:loc>https://example.org/s2.xml</s:loc></s:sitemap></s:sitemapindex>"
    many = "<urlset>" + "".join(f"<loc>u{i}</loc>" for i in range(600)) + "</urlset>"
    docs = spark.createDataFrame([("s0", urlset), ("s1", index), ("https://example.org/s2.xml", many), ("s3", "<html>"), ("s4", index.replace("s2.xml", "s5.xml")), ("https://example.org/s5.xml", index)], "url string, text string")
    got = {r["url"]: (r["kind"], r["status"], r["locations"]) for r in discovery.sitemap_locations(docs).collect()}
    assert got["s0"] == ("urlset", None, ["https://example.org/a&b", "/c"]) and got["s1"][0] == "sitemapindex" and got["s3"][1] == "parse_error"
    assert len(got["https://example.org/s2.xml"][2]) == 500
    declared = spark.createDataFrame([("s0", 0), ("s1", 1), ("s4", 2)], "url string, at int")
    listed = discovery.sitemap_urls(declared, docs).groupBy("via").count().collect()
    assert {r["via"]: r["count"] for r in listed} == {"s0": 2, "https://example.org/s2.xml": 500}
    assert discovery.seeds("https://example.org/x") == [(BASE + "/.well-known/security.txt", "security_txt"), (BASE + "/sitemap.xml", "sitemap")]


def test_security_txt(spark):
    at = datetime.datetime(2024, 1, 1)
    text = "# c\nContact: mailto:s@e.org?subject=x\r\nCONTACT: tel:+33123456789\nContact: https://e.org/form\nContact: https://x.com/s\nEncryption: https://e.org/k.asc\nEncryption:\nExpires: x"
    docs = spark.createDataFrame([("u", text, at), ("v", "Encryption: https://e.org/k", at), ("w", "Contact: x\n" * 1001, at), ("x", "Contact: " + "y" * 2100, at)], "url string, text string, fetched_at timestamp")
    got = [(r["source_url"], r["field"], r["raw_value"]) for r in discovery.security_txt(docs).orderBy("seq").collect()]
    assert got == [("u", "email", "s@e.org?subject=x"), ("u", "phone", "+33123456789"), ("u", "social_profile", "https://x.com/s"), ("u", "pgp_key_url", "https://e.org/k.asc")]
    assert each(spark, [text, "Encryption: x", "Contact: x\n" * 1001, "Contact: " + "y" * 2100], discovery.security_txt_status) == [None, "parse_error", "too_large", "too_large"]


def log_of(spark, *runs):
    rows = [(f"r{k}", i, s, None) for k, run in enumerate(runs) for i, s in enumerate(run)]
    return spark.createDataFrame(rows, "run_id string, seq long, status string, retry_after double")


def test_aborts(spark):
    ok, bad, slow, skip = "ok", "http_error", "rate_limited", "skipped_robots"
    log = log_of(spark, [slow, slow, skip, slow], [slow, slow, ok, slow, slow], [bad] * 9 + [ok] + [bad] * 10, [bad] * 10, [ok, "parse_error"] * 9 + ["parse_error", "parse_error", ok], [skip] * 30)
    got = {r["run_id"]: (r["outcome"], r["at"]["seq"]) for r in health.first_abort(log).collect()}
    assert got == {"r0": ("aborted_rate_limited", 3), "r2": ("aborted_host_unhealthy", 19), "r3": ("aborted_host_unhealthy", 9), "r4": ("aborted_error_rate", 19)}
    long = spark.createDataFrame([("r", 0, slow, 121.0), ("q", 0, slow, 120.0)], "run_id string, seq long, status string, retry_after double")
    assert [(r["run_id"], r["outcome"]) for r in health.first_abort(long).collect()] == [("r", "aborted_rate_limited")]


def test_spacing_closed_form(spark):
    r = random.Random(1)
    arrivals = sorted(r.uniform(0, 50) for _ in range(200))
    rows = spark.createDataFrame([("h", i, a) for i, a in enumerate(arrivals)], "host string, seq int, arrival double")
    got = [x["start"] for x in health.request_starts(rows, 0.5, order=["seq"]).orderBy("seq").collect()]
    last, want = float("-inf"), []
    for a in arrivals:
        last = max(a, last + 0.5)
        want.append(last)
    assert got == pytest.approx(want)


def test_backoff_depth_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (9, None), (1, 30.0), (1, 500.0)], "n int, r double")
    assert [x[0] for x in df.select(health.backoff(F.col("n"), F.col("r"), F.lit(0.0))).collect()] == [2.0, 4.0, 8.0, 8.0, 30.0, 120.0]
    assert df.limit(1).select(health.backoff(F.col("n"), F.col("r"), F.lit(1.0))).first()[0] == 3.0
    log = spark.createDataFrame([("r", 1, 0), ("r", 2, 2), ("r", 3, 1)], "run_id string, seq int, depth int")
    assert [x["deepest"] for x in health.running_depth(log).orderBy("seq").collect()] == [0, 2, 2]
    assert [x["number"] for x in health.numbered(log, 26).orderBy("seq").collect()] == [26, 27, 28]
    twice = spark.createDataFrame([("u", 1, "f"), ("u", 2, "f"), ("v", 3, "f")], "url string, seq int, final_url string")
    assert crawl.first_log_row(twice).count() == 2 and crawl.collapse_final(twice).count() == 1
    pages = log_of(spark, ["ok", "no_findings", "skipped_robots", "skipped_depth", "http_error", "too_large"])
    assert tuple(crawl.page_counts(pages).first()) == (2, 2, 2, 1)


def test_declared_charsets(spark):
    rows = [("日本".encode("shift_jis"), "Shift_JIS", "日本"), ("мир".encode("cp1251"), "windows-1251", "мир"), ("é".encode(), None, "é"), ("é".encode("latin-1"), None, "é"), ("é".encode("latin-1"), "iso-8859-1", "é"), (b"a\xff", "utf-8", "aÿ"), (b"x", "no-such", "x"), ("z".encode("utf-16"), "UTF-16", "z")]
    got = spark.createDataFrame(rows, "body binary, charset string, want string").select(crawl.decode_body(F.col("body"), F.col("charset")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_zone_of_the_session(spark, zone):
    from sitelens.functions import text as T

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(T.rfc3339(F.timestamp_seconds(F.lit(0))).alias("at"), crawl.retry_after(F.lit("Thu, 01 Jan 1970 00:02:00 GMT"), F.timestamp_seconds(F.lit(0))).alias("wait")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("1970-01-01T00:00:00Z", 120.0)


def test_sitemap_limit_holds_for_each_site(spark):
    documents = spark.createDataFrame([(f"https://s{s}.example/{k}.xml", f"<urlset><loc>https://s{s}.example/p{k}</loc></urlset>") for s in (1, 2) for k in range(7)], "url string, text string")
    declared = spark.createDataFrame([(f"https://s{s}.example/{k}.xml", k, f"s{s}") for s in (1, 2) for k in range(7)], "url string, at int, site string")
    got = discovery.sitemap_urls(declared, documents).groupBy("site").count().collect()
    assert sorted(map(tuple, got)) == [("s1", 5), ("s2", 5)]


LINK = "src string, at int, raw string, dst string, reason string, detail string"


def test_a_link_that_is_followed_beats_one_with_credentials(spark):
    """A page links one URL with and without credentials: it is fetched, whatever order the names of statuses have."""
    home, page = "https://a.example.org/", "https://a.example.org/p"
    rows = [(home, 0, "https://u:p@a.example.org/p", page, "credentials_in_url", None), (home, 1, "/p", page, None, None), (page, 0, "/q", "https://a.example.org/q", "credentials_in_url", None), (home, 2, "/z.zip", "https://a.example.org/z.zip", None, None)]
    rows += [("https://a.example.org/r", 0, "/q", "https://a.example.org/q", None, None), (page, 1, "/r", "https://a.example.org/r", None, None), (home, 3, "https://b.example.net/", "https://b.example.net/", None, None)]
    links = spark.createDataFrame(rows, LINK)
    for table in (links, crawl.by_source(links, 3)):
        got = {(r["url"].removeprefix("https://"), r["depth"], r["status"]) for r in crawl.waves(table, Target(home), Settings(max_depth=3)).collect()}
        assert got == {("a.example.org/", 0, "fetch"), ("a.example.org/p", 1, "fetch"), ("a.example.org/z.zip", 1, "skipped_extension"), ("b.example.net/", 1, "skipped_off_scope"), ("a.example.org/r", 2, "fetch"), ("a.example.org/q", 3, "fetch")}


def test_levels_move_the_frontier_and_not_the_links(spark):
    links = crawl.by_source(spark.range(1000).selectExpr("concat('https://a.org/', id) AS src", "0 AS at", "'' AS raw", "concat('https://a.org/', id * 7 % 1000) AS dst", "CAST(NULL AS string) AS reason", "CAST(NULL AS string) AS detail"), 4)
    frontier = spark.range(50).selectExpr("concat('https://a.org/', id) AS url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = crawl._out(links, frontier)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = plan[plan.index("SortMergeJoin") :]
    assert below.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    side = [part for part in re.split(r"\n(?=\s*:?[-+ ]*Sort )", below) if "Bucketed: true" in part]
    assert len(side) == 1 and "Exchange" not in side[0]


def test_links_without_a_tree_are_those_of_the_parse():
    from sitelens.functions import html

    for markup in (None, "", "<a href=' /x '>a<a HREF=\"/y&amp;z\">b</a><A href>c</a><script><a href='/no'></script><a href=/q/><p><a href='/b' href='/c'><!-- <a href='/d'> --><area href='/e'>"):
        assert html.page_links(markup) == html.read_page(markup)[2]
