"""Queries that hold column functions and row operators against SQL over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import views
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions import validate
from sitelens.functions.html import parsed
from sitelens.operators import aggregate, crawl, extract, health, robots
from sitelens.operators.settings import Target
from sitelens.plans.registry import query
from sitelens.plans.rendered import SUPPLIERS, _flat, _html, _values, as_pages, suppliers
from sitelens.sinks import ledger
from sitelens.sources import discovery, snapshot
from sitelens.storage import table

_URL = "CASE c_custkey % 3 WHEN 0 THEN 'HTTP' ELSE 'https' END || '://' || CASE WHEN c_custkey % 5 = 0 THEN 'user:pw@' ELSE '' END || 'H' || c_custkey || '.Example.com' || CASE c_custkey % 4 WHEN 1 THEN ':8080' WHEN 2 THEN ':443' WHEN 3 THEN ':80' ELSE '' END || '/a/b?x=1'"


@query(f"""WITH u AS (SELECT c_custkey, {_URL} AS url, lower(CASE c_custkey % 3 WHEN 0 THEN 'http' ELSE 'https' END) AS scheme, 'h' || c_custkey || '.example.com' AS host,
  CASE c_custkey % 4 WHEN 1 THEN 8080 WHEN 2 THEN 443 WHEN 3 THEN 80 END AS p, c_custkey % 5 = 0 AS login FROM customer)
SELECT c_custkey, login AS has_userinfo, replace(url, 'user:pw@', '') AS shown, host, (CASE WHEN p = 443 AND scheme = 'https' OR p = 80 AND scheme = 'http' THEN NULL ELSE p END)::INT AS port,
  regexp_extract(url, '^([A-Za-z]+://[^/]*)', 1) AS origin, scheme || '://' || lower(regexp_extract(url, '://([^/]*)', 1)) || '/robots.txt' AS robots_url FROM u""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials, host, port, origin and the place of robots.txt of URLs with and without each."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_URL).alias("url"))
    u = F.col("url")
    return rows.select("c_custkey", U.has_userinfo(u).alias("has_userinfo"), U.without_userinfo(u).alias("shown"), U.host(u).alias("host"), U.port(u).alias("port"), U.origin(u).alias("origin"), U.robots_url(u).alias("robots_url"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE CASE c_custkey % 4 WHEN 2 THEN 'http' ELSE 'https' END || '://xn--bcher-kva' || c_custkey || '.example.com/' END AS url,
  CASE c_custkey % 4 WHEN 3 THEN 'unsupported_scheme' END AS reason FROM (SELECT c_custkey FROM customer)""".replace("'://xn--bcher-kva' || c_custkey || '.example.com/'", "'://xn--bcher-kva.c' || c_custkey || '.example.com/'"))
def target_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an operator types becomes a URL: a bare domain means https, hosts are encoded, other schemes are refused."""
    name = F.concat(F.lit("Bücher.C"), F.col("c_custkey").cast("string"), F.lit(".Example.com"))
    k = F.col("c_custkey") % 4
    entered = F.when(k == 0, F.concat(F.lit("  "), name, F.lit(" "))).when(k == 1, F.concat(F.lit("https://"), name, F.lit("/#top"))).when(k == 2, F.concat(F.lit("http://"), name, F.lit(":80"))).otherwise(F.concat(F.lit("ftp://"), name))
    rows = table(spark, sf_dir, "customer").select("c_custkey", U.normalize_target(entered).alias("t"))
    return rows.select("c_custkey", F.when(F.col("t.reason").isNull(), F.col("t.url")).alias("url"), F.col("t.reason").alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS elapsed,
  CASE WHEN b >= 1073741824 THEN printf('%.1f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%d B', b) END AS size,
  CASE WHEN t > 0 THEN least(100, round_even(100.0 * d / t, 0))::INT ELSE 0 END AS percent, CASE WHEN r < 0 THEN 'expired' WHEN r = 1 THEN '1 day left' ELSE r || ' days left' END AS retention,
  least(greatest(o_orderkey % 700, 0.5), 300)::DOUBLE AS clamped, least(greatest(o_orderkey % 13 / 4.0, 0.5), 1e9)::DOUBLE AS pace
FROM (SELECT o_orderkey, o_orderkey % 9000 AS s, (o_orderkey * 7919 % 1500 + 1) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 512 WHEN 2 THEN 1048576 ELSE 524288 END) AS b,
  o_orderkey % 350 AS d, o_orderkey % 7 * 40 AS t, o_orderkey % 5 - 1 AS r FROM orders)""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed time, sizes, percentages, retention, bounds and pace as a display shows them."""
    k = F.col("o_orderkey")
    size = (k * 7919 % 1500 + 1) * F.when(k % 4 == 0, 1).when(k % 4 == 1, 512).when(k % 4 == 2, 1048576).otherwise(524288)
    days = (k % 5 - 1).cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.format_elapsed((k % 9000).cast("double") + 0.25).alias("elapsed"), T.format_size(size).alias("size"), T.percent(k % 350, k % 7 * 40).alias("percent"),
        T.retention_text(days, days < 0).alias("retention"), T.clamp((k % 700).cast("double"), 0.5, 300.0).alias("clamped"), U.effective_interval(k % 13 / 4, F.lit(None)).alias("pace"),
    )


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS shown, date_trunc('second', ts) AS again, printf('%s %d', event_type, user_id) AS joined,
  list_distinct([lower(event_type), 'x']) AS classes, trim(regexp_replace(lower('No. ' || user_id || ', ' || event_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS address_key FROM events""".replace("list_distinct([lower(event_type), 'x'])", "lower(event_type) || ' x'"))
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written and read again, attribute lists, class lists and address keys."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    user = F.col("user_id").cast("string")
    classes = T.css_classes(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  x X "), F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        "event_id", T.rfc3339(ts).alias("shown"), T.parse_rfc3339(T.rfc3339(ts)).cast("timestamp_ntz").alias("again"), T.attribute_join(F.array("event_type", user)).alias("joined"),
        F.array_join(classes, " ").alias("classes"), T.address_key(F.concat(F.lit("No. "), user, F.lit(", "), F.col("event_type"), F.lit("!"))).alias("address_key"),
    )


@query("SELECT event_id, NOT (event_id % 3 = 1) AS honest, true AS well_formed FROM events")
def agents_and_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that read like a browser are told from honest ones, among them our own; run ids have their form."""
    own = T.user_agent(C.PRODUCT_TOKEN, "1.0", "https://example.org", "me@example.org")
    agent = F.when(F.col("event_id") % 3 == 1, F.lit("x/1 (compatible; Mozilla/5.0)")).when(F.col("event_id") % 3 == 2, F.lit(own)).otherwise(F.concat(F.lit("reader/"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", T.is_honest_agent(agent).alias("honest"), T.new_run_id().rlike("^r-[0-9a-f]{8}$").alias("well_formed"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 86400 WHEN 2 THEN 0 ELSE 0 END::DOUBLE AS wait,
  CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 503 ELSE 404 END::INT AS status FROM events""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a server asks to wait, as seconds or as a date; and which of recorded attempts counts."""
    k = F.col("event_id")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    date = F.concat(F.lit("Tue, "), F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(1_700_000_000) + k % 86400), F.current_timezone()), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(k % 4 == 0, (k % 50).cast("string")).when(k % 4 == 1, date).when(k % 4 == 2, F.lit("-5")).otherwise(F.lit("soon"))
    tried = lambda *codes: F.array(*[F.struct(F.lit(c).alias("status")) for c in codes])
    attempts = F.when(k % 3 == 0, tried(503, 200, 200)).when(k % 3 == 1, tried(503, 503)).otherwise(tried(404))
    return table(spark, sf_dir, "events").select("event_id", crawl.retry_after(value, now).alias("wait"), snapshot.last_attempt(attempts)["status"].alias("status"))


@query("""WITH a AS (SELECT event_id, (event_id % 5)::INT AS bad, CASE WHEN event_id % 7 = 0 THEN (event_id % 20)::DOUBLE END AS asked FROM events)
SELECT event_id, CASE WHEN bad <= 3 THEN 200 ELSE 503 END::INT AS status, least(bad + 1, 4)::INT AS tries,
  CASE WHEN asked IS NOT NULL THEN asked * least(bad, 3) ELSE CASE least(bad, 3) WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 0 END END::DOUBLE AS waited FROM a""")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a client would have tried again after up to four failures, and how long it would have waited in all."""
    k = F.col("event_id")
    asked = F.when(k % 7 == 0, (k % 20).cast("double"))
    attempt = lambda code: F.struct(F.lit(code).alias("status"), asked.alias("retry_after"))
    attempts = F.concat(F.array_repeat(attempt(503), (k % 5).cast("int")), F.array(F.struct(F.lit(200).alias("status"), F.lit(None).cast("double").alias("retry_after"))))
    rows = table(spark, sf_dir, "events").select("event_id", snapshot.retried(attempts).alias("r"))
    return rows.select("event_id", "r.status", "r.tries", "r.waited")


@query("""WITH p AS (SELECT page_id, 'https://h' || page_id || '.example.com' AS host, (page_id % 9)::INT AS k FROM pages)
SELECT host AS host_key, CASE WHEN k <= 5 THEN 404 END::INT AS status_code, CASE WHEN k = 6 THEN 'too_many_redirects' WHEN k > 6 THEN 'transport' END AS error FROM p""")
def robots_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt behind up to five redirects is found, behind six it is not; a redirect to nowhere and a host without response are transport errors."""
    host = F.concat(F.lit("https://h"), F.col("page_id").cast("string"), F.lit(".example.com"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 9).cast("int").alias("k"), host.alias("host"))
    place = lambda i: F.when(i == 0, F.concat("host", F.lit("/robots.txt"))).otherwise(F.concat(F.lit("https://cdn.example.net/"), F.substring("host", 9, 99), F.lit("/"), i.cast("string")))
    hops = pages.where("k <= 6").select("host", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    routes = hops.select(place(F.col("i")).alias("url"), F.lit(b"").alias("body"), F.when(F.col("i") < F.col("k"), 302).otherwise(404).alias("status"), F.when(F.col("i") < F.col("k"), place(F.col("i") + 1)).alias("location"))
    nowhere = pages.where("k = 7").select(place(F.lit(0)).alias("url"), F.lit(b"").alias("body"), F.lit(301).alias("status"), F.lit(" ").alias("location"))
    found = robots.answers(pages.select(F.concat("host", F.lit("/x")).alias("url")), routes.unionByName(nowhere))
    return found.select("host_key", "status_code", "error")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 3 OR page_id % 3 = 0 THEN 'parse_error' END AS status FROM pages""")
def html_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no HTML by their type, or hold no element, are parse errors."""
    k = F.col("page_id")
    kind = F.when(k % 5 == 0, "TEXT/HTML; charset=utf-8").when(k % 5 == 1, " application/xhtml+xml ").when(k % 5 == 2, "").when(k % 5 == 3, "application/json; x=text/html")
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), F.when(k % 3 == 0, "{\"a\": 1}").otherwise(F.col("html")).alias("text"))
    return extract.page_status(extract.parse_pages(rows)).select("page_id", "status")


@query("SELECT o_orderkey::VARCHAR AS run_id, o_orderdate AS created, (o_orderdate + to_days(30) <= TIMESTAMP '1998-01-01') AS expired FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC LIMIT 50")
def runs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest runs of a ledger."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(30).alias("retention_days"), F.lit("x").alias("directory"))
    return ledger.summaries(rows, None, "1998-01-01 00:00:00").limit(50).select("run_id", F.col("created_at").cast("timestamp_ntz").alias("created"), "expired")


@query("SELECT c_custkey, name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || c_custkey % 10 AS name FROM customer) ORDER BY lower(name) DESC, name, c_custkey LIMIT 40")
def rows_sorted_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty rows of a table that is sorted by a column of text, falling and without case."""
    segment = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(segment, (F.col("c_custkey") % 10).cast("string")).alias("name"))
    return views.sorted_by(rows, "name", True, ["c_custkey"]).limit(40)


_ROUTE_STATUS = """CASE WHEN page_id % 11 = 0 THEN 'transport_error' WHEN page_id % 11 = 1 THEN 'rate_limited' WHEN page_id % 11 IN (2, 3) THEN 'http_error' WHEN page_id % 11 = 4 THEN 'skipped_content_type'
  WHEN octet_length(encode(html)) > 20000 THEN 'too_large' END"""


@query(f"SELECT 'https://p' || page_id || '.example.com/' AS url, {_ROUTE_STATUS} AS status, CASE WHEN {_ROUTE_STATUS} IS NULL THEN length(html) END AS chars, 'v' || page_id AS server FROM pages")
def page_byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a stored response, some of them failed, of another type or over a cap: its status, text and headers as a fetch gives them."""
    k, none = F.col("page_id"), F.lit(None).cast("string")
    routes = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://p"), k.cast("string"), F.lit(".example.com/")).alias("url"), F.encode("html", "UTF-8").alias("body"),
        F.when(k % 11 == 1, 429).when(k % 11 == 2, 500).when(k % 11 == 3, 404).otherwise(200).alias("status"), F.when(k % 11 == 4, "application/pdf").when(k % 2 == 0, "Text/HTML; charset=UTF-8").alias("content_type"),
        none.alias("location"), F.create_map(F.lit("SERVER"), F.concat(F.lit("v"), k.cast("string"))).alias("headers"), F.when(k % 11 == 0, "transport").alias("error"),
    )
    return snapshot.fetched(routes, cap=20_000).select("url", "status", F.length("text").cast("long").alias("chars"), T.metadata_get(F.col("headers"), "server").alias("server"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored in several charsets, declared or not, come back as they were."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, F.encode("text", "UTF-16")).when(k == 1, F.encode("text", "UTF-16LE")).when(k == 2, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    name = F.when(k == 0, "UTF-16").when(k == 1, "utf-16le").when(k == 2, "UTF-16BE")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(crawl.decode_body(body, name)).alias("digest"))


@query(f"""SELECT 'https://shop.example.com/c' || c_custkey AS url, 'https://' || CASE WHEN c_custkey % 9 = 8 THEN 'shop.example.com/c' || c_custkey ELSE 'shop.example.com/c' || (c_custkey - least(c_custkey % 9, {C.MAX_REDIRECTS})) END AS final_url,
  CASE WHEN c_custkey % 9 = 8 THEN 0 ELSE least(c_custkey % 9, {C.MAX_REDIRECTS}) END::INT AS hops, CASE WHEN c_custkey % 9 = 8 THEN 'off_scope' WHEN c_custkey % 9 > {C.MAX_REDIRECTS} THEN 'redirects' END AS error FROM customer""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to seven redirects, and some that leave the site."""
    k = F.col("c_custkey")
    at = lambda x: F.concat(F.lit("https://shop.example.com/c"), x.cast("string"))
    location = F.when(k % 9 == 8, F.lit("https://else.example/")).when(k % 9 != 0, F.concat(F.lit("/c"), (k - 1).cast("string")))
    rows = table(spark, sf_dir, "customer").select(at(k).alias("url"), F.when(k % 9 == 0, 200).otherwise(302).alias("status"), location.alias("location"))
    return crawl.resolve_redirects(rows, rows, Target("shop.example.com"))


_POLICY = """CASE s_suppkey % 5 WHEN 0 THEN 'robots_unreachable_transport' WHEN 1 THEN 'robots_refused_403' WHEN 2 THEN 'robots_absent_404' WHEN 3 THEN CASE WHEN priv THEN 'robots_disallow' ELSE 'robots_allow_rule' END ELSE 'robots_unreachable_transport' END"""


@query(f"""SELECT 'https://s' || s_suppkey || '.example.com/' || CASE WHEN priv THEN 'private/x' ELSE 'open' END AS url, {_POLICY} AS robots_reason, {_POLICY} IN ('robots_absent_404', 'robots_allow_rule') AS robots_allowed,
  CASE WHEN s_suppkey % 5 = 3 THEN (s_suppkey % 4 + 1)::DOUBLE END AS robots_delay, 'https://s' || s_suppkey || '.example.com/robots.txt' AS robots_url
FROM supplier, (SELECT unnest([true, false]) AS priv)""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two URLs of each host under its robots.txt: rules, refusals, absence, an answer older than a day, none at all. The newest of two answers counts."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", host.alias("host_key"))
    body = F.concat(F.lit("User-agent: *\nDisallow: /private\nCrawl-delay: "), (k % 4 + 1).cast("string"), F.lit("\nSitemap: /map.xml\n"))
    answers = rows.where(k % 5 != 4).select(
        "host_key", F.when(k % 5 == 1, 403).when(k % 5 == 2, 404).otherwise(200).alias("status_code"), F.encode(body, "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"),
        F.expr("TIMESTAMP '2024-01-02 00:00:00' - make_interval(0, 0, 0, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END, 1)").alias("fetched_at"),
    )
    older = answers.withColumn("status_code", F.lit(500)).withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 HOUR"))
    urls = rows.select(F.explode(F.array(F.concat("host_key", F.lit("/private/x")), F.concat("host_key", F.lit("/open")))).alias("url"))
    return robots.decide(urls, answers.unionByName(older), now=F.expr("TIMESTAMP '2024-01-02 00:00:00'"))


@query("SELECT s_suppkey, ['https://s' || s_suppkey || '.example.com/a.xml', '/b.xml'] AS sitemaps FROM supplier".replace("['https://s' || s_suppkey || '.example.com/a.xml', '/b.xml']", "'https://s' || s_suppkey || '.example.com/a.xml /b.xml'"))
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("SITEMAP : https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/a.xml\nUser-agent: *\n  Sitemap:/b.xml  \nDisallow: /sitemap: x\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(robots.sitemaps(body), " ").alias("sitemaps"))


@query("""SELECT 'https://n' || n_nationkey || '.example.com/p' || i AS url, 'https://n' || n_nationkey || '.example.com/m' || k || '.xml' AS via, 'n' || n_nationkey AS site
FROM nation, (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 3)) AS i) WHERE k < 4 ORDER BY 1""".replace("'.example.com/p' || i", "'.example.com/p' || k || '-' || i"))
def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of seven sitemaps at each of several sites: five documents of a site are read, the index among them."""
    site = F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".example.com/"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("site"), site.alias("base"))
    maps = rows.select("base", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    loc = lambda *parts: F.concat(F.lit("<loc>"), *parts, F.lit("</loc>"))
    index = rows.select(F.concat("base", F.lit("index.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), *[loc(F.col("base"), F.lit(f"m{k}.xml")) for k in range(7)], F.lit("</sitemapindex>")).alias("text"))
    each = maps.select(F.concat("base", F.lit("m"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), *[loc(F.col("base"), F.lit("p"), F.col("k").cast("string"), F.lit(f"-{i}")) for i in range(3)], F.lit("</urlset>")).alias("text"))
    declared = rows.select(F.concat("base", F.lit("index.xml")).alias("url"), F.lit(0).alias("at"), "site")
    return discovery.sitemap_urls(declared, index.unionByName(each))


_LOG = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"


@query(f"""SELECT 'https://u' || user_id || '.example/' AS url, event_id AS seq, event_type AS status, (max(event_id % 7) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS UNBOUNDED PRECEDING))::INT AS deepest,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) + 100 - 1 AS number FROM ({_LOG}) WHERE k = 1""".replace("(max(event_id % 7) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS UNBOUNDED PRECEDING))::INT", "max(event_id % 7) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS UNBOUNDED PRECEDING)"))
def log_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page logs keep the first row of each URL; then the deepest depth so far and display numbers of each run."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example/")).alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 7).alias("depth"), (F.col("user_id") % 50).alias("run_id"))
    log = health.numbered(health.running_depth(crawl.first_log_row(rows)), first=100)
    return log.select("url", "seq", "status", "deepest", F.col("number").cast("long").alias("number"))


@query("SELECT 'https://f' || o_custkey || '.example/' AS final_url, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def final_url_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://f"), F.col("o_custkey").cast("string"), F.lit(".example/")).alias("final_url"), F.col("o_orderkey").alias("seq"))
    return crawl.collapse_final(rows)


_LAYER_OF = "CASE o_orderkey % 3 WHEN 0 THEN 'text_heuristic' WHEN 1 THEN 'semantic_html' ELSE 'structured_data' END"


@query(f"""WITH a AS (SELECT o_custkey::VARCHAR AS dedup_value, o_orderpriority || ' ' || o_custkey AS value, 'https://s/' || lpad((o_orderkey % 97)::VARCHAR, 3, '0') AS url, o_orderkey AS seq,
  CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS ord, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 0.9 END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN 'r' || o_orderkey END AS role FROM orders)
SELECT dedup_value, min_by(value, (ord, url, value)) AS value, max(confidence)::DOUBLE AS extraction_confidence, count(DISTINCT url)::INT AS page_support, count(*)::INT AS occurrence_count, min(url) AS first_seen_url,
  coalesce(min_by(role, (ord, url, seq)) FILTER (WHERE role IS NOT NULL), '') AS role FROM a GROUP BY dedup_value""")
def preferred_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a finding's spellings the one of most authority is shown; metadata come from the best row that has each key."""
    k = F.col("o_orderkey")
    none = F.expr("CAST(map() AS map<string,string>)")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("organization_name").alias("field"), F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey").cast("string")).alias("value"), F.col("o_custkey").cast("string").alias("dedup_value"),
        F.concat(F.lit("https://s/"), F.lpad((k % 97).cast("string"), 3, "0")).alias("source_url"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("collected_at"), F.expr(_LAYER_OF).alias("extraction_layer"), F.lit("raw").alias("raw_value"),
        F.when(k % 4 == 0, F.create_map(F.lit("role"), F.concat(F.lit("r"), k.cast("string")))).otherwise(none).alias("metadata"), k.cast("int").alias("seq"),
    )
    found = aggregate.findings(rows)
    return found.select("dedup_value", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url", T.metadata_get(F.col("metadata"), "role").alias("role"))


@query("""WITH o AS (SELECT c_custkey::VARCHAR AS k, c_nationkey AS n FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_custkey::VARCHAR AS k, c_nationkey + (c_custkey % 5 = 0)::INT AS n FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(o.k, w.k) AS dedup_value, CASE WHEN o.k IS NULL THEN 'append' WHEN w.k IS NULL THEN 'keep' WHEN o.n = w.n THEN 'unchanged' ELSE 'update' END AS change, coalesce(w.n, o.n)::BIGINT AS page_support FROM o FULL JOIN w ON o.k = w.k""")
def findings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live table against the next snapshot of findings."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lit("email").alias("field"), k.cast("string").alias("dedup_value"), F.col("c_nationkey").cast("long").alias("page_support"), k)
    old = rows.where(k % 3 != 0).drop("c_custkey")
    new = rows.where(k % 4 != 0).withColumn("page_support", F.col("page_support") + (k % 5 == 0).cast("long")).drop("c_custkey")
    return aggregate.upsert(old, new).select("dedup_value", "change", "page_support")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'no provenance' WHEN 2 THEN 'too many provenance entries' WHEN 3 THEN 'no source URL' WHEN 4 THEN 'no time' END AS fault FROM orders")
def provenance_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that nobody could attribute, and why."""
    entry = lambda url, at: F.struct(F.lit(url).alias("source_url"), F.expr(f"CAST({at} AS TIMESTAMP)").alias("collected_at"))
    good = entry("https://e.org/", "'2024-01-01'")
    k = F.col("o_orderkey") % 5
    kinds = F.when(k == 0, F.array(good, good)).when(k == 1, F.filter(F.array(good), lambda p: F.lit(False))).when(k == 2, F.array_repeat(good, C.MAX_PROVENANCE + 1)).when(k == 3, F.array(good, entry(" ", "'2024-01-01'"))).otherwise(F.array(entry("https://e.org/", "NULL")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kinds.alias("provenance"))
    return rows.select("o_orderkey", aggregate.provenance_fault(rows).alias("fault"))


@query("SELECT DISTINCT event_type AS status FROM events")
def statuses_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statuses_seen(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("SELECT event_id, event_type AS status FROM events WHERE event_type = 'error'")
def log_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.of_status(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status")), "error")


_SEVERITY = "CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped_robots' ELSE 'http_error' END"


@query(f"""SELECT event_id AS number, {_SEVERITY} AS status, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity,
  'https://e/' || event_id || chr(10) || 'Status: ' || {_SEVERITY} || chr(10) || 'Depth: ' || (event_id % 4) || CASE WHEN event_id % 3 = 2 THEN chr(10) || 'HTTP status: 404' ELSE '' END || chr(10) || 'Findings on this page: ' || (event_id % 9) AS tooltip FROM events""")
def page_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, severity and tooltips of page logs."""
    k = F.col("event_id")
    log = table(spark, sf_dir, "events").select(k.alias("number"), (k % 4).alias("depth"), F.expr(_SEVERITY).alias("status"), F.concat(F.lit("https://e/"), k.cast("string")).alias("url"), F.lit(None).cast("string").alias("detail"),
        F.when(k % 3 == 2, 404).alias("http_status"), F.lit("").alias("content_type"), (k % 9).alias("findings_count"))
    return views.page_rows(log).select("number", "status", "severity", "tooltip")


@query(_flat("SELECT 'postal_address' AS field, s_suppkey || ' Main Street, 75001 ' || n_name AS value, 0.75 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'person_name', person, 0.75, 1, host FROM suppliers UNION ALL SELECT 'email', 'a@' || host, 0.75, 2, host FROM suppliers"))
def authorship_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address elements, the author meta element and links with rel=author."""
    body = _html("<meta name='Author' content='", F.col("person"), "'><address> ", F.col("s_suppkey"), " Main Street,\n 75001 ", F.col("n_name"), "</address><a rel='nofollow Author' href='mailto:a@", F.col("host"), "?x=1'>w</a>")
    return _values(as_pages(suppliers(spark, sf_dir), body), "postal_address", "person_name", "email")


@query(_flat("""SELECT 'company_identifier' AS field, siren AS value, 0.5 AS confidence, 1 AS n, host FROM suppliers, (SELECT unnest(['rcs', 'siren']))
UNION ALL SELECT 'company_identifier', 'FR' || lpad(((12 + 3 * (siren::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || siren, 0.5, 1, host FROM suppliers UNION ALL SELECT 'company_identifier', 'DE' || siren, 0.5, 1, host FROM suppliers"""))
def company_ids_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register and VAT numbers in prose: the French key must hold, other countries go by format. A number after RCS counts as rcs and as siren."""
    siren = F.col("siren")
    key = F.lpad(((F.lit(12) + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")
    wrong = F.lpad(((F.lit(13) + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")
    body = _html("<p>RCS Paris B ", siren, ". VAT FR", key, siren, ", not FR", wrong, siren, ", nor DE12; DE", siren, ".</p>")
    return _values(as_pages(suppliers(spark, sf_dir), body), "company_identifier")


@query(_flat("SELECT 'phone' AS field, '+331' || lpad(s_suppkey::VARCHAR, 8, '40000000') AS value, 0.5 AS confidence, 2 AS n, host FROM suppliers"))
def phones_in_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number in international and in national form; digits that are no number are left."""
    n = F.lpad(F.col("s_suppkey").cast("string"), 8, "40000000")
    body = _html("<p>Call +33 1 ", n, " or 01 ", n, ". Order 12345.</p>")
    return _values(as_pages(suppliers(spark, sf_dir), body), "phone")


#: Calling codes that go by lengths, as texts, which SQL and Spark both take.
_CODES = [[code, str(least), str(most)] for code, (least, most) in sorted(validate.numbering_plan().items()) if code not in {c for c, _, _ in C.PHONE_REGIONS.values()}]


@query(f"""WITH {SUPPLIERS}, picked AS (SELECT s_suppkey, ({_CODES})[1 + ((s_suppkey * 20 + i) % {len(_CODES)})::INT] AS c FROM suppliers, (SELECT unnest(range(20)) AS i)),
n AS (SELECT c[1] AS code, c[2]::INT AS least, c[3]::INT AS most, '2' || repeat((s_suppkey % 10)::VARCHAR, 14) AS digits FROM picked)
SELECT value, 'UNKNOWN' AS number_type, count(*)::INT AS occurrence_count FROM (
  SELECT '+' || code || substr(digits, 1, least) AS value FROM n UNION ALL SELECT '+' || code || substr(digits, 1, most) FROM n WHERE least < most) GROUP BY value""")
def phones_of_all_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every calling code with the fewest and the most digits, and with one more, which are none."""
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(int(a)).alias("least"), F.lit(int(b)).alias("most")) for c, a, b in _CODES])
    rows = suppliers(spark, sf_dir).select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    rows = rows.select(F.element_at(codes, ((F.col("s_suppkey") * 20 + F.col("i")) % len(_CODES) + 1).cast("int")).alias("c"), F.concat(F.lit("2"), F.repeat((F.col("s_suppkey") % 10).cast("string"), F.lit(14))).alias("digits"))
    rows = rows.select("c.code", F.explode(F.array_distinct(F.array("c.least", "c.most", F.col("c.most") + 1))).alias("k"), "digits")
    raw = F.concat(F.lit("+"), "code", F.lit(" "), F.substring("digits", F.lit(1), F.col("k")))
    found = rows.select(validate.phone(raw, "FR").alias("v")).where("v IS NOT NULL").select("v.value", T.metadata_get(F.col("v.metadata"), "number_type").alias("number_type"))
    return found.groupBy("value", "number_type").agg(F.count("*").cast("int").alias("occurrence_count"))


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, s_name || ' of ' || n_name || ' a & b' AS visible, 9::INT AS elements FROM suppliers")
def visible_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees: no scripts, styles or templates, references decoded, white space collapsed."""
    body = _html("<html><head><style>x{}</style><script>var a;</script></head><body><p> ", F.col("s_name"), "\n of <b>", F.col("n_name"), "</b></p><template>no</template><noscript>no</noscript> a &amp; b</body></html>")
    rows = suppliers(spark, sf_dir).select("s_suppkey", parsed(body).alias("p"))
    return rows.select("s_suppkey", F.col("p.visible_text").alias("visible"), F.col("p.n_elements").cast("int").alias("elements"))
