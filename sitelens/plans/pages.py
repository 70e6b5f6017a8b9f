"""Queries over pages: URL algebra, links, crawl decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions.html import links_of, parsed
from sitelens.operators import crawl
from sitelens.operators.settings import Settings, Target
from sitelens.plans.registry import query
from sitelens.storage import table

DROPPED = ", ".join(f"'{p}'" for p in C.DROPPED_PARAMETERS)
EXTENSIONS = ", ".join(f"'{e}'" for e in C.SKIPPED_EXTENSIONS)
#: Parts of a URL in column `url`.
PARTS = """lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query"""
CANONICAL = f"""parts AS (SELECT *, {PARTS} FROM source), cleaned AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT list_contains([{DROPPED}], lower(split_part(x, '=', 1))))), '&') AS q FROM parts
), canonical AS (
  SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM cleaned
)"""
_SAFE = "".join(C.SEGMENT_SAFE)


def _decoded(expression: str) -> str:
    for c in _SAFE:
        expression = f"replace({expression}, '%{ord(c):02X}', '{c.replace(chr(39), chr(39) * 2)}')"
    return expression


#: Links of pages: page_id, canonical page URL, position, raw link, canonical target.
LINKS = f"""WITH source AS (SELECT page_id, url, html FROM pages), {CANONICAL}, raw_links AS (
  SELECT page_id, canonical_url AS src, scheme, host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos
  FROM canonical
), links AS (
  SELECT page_id, src, pos::INT AS pos, raw, scheme, host, {_decoded("scheme || '://' || host || '/' || url_encode(substr(raw, 2))")} AS dst FROM raw_links
)"""
TARGET, SETTINGS = Target("https://www.example.com/"), Settings(max_depth=3)
SCOPE = "example.com"


@query(f"WITH source AS (SELECT page_id, url FROM pages), {CANONICAL} SELECT page_id, canonical_url FROM canonical")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_ascii(F.col("url")).alias("canonical_url"))


@query(f"WITH source AS (SELECT page_id, url FROM pages), {CANONICAL} SELECT page_id, canonical_url, NULL::VARCHAR AS reason FROM canonical")
def url_canonical_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete rule, through the Arrow UDF; it must agree with the built-in twin on these URLs."""
    rows = table(spark, sf_dir, "pages").select("page_id", U.canonicalize(F.col("url"), F.lit(None).cast("string")).alias("c"))
    return rows.select("page_id", F.col("c.url").alias("canonical_url"), F.col("c.reason").alias("reason"))


@query(f"WITH source AS (SELECT page_id, url FROM pages), parts AS (SELECT *, {PARTS} FROM source) SELECT page_id, lower(regexp_replace(host, '^www\\.', '') || rtrim(path, '/')) AS key FROM parts")
def url_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.dedup_url(F.col("url")).alias("key"))


@query(f"""WITH source AS (SELECT page_id, url FROM pages), parts AS (SELECT *, {PARTS} FROM source)
SELECT host, regexp_replace(host, '^www\\.', '') AS scope_host, host = '{SCOPE}' OR host LIKE '%.{SCOPE}' AS below, host IN ('{SCOPE}', 'www.{SCOPE}') AS itself, count(*) AS pages
FROM parts GROUP BY ALL""")
def url_hosts_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(U.host(url).alias("host"), U.scope_host(url).alias("scope_host"), U.in_scope(url, SCOPE, True).alias("below"), U.in_scope(url, SCOPE, False).alias("itself"))
    return rows.groupBy("host", "scope_host", "below", "itself").agg(F.count("*").alias("pages"))


@query(f"""WITH source AS (SELECT page_id, url FROM pages), parts AS (SELECT *, {PARTS} FROM source)
SELECT count(*) FILTER (WHERE host LIKE '%.{SCOPE}') AS in_scope, count(*) FILTER (WHERE NOT host LIKE '%.{SCOPE}') AS off_scope FROM parts""")
def url_in_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = U.in_scope(F.col("url"), SCOPE, True)
    return table(spark, sf_dir, "pages").agg(F.count_if(inside).alias("in_scope"), F.count_if(~inside).alias("off_scope"))


@query(f"""WITH source AS (SELECT page_id, url FROM pages), parts AS (SELECT *, {PARTS} FROM source),
p AS (SELECT page_id, lower(split_part(unnest(string_split(query, '&')), '=', 1)) AS name FROM parts WHERE query <> '')
SELECT name, name IN ({DROPPED}) AS dropped, count(*) AS n FROM p GROUP BY ALL""")
def url_dropped_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.explode(F.split(U.query(F.col("url")), "&")).alias("pair")).where("pair <> ''")
    rows = rows.select(F.lower(F.split_part("pair", F.lit("="), F.lit(1))).alias("name"))
    return rows.groupBy("name", F.col("name").isin(*C.DROPPED_PARAMETERS).alias("dropped")).agg(F.count("*").alias("n"))


_DEEP = """CASE page_id % 5 WHEN 0 THEN 'https://deep.example.com/' || repeat('s' || page_id || '/', (page_id % 9)::INT)
  WHEN 1 THEN 'https://deep.example.com/' || array_to_string(list_transform(range(0, 15 + page_id % 12), lambda i: 'p' || i), '/')
  WHEN 2 THEN 'https://deep.example.com/a?' || array_to_string(list_transform(range(0, 5 + page_id % 9), lambda i: 'k' || i || '=1'), '&')
  WHEN 3 THEN 'https://deep.example.com/' || repeat('x', (page_id * 40 % 4000)::INT) ELSE url END"""


@query(f"""WITH source AS (SELECT page_id, {_DEEP} AS url FROM pages), parts AS (SELECT *, {PARTS} FROM source),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM parts)
SELECT page_id, CASE WHEN len(segments) > 20 THEN 'segments'
  WHEN coalesce(list_max(list_transform(segments, lambda x: len(list_filter(segments, lambda y: y = x)))), 0) > 4 THEN 'repeats'
  WHEN query <> '' AND len(string_split(query, '&')) > 10 THEN 'parameters' WHEN length(url) > 2048 THEN 'length' END AS problem FROM s""")
def url_shape_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    numbered = lambda prefix, n, suffix="": F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix)))
    deep = (
        F.when(k % 5 == 0, F.concat(F.lit("https://deep.example.com/"), F.repeat(F.concat(F.lit("s"), k.cast("string"), F.lit("/")), (k % 9).cast("int"))))
        .when(k % 5 == 1, F.concat(F.lit("https://deep.example.com/"), F.array_join(numbered("p", 15 + k % 12), "/")))
        .when(k % 5 == 2, F.concat(F.lit("https://deep.example.com/a?"), F.array_join(numbered("k", 5 + k % 9, "=1"), "&")))
        .when(k % 5 == 3, F.concat(F.lit("https://deep.example.com/"), F.repeat(F.lit("x"), (k * 40 % 4000).cast("int"))))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", U.shape_problem(deep).alias("problem"))


@query(f"""WITH rows AS (SELECT page_id, regexp_extract(lower(split_part(url, '?', 1)), '(\\.[^./#]*)(?:#.*)?$', 1) AS found,
  'https://files.example.com/d/f' || ([{EXTENSIONS}])[1 + (page_id % {len(C.SKIPPED_EXTENSIONS)})::INT] AS rendered FROM pages)
SELECT page_id, found IN ({EXTENSIONS}) AS page_skipped, true AS rendered_skipped FROM rows""")
def url_extension_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(e) for e in C.SKIPPED_EXTENSIONS]), (F.col("page_id") % len(C.SKIPPED_EXTENSIONS) + 1).cast("int"))
    rendered = F.concat(F.lit("https://files.example.com/d/f"), extension)
    return table(spark, sf_dir, "pages").select("page_id", U.has_skipped_extension(F.col("url")).alias("page_skipped"), U.has_skipped_extension(rendered).alias("rendered_skipped"))


_WORDS = ["contact", "blog", "Mentions-Legales", "products", "a-propos", "equipe", "shop", "IMPRINT", "news", "about-us"]


@query(f"""WITH rows AS (SELECT page_id, '/' || page_id || '/' || ([{", ".join(f"'{w}'" for w in _WORDS)}])[1 + (page_id % {len(_WORDS)})::INT] AS path FROM pages)
SELECT page_id, path, regexp_matches(lower(path), '{C.HIGH_VALUE_PATH}') AS high_value FROM rows""")
def url_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("page_id") % len(_WORDS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), word).alias("path"))
    return rows.select("page_id", "path", U.is_high_value(T.ascii_fold(F.col("path"))).alias("high_value"))


@query("""SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", links_of(F.col("html")).alias("links"))
    return rows.select("page_id", F.posexplode("links").alias("pos", "href"))


@query(f"{LINKS} SELECT src, pos, raw, dst FROM links")
def page_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_table(table(spark, sf_dir, "pages")).select("src", F.col("at").alias("pos"), "raw", "dst")


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS distinct_links FROM pages")
def page_outdegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", links_of(F.col("html")).alias("links"))
    return rows.select("page_id", F.size("links").cast("long").alias("links"), F.size(F.array_distinct("links")).cast("long").alias("distinct_links"))


@query()
def page_visible_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible characters and elements of each page; malformed markup has no SQL."""
    rows = table(spark, sf_dir, "pages").select("page_id", parsed(F.col("html")).alias("p"))
    return rows.select("page_id", F.length("p.visible_text").alias("visible_chars"), F.col("p.n_elements").alias("n_elements"))


@query(f"""{LINKS}, edges AS (SELECT DISTINCT src, dst FROM links), seeds AS (SELECT DISTINCT src AS url FROM links)
SELECT url, min(depth) AS depth FROM (
  SELECT url, 0 AS depth FROM seeds UNION ALL SELECT dst, 1 FROM edges
  UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src
) GROUP BY url""")
def crawl_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least depth of everything within two links of a page that has links."""
    links = crawl.by_source(crawl.link_table(table(spark, sf_dir, "pages")))
    return crawl.reachable(links, links.select(F.col("src").alias("url")), 2)


@query(f"""{LINKS}, gates AS (SELECT DISTINCT dst, CASE WHEN NOT dst LIKE 'http%://%.example.com/%' THEN 'skipped_off_scope'
  WHEN list_contains([{EXTENSIONS}], regexp_extract(lower(dst), '(\\.[^./]*)$', 1)) THEN 'skipped_extension' ELSE 'fetch' END AS status FROM links)
SELECT status, count(*) AS urls FROM gates GROUP BY status""")
def crawl_page_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of one domain would do with every link of the snapshot."""
    links = crawl.link_table(table(spark, sf_dir, "pages")).select("dst", "reason").distinct()
    status = F.coalesce(crawl.gate(F.col("dst"), F.col("reason"), F.lit(1), TARGET, SETTINGS), F.lit("fetch"))
    return links.where(F.coalesce("reason", F.lit("")) != "unsupported_scheme").groupBy(status.alias("status")).agg(F.count("*").alias("urls"))


@query(f"""{LINKS}, urls AS (SELECT DISTINCT dst AS url FROM links WHERE dst LIKE 'http%://%.example.com/%'),
ranked AS (SELECT url, row_number() OVER (ORDER BY regexp_matches(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '{C.HIGH_VALUE_PATH}') DESC, url) AS k FROM urls)
SELECT url, k::INT AS k FROM ranked WHERE k <= 50""")
def crawl_budget_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty claims of a level under a budget: high-value paths, then by URL."""
    urls = crawl.link_table(table(spark, sf_dir, "pages")).select(F.col("dst").alias("url")).where(U.in_scope(F.col("dst"), SCOPE, True)).distinct()
    first = urls.orderBy(F.desc(U.path(F.col("url")).rlike(C.HIGH_VALUE_PATH)), "url").limit(50)
    return first.select("url", (F.row_number().over(_budget_order())).alias("k"))


def _budget_order():
    from pyspark.sql import Window

    return Window.orderBy(F.desc(U.path(F.col("url")).rlike(C.HIGH_VALUE_PATH)), "url")


def _level(d: int, budget: int) -> str:
    """CTEs of a level of the crawl: its URLs (w), which of them are claimed (f), all claimed so far (r), and the log rows of the others (s)."""
    left = f"{budget} - (SELECT count(*) FROM r{d - 1})"
    return f"""g{d} AS (SELECT DISTINCT dst AS url, CASE WHEN list_contains([{EXTENSIONS}], regexp_extract(lower(dst), '(\\.[^./]*)$', 1)) THEN 'skipped_extension' WHEN {d} > {SETTINGS.max_depth} THEN 'skipped_depth' ELSE 'fetch' END AS status
  FROM edges JOIN f{d - 1} ON src = url),
w{d} AS MATERIALIZED (SELECT * FROM g{d} WHERE url NOT IN (SELECT url FROM r{d - 1})),
k{d} AS MATERIALIZED (SELECT url, row_number() OVER (ORDER BY regexp_matches(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '{C.HIGH_VALUE_PATH}') DESC, url) AS k FROM w{d} WHERE status = 'fetch'),
f{d} AS MATERIALIZED (SELECT url FROM k{d} WHERE k <= {left}),
r{d} AS MATERIALIZED (SELECT * FROM r{d - 1} UNION ALL SELECT url, {d} FROM f{d}),
s{d} AS (SELECT url, {d} AS depth, status FROM w{d} WHERE status <> 'fetch' UNION ALL SELECT url, {d}, 'skipped_budget' FROM k{d} WHERE k > {left})"""


_LEVELS = range(1, SETTINGS.max_depth + 2)
_BUDGET = 200


@query(f"""{LINKS}, edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM links), f0 AS MATERIALIZED (SELECT min(src) AS url FROM edges WHERE src LIKE 'http%://%.example.com/%'),
r0 AS MATERIALIZED (SELECT url, 0 AS depth FROM f0), {", ".join(_level(d, _BUDGET) for d in _LEVELS)},
skipped AS ({" UNION ALL ".join(f"SELECT * FROM s{d}" for d in _LEVELS)})
SELECT url, depth::INT AS depth, 'fetch' AS status FROM r{_LEVELS[-1]}
UNION ALL SELECT url, arg_min(depth, (depth, status))::INT, arg_min(status, (depth, status)) FROM skipped WHERE url NOT IN (SELECT url FROM r{_LEVELS[-1]}) GROUP BY url""")
def crawl_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level-by-level crawl from one page under a budget of 200 pages."""
    links = crawl.by_source(crawl.link_table(table(spark, sf_dir, "pages")))
    seed = links.agg(F.min(F.when(U.in_scope(F.col("src"), SCOPE, True), F.col("src")))).first()[0]
    return crawl.waves(links, Target(seed), SETTINGS, _BUDGET)
