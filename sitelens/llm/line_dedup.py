"""Line dedup by site-relative frequency.

Documents are grouped by host. A line's ratio is the number of the host's pages that contain it over the host's
page total; lines above a boilerplate ratio are dropped from every page of that host.

A line is dropped if it is on more than `max_ratio` of the host's pages and on at least `min_pages` of them. Where a
host has too few pages for that many, a higher ratio decides: a line on at least `few_pages` pages is dropped if these are
over `few_ratio` of the host's.

Copies of one page are one page: pages of a host with the same set of lines count once, in both numbers. Else a
page copied a thousand times would make boilerplate of its own content, and deleting it would lose the content. Pages
that differ in any line are different pages, however long the lines they share.

Only (host, line hash, page hash) triples are shuffled, made distinct before the shuffle. The lines to drop are at
most lines-per-page / max_ratio for each host. While they are few they are broadcast, an array for a host, which is
intersected by hash with a document's own lines once; texts never move. Beyond `broadcast_rows` they are joined with the triples by (host, line
hash), where Spark splits a line that is on very many pages, and each page meets the lines that it has itself.

Defined cases: a null text stays null and has no lines; a null host is a host of its own; lines of white space alone
are kept and never counted; an empty table gives no rows; repeated rows are one page; other columns stay as they are,
whatever their names; columns n_lines and n_dropped are replaced where counts are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import aside, stored, table

#: A line is boilerplate on a host if over this share of its pages contain it ...
MAX_RATIO = 0.05
#: ... and at least so many pages; or, on a small host, so many pages that are over this share.
MIN_PAGES = 5
FEW_PAGES = 3
FEW_RATIO = 0.5
#: (host, line) rows that are broadcast at most: about 2 MB.
BROADCAST_ROWS = 200_000
#: White space alone makes a blank line; backslashes are doubled for the SQL text.
_BLANK = r"^[\\x20\\x09-\\x0D]*$"


def _lines(text: str) -> str:
    return f"filter(split(`{text}`, '\\n', -1), x -> NOT x RLIKE '{_BLANK}')"


def _pages(docs: DataFrame, host: str, text: str) -> DataFrame:
    """(host, hashes, page): a document's distinct line hashes, and their own hash, which knows the page."""
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.expr(_lines(text)).alias("lines")).where("size(lines) > 0")
    hashes = F.expr("array_sort(array_distinct(transform(lines, x -> xxhash64(x))))").alias("hashes")
    return pages.select("host", hashes).withColumn("page", F.expr("xxhash64(hashes)"))


def _seen(pages: DataFrame) -> DataFrame:
    return pages.select("host", "page", F.explode("hashes").alias("line_hash")).distinct()


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    few_pages: int = FEW_PAGES, few_ratio: float = FEW_RATIO,
) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines to drop."""
    pages = _pages(docs, host, text)
    host_pages = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = _seen(pages).groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min(min_pages, few_pages))
    n, all_pages = F.col("pages"), F.col("host_pages")
    enough = (n >= min_pages) & (n > max_ratio * all_pages) | (n >= few_pages) & (n > few_ratio * all_pages)
    return counts.join(host_pages, counts["host"].eqNullSafe(host_pages["host"])).where(enough).select(counts["host"], "line_hash", "pages", "host_pages")


def drop_lines(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    broadcast_rows: int = BROADCAST_ROWS, counts: bool = True,
) -> DataFrame:
    """The documents with their boilerplate lines dropped, and n_lines and n_dropped added if counts are wanted."""
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    docs, names = aside(docs)
    host, text = names[host], names[text]
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate").select(F.col("host").alias("of_host"), F.col("line_hash").alias("hot"))
    hashes = f"transform({_lines(text)}, x -> xxhash64(x))"
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = found.groupBy("of_host").agg(F.collect_list("hot").alias("all_hot"))
        rows = docs.join(F.broadcast(hot), F.col(host).eqNullSafe(F.col("of_host")), "left")
        rows = rows.withColumn("own", F.expr(f"array_intersect({hashes}, all_hot)"))
    else:
        seen = _seen(_pages(docs, host, text)).join(found, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line_hash") == F.col("hot")))
        own = seen.groupBy("host", "page").agg(F.collect_list("line_hash").alias("own")).select(F.col("host").alias("of_host"), F.col("page").alias("of_page"), "own")
        page = F.expr(f"xxhash64(array_sort(array_distinct({hashes})))")
        rows = docs.withColumn("page", page).join(own, F.col(host).eqNullSafe(F.col("of_host")) & (F.col("page") == F.col("of_page")), "left")
    lines = f"split({text}, '\n', -1)"
    left = f"filter({lines}, x -> x RLIKE '{_BLANK}' OR NOT array_contains(own, xxhash64(x)))"
    rows = rows.withColumn("left", F.expr(f"CASE WHEN coalesce(size(own), 0) = 0 THEN {lines} ELSE {left} END"))
    cleaned = rows.withColumn("n_lines", F.expr(f"CAST(coalesce(size({lines}), 0) AS BIGINT)")).withColumn("n_dropped", F.expr("n_lines - coalesce(size(left), 0)"))
    columns = [F.expr("array_join(left, '\n')").alias(old) if new == text else F.col(new).alias(old) for old, new in names.items()]
    return cleaned.select(*columns, *(["n_lines", "n_dropped"] if counts else []))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP10_SQL = """
WITH split AS (
  SELECT source, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) AS lines
  FROM documents WHERE text IS NOT NULL
), pages AS (
  SELECT DISTINCT source, list_sort(list_distinct(lines)) AS lines FROM split WHERE len(lines) > 0
), totals AS (
  SELECT source, count(*) AS host_pages FROM pages GROUP BY source
), hot AS (
  SELECT p.source, line, count(*) AS n FROM (SELECT source, unnest(lines) AS line FROM pages) p GROUP BY p.source, line
), dropped AS (
  SELECT hot.source, list(line) AS lines FROM hot JOIN totals ON hot.source IS NOT DISTINCT FROM totals.source
  WHERE n >= 5 AND n > 0.05 * host_pages OR n >= 3 AND n > 0.5 * host_pages GROUP BY hot.source
), result AS (
  SELECT doc_id, string_split(d.text, chr(10)) AS all_lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(dropped.lines, []), x)) AS kept
  FROM documents d LEFT JOIN dropped ON d.source IS NOT DISTINCT FROM dropped.source
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(all_lines), 0)::BIGINT AS n_lines,
  coalesce(len(all_lines) - len(kept), 0)::BIGINT AS n_dropped
FROM result
"""
