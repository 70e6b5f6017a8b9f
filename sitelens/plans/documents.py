"""Queries over documents: emails and identifiers in prose, guards of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.operators import aggregate, extract
from sitelens.plans.registry import query
from sitelens.storage import table

COLLECTED = "TIMESTAMP '2024-01-01 00:00:00'"
ROLES = ", ".join(f"'{r}'" for r in C.ROLE_LOCAL_PARTS)
_ATOM = "[a-z0-9!#$%&''*+/=?^_`{|}~-]+"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
#: Accepted emails of documents: source_url, value, email_kind.
EMAILS_SQL = f"""
found AS (
  SELECT 'doc:' || lpad(doc_id::VARCHAR, 12, '0') AS source_url, unnest(regexp_extract_all(text, '{C.EMAIL.replace("'", "''")}')) AS raw_value
  FROM documents
), emails AS (
  SELECT source_url, raw_value, lower(trim(raw_value)) AS value, split_part(lower(trim(raw_value)), '@', 1) AS local FROM found
  WHERE regexp_full_match(lower(trim(raw_value)), '{_ATOM}(?:\\.{_ATOM})*@{_LABEL}(?:\\.{_LABEL})+')
    AND length(split_part(trim(raw_value), '@', 1)) <= 64 AND length(trim(raw_value)) <= 254
    AND NOT regexp_matches(split_part(trim(raw_value), '@', 2), '\\.[0-9]+$')
), kinds AS (
  SELECT *, CASE WHEN local IN ({ROLES}) OR list_has_any(string_split_regex(local, '[^a-z0-9]+'), [{ROLES}]) THEN 'role' ELSE 'other' END AS email_kind
  FROM emails
)"""


def prose(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Documents as parsed pages: url, fetched_at, visible_text."""
    docs = table(spark, sf_dir, "documents")
    return as_prose(docs if where is None else docs.where(where))


def as_prose(docs: DataFrame) -> DataFrame:
    url = F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return docs.select(url.alias("url"), F.expr(COLLECTED).alias("fetched_at"), T.collapse(F.col("text")).alias("visible_text"))


def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prose(spark, sf_dir, F.col("text").contains("@"))  # reaches the scan, unlike a filter on collapsed text
    return aggregate.accepted(extract.emails_in_text(rows))


@query(f"""WITH {EMAILS_SQL}
SELECT 'email' AS field, value, email_kind, 0.5::DOUBLE AS extraction_confidence, count(DISTINCT source_url)::INT AS page_support,
  count(*)::INT AS occurrence_count, min(source_url) AS first_seen_url
FROM kinds GROUP BY value, email_kind""")
def doc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.total_order(aggregate.findings(email_candidates(spark, sf_dir)))
    return found.select("field", "value", T.metadata_get(F.col("metadata"), "email_kind").alias("email_kind"), "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(f"WITH {EMAILS_SQL} SELECT email_kind, count(DISTINCT value) AS addresses, count(*) AS occurrences FROM kinds GROUP BY email_kind")
def doc_email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = email_candidates(spark, sf_dir).select("value", T.metadata_get(F.col("metadata"), "email_kind").alias("email_kind"))
    return rows.groupBy("email_kind").agg(F.count_distinct("value").alias("addresses"), F.count("*").alias("occurrences"))


@query(f"""WITH {EMAILS_SQL}
SELECT value, source_url, raw_value FROM (
  SELECT value, source_url, raw_value, row_number() OVER (PARTITION BY value ORDER BY source_url, raw_value) AS k FROM kinds
) WHERE k <= 10""")
def doc_email_top10_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.flatten(aggregate.findings(email_candidates(spark, sf_dir)))
    return rows.select("value", "source_url", "raw_value")


@query(f"WITH {EMAILS_SQL} SELECT value, min(source_url) AS first_seen_url FROM kinds GROUP BY value")
def doc_email_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.findings(email_candidates(spark, sf_dir)).select("value", "first_seen_url")


_SEP = "[ \\x{00a0}.\\x{2011}-]?"
_EDGE = "(?:^|[^0-9A-Za-z_\\p{L}\\p{Nd}])"


@query(f"""WITH numbers AS (
  SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9]{{3}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{3}}(?:{_SEP}[0-9]{{5}})?')), '[^0-9]', '', 'g') AS digits FROM documents
)
SELECT len(digits) AS length, count(*) AS candidates,
  count(*) FILTER (WHERE list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN (len(digits) - i) % 2 = 0 THEN digits[i]::INT
    ELSE (digits[i]::INT * 2) % 10 + (digits[i]::INT * 2) // 10 END)) % 10 = 0) AS valid
FROM numbers GROUP BY 1""")
def doc_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of nine or fourteen digits in prose, and how many hold the Luhn checksum that company numbers carry."""
    sep = C.SEPARATOR
    pattern = rf"[0-9]{{3}}{sep}[0-9]{{3}}{sep}[0-9]{{3}}(?:{sep}[0-9]{{5}})?"
    rows = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("raw"))
    rows = rows.select(F.regexp_replace("raw", "[^0-9]", "").alias("digits"))
    return rows.groupBy(F.length("digits").cast("long").alias("length")).agg(F.count("*").alias("candidates"), F.count_if(F.call_function("luhn_check", F.col("digits"))).alias("valid"))


_TWICE = "+".join(f"(substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) % 10 + (substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) // 10" for i in range(1, 9))


@query(f"""WITH d AS (SELECT 'doc:' || lpad(doc_id::VARCHAR, 12, '0') AS url, (10000000 + doc_id % 210 * 7919)::VARCHAR AS b FROM documents WHERE doc_id % 7 = 0),
s AS (SELECT url, b || ((10 - ({_TWICE}) % 10) % 10)::VARCHAR AS siren FROM d), ids AS (SELECT url, siren AS value, 'siren' AS scheme FROM s
  UNION ALL SELECT url, 'FR' || lpad(((12 + 3 * (siren::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || siren, 'vat_eu' FROM s)
SELECT value, scheme, count(DISTINCT url)::INT AS page_support, count(*)::INT AS occurrence_count, min(url) AS first_seen_url FROM ids GROUP BY value, scheme""")
def doc_company_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company identifiers in all prose: every seventh document gets two at its end, a number without its check digit, and a key that does not hold."""
    base = (10_000_000 + F.col("doc_id") % 210 * 7919).cast("string")
    siren = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(base, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    wrong = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(base, c.cast("string"))), lambda x: ~F.call_function("luhn_check", x)), 1)
    key = lambda k: F.lpad(((k + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")
    stated = F.concat(F.lit(". SIREN "), siren, F.lit(" (not "), wrong, F.lit("), VAT FR"), key(F.lit(12)), siren, F.lit(" and FR"), key(F.lit(13)), siren, F.lit("."))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, stated).otherwise("")))
    found = aggregate.findings(aggregate.accepted(extract.text_heuristics(as_prose(docs)).where("field = 'company_identifier'")))
    return found.select("value", T.metadata_get(F.col("metadata"), "scheme").alias("scheme"), "page_support", "occurrence_count", "first_seen_url")


@query("""SELECT value, 'FIXED_LINE_OR_MOBILE' AS number_type, count(DISTINCT doc_id)::INT AS page_support, count(*)::INT AS occurrence_count FROM (
  SELECT doc_id, '+1' || regexp_replace(unnest(regexp_extract_all(text, '\\+1 (\\([2-9]\\d{2}\\) [2-9]\\d{2}-\\d{4})(?:[^\\p{Latin}\\p{Sc}%\\w]|$)', 1)), '[^0-9]', '', 'g') AS value FROM documents) GROUP BY value""")
def doc_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers in prose that a region accepts in international form."""
    rows = extract.text_heuristics(prose(spark, sf_dir)).where("field = 'phone'")
    found = aggregate.findings(aggregate.accepted(rows, "US"))
    return found.select("value", T.metadata_get(F.col("metadata"), "number_type").alias("number_type"), "page_support", "occurrence_count")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS guarded FROM documents")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.formula_guard(F.col("text")).alias("guarded"))


_MD = "text"
for _plain, _escaped in (("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("<", "&lt;"), (">", "&gt;"), ("[", "\\["), ("]", "\\]")):
    _MD = f"replace({_MD}, '{_plain}', '{_escaped}')"
_ENDS = "(?:\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_MD}, '{_ENDS}$', ''), '{_ENDS}', ' ', 'g') AS cell FROM documents")
def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, replace(replace(replace(text, chr(9), ' '), chr(13), ' '), chr(10), ' ') || chr(9) || coalesce(lang, '') AS line FROM documents")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tsv_line([F.col("text"), F.col("lang")]).alias("line"))


@query(f"""WITH {EMAILS_SQL}, capped AS (
  SELECT *, row_number() OVER (PARTITION BY value ORDER BY source_url, raw_value) AS k, count(*) OVER (PARTITION BY value) AS occurrence_count,
    min(source_url) OVER (PARTITION BY value) AS first_seen_url FROM kinds
), support AS (SELECT value, count(DISTINCT source_url) AS page_support FROM kinds GROUP BY value)
SELECT 'email' AS field, value, email_kind, 0.5::DOUBLE AS extraction_confidence, page_support::INT AS page_support, occurrence_count::INT AS occurrence_count, first_seen_url,
  source_url, 'text_heuristic' AS extraction_layer, raw_value, '2024-01-01T00:00:00Z' AS collected_at
FROM capped JOIN support USING (value) WHERE k <= 10""")
def findings_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export's rows of one finding and provenance entry each."""
    rows = aggregate.flatten(aggregate.findings(email_candidates(spark, sf_dir)))
    return rows.select(
        "field", "value", T.metadata_get(F.col("metadata"), "email_kind").alias("email_kind"), "extraction_confidence", "page_support", "occurrence_count",
        "first_seen_url", "source_url", "extraction_layer", "raw_value", T.rfc3339(F.col("collected_at")).alias("collected_at"),
    )


@query("SELECT lower(strip_accents(regexp_replace(c_mktsegment || ' É' || n_name, '\\s+', ' ', 'g'))) AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of accented, mixed-case names by their folded key; folded once for each distinct name, not for each row."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = rows.groupBy(F.concat("c_mktsegment", F.lit(" É"), "n_name").alias("name")).agg(F.count("*").alias("n"))
    return names.groupBy(T.fold(F.col("name")).alias("key")).agg(F.sum("n").alias("n"))
