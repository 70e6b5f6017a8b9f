"""What a site says of itself: sitemaps and security.txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.functions import urls as U


def _unescaped(c: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def sitemap_kind(text: Column) -> Column:
    """urlset, sitemapindex, or null for neither."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)<(?:\w+:)?(urlset|sitemapindex)[\s>]", 1)), F.lit(""))


def locations(text: Column, most: int = C.MAX_LOCATIONS) -> Column:
    """The <loc> values in order, white space collapsed, empty ones dropped, at most `most`; also of bad XML."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?loc(?:\s[^>]*)?>(.*?)</(?:\w+:)?loc\s*>"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: T.collapse(_unescaped(x))), lambda x: x != ""), 1, most)


def sitemap_locations(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with kind, status and locations; over the size cap or neither kind: too_large, parse_error."""
    status = F.when(F.octet_length(text) > C.MAX_SITEMAP, "too_large").when(F.col("kind").isNull(), "parse_error")
    rows = documents.withColumn("kind", sitemap_kind(F.col(text))).withColumn("status", status)
    return rows.withColumn("locations", F.when(F.col("status").isNull(), locations(F.col(text))))


def sitemap_urls(declared: DataFrame, documents: DataFrame) -> DataFrame:
    """(url, via), and site: what declared sitemaps list. An index is followed one level; at most five documents of a site are read.

    declared: (url, at) in order, and site where several sites are read at once; documents: (url, text). Second-level
    indexes list nothing.
    """
    several = "site" in declared.columns
    declared = declared if several else declared.withColumn("site", F.lit(""))
    read = sitemap_locations(documents).where("status IS NULL").select(F.col("url").alias("_doc"), "kind", "locations")
    first = declared.join(read, F.col("url") == F.col("_doc")).select("site", F.lit(0).alias("level"), F.col("at").cast("long").alias("at"), "_doc", "kind", "locations")
    below = first.where("kind = 'sitemapindex'").select("site", "at", F.posexplode("locations").alias("k", "_next"))
    second = below.join(read, F.col("_next") == F.col("_doc")).select("site", F.lit(1).alias("level"), (F.col("at") * C.MAX_LOCATIONS + F.col("k")).alias("at"), "_doc", "kind", "locations")
    both = first.unionByName(second)
    once = both.withColumn("_k", F.row_number().over(Window.partitionBy("site", "_doc").orderBy("level", "at"))).where("_k = 1")
    read_ones = once.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("level", "at", "_doc"))).where(F.col("_k") <= C.MAX_SITEMAPS)
    return read_ones.where("kind = 'urlset'").select("site", F.col("_doc").alias("via"), F.explode("locations").alias("url")).select("url", "via", *(["site"] if several else []))


def security_txt(documents: DataFrame, text: str = "text") -> DataFrame:
    """Candidates of layer well_known from documents (url, text, fetched_at), with the RFC's limits.

    A document over a limit, or without Contact, gives nothing; see security_txt_status().
    """
    ok = documents.where(security_txt_status(F.col(text)).isNull())
    lines = ok.select("url", "fetched_at", F.posexplode(F.split(text, r"\r\n|[\r\n]")).alias("seq", "line"))
    at = F.instr("line", ":")
    lines = lines.where(at > 0).select("url", "fetched_at", "seq", F.lower(F.trim(F.expr("left(line, instr(line, ':') - 1)"))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    lines = lines.where("value <> '' AND key IN ('contact', 'encryption')").withColumn("platform", U.platform(F.col("value")))
    low = F.lower("value")
    field = (
        F.when(F.col("key") == "encryption", "pgp_key_url")
        .when(low.startswith("mailto:"), "email")
        .when(low.startswith("tel:"), "phone")
        .when(F.col("platform").isNotNull(), "social_profile")
    )
    metadata = F.when(field == "social_profile", F.create_map(F.lit("platform"), F.col("platform"))).otherwise(F.expr("CAST(map() AS map<string,string>)"))
    raw = F.when(field.isin("email", "phone"), T.strip_scheme(F.col("value"))).otherwise(F.col("value"))
    return lines.select(
        field.alias("field"), F.trim(raw).alias("raw_value"), F.col("url").alias("source_url"), F.col("fetched_at").alias("collected_at"),
        F.lit("well_known").alias("extraction_layer"), metadata.alias("metadata"), "seq",
    ).where("field IS NOT NULL")


def security_txt_status(text: Column) -> Column:
    """too_large or parse_error for a document that breaks a limit or names no contact, else null."""
    lines = F.split(text, r"\r\n|[\r\n]")
    long_field = F.exists(lines, lambda x: (F.length(x) > C.MAX_SECURITY_FIELD) & x.rlike(r"(?i)^\s*(contact|encryption)\s*:\s*\S"))
    contact = F.exists(lines, lambda x: x.rlike(r"(?i)^\s*contact\s*:\s*\S"))
    return (
        F.when(F.octet_length(text) > C.MAX_SECURITY_TXT, "too_large")
        .when(F.size(lines) > C.MAX_SECURITY_LINES, "too_large")
        .when(long_field, "too_large")
        .when(~contact, "parse_error")
    )


def seeds(target_url: str, declared: list[str] | None = None) -> list[tuple[str, str]]:
    """(url, kind) that a run asks for besides its target: security.txt, then sitemaps or the default one."""
    found = [(U.canonical("/.well-known/security.txt", target_url)[0], "security_txt")]
    for raw in declared or ["/sitemap.xml"]:
        url, reason, _ = U.canonical(raw, target_url)
        if not reason:
            found.append((url, "sitemap"))
    return found
