"""Text functions as column expressions; only fold() needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelens import constants as C


def collapse(c: Column) -> Column:
    """White space of any script becomes single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_text(value: str | None) -> str | None:
    if value is None:
        return None
    plain = "".join(x for x in unicodedata.normalize("NFKD", value) if not unicodedata.combining(x))
    return " ".join(plain.split()).lower()


@F.pandas_udf(StringType())
def fold(values: pd.Series) -> pd.Series:
    """Without accents, case and extra white space, for keys only."""
    return values.map(fold_text)


def ascii_fold(c: Column) -> Column:
    """fold() for values that are ASCII, inside code generation."""
    return F.lower(collapse(c))


def address_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def strip_scheme(c: Column) -> Column:
    """Drop one mailto: or tel: prefix."""
    return F.regexp_replace(F.trim(c), "^(?i)(mailto|tel):", "")


def normalize_property(c: Column) -> Column:
    """Comparable form of a schema.org name: what follows the last slash and hash."""
    return F.lower(F.trim(F.substring_index(F.substring_index(c, "/", -1), "#", -1)))


def join_address(components: dict[str, Column]) -> Column:
    """Address parts in their fixed order, empty ones skipped."""
    parts = [F.nullif(collapse(components[k]), F.lit("")) for k in C.ADDRESS_COMPONENTS if k in components]
    return F.concat_ws(", ", *parts)


def formula_guard(c: Column) -> Column:
    """Cells that a spreadsheet would run get an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def markdown_cell(c: Column) -> Column:
    """Safe inside a table: markup escaped, line ends to spaces."""
    for plain, escaped in (("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("<", "&lt;"), (">", "&gt;"), ("[", "\\["), ("]", "\\]")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    ends = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029])"
    return F.regexp_replace(F.regexp_replace(c, ends + r"\z", ""), ends, " ")


def tsv_cell(c: Column) -> Column:
    return F.translate(c, "\t\r\n", "   ")


def tsv_line(columns: list[Column]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(tsv_cell(c.cast("string")), F.lit("")) for c in columns])


def rfc3339(c: Column) -> Column:
    """In UTC, whatever the time zone of the session."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(c: Column) -> Column:
    return F.to_timestamp(c)


def days_remaining(created_at: Column, retention_days: Column, now: Column) -> Column:
    """Whole days until a run expires, rounded down; negative after."""
    seconds = F.unix_timestamp(created_at) + retention_days.cast("long") * 86400 - F.unix_timestamp(now)
    return F.floor(seconds / 86400).cast("long")


def is_expired(created_at: Column, retention_days: Column, now: Column) -> Column:
    return created_at + F.make_dt_interval(retention_days.cast("int")) <= now


def retention_text(days: Column, expired: Column) -> Column:
    return F.when(expired, "expired").when(days == 1, "1 day left").otherwise(F.format_string("%d days left", days))


def format_elapsed(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def format_size(size: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB with one decimal."""
    out = F.format_string("%d B", size.cast("long"))
    for unit, power in (("KiB", 10), ("MiB", 20), ("GiB", 30)):
        out = F.when(size >= 1 << power, F.format_string(f"%.1f {unit}", size / float(1 << power))).otherwise(out)
    return out


def percent(done: Column, total: Column) -> Column:
    """At most 100, rounded half to even; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.bround(100.0 * done / total))).otherwise(0).cast("int")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def new_run_id() -> Column:
    return F.concat(F.lit("r-"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(8)))


def user_agent(token: str, version: str, project_url: str, contact: str) -> str:
    """An honest identification; refuses anything that reads like a browser."""
    text = f"{token}/{version} (+{project_url}; contact: {contact})"
    if found := next((b for b in C.BROWSER_TOKENS if b.lower() in text.lower()), None):
        raise ValueError(f"user agent {text!r} contains the browser token {found!r}")
    return text


def is_honest_agent(c: Column) -> Column:
    return ~c.rlike("(?i)" + "|".join(C.BROWSER_TOKENS))


def metadata_get(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def attribute_join(values: Column) -> Column:
    return F.concat_ws(" ", values)


def css_classes(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(value), r"\s+"), lambda x: x != ""))
