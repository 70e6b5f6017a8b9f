"""URL algebra. The canonical URL is the key of every table.

canonicalize() is the full rule as an Arrow-batched UDF (IDNA and percent-encoding have no built-in expression);
canonical_ascii() is its twin inside code generation for absolute ASCII URLs without escapes.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitelens import constants as C
from sitelens.functions.text import fold_text

CANONICAL = StructType([StructField(n, StringType()) for n in ("url", "reason", "detail")])
_TRACKED = frozenset(C.DROPPED_PARAMETERS)
_HIGH_VALUE = re.compile(C.HIGH_VALUE_PATH)


def _path(path: str) -> str:
    kept: list[str] = []
    for part in filter(None, path.split("/")):
        if part == "..":
            del kept[-1:]
        elif part != ".":
            plain = unquote(part, errors="surrogateescape")
            kept.append(quote(plain, safe=C.SEGMENT_SAFE, errors="surrogateescape"))
    return "/" + "/".join(kept) + ("/" if kept and path.endswith("/") else "")


def _pairs(query: str) -> list[tuple[str, str]]:
    return sorted(p for p in parse_qsl(query, keep_blank_values=True) if p[0].lower() not in _TRACKED)


def _trap(url: str, path: str, query: str) -> str | None:
    """Why the shape is that of a spider trap."""
    parts = [p for p in path.split("/") if p]
    if len(parts) > C.MAX_SEGMENTS:
        return f"{len(parts)} path segments, over {C.MAX_SEGMENTS}"
    if any(parts.count(p) > C.MAX_REPEATS for p in set(parts)):
        return f"a path segment comes more than {C.MAX_REPEATS} times"
    if query.count("&") >= C.MAX_PARAMETERS:
        return f"over {C.MAX_PARAMETERS} query parameters"
    return f"{len(url)} characters, over {C.MAX_URL}" if len(url) > C.MAX_URL else None


def canonical(raw: str | None, base: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(url, None, None), or (what may be reported, reason, detail)."""
    text = (raw or "").strip()
    if not text:
        return raw, "url_rejected_shape", "empty"
    try:
        text = urljoin(base, text) if base else text
        parts = urlsplit(text)
        scheme, host = parts.scheme.lower(), (parts.hostname or "").rstrip(".")
    except ValueError as e:
        return text, "url_rejected_shape", str(e)
    if scheme not in C.SCHEMES:
        return text, "unsupported_scheme", scheme or "none"
    try:
        port = parts.port
    except ValueError:
        port = -1
    if parts.username or parts.password:
        shown = host.lower() if port in (None, -1, C.DEFAULT_PORTS[scheme]) else f"{host.lower()}:{port}"
        return urlunsplit((scheme, shown, parts.path, parts.query, "")), "credentials_in_url", "userinfo"
    if not host:
        return text, "url_rejected_shape", "no host"
    try:
        host = host.lower() if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return text, "url_rejected_shape", "host is not encodable"
    if port == -1:
        return text, "url_rejected_shape", "unusable port"
    if port is not None and port != C.DEFAULT_PORTS[scheme]:
        host = f"{host}:{port}"
    path, query = _path(parts.path), urlencode(_pairs(parts.query), quote_via=quote)
    url = urlunsplit((scheme, host, path, query, ""))
    trap = _trap(url, path, query)
    return (url, "url_rejected_shape", trap) if trap else (url, None, None)


@F.pandas_udf(CANONICAL)
def canonicalize(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Canonical URL of raw, resolved against base (null: none), or why there is none."""
    return pd.DataFrame([canonical(r, b) for r, b in zip(raw, base, strict=True)], columns=["url", "reason", "detail"])


def normalize_target(entered: Column) -> Column:
    """What an operator typed: a bare domain means https."""
    value = F.trim(entered)
    return canonicalize(F.when(F.instr(value, "//") > 0, value).otherwise(F.concat(F.lit("https://"), value)), F.lit(None).cast("string"))


def target_url(entered: str) -> str:
    value = entered.strip()
    url, reason, detail = canonical(value if "//" in value else f"https://{value}") if value else (None, "empty", "no target")
    if reason:
        raise ValueError(f"{entered!r} is no target: {detail}")
    return url


# -- built-in expressions -----------------------------------------------------------------------------------------
def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(.*?)(?::\d*)?$", 1))


def port(url: Column) -> Column:
    """The explicit port unless it is the scheme's own, else null."""
    number = F.nullif(F.regexp_extract(authority(url), r":(\d+)$", 1), F.lit("")).cast("int")
    own = F.when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)
    return F.nullif(number, own)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def has_userinfo(url: Column) -> Column:
    return authority(url).contains("@")


def without_userinfo(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z]+://)[^/@]*@", "$1")


def normal_path(p: Column) -> Column:
    """Dot segments resolved, runs of slashes made one, a final slash kept."""
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(p.endswith("/") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def kept_parameters(q: Column) -> Column:
    """Sorted name=value pairs without tracking and session parameters."""
    dropped = F.array(*[F.lit(x) for x in C.DROPPED_PARAMETERS])
    kept = F.filter(F.split(q, "&"), lambda x: (x != "") & ~F.array_contains(dropped, F.lower(F.split_part(x, F.lit("="), F.lit(1)))))
    split = F.transform(kept, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(split), lambda s: s["x"])


def canonical_ascii(url: Column) -> Column:
    """The canonical form of an absolute ASCII URL without percent escapes."""
    q = F.array_join(kept_parameters(query(url)), "&")
    where = F.concat_ws(":", F.rtrim(host(url), F.lit(".")), port(url).cast("string"))
    return F.concat(scheme(url), F.lit("://"), where, normal_path(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def scope_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def in_scope(url: Column, scope: Column | str, include_subdomains: Column | bool, scope_port: Column | None = None) -> Column:
    """Confinement goes down, never up: the host itself, its www twin or, if wanted, its subdomains."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    sub = F.lit(include_subdomains) if isinstance(include_subdomains, bool) else include_subdomains
    same_port = port(url).eqNullSafe(F.lit(None).cast("int") if scope_port is None else scope_port)
    below = F.when(sub, host(url).endswith(F.concat(F.lit("."), scope))).otherwise(host(url) == F.concat(F.lit("www."), scope))
    return scheme(url).isin(*C.SCHEMES) & same_port & ((host(url) == scope) | below)


def shape_problem(url: Column) -> Column:
    """Which guard against spider traps the URL breaks, else null; in the order of the guards."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    most = F.array_max(F.transform(F.array_distinct(parts), lambda s: F.size(F.filter(parts, lambda x: x == s))))
    q = query(url)
    return (
        F.when(F.size(parts) > C.MAX_SEGMENTS, "segments")
        .when(F.coalesce(most, F.lit(0)) > C.MAX_REPEATS, "repeats")
        .when((q != "") & (F.size(F.split(q, "&")) > C.MAX_PARAMETERS), "parameters")
        .when(F.length(url) > C.MAX_URL, "length")
    )


def has_skipped_extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"(\.[^./]*)$", 1).isin(*C.SKIPPED_EXTENSIONS)


def is_high_value(folded_path: Column) -> Column:
    """On the accent-folded, lower-cased path."""
    return folded_path.rlike(C.HIGH_VALUE_PATH)


def is_high_value_url(url: str) -> bool:
    return _HIGH_VALUE.search(fold_text(urlsplit(url).path) or "") is not None


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.lit("/robots.txt"))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/]*)", 1)


def dedup_url(url: Column) -> Column:
    """Host without www. and path without final slashes, lower-cased."""
    return F.lower(F.concat(F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), F.rtrim(path(url), F.lit("/"))))


def normalize_profile(url: Column) -> Column:
    """Comparable form of a profile URL; the path keeps its case."""
    u = F.trim(url)
    number = F.nullif(F.regexp_extract(authority(u), r":(\d+)$", 1), F.lit(""))
    q = F.array_join(kept_parameters(query(u)), "&")
    where = F.concat_ws(":", F.regexp_replace(host(u), r"^www\.", ""), number)
    return F.concat(scheme(u), F.lit("://"), where, F.rtrim(path(u), F.lit("/")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def normalize_key_url(url: Column) -> Column:
    """Scheme and authority lower-cased, the rest as it is; null if it is no absolute web URL."""
    ok = scheme(url).isin(*C.SCHEMES) & (authority(url) != "")
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    return F.when(ok, F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), rest))


def platform(url: Column) -> Column:
    """Platform of a profile URL, by the listed host that it is or is below of; null for none or a bare root.

    Every listed host has two labels, so the last two labels of the URL's host are the key of one look-up.
    """
    u = F.trim(url)
    names = F.create_map(*[F.lit(x) for pair in C.PLATFORMS.items() for x in pair])
    found = F.try_element_at(names, F.substring_index(host(u), ".", -2))
    return F.when(scheme(u).isin(*C.SCHEMES) & (F.trim(path(u), F.lit("/")) != ""), found)


def effective_interval(*seconds: Column) -> Column:
    """The slowest of all wishes, never below the floor."""
    return F.greatest(*[F.coalesce(s.cast("double"), F.lit(C.INTERVAL_FLOOR)) for s in seconds], F.lit(C.INTERVAL_FLOOR))
