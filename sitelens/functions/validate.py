"""Validators: each maps a raw value to (value, dedup_value, metadata), or to null if it is rejected.

Expressions only; names need fold(), which callers compute once for all rows. Emails and phones accept a published
subset of what specialised libraries do:

- email: local part of 1 to 64 characters without dots at its ends or doubled, labels of 1 to 63 characters,
  at least two labels, the last ending in a letter and none of constants.SPECIAL_USE, 254 characters in all; no quoted local parts. Addresses
  with other than ASCII characters or with encoded labels go through international_email(), which callers compute once for all rows: local part in
  NFC, domain by the rules of IDNA 2003, shown in Unicode;
- phone: all calling codes in international form (+ or 00), and the national form of the crawl's region. Numbers of the regions in
  constants.PHONE_REGIONS are held against the form of their plan, others against the lengths of theirs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.functions import urls as U

VALIDATED = "struct<value string, dedup_value string, metadata map<string,string>>"


def _accepted(value: Column, key: Column, **metadata: Column) -> Column:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v)]
    of = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(value.alias("value"), key.alias("dedup_value"), of.cast("map<string,string>").alias("metadata"))


def email_kind(local: Column) -> Column:
    """role for a mailbox of an organisation, else other; of a folded local part."""
    roles = F.array(*[F.lit(r) for r in C.ROLE_LOCAL_PARTS])
    tokens = F.filter(F.split(local, "[^a-z0-9]+"), lambda x: x != "")
    return F.when(F.array_contains(roles, local) | F.arrays_overlap(tokens, roles), "role").otherwise("other")


_ATOM = "[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
#: What needs international_email().
BEYOND_ASCII = r"[^\x00-\x7f]|(?i:@(?:.*\.)?xn--)"


def email(raw: Column, international: Column | None = None) -> Column:
    """international: what international_email() says of the row's value."""
    value = F.lower(F.trim(raw))
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    ok = value.rlike(rf"^{_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+$") & ~value.rlike(BEYOND_ASCII)
    special = "|".join(C.SPECIAL_USE)
    ok = ok & (F.length(local) <= 64) & (F.length(value) <= 254) & domain.rlike("[a-z]$") & ~domain.rlike(rf"(?:^|\.)(?:{special})$") & ~domain.rlike(r"(?:^|\.)..--")
    ascii_only = F.when(ok, _accepted(value, value, email_kind=email_kind(local)))
    if international is None:
        return ascii_only
    shown = F.when(international.isNotNull(), _accepted(international, international, email_kind=email_kind(F.split_part(international, F.lit("@"), F.lit(1)))))
    return F.coalesce(shown, ascii_only)


_PLAIN_LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", re.ASCII)
_INTERNATIONAL_ATOM = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\u0080-\U0010ffff-]+")
_DOTS = re.compile("[.\u3002\uff0e\uff61]")


def international_address(raw: str | None) -> str | None:
    """The address as it is shown, or none."""
    local, at, domain = unicodedata.normalize("NFC", (raw or "").strip()).rpartition("@")
    atoms, labels = local.split("."), _DOTS.split(domain)
    unsafe = any(unicodedata.category(c)[0] in "CZ" for c in local + domain) or any(unicodedata.category(a[0])[0] == "M" for a in atoms if a)
    if not at or unsafe or len(local) > 64 or len(labels) < 2 or not all(map(_INTERNATIONAL_ATOM.fullmatch, atoms)):
        return None
    try:
        encoded = [label.encode("idna").decode().lower() for label in labels]
        decoded = [label.encode().decode("idna") for label in encoded]
    except UnicodeError:
        return None
    if not all(_PLAIN_LABEL.fullmatch(x) and (x[2:4] != "--" or x.startswith("xn--") and x != y) and y.strip("-") == y and y[2:4] != "--" for x, y in zip(encoded, decoded, strict=True)):
        return None
    shown = f"{local}@{'.'.join(decoded)}".lower()
    long = len(f"{local}@{'.'.join(encoded)}".encode()) > 254 or len(".".join(encoded)) > 253
    return None if long or encoded[-1] in C.SPECIAL_USE or not encoded[-1][-1].isalpha() and not encoded[-1].startswith("xn--") else shown


@F.pandas_udf(StringType())
def international_email(raw: pd.Series) -> pd.Series:
    return raw.map(international_address)


def numbering_plan() -> dict[str, tuple[int, int]]:
    """Calling codes with the least and most digits of their national numbers."""
    plan = {}
    for lengths, codes in C.CALLING_CODES.items():
        least, most = map(int, lengths.split("-"))
        for part in codes.split():
            first, _, last = part.partition("-")
            plan |= {str(code): (least, most) for code in range(int(first), int(last or first) + 1)}
    return plan


def prefix_pattern(words: Iterable[str]) -> str:
    """A pattern of exactly these words as the trie of their characters: each position is decided by one character."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        arms = [re.escape(c) + of(below) for c, below in sorted(node.items()) if c]
        if not arms:
            return ""
        return f"(?:{'|'.join(arms)}){'?' if '' in node else ''}"

    return of(trie)


def _constant(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def phone(raw: Column, region: str) -> Column:
    """Look-ups by calling code instead of an arm for each keep the plan small. region: one of constants.PHONE_REGIONS, or a calling code."""
    shown = F.trim(raw)
    digits = F.regexp_replace(F.regexp_replace(shown, "[^0-9+]", ""), "^00", "+")
    plan = numbering_plan()
    known = {code: f"^(?:{trunk})?({form})$" if trunk else f"^({form})$" for code, trunk, form in C.PHONE_REGIONS.values()}
    by_length = {code: rf"^({'' if code in C.LEADING_ZERO else '(?!0)'}\d{{{least},{most}}})$" for code, (least, most) in plan.items()}
    mobile = {C.PHONE_REGIONS[r][0]: f"^{start}" for r, start in C.MOBILE.items()}
    forms = by_length | known
    if region in C.PHONE_REGIONS:
        code, trunk, form = C.PHONE_REGIONS[region]
    else:
        code, trunk = (region, "0") if region in plan else ("", "")
        form = rf"(?!0)\d{{{plan[region][0]},{plan[region][1]}}}" if region in plan else "$^"
    abroad = F.regexp_extract(digits, rf"^\+({prefix_pattern(plan)})", 1)
    at_home = ~digits.startswith("+")
    of = F.when(at_home, F.lit(code)).otherwise(abroad)
    home = rf"^{trunk}({form})$" if trunk == "0" and region in C.PHONE_REGIONS else rf"^(?:{trunk})?({form})$"
    national = F.when(at_home, F.regexp_extract(digits, home, 1)).otherwise(
        F.call_function("regexp_extract", F.substring(digits, F.length(abroad) + 2, F.lit(20)), F.coalesce(F.try_element_at(_constant(forms), abroad), F.lit("($^)")), F.lit(1))
    )
    is_mobile = F.coalesce(F.regexp(national, F.try_element_at(_constant(mobile), of)), F.lit(False))
    kind = F.when(of == "1", "FIXED_LINE_OR_MOBILE").when(is_mobile, "MOBILE").when(of.isin(*known), "FIXED_LINE").otherwise("UNKNOWN")
    value = F.concat(F.lit("+"), of, national)
    return F.when(shown.rlike(r"^\(?[+0-9][0-9 \u00a0.()/\-]*$") & (national != "") & ~shown.rlike(_DATE), _accepted(value, value, number_type=kind))


#: What is written like a number but is a date, or a date with an hour.
_DATE = r"^(?:(?:0?[1-9]|[12]\d|3[01])([/.-])(?:0?[1-9]|1[0-2])\1(?:19|20)\d{2}|(?:19|20)\d{2}([/.-])(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01]))(?: \d{2})?$"


def postal_address(raw: Column) -> Column:
    value = T.collapse(raw)
    return F.when(F.length(value).between(6, 300) & value.rlike(r"\p{L}"), _accepted(value, T.address_key(value)))


def person_name(raw: Column, folded: Column) -> Column:
    value = T.collapse(raw)
    return F.when(F.length(value).between(1, 80) & ~value.rlike(r"\p{Nd}") & value.rlike(r"\p{L}"), _accepted(value, folded))


def organization_name(raw: Column, folded: Column) -> Column:
    value = T.collapse(raw)
    return F.when(F.length(value).between(1, 200), _accepted(value, folded))


def social_profile(raw: Column) -> Column:
    value = U.normalize_profile(T.collapse(raw))
    name = U.platform(T.collapse(raw))
    return F.when(name.isNotNull(), _accepted(value, F.lower(value), platform=name))


def pgp_key_url(raw: Column) -> Column:
    value = U.normalize_key_url(T.collapse(raw))
    return F.when(value.isNotNull(), _accepted(value, U.dedup_url(value)))


def french_vat_key_holds(body: Column) -> Column:
    """A numeric key must be (12 + 3 * (SIREN mod 97)) mod 97; others pass by format."""
    key, siren = F.substring(body, 1, 2), F.substring(body, 3, 20)
    expected = (F.lit(12) + 3 * (siren.try_cast("long") % 97)) % 97
    return F.when(key.rlike("^[0-9]{2}$"), key.try_cast("long") == expected).otherwise(True)


def luhn_holds(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def company_identifier(raw: Column, metadata: Column) -> Column:
    compact = F.upper(F.regexp_replace(raw, C.IDENTIFIER_NOISE, ""))
    country, body = F.substring(compact, 1, 2), F.substring(compact, 3, 20)
    formats = F.create_map(*[F.lit(x) for k, v in C.VAT_FORMATS.items() for x in (k, f"^(?:{v})$")])
    form = F.try_element_at(formats, country)
    is_vat = compact.rlike("^[A-Z]{2}[A-Z0-9]{2,13}$") & form.isNotNull()
    vat_ok = F.regexp(body, form) & ((country != "FR") | french_vat_key_holds(body))
    hinted = F.coalesce(F.try_element_at(metadata, F.lit("scheme")), F.lit("")) == "rcs"
    scheme = F.when(F.length(compact) == 14, "siret").when((F.length(compact) == 9) & hinted, "rcs").when(F.length(compact) == 9, "siren")
    french_ok = compact.rlike("^[0-9]+$") & scheme.isNotNull() & F.call_function("luhn_check", compact)
    tagged = lambda s: _accepted(compact, F.concat_ws(":", s, compact), scheme=s)
    return F.when(is_vat, F.when(vat_ok, tagged(F.lit("vat_eu")))).when(french_ok, tagged(scheme))


def technology(raw: Column) -> Column:
    value = T.collapse(raw)
    return F.when(F.length(value).between(1, 100), _accepted(value, F.lower(value)))


def validated(field: Column, raw: Column, metadata: Column, folded: Column, region: str, international: Column | None = None) -> Column:
    """The validator of each row's field; null for a field without one."""
    return (
        F.when(field == "email", email(raw, international))
        .when(field == "phone", phone(raw, region))
        .when(field == "postal_address", postal_address(raw))
        .when(field == "person_name", person_name(raw, folded))
        .when(field == "organization_name", organization_name(raw, folded))
        .when(field == "social_profile", social_profile(raw))
        .when(field == "pgp_key_url", pgp_key_url(raw))
        .when(field == "company_identifier", company_identifier(raw, metadata))
        .when(field == "technology", technology(raw))
    )
