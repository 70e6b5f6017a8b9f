"""Secret scans with structural confirmation.

Patterns find assignments, access keys and long hexadecimal runs. Candidates that claim to hold an encoded key are
decoded from base64 or hex and parsed before they are reported: DER private keys by their nested lengths and
version fields, OpenSSH keys by their magic and length-prefixed strings, signed tokens by their JSON header and claims,
PEM blocks by what their body decodes to. Line ends may be escaped, as in JSON; base64 that is wrapped in lines of one
length is joined before it is decoded, outside PEM blocks too. Unconfirmed candidates add nothing; the patterns' own spans always stay.

Spans are in code points, ends exclusive. Each text is scanned whole, on its own; nothing is shuffled or collected.

Defined cases: null and empty texts have no spans; equal starts are ordered by kind as in KINDS; repeated rows repeat
results; an empty table gives no rows; columns that are not needed are ignored; a long text takes time in proportion to
its length, whatever is in it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import LOWER, as_bytes, ship, table

#: Kinds in the order that breaks ties, base kinds first.
KINDS = ("assign", "access", "hex", "pem", "token", "key")
BASE = KINDS[:3]
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ENCODED_HEX = re.compile(rb"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){32,}+(?![0-9A-Za-z])")
ENCODED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: The shortest header is {"alg":""} and the shortest claims {}, which are 14 and 3 characters of base64.
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)\.([A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]*+)")
PEM_MARK = re.compile(rb"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
#: A header line of a PEM block, and the headers of an encrypted one.
PEM_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9-]*:")
PEM_CIPHER = re.compile(rb"DEK-Info:[\x20\t]*[A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,}")
ESCAPED_END = re.compile(rb"(?<!\\)\\++[rn]")
#: A line end, as such or escaped, with the white space around it; and lines of base64 in a row.
BREAK = re.compile(rb"[\x20\t]*+(?:\r?\n|(?:\\++r)?\\++n)[\x20\t]*+")
WRAPPED = re.compile(rb"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]{32,}+(?:" + BREAK.pattern + rb"[A-Za-z0-9+/_-]++)++={0,2}")
#: No encoded candidate is shorter than this many bytes without white space.
SHORTEST = 17
OPENSSH = b"openssh-key-v1\0"


def decoded(text: bytes) -> bytes:
    """Bytes of a base64 text in either alphabet, padded or not; empty if it is none."""
    text = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill `data` exactly; None if lengths do not nest."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None  # DER wants the shortest form
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_private_key(data: bytes) -> bool:
    """A DER private key: PKCS#1, SEC 1, PKCS#8 plain or encrypted."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der_items(outer[0][1])
    if not fields or len(fields) < 2:
        return False
    tags = [t for t, _ in fields]
    if tags[0] == 0x02 and len(fields[0][1]) == 1:
        version = fields[0][1][0]
        if version in (0, 1) and tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:  # PKCS#8
            return bool(inner := der_items(fields[1][1])) and inner[0][0] == 0x06
        if version == 1 and tags[1] == 0x04:  # SEC 1
            return all(t in (0xA0, 0xA1) for t in tags[2:])
        return version in (0, 1) and len(tags) >= 6 and set(tags[1:9]) == {0x02}  # PKCS#1, DSA
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return bool(inner := der_items(fields[0][1])) and inner[0][0] == 0x06
    return False


def is_openssh_key(data: bytes) -> bool:
    """Magic, then cipher, key derivation and its options, a count, and as many public keys and one private part."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        value, at = (data[at + 4 : end], end) if end <= len(data) else (None, at)
        return value

    if any(take() is None for _ in range(3)) or at + 4 > len(data):
        return False
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= n <= 16 and all(take() is not None for _ in range(n + 1))


def is_key(data: bytes) -> bool:
    return is_openssh_key(data) or is_private_key(data)


def is_token(header: bytes, claims: bytes) -> bool:
    try:
        head, body = json.loads(decoded(header)), json.loads(decoded(claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def wrapped_keys(run: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the keys in lines of base64: lines of one length, then perhaps a shorter one."""
    lines, at = [], 0
    for m in BREAK.finditer(run):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(run)))
    first = 0
    while first < len(lines):
        width = lines[first][1] - lines[first][0]
        after = first + 1
        while after < len(lines) and lines[after][1] - lines[after][0] == width:
            after += 1
        ends = [after]
        if after < len(lines) and lines[after][1] - lines[after][0] < width:
            ends.insert(0, after + 1)
        for end in ends:
            if end - first > 1 and is_key(decoded(b"".join(run[a:b] for a, b in lines[first:end]))):
                yield lines[first][0], lines[end - 1][1]
                after = end
                break
        first = after


def is_pem_body(body: bytes) -> bool:
    """A key in base64 under header lines, or whole cipher blocks where the headers say that it is encrypted."""
    lines = [x.strip() for x in ESCAPED_END.sub(b"\n", body).replace(b"\\/", b"/").splitlines()]
    data = decoded(b"".join(b"".join(x for x in lines if not PEM_HEADER.match(x)).split()))
    if any(PEM_CIPHER.match(x) for x in lines):
        return len(data) >= 32 and len(data) % 8 == 0
    return is_key(data)


def pem_blocks(raw: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of confirmed blocks: an END mark closes the last BEGIN mark before it, if that has its label."""
    last = None
    for m in PEM_MARK.finditer(raw):
        if m[1] == b"BEGIN":
            last = m
        elif last and last[2] == m[2]:
            if is_pem_body(raw[last.end() : m.start()]):
                yield last.start(), m.end()
            last = None


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans in bytes, sorted."""
    spans: set[tuple[int, int, int]] = set()
    low = raw.translate(LOWER)
    if any(w in low for w in WORDS):
        spans |= {(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8}
    if b"AKIA" in raw:
        spans |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16}
    if b"PRIVATE KEY-----" in raw:
        spans |= {(a, 3, b) for a, b in pem_blocks(raw)}
    if max(map(len, raw.split()), default=0) >= SHORTEST:
        spans |= {(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= 32} if _long_hex(raw) else set()
        for m in TOKEN.finditer(raw) if raw.count(b".") > 1 else ():
            if is_token(m[1], m[2]):
                spans.add((m.start(), 4, m.end()))
        keys = [m.span() for m in ENCODED.finditer(raw) if is_key(decoded(m[0]))]
        keys += [m.span() for m in ENCODED_HEX.finditer(raw) if is_key(bytes.fromhex(m[0].decode()))]
        keys += [(m.start() + a, m.start() + b) for m in WRAPPED.finditer(raw) for a, b in wrapped_keys(m[0])]
        blocks = sorted((a, b) for a, k, b in spans if k == 3)
        for a, b in keys:
            k = bisect.bisect_right(blocks, (a, len(raw))) - 1  # blocks lie apart
            if k < 0 or blocks[k][1] < b:  # a block's own key is told by the block
                spans.add((a, 5, b))
    return sorted(spans)


_LONG_HEX = re.compile(rb"[0-9a-f]{32}")


def _long_hex(raw: bytes) -> bool:
    return _LONG_HEX.search(raw) is not None


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points, in one pass over the text."""
    if not spans or raw.isascii():
        return spans
    at, seen, places = 0, 0, {}
    for place in sorted({x for a, _, b in spans for x in (a, b)}):
        seen += len(raw[at:place].decode("utf-8", "replace"))
        at, places[place] = place, seen
    return [(places[a], k, places[b]) for a, k, b in spans]


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document: counts by kind, and spans as kind:start:end, comma-joined."""
    ship(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in as_bytes(batch.column(1)):
                spans = in_code_points(raw or b"", scan(raw or b""))
                told = [(KINDS[k], f"{KINDS[k]}:{a}:{b}") for a, k, b in spans]
                base = ",".join(s for k, s in told if k in BASE)
                kinds = [k for k, _ in told]
                rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in told)])
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", text).mapInArrow(apply, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
