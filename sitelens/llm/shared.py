"""What several operators of this subpackage need: words, their hashes, and the library's shared storage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.storage import shared_dir, ship, stored, table

__all__ = ["LOWER", "LOWER_ALNUM", "WordHashes", "as_bytes", "aside", "chunks", "flat_words", "mounted", "renamed", "save", "shared_dir", "shingle_hashes", "ship", "stored", "table"]

#: Bytes of text that a Python worker breaks into words at once.
CHUNK_BYTES = 4 << 20
#: Words whose hashes a worker keeps; the table starts anew beyond it.
KEPT_WORDS = 400_000
#: Lower-cases A-Z, leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is neither letter nor digit becomes a space.
LOWER_ALNUM = bytes(
    c if c >= 128 else (c + 32 if 65 <= c <= 90 else (c if chr(c).isalnum() else 32)) for c in range(256)
)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1 and so on, so that no column of an operator's own can clash; and the new name of each."""
    new = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def renamed(names: dict[str, str]) -> list[Column]:
    """Columns that give `aside` its names back."""
    return [F.col(new).alias(old) for old, new in names.items()]


def mounted(path: str) -> str:
    """The path of a folder that workers can map files of."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"arrays are memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name of its own, then rename it: a task that runs again replaces the file by an equal one."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, values)
    os.replace(own, f"{folder}/{name}.npy")


class WordHashes(dict):
    """XXH64 of each word, computed once for as long as it is kept."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each string, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch so that each part has about `most` bytes of text; null is empty."""
    texts = [x or b"" for x in as_bytes(batch.column(batch.schema.get_field_index(column)))]
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def flat_words(texts: list[bytes], hashes: WordHashes, fold: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and where each text begins (and the last ends).

    Words are runs of bytes other than space, tab, newline, vertical tab, form feed, return.
    """
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = (text.translate(fold) if fold else text).split()
        parts.append(hashes.of(words))
        starts[i + 1] = starts[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def shingle_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of `size` words that begins at each word, and the indexes where a whole run lies in its text."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    return h, at
