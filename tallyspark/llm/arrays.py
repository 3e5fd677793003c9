"""Byte-level helpers shared by the text operators: word splitting and 64-bit hashes as numpy arrays.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D, which for UTF-8 text
are the matches of ``[^\\x20\\x09-\\x0D]+``. Work is cut into blocks of a quarter
of a megabyte, so that memory stays bounded however long a text or a batch is.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = b" \t\n\v\f\r"
BLOCK = 1 << 18
#: Rows of one Arrow batch: whole texts travel in it, so it is kept small.
BATCH_ROWS = 500

_LOWER = bytes(range(256)).translate(bytes.maketrans(SPACE + bytes(range(65, 91)), b" " * 6 + bytes(range(97, 123))))
_PLAIN = bytes(range(256)).translate(bytes.maketrans(SPACE, b" " * 6))
#: As _LOWER; what is ASCII and no letter counts as space too.
LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in _LOWER)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None


def release() -> None:
    """Gives freed memory back: workers stay between tasks, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def as_lower_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of the texts in lower case, letters beyond ASCII included."""
    return [None if t is None else t.lower().encode() for t in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 1024)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
        with np.errstate(over="ignore"):
            for key, base in (("up", _MULTIPLIER), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, from one running sum."""
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_blocks(texts: list[bytes], gap: bytes = b" ") -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Blocks of texts joined by ``gap``: the bytes, the texts' numbers and where each begins; a long text is cut at spaces."""
    parts: list[bytes] = []
    numbers: list[int] = []
    begins: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > BLOCK:
                cut = text.rfind(b" ", at, at + BLOCK)
                cut = cut if cut > at else text.find(b" ", at + BLOCK)
                end = cut + 1 if cut > 0 else end
            if size and size + end - at > BLOCK:
                yield gap.join(parts), numbers, begins
                parts, numbers, begins, size = [], [], [], 0
            parts.append(text[at:end])
            numbers.append(k)
            begins.append(size)
            size += end - at + len(gap)
            at = max(end, 1)
    if parts:
        yield gap.join(parts), numbers, begins


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; other white space than 0x20 has been mapped to it."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = data != 32
    change = np.flatnonzero(np.diff(inside))
    return change[::2], change[1::2]


def word_blocks(texts: list[bytes | None], table: bytes = _LOWER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its bytes, the words' starts and ends in it, and the number of each word's text."""
    for block, numbers, begins in text_blocks([(t or b"").translate(table) for t in texts]):
        data = np.frombuffer(block, np.uint8)
        starts, ends = word_bounds(data)
        yield data, starts, ends, np.asarray(numbers)[np.searchsorted(begins, starts, "right") - 1]


def word_hashes(texts: list[bytes | None], table: bytes = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in order, and the number of words of each text."""
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for data, starts, ends, of in word_blocks(texts, table):
        hashes.append(span_hashes(data, starts, ends))
        owners.append(of)
    return np.concatenate(hashes), np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(texts))


LOWER, PLAIN = _LOWER, _PLAIN


def slices(texts: list, limit: int = 8 << 20) -> Iterator[slice]:
    """Runs of rows with about ``limit`` bytes of text, one row at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = len(text or b"")
        if k > begin and size + n > limit:
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def sums_by(owners: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, weights=weights, minlength=n)


def batches(iterator, columns: list[str]) -> Iterator[dict[str, pa.Array]]:
    """Arrow batches as a mapping from name to column; empty ones are left out."""
    for batch in iterator:
        if batch.num_rows:
            yield {c: batch.column(k) for k, c in enumerate(columns)}
