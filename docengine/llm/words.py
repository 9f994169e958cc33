"""Vectorised words, word hashes and shingles over Arrow string columns.

A text's words are the runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
UTF-8 never uses those byte values inside a longer sequence, so working on bytes gives the
same words as working on characters.

Words are hashed by two polynomials modulo the prime 2**31 - 1 (62 bits, mixed into 64), which
tell apart what polynomials modulo 2**64 can't, such as a Thue-Morse string and its complement.
The faster hash modulo 2**64 serves where a collision only costs time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_PRIME = (1 << 31) - 1
_PRIME_BASES = (1103515245, 69069069)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, which at a task's end also gives unused memory back to the system.

    Workers are reused by later stages, so what one task leaves behind would count for all. What
    ``forget`` names is called first, to drop a worker's caches. Texts may be long, so batches are
    made smaller than by default, unless the session has a limit of its own.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_BYTES, None) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH_BYTES, "8MB")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # which the trimming below covers
        try:
            yield from run(batches)
        finally:
            for drop in (_Powers.drop, *forget):
                drop()
            give_back()

    return tidy


def give_back() -> None:
    """Returns memory that is no longer used to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def appended(df: DataFrame, *out: str) -> dict[str, str]:
    """The columns of df that keep their place beside new columns ``out``, with their DDL.

    Columns whose names clash with ``out`` (as Spark compares names, without regard to case) give way.
    """
    taken = {x.lower() for x in out}
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return {f.name: f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() not in taken}


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    prime: tuple = tuple((np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _PRIME_BASES)

    @classmethod
    def drop(cls) -> None:
        cls.up = cls.down = np.ones(1, np.uint64)
        cls.prime = tuple((cls.up, cls.up) for _ in _PRIME_BASES)

    @classmethod
    def modulo(cls, n: int) -> tuple:
        """For each base its powers modulo the prime and their inverses, by doubling."""
        if len(cls.prime[0][0]) <= n:
            out = []
            for base in _PRIME_BASES:
                pair = []
                for b in (base, pow(base, -1, _PRIME)):
                    x = np.ones(1, np.uint64)
                    while len(x) <= n:
                        x = np.concatenate([x, _reduced(x * np.uint64(pow(b, len(x), _PRIME)))])
                    pair.append(x)
                out.append(tuple(pair))
            cls.prime = tuple(out)
        return cls.prime

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = n + n // 8 + 1024
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up, cls.down


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**63."""
    p, s = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count == len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    _, offsets = raw_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with hash(i, j) = (H[j] - H[i]) * down[i]; see span_hash."""
    up, _ = _Powers.upto(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.upto(len(h))
    return mixed((h[end] - h[start]) * down[start])


def prime_sums(data: np.ndarray) -> list[np.ndarray]:
    """For each base, the sums behind the hashes of prime_spans."""
    symbols = data.astype(np.uint64) + np.uint64(1)
    out = []
    for up, _ in _Powers.modulo(len(data)):
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = symbols * up[: len(data)]  # below 2**40, so that 2**23 of them can be summed
        np.cumsum(terms if len(data) < 1 << 23 else _reduced(terms), out=sums[1:])
        out.append(sums)
    return out


def prime_spans(sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans by two polynomials modulo the prime."""
    value = np.zeros(len(starts), np.uint64)
    for own, (_, down) in zip(sums, _Powers.modulo(len(sums[0]) - 1), strict=True):
        value = (value << np.uint64(31)) | _reduced(_reduced(own[ends] - own[starts]) * down[starts])
    return mixed(value)


def word_spans(column: pa.Array, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, the words' starts and ends, each row's first word."""
    data, offsets = raw_bytes(column)
    inside = in_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and the index of each row's first word."""
    data, starts, ends, rows = word_spans(column)
    return prime_spans(prime_sums(data), starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row (repeats included) and the index of each row's first.

    A row with fewer words than size has one shingle, its whole sequence; without words, none.
    """
    lengths = np.diff(rows)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(rows[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    value = np.zeros(len(first), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    width = np.repeat(np.minimum(lengths, size), counts)
    for j in range(size):
        value = value * _STEP + np.where(j < width, padded[first + j], np.uint64(0))
    return mixed(value + width.astype(np.uint64)), bounds


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    values, bounds = shingle_hashes(*word_hashes(column), size)
    for i in range(len(bounds) - 1):
        yield np.unique(values[bounds[i] : bounds[i + 1]])


def list_array(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """One Arrow list per numpy array."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
