"""Shared parts of the corpus operators: intermediate tables in the shared
folder, Arrow helpers, and vectorised hashing of words and byte ranges."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.tables import cut, new_folder, shared_folder, table  # noqa: F401

U64 = np.uint64
#: White space as the result contracts define it: space, and tab to carriage return.
SPACE_TABLE = np.zeros(256, bool)
SPACE_TABLE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that one vectorised step works on; bounds a worker's memory.
STEP_BYTES = 1 << 20


def worker_cache(name: str, make):
    """An object kept for the life of a Python worker process."""
    mod = sys.modules.setdefault("_turnloom_worker", types.ModuleType("_turnloom_worker"))
    if not hasattr(mod, name):
        setattr(mod, name, make())
    return getattr(mod, name)


#: Bytes of a batch that travels between the JVM and Python, unless the session names another
#: bound: a number of rows bounds nothing where texts may be long.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not getattr(spark, "_turnloom_batches", False):
        if int(spark.conf.get(key).rstrip("bB")) == 64 << 20:  # as Spark has it
            spark.conf.set(key, str(BATCH_BYTES))
        spark._turnloom_batches = True


def tidy() -> None:
    """Give freed memory back: workers are kept, and one step's peak must not stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """``run``, and memory given back at the end of the task."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return inner


def packed(docs: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """``row`` (a struct of every other column, so that no name can clash),
    ``text`` (null becomes empty) and ``more``."""
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("_"))
    return docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[c.alias(n) for n, c in more.items()])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges of documents of about ``limit`` bytes; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sliced(batches, rows: int = 500):
    """Smaller batches, so that copies of texts in Python stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, U64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    held = worker_cache(f"powers_{base}", lambda: [np.zeros(0, U64)])
    if len(held[0]) < n:
        held[0] = _powers(max(n, 1 << 12), base)
    return held[0][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and n + 1 offsets into them
    for the documents; words never cross documents."""
    solid = ~SPACE_TABLE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Places of a word that share one table of codes; later places are mixed one by one.
PLACES = 64


def _place_codes(seed: int, lower: bool) -> np.ndarray:
    """A code for each (place, byte) below PLACES, as one flat table."""
    return worker_cache(f"places_{seed}_{lower}", lambda: _far_codes(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256), seed, lower))


def _far_codes(byte: np.ndarray, place: np.ndarray, seed: int, lower: bool) -> np.ndarray:
    if lower:
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    with np.errstate(over="ignore"):
        return mix(mix(place.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + byte.astype(U64) * U64(0xD1342543DE82EF95))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words; ``lower`` folds A-Z. Every (place, byte) has a mixed
    code of its own and a word is the sum of its codes: no polynomial, so no family
    of words of any length clashes by construction."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    lead = np.diff(starts, append=len(data))  # a word's bytes and what follows until the next one
    place = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts, lead).astype(np.int32)
    data, starts = data[starts[0] :], starts - starts[0]
    value = _place_codes(seed, lower)[np.minimum(place, PLACES - 1) * 256 + data]
    if sizes.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = _far_codes(data[far], place[far], seed, lower)
    value[place >= np.repeat(sizes, lead)] = 0
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(value, starts) + sizes.astype(U64) * U64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of every k consecutive entries (of one array; document edges are
    the caller's business)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mix(np.arange(1, k + 1, dtype=U64) * U64(0xA24BAED4963EE407) + U64(seed)) | U64(1)):
            total += words[i : i + n] * c
    return mix(total)
