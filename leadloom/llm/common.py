"""Shared parts: words of Arrow text columns as hashed arrays, bounded labelled samples, worker state.

Text functions take Arrow arrays and work on slices of about a megabyte, so a
worker's memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
_SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def worker_state(key: str, build: Callable):
    """`build()` once per Python worker; functions shipped by value have no module to keep it in."""
    home = sys.modules.setdefault("_leadloom_worker_state", types.ModuleType("_leadloom_worker_state"))
    if not hasattr(home, key):
        setattr(home, key, build())
    return getattr(home, key)


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from: crc32 of the id as text, modulo 3, is 1.  A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label of about `per_class` rows of each value of `label`, or all where there are fewer.

    A row is in when the hash of its id is below its class's share, so the
    choice needs one count per class and no sort.  Classes must be few.
    """
    usable = docs.select("doc_id", "text", label).where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    shares = [(row[0], per_class / row[1]) for row in usable.groupBy(label).count().collect()]
    return usable.where(in_shares(F.col(label), F.xxhash64("doc_id"), shares))


def in_shares(label: Column, digest: Column, shares: list) -> Column:
    """Whether the hash falls into its class's share."""
    steps = 1_000_000_000
    limit = F.lit(0)
    for value, share in shares:
        limit = F.when(label == F.lit(value), F.lit(int(min(1.0, share) * steps))).otherwise(limit)
    return F.pmod(digest, F.lit(steps)) < limit


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_MULT))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """Bytes that part words: blank, tab and the line ends."""
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    return table


def letterless_table() -> np.ndarray:
    """Bytes that are neither an ASCII letter nor part of a longer character."""
    table = np.ones(256, dtype=bool)
    table[65:91] = table[97:123] = table[128:] = False
    return table


def byte_slices(texts: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~parts[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1], edge[:-1] = True, ~inside[1:]
    last = offsets[1:]
    edge[last[last > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64; kept and grown in the worker."""
    state = worker_state("powers", lambda: {"table": np.ones(1, np.uint64)})
    if len(state["table"]) < n:
        size = max(n, 1 << 12)
        factors = np.full(size, 0xD1342543DE82EF95, np.uint64)
        factors[0] = 1
        state["table"] = np.multiply.accumulate(factors)
    return state["table"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; `letters` gives the random word of each byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = letters[data[within + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(_MULT))


def letter_words(fold: bool) -> np.ndarray:
    """Random words by byte; with `fold`, A-Z share those of a-z."""
    table = random_words(11, 256)
    return table[lower_table()] if fold else table


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums between neighbouring entries of `firsts`; an empty stretch sums to 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
