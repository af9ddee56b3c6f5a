"""Document fingerprints by randomised edit embedding: shared random walks over characters.

A walk reads a text from left to right and writes the character it stands on at
every step; a shared random bit of the step and the character says whether it
moves on.  Two walks that lost step by an edit soon meet again, so the edit
distance of texts becomes the Hamming distance of what is written.  The
fingerprint samples that string: the first 32 places, and 32 random places of
each following octave, as hex digits of hashed characters.  Likeness weighs the
octaves by their width and takes off what chance gives.

Near texts are found by banding: each band samples some of the digits under the
highest full octaves of the text; texts that share a band are verified by the
likeness of their whole fingerprints, and linked into groups.

Neighbours are found by ranges of doc_id: each range is one stretch of a
partition read in order, and gets a copy of the first row of the next range.

Defined cases: a null text is empty, and two empty texts are alike; equal texts
have equal fingerprints; null ids come last, in order of text; rows with equal
ids are ordered by text; a table of one row is its own next; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import mix, random_words, read, worker_state
from leadloom.llm.components import link_buckets, shared_buckets
from leadloom.session import settle

PER_OCTAVE = 32
FIRST_OCTAVE = 5
OCTAVES = 20
KINDS = 64
PHASES = 4096
#: Share of digits that agree between unrelated texts: equal letters, and other letters with one digit.
CHANCE = 0.12
BANDS = 12
DIGITS = 8
LIKE = 0.75
_PAD = 255
_GROUP_ROWS = 256
_GROUP_CHARS = 1 << 20
ROWS_PER_RANGE = 1000
MOST_RANGES = 20_000


def places() -> np.ndarray:
    """Steps of the walk whose characters are sampled, ascending."""
    draws = random_words(41, OCTAVES * PER_OCTAVE).reshape(OCTAVES, PER_OCTAVE)
    width = np.uint64(1) << (np.arange(OCTAVES, dtype=np.uint64) + np.uint64(FIRST_OCTAVE))
    later = np.sort(width[:, None] + draws % width[:, None], axis=1).reshape(-1)
    return np.concatenate([np.arange(PER_OCTAVE), later.astype(np.int64)])


def stays() -> np.ndarray:
    """Steps a walk stands on a character of each kind, by the phase at which it comes there."""
    bits = random_words(42, KINDS * PHASES).reshape(KINDS, PHASES) >> np.uint64(63) == 1
    bits[:, -1] = True
    twice = np.concatenate([bits, bits], axis=1)
    ahead = np.where(twice, np.arange(2 * PHASES), 4 * PHASES)
    following = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :PHASES]
    return (following - np.arange(PHASES) + 1).astype(np.int32)


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length of the walk and the sampled digits of each text."""
    sampled, flat = places(), worker_state("walk_stays", lambda: stays().reshape(-1))
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = mix(points.astype(np.uint64) + np.uint64(0x51ED27))
    kind, digit = (mixed >> np.uint64(58)).astype(np.int64), (mixed & np.uint64(15)).astype(np.uint8)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, sizes = first[order].copy(), lengths[order]
    step, left = np.zeros(len(texts), np.int64), np.zeros(len(points), np.int32)
    active = int(np.searchsorted(-sizes, 0, "left"))
    done = 0
    while active:
        # All walks take one character at a time; those at their end drop out.
        until = int(sizes[active - 1])
        now, where = step[:active], at[:active]
        for _ in range(done, until):
            now += flat[(kind[where] << 12) + (now & (PHASES - 1))]
            left[where] = now
            where += 1
        done = until
        active = int(np.searchsorted(-sizes, -until, "left"))
    walk = np.zeros(len(texts), np.int64)
    walk[order] = step
    digits = np.full((len(texts), len(sampled)), _PAD, np.uint8)
    for i, (a, n) in enumerate(zip(first, lengths)):
        inside = int(np.searchsorted(sampled, walk[i], "left"))
        digits[i, :inside] = digit[a + np.searchsorted(left[a:a + n], sampled[:inside], "right")]
    return walk, digits


def as_text(walk: np.ndarray, digits: np.ndarray) -> list[str]:
    letters = np.frombuffer(b"0123456789abcdef", np.uint8)
    sampled = places()
    return [f"{int(w):x}:" + letters[d[: int(np.searchsorted(sampled, w, "left"))]].tobytes().decode() for w, d in zip(walk, digits)]


def from_text(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    walk = np.array([int(p.split(":")[0], 16) for p in prints], np.int64)
    digits = np.full((len(prints), (OCTAVES + 1) * PER_OCTAVE), _PAD, np.uint8)
    for i, p in enumerate(prints):
        tail = np.frombuffer(p.split(":")[1].encode(), np.uint8)
        digits[i, : len(tail)] = np.where(tail > 57, tail - 87, tail - 48)
    return walk, digits


def likeness(walk_a: np.ndarray, a: np.ndarray, walk_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness from 0 to 1 of fingerprints, row by row."""
    longest = np.maximum(walk_a, walk_b)
    sampled = places()
    used = sampled[None, :] < longest[:, None]
    same = (a == b) & (a != _PAD)
    shape = (len(a), OCTAVES + 1, PER_OCTAVE)
    used_n, same_n = used.reshape(shape).sum(axis=2), same.reshape(shape).sum(axis=2)
    begin = np.concatenate([[0], 1 << (np.arange(OCTAVES) + FIRST_OCTAVE)])
    end = np.concatenate([begin[1:], [begin[-1] * 2]])
    width = np.where(used_n > 0, np.clip(np.minimum(end[None, :], longest[:, None]) - begin[None, :], 0, None), 0)
    share = (width * same_n / np.maximum(used_n, 1)).sum(axis=1) / np.maximum(width.sum(axis=1), 1)
    return np.where(longest == 0, 1.0, np.clip((share - CHANCE) / (1 - CHANCE), 0, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> list[int]:
    """First ids of the ranges, ascending: quantiles of doc_id, which are ids of the table."""
    n = docs.where(F.col("doc_id").isNotNull()).count()
    parts = min(MOST_RANGES, max(1, n // ROWS_PER_RANGE))
    if not n:
        return []
    shares = [i / parts for i in range(parts)]
    row = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 10 * parts + 1000).alias("q")).first()
    return sorted({row["low"], *row["q"]})


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, ahead: rows in order within their range, then (`ahead`) the first row of the next range."""
    starts = np.array(_ranges(docs), dtype=np.int64)
    last = max(len(starts) - 1, 0)

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"]
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.where(null, last, np.clip(np.searchsorted(starts, value, "right") - 1, 0, None))
            first = np.flatnonzero((~null & (starts[place] == value)) if len(starts) else null)
            before = np.where(place[first] > 0, place[first] - 1, last)
            rows = pa.array(np.concatenate([np.arange(len(ids)), first]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), batch["text"].fill_null("").take(rows), pa.array(np.concatenate([place, before]), pa.int64()),
                 pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(first), bool)]))],
                names=["doc_id", "text", "range", "ahead"])

    dealt = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, range long, ahead boolean")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), "text")


def _pairs(batches):
    """(doc_id, text, next text) in order, from rows in order."""
    held = None
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        for doc_id, text, stretch, ahead in zip(ids, texts, batch["range"].to_pylist(), batch["ahead"].to_pylist()):
            if held is not None and held[2] == stretch:
                yield held[0], held[1], text
            held = None if ahead else (doc_id, text, stretch)


def _groups(batches):
    group, size = [], 0
    for pair in _pairs(batches):
        group.append(pair)
        size += len(pair[1])
        if len(group) == _GROUP_ROWS or size >= _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for group in _groups(batches):
            ids, texts, following = zip(*group)
            changed = [edited(t, f) for t, f in zip(texts, following)]
            n = len(group)
            # The next text of a row is the text of the row after it, unless a range ends there.
            extra = [i for i in range(n) if i == n - 1 or following[i] is not texts[i + 1]]
            walk, digits = embed([*texts, *changed, *[following[i] for i in extra]])
            after = np.arange(1, n + 1)
            after[extra] = 2 * n + np.arange(len(extra))
            own, new = np.arange(n), np.arange(n, 2 * n)
            prints = as_text(walk[: 2 * n], digits[: 2 * n])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()),
                pa.array(likeness(walk[own], digits[own], walk[new], digits[new])),
                pa.array(likeness(walk[own], digits[own], walk[after], digits[after])),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    made = in_order(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def band_keys(walk: np.ndarray, digits: np.ndarray, bands: int = BANDS, size: int = DIGITS) -> list[list[int]]:
    """Keys of the bands of each fingerprint, for the highest full octave of its walk and the one below."""
    keys = []
    for length, own in zip(walk.tolist(), digits):
        if not length:
            keys.append([])
            continue
        top = max(0, int(length).bit_length() - 1 - FIRST_OCTAVE)
        found = []
        for octave in {top, max(0, top - 1)}:
            pool = PER_OCTAVE * (octave + 1) if length >= PER_OCTAVE else min(PER_OCTAVE, length)
            picks = (random_words(1000 + octave, bands * size) % np.uint64(max(1, min(pool, 4 * PER_OCTAVE)))).astype(np.int64)
            chosen = own[pool - 1 - picks].astype(np.uint64).reshape(bands, size)
            value = np.arange(bands, dtype=np.uint64) + np.uint64(octave * 4096 + 1)
            for j in range(size):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
            found += value.view(np.int64).tolist()
        keys.append(found)
    return keys


def near_groups(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, group_id of a table (doc_id, fingerprint): the smallest id reachable by links of likeness `like` or more.

    Equal fingerprints are one class; classes that share a band are compared on
    their whole fingerprints.  Rows without an id have a null group.
    """
    classes = settle(
        prints.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("node")), "print-classes")

    def run(batches):
        for batch in batches:
            keys = band_keys(*from_text(batch["fingerprint"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    def verify(batches):
        for batch in batches:
            keep = likeness(*from_text(batch["left"].to_pylist()), *from_text(batch["right"].to_pylist())) >= like
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    def confirm(pairs: DataFrame) -> DataFrame:
        left = classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("left"))
        right = classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("right"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")

    members = classes.mapInArrow(run, "node long, keys array<long>").select("node", F.lit(1).cast("long").alias("size"), F.explode("keys").alias("key"))
    roots = link_buckets(shared_buckets(members), confirm, 0).select(F.col("node").alias("_node"), "root")
    placed = settle(
        classes.join(roots, F.col("node") == F.col("_node"), "left").select(F.col("fingerprint").alias("_print"), F.coalesce("root", "node").alias("group_id")),
        "print-groups")
    return prints.join(placed, F.col("fingerprint") == F.col("_print"), "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(read(spark, folder, "documents"))
