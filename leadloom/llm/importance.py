"""Importance resampling towards a target: hashed word runs of the corpus against those of the target.

The texts of a slice of a batch are joined with a separator between them.  One
regex pass over the bytes finds all words; the places of the words, searched in
the offsets of the documents, tell which runs of two or three words would cross
from one document into the next, and those are masked before the counts of all
buckets are taken at once.  The bucket of a run needs no joined bytes: the
checksum of a joined run follows from those of its words, since a checksum is
moved on by n bytes through a fixed linear map (tables for short words, powers
of two for long ones).

Two passes over the texts: one counts the buckets of the corpus, one adds up the
gains of each document.  What is sent to all tasks is one gain per bucket.  A
draw adds to each weight a Gumbel number from a hash of the id, so that the
highest sums are a sample without replacement by weight; ranks come from counts
per score, never from one sorted task.

Defined cases: null and empty texts have no runs and weight 0; a text
longer than a slice is one slice; repeated rows each count, and each can be
drawn; ties go to the smaller id (null ids last, then by feature count and
weight); a null id is hashed as the seed and a colon alone; an empty corpus
gives an empty result, an empty target gives every bucket the gain of no hits;
other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import byte_slices, lower_table, read, segment_sums, worker_state
from leadloom.session import settle

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Scores that are ranked together: counts per score are summed over blocks of this width first.
_BLOCK = 1 << 12
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = 0
_SHORT = 64


def _moved_by_one(values: np.ndarray) -> np.ndarray:
    """Checksum registers after one more zero byte."""
    single = np.frombuffer(b"".join(_register(bytes([b])).to_bytes(4, "little") for b in range(256)), "<u4")
    return (values >> np.uint32(8)) ^ single[values & np.uint32(255)]


def _register(data: bytes) -> int:
    """What a byte leaves in an empty register: the checksum without the flips at both ends."""
    return zlib.crc32(data) ^ zlib.crc32(bytes(len(data)))


def _as_tables(images: np.ndarray) -> np.ndarray:
    """Tables by byte of the linear map that takes bit i to images[i]."""
    tables = np.zeros((4, 256), np.uint32)
    for i in range(32):
        where = np.arange(256) >> (i % 8) & 1 == 1
        tables[i // 8][where] ^= images[i]
    return tables


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (tables[0][values & np.uint32(255)] ^ tables[1][values >> np.uint32(8) & np.uint32(255)]
            ^ tables[2][values >> np.uint32(16) & np.uint32(255)] ^ tables[3][values >> np.uint32(24)])


class Mover:
    """Moves checksums on by the bytes that follow."""

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        tables, images = [], bits
        for _ in range(_SHORT):
            tables.append(_as_tables(images))
            images = _moved_by_one(images)
        self.short = np.stack(tables, axis=1)
        self.doublings = [_as_tables(images)]
        for _ in range(40):
            last = self.doublings[-1]
            self.doublings.append(_as_tables(_apply(last, _apply(last, bits))))

    def joined(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Checksums of two parts put together, from theirs and the second's size in bytes."""
        low = size % _SHORT
        moved = (self.short[0][low, first & np.uint32(255)] ^ self.short[1][low, first >> np.uint32(8) & np.uint32(255)]
                 ^ self.short[2][low, first >> np.uint32(16) & np.uint32(255)] ^ self.short[3][low, first >> np.uint32(24)])
        rest = size // _SHORT
        for step in range(int(rest.max(initial=0)).bit_length()):
            there = np.flatnonzero(rest >> step & 1)
            moved[there] = _apply(self.doublings[step], moved[there])
        return moved ^ second


def _mover() -> Mover:
    return worker_state("checksum_mover", Mover)


def runs(texts: pa.Array, buckets: int, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, words per text, bucket of every run, number of the text of every run) of slices of texts.

    Runs come by length, and within a length by place.
    """
    mover, lower = _mover(), lower_table()
    for first, end, data, offsets in byte_slices(texts):
        joined = np.full(len(data) + end - first, _SEPARATOR, np.uint8)
        ends = offsets + np.arange(len(offsets))
        keep = np.ones(len(joined), bool)
        keep[ends[1:] - 1] = False
        joined[keep] = lower[data]
        parts = [np.zeros((3, 0), np.int64)]
        for some in itertools.batched(_WORDS.finditer(joined.tobytes()), 1 << 16):
            words = [m.group() for m in some]
            parts.append(np.array([[m.start() for m in some], list(map(len, words)), list(map(zlib.crc32, words))], np.int64))
        starts, sizes, sums = np.concatenate(parts, axis=1)
        sums = sums.astype(np.uint32)
        owner = np.searchsorted(ends, starts, "right") - 1
        counts = np.bincount(owner, minlength=end - first)
        #: Checksum of a blank and each word, to be put behind a run.
        blank = np.full(len(sums), zlib.crc32(b" "), np.uint32)
        behind = mover.joined(blank, sums, sizes)
        places, owners, whole = [sums % np.uint32(buckets)], [owner], sums
        for n in range(2, most + 1):
            if len(sums) < n:
                break
            whole = mover.joined(whole[:-1], behind[n - 1:], sizes[n - 1:] + 1)
            same = owner[n - 1:] == owner[: 1 - n]
            places.append(whole[same] % np.uint32(buckets))
            owners.append(owner[n - 1:][same])
        yield first, end, counts, np.concatenate(places).astype(np.int64), np.concatenate(owners)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: word runs of all texts in each bucket that has any."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, places, _ in runs(batch["text"], buckets):
                total += np.bincount(places, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the corpus, one more hit each."""
    hits = []
    for counts in (corpus, target):
        found = np.zeros(buckets, np.int64)
        for row in bucket_counts(counts, buckets).collect():
            found[row["bucket"]] = row["n"]
        hits.append(found)
    s, t = hits
    all_s, all_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    def run(batches):
        for batch in batches:
            words, features = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            weights = np.zeros(len(batch), np.int64)
            for first, end, counts, places, owners in runs(batch["text"], len(table)):
                words[first:end] = counts
                features[first:end] = np.bincount(owners, minlength=end - first)
                # Whole numbers below 2^53 in size, so sums of doubles are exact.
                weights[first:end] = np.bincount(owners, weights=table[places], minlength=end - first).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(a, pa.int64()) for a in (words, features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows with `score` and `rank`: the highest scores of the rows with enough words, the others' rank null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = settle(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "importance-scores")
    able = F.col("n_words") >= least_words
    per_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", F.floor(F.col("score") / _BLOCK))
    blocks = per_score.groupBy("__block").agg(F.sum("__n").alias("__all"))
    over = Window.orderBy(F.desc("__block"))
    above = blocks.select(
        "__block",
        F.coalesce(F.sum("__all").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__blocks_above"),
        F.floor(F.sum("__all").over(Window.partitionBy()) * percent / 100).cast("long").alias("__drawn"))
    within = Window.partitionBy("__block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = (
        per_score.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(above, "__block")
        .select(F.col("score").alias("__score"), (F.col("__in") + F.col("__blocks_above")).alias("__above"), "__drawn")
        .where(F.col("__above") < F.col("__drawn")))
    joined = scored.join(places, able & (F.col("score") == F.col("__score")), "left")
    turn = F.row_number().over(Window.partitionBy("score", F.col("__score").isNull()).orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    place = F.col("__above") + turn
    return joined.withColumn("rank", F.when(place <= F.col("__drawn"), place)).drop("__score", "__above", "__drawn")


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    return draw(weigh(docs, gains(docs, target))).select("doc_id", "n_features", "weight", "score", "rank")
