"""Near-duplicate documents by min-max hashing on five-word shingles.

Each permutation gives two signature values, the least and the greatest hash of
a document's set, so half the hash evaluations make a signature of the same
length.  Bands of it name buckets.  Documents with equal sets are one class from
the start.  A class first meets the smallest and greatest classes of its
buckets that it shares most buckets with, and links are confirmed on the full
sets.  Only where a bucket stays in several parts do the classes outside its
commonest part meet those of its other parts, so a large group of copies never
meets itself in all pairs.  There sketches are compared in the join, and pairs
that they show to be far apart are not confirmed.  The others are confirmed in
rounds: first the pair of each two parts whose sketches are most alike, then
some more, at last all that still lie in different parts; parts that a link has
joined need no further pair.  No number of partners is capped.  A sketch deals a set over 384 bins and keeps four bits of the least
value of each, so a set with fewer values than bins is kept almost whole.

At the least similarity asked for, 0.75, a pair misses all 40 bands of 5 values
with probability (1 - 0.75 ** 5) ** 40 = 2e-5; at 0.8 with 1e-7.  Its sketches
differ in more bins than allowed, five deviations above what 0.75 makes one
expect, with a probability of about 3e-7.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; a text of one to four words is one shingle; a null
doc_id is never linked, has a null component and is kept; rows with the same
doc_id and text share a component, and all say kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import byte_slices, letter_words, mix, random_words, read, space_table, word_bounds, word_hashes
from leadloom.llm.components import components
from leadloom.operators.ordering import first_k
from leadloom.session import settle

WIDTH = 5
BANDS = 40
ROWS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Partners that a class meets first.
FIRST_MET = 4
#: Bins of a sketch, bits kept of each, and words for one bit of all bins.
BINS = 384
BITS = 4
_WORDS = BINS // 64
#: Words of a bitmap: every value of a set sets one of its bits.
BITMAP = 24
#: Pairs of each two parts that a round confirms; the last round confirms all that are left.
ROUNDS = (1, 8, None)
#: Deviations above the expected number of differing bins from which on a pair is too far apart.
DEVIATIONS = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the place of each text's first (one more at the end)."""
    starts, ends, firsts = word_bounds(data, offsets, space_table())
    words = word_hashes(data, starts, ends, letter_words(fold=True))
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    factors = random_words(5, WIDTH) | np.uint64(1)
    values, owners = [], []
    if len(words) >= WIDTH:
        full = len(words) - WIDTH + 1
        whole = sum((words[j: j + full] * factors[j] for j in range(1, WIDTH)), words[:full] * factors[0])
        inside = text[:full] == text[WIDTH - 1:]
        values.append(whole[inside])
        owners.append(text[:full][inside])
    for n in range(1, WIDTH):
        short = np.flatnonzero(counts == n)
        values.append(sum((words[firsts[short] + j] * factors[j] for j in range(n)), np.full(len(short), n, np.uint64)))
        owners.append(short)
    value, owner = mix(np.concatenate(values)), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def extremes(values: np.ndarray, firsts: np.ndarray, n: int = BANDS * ROWS // 2) -> np.ndarray:
    """Least and greatest value of each nonempty set under each of `n` permutations, one column a set."""
    factor, shift = random_words(21, n) | np.uint64(1), random_words(22, n)
    at = firsts[:-1][np.diff(firsts) > 0]
    signature = np.empty((2 * n, len(at)), np.uint64)
    for k in range(n):
        permuted = values * factor[k] + shift[k]
        signature[k] = np.minimum.reduceat(permuted, at)
        signature[n + k] = np.maximum.reduceat(permuted, at)
    return signature


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One row a set: the key of each band of `rows` values."""
    keys = np.empty((signature.shape[1], len(signature) // rows), np.uint64)
    for b in range(keys.shape[1]):
        key = np.full(len(keys), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        keys[:, b] = key
    return keys


def sketches(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One row a nonempty set: `_WORDS` words of the first bit of every bin, as many of the second, and so on; 0 is an empty bin."""
    lengths = np.diff(firsts)
    lengths = lengths[lengths > 0]
    place = np.repeat(np.arange(len(lengths)), lengths) * BINS + (values % np.uint64(BINS)).astype(np.int64)
    kept = (1 + (values >> np.uint64(20)) % np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bins = np.zeros(len(lengths) * BINS, np.uint8)
    # Values ascend within a set; written last to first, the least of a bin stays.
    bins[place[::-1]] = kept[::-1]
    bins = bins.reshape(-1, BINS)
    planes = [np.packbits((bins >> k) & 1, axis=1, bitorder="little") for k in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.uint64)


def bitmaps(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a nonempty set: a bitmap with one bit of each value, and how many values it hides behind bits of others."""
    lengths = np.diff(firsts)
    lengths = lengths[lengths > 0]
    bits = np.zeros((len(lengths), 64 * BITMAP), bool)
    bits[np.repeat(np.arange(len(lengths)), lengths), ((values >> np.uint64(33)) % np.uint64(64 * BITMAP)).astype(np.int64)] = True
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64), lengths - bits.sum(axis=1)


def most_different(size: Column, percent: int = PERCENT) -> Column:
    """In how many bins two sets of `size` values together may differ and still be a link.

    The least values of the occupied bins are a random choice, without
    repetition, of the values of both sets; a bin differs if its value is in one
    set only.  The variance adds up that of the choice and that of the number
    of occupied bins.
    """
    apart = 1 - percent / 100
    union = size / (2 - apart)
    empty = F.exp(-union / BINS)
    occupied = BINS * (1 - empty)
    chosen = apart * (1 - apart) * occupied * F.greatest(1 - occupied / union, F.lit(0.0))
    filled = apart * apart * BINS * empty * F.greatest(1 - (1 + union / BINS) * empty, F.lit(0.0))
    return apart * occupied + DEVIATIONS * F.sqrt(chosen + filled) + 2


def differing(x: str, y: str) -> Column:
    """In how many bins the sketches in the columns `x` and `y` differ.

    Every word is read once, which keeps the generated method short enough to be compiled.
    """
    total = F.lit(0)
    for w in range(_WORDS):
        words = [F.get(x, k * _WORDS + w).bitwiseXOR(F.get(y, k * _WORDS + w)) for k in range(BITS)]
        total = total + F.bit_count(reduce(Column.bitwiseOR, words))
    return total


def most_shared(x: str, y: str) -> Column:
    """At most how many values two sets share: the bits that both bitmaps have, and what the one that hides less hides."""
    both = [F.bit_count(F.get(f"{x}_bitmap", w).bitwiseAND(F.get(f"{y}_bitmap", w))) for w in range(BITMAP)]
    return reduce(Column.__add__, both) + F.least(f"{x}_hidden", f"{y}_hidden")


def _sign(batches):
    for batch in batches:
        n = np.zeros(len(batch), np.int64)
        classes, keys, marks, maps, hidden = ([None] * len(batch) for _ in range(5))
        for first, end, data, offsets in byte_slices(batch["text"]):
            values, firsts = shingle_sets(data, offsets)
            n[first:end] = np.diff(firsts)
            full = np.flatnonzero(np.diff(firsts) > 0)
            if not len(full):
                continue
            at = firsts[:-1][full]
            prints = np.stack([np.add.reduceat(mix(values + np.uint64(31)), at), np.bitwise_xor.reduceat(mix(values + np.uint64(37)), at)], axis=1)
            band, sketch = band_keys(extremes(values, firsts)).view(np.int64), sketches(values, firsts).view(np.int64)
            bits, behind = bitmaps(values, firsts)
            for i, j in enumerate(full):
                classes[first + j], keys[first + j], marks[first + j] = prints[i].tobytes(), band[i], sketch[i]
                maps[first + j], hidden[first + j] = bits[i].view(np.int64), behind[i]
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(classes, pa.binary()), pa.array(n), pa.array(keys, lists), pa.array(marks, lists),
             pa.array(maps, lists), pa.array(hidden, pa.int64())],
            names=["doc_id", "cls", "n_shingles", "bands", "sketch", "bitmap", "hidden"])


def _confirm(batches):
    """Sizes of intersection and union of the sets of each pair of texts."""
    for batch in batches:
        sets = []
        for name in ("text_a", "text_b"):
            own = []
            for _first, _end, data, offsets in byte_slices(batch[name]):
                values, firsts = shingle_sets(data, offsets)
                own += [values[x:y] for x, y in zip(firsts[:-1], firsts[1:])]
            sets.append(own)
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], np.int64)
        either = np.array([len(x) + len(y) for x, y in zip(*sets)], np.int64) - both
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(both), pa.array(either)], names=["a", "b", "both", "either"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, from a table (a, b, text_a); `texts` is (node, text)."""
    kind = pairs.schema["a"].dataType.simpleString()
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    measured = pairs.join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, f"a {kind}, b {kind}, both long, either long")
    return measured.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """key, node, size, least, greatest of the buckets of two nodes or more; they grow with the data, so the join is never a broadcast."""
    members = classes.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    ends = settle(
        members.groupBy(F.col("key").alias("_key")).agg(F.min("node").alias("least"), F.max("node").alias("greatest"))
        .where(F.col("least") < F.col("greatest")), "near-ends")
    return settle(members.join(ends.hint("merge"), F.col("key") == F.col("_key")).drop("_key"), "near-buckets")


def first_met(shared: DataFrame) -> DataFrame:
    """_node, partners: each node with the ends of its buckets that it shares most buckets with.

    A node has a bucket a band, so the lists gathered here have twice as many entries as there are bands at most.
    """
    ends = shared.groupBy(F.col("node").alias("_node")).agg(F.collect_list("least").alias("least"), F.collect_list("greatest").alias("greatest"))
    met = F.array_remove(F.concat("least", "greatest"), F.col("_node"))
    ranked = F.sort_array(F.transform(F.array_distinct("met"), lambda b: F.struct((-F.size(F.filter("met", lambda c: c == b))).alias("n"), b.alias("b"))))
    return ends.select("_node", met.alias("met")).select("_node", F.slice(ranked, 1, FIRST_MET)["b"].alias("partners"))


def rest_pairs(shared: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that `roots` leaves in different parts and whose sizes, bitmaps and sketches allow a link, each pair once.

    a, b, their parts (low, high) and in how many bins their sketches differ (apart).
    """
    placed = settle(
        shared.select("key", "node", "size").join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
        .select("key", "node", "size", F.coalesce("root", "node").alias("root")), "near-placed")
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    split = settle(
        counted.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("parts"), F.max_by("root", F.col("n")).alias("main")).where(F.col("parts") > 1)
        .drop("parts"), "near-split")
    # The limit for two sets of this size holds for it and any smaller set; a column keeps the join's condition short enough to be compiled.
    limit = F.ceil(most_different(2 * F.col("n_shingles"), percent)).cast("int")
    marks = classes.select(F.col("node").alias("_node"), "bands", "sketch", "bitmap", "hidden", limit.alias("limit"))
    left_open = settle(
        placed.join(split.hint("merge"), F.col("key") == F.col("_key")).join(marks.hint("merge"), F.col("node") == F.col("_node"))
        .select("key", "node", "size", "root", "main", "bands", "sketch", "bitmap", "hidden", "limit"), "near-open")
    columns = ("node", "size", "root", "bands", "sketch", "bitmap", "hidden", "limit")
    x = left_open.where(F.col("root") != F.col("main")).select("key", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = left_open.select(F.col("key").alias("_key"), F.col("main").alias("y_main"), *[F.col(c).alias(f"y_{c}") for c in columns])
    apart = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("y_main")) | (F.col("x_node") < F.col("y_node")))
    sizes = (F.col("x_size") * 100 >= F.col("y_size") * percent) & (F.col("y_size") * 100 >= F.col("x_size") * percent)
    alike = differing("x_sketch", "y_sketch") <= F.greatest("x_limit", "y_limit")
    sharing = most_shared("x", "y") * (100 + percent) >= (F.col("x_size") + F.col("y_size")) * percent
    # A pair may count as one of the main part in one bucket and not in another; what is left of such repeats goes by distinct.
    once = F.col("key") == F.array_min(F.array_intersect("x_bands", "y_bands"))
    met = x.join(y.hint("merge"), (F.col("key") == F.col("_key")) & apart & sizes & sharing & alike & once)
    return settle(
        met.select(
            F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), F.least("x_root", "y_root").alias("low"),
            F.greatest("x_root", "y_root").alias("high"), differing("x_sketch", "y_sketch").alias("apart")).distinct(), "near-rest")


def joined_parts(rest: DataFrame, texts: DataFrame, percent: int) -> list[DataFrame]:
    """Links (a, b) between parts, confirmed in rounds over the pairs of `rest`."""
    own = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    found = []
    for most in ROUNDS:
        if rest.isEmpty():
            break
        chosen = rest if most is None else settle(first_k(rest, ["low", "high"], [F.col("apart"), F.col("a"), F.col("b")], most), "near-chosen")
        links = settle(confirmed(chosen.select("a", "b").join(own, "a"), texts, percent), "near-links")
        found.append(links)
        if most is None:
            break
        parts = components(chosen.join(links, ["a", "b"], "left_semi").select(F.col("low").alias("a"), F.col("high").alias("b")))
        parts = settle(parts, "near-parts")
        for side in ("low", "high"):
            rest = rest.join(parts.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(side) == F.col("_node"), "left").withColumn(
                side, F.coalesce("_root", side)).drop("_node", "_root")
        open_ = rest.where(F.col("low") != F.col("high")).join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        rest = settle(open_.select("a", "b", F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"), "apart"), "near-rest")
    return found


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = settle(
        docs.select("doc_id", "text").mapInArrow(
            _sign, f"doc_id {kind}, cls binary, n_shingles long, bands array<long>, sketch array<long>, bitmap array<long>, hidden long"), "near-signed")
    # Rows of a class have equal sets, so any of their bands, sketches and bitmaps will do.
    classes = settle(
        signed.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).groupBy("cls").agg(
            F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "bitmap", "hidden")]), "near-classes")
    shared = shared_buckets(classes)
    # Texts to compare grow with the data, so this join is never a broadcast.
    texts = settle(
        docs.select("doc_id", "text").join(first_met(shared).hint("merge"), F.col("doc_id") == F.col("_node"))
        .select(F.col("doc_id").alias("node"), "partners", "text"), "near-texts")
    met = texts.select(F.col("node").alias("a"), F.explode("partners").alias("b"), F.col("text").alias("text_a"))
    links = settle(confirmed(met, texts, percent), "near-links")
    roots = settle(components(links), "near-roots")
    more = joined_parts(rest_pairs(shared, roots, classes, percent), texts, percent)
    if more and not all(links.isEmpty() for links in more):
        roots = settle(components(reduce(DataFrame.unionByName, more, roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "near-roots")
    placed = settle(
        classes.select("cls", "node").join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
        .select(F.col("cls").alias("_cls"), F.coalesce("root", "node").alias("_component")), "near-components")
    return signed.join(placed, F.col("cls") == F.col("_cls"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("_component", "doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay: one document of each group; of rows with the same doc_id and text one stays."""
    kept = settle(
        near_groups(docs, percent).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_kept")).distinct(), "near-kept")
    rows = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    named = docs.where(F.col("doc_id").isNull())
    return rows.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash").unionByName(named)


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(read(spark, folder, "documents"))
