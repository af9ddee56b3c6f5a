"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

Every word has a log-odds of standing in toxic texts.  Its prior is the rate of
its longest counted prefix, whose prior is that of the next shorter one, down to
the rate of all texts, so an unseen form leans on what it begins with; a longer
unit moves away from its prefix only by what is beyond the error of its counts.  With a small cost per word, one
linear scan of a text finds all its maximal scoring segments, from every place of every word.
Within a segment the k-th place of a word that speaks for toxicity counts 1/k, and the segment's score shrinks to
that share of it: repeats are not independent, but no place is lost to an earlier part of the text.  By the theory of maximal segment scores the best one of n clean words
exceeds x with probability 1 - exp(-K n exp(-lambda x)); lambda and K are
estimated on clean texts, and the evidence of a text is that of its significant
segments beyond chance.  A logistic fit turns evidence into the score.

Learning reads about `PER_CLASS` labelled rows of each label (a documented
bound) that are not held out.  Of near copies with one label, found by bands of a
min-max signature, the one with the smallest id counts: the chance words of a
text that occurs many times would else look like evidence.  Word rates are cross-fitted: the calibration
scores each half of them with the rates of the other half.

Defined cases: a null or empty text has no words, no evidence and the score of
none; without labels of both kinds every score is 0; equal segments tie towards
the earlier; repeated rows are scored alike; several labels of one document
count as toxic if any is; an empty table gives an empty result; other columns
are passed through or not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import (
    byte_slices, held_out, in_shares, letter_words, letterless_table, mix, powers, read, word_bounds, word_hashes,
)
from leadloom.llm.near_dedup import band_keys, extremes, shingle_sets
from leadloom.session import settle

PER_CLASS = 10_000
#: Bytes of the counted beginnings of a word; the whole word comes after them.
PREFIXES = (4, 5, 6, 7, 9)
LEVELS = len(PREFIXES) + 1
MIN_TEXTS = 3
PRIOR = 10.0
COST = 0.2
CAUTION = 1.5
RANGE = (-1.0, 6.0)
TOXIC_FROM = 0.7
LAMBDAS = np.linspace(0.2, 2.6, 13)
_TABLE = 1 << 19
_FOLDS = 2
#: Rows of counts that a task holds per level before it gives them on.
_HELD = 300_000
#: Bands of a signature and values of each, by which copies among the labelled rows are found.
_BANDS, _BAND_ROWS = 10, 3


@dataclass(frozen=True)
class Rates:
    """Per level, a table from hashed units to scores; a tag tells units of one place apart."""

    tags: np.ndarray
    scores: np.ndarray


@dataclass(frozen=True)
class Model:
    rates: Rates
    scale: float
    k: float
    weights: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray):
    """First word of each text, and per level the hashed unit of each word and whether the word has one."""
    letters = letter_words(fold=True)
    starts, ends, firsts = word_bounds(data, offsets, letterless_table())
    lengths = ends - starts
    power = powers(16)
    levels, running, done = [], np.zeros(len(starts), np.uint64), 0
    for level, size in enumerate(PREFIXES):
        longer = lengths > size
        for j in range(done, size):
            running = running + letters[data[np.minimum(starts + j, max(len(data) - 1, 0))]] * power[j]
        done = size
        levels.append((mix(running + np.uint64(level + 1)), longer))
    levels.append((word_hashes(data, starts, ends, letters), np.ones(len(starts), bool)))
    return firsts, levels


def word_scores(rates: Rates, firsts: np.ndarray, levels: list) -> np.ndarray:
    """The log-odds of each word from its longest known unit, less the cost of a word."""
    score = np.zeros(int(firsts[-1]), np.float32)
    for level, (key, has) in enumerate(levels):
        place = key & np.uint64(_TABLE - 1)
        known = has & (rates.tags[level][place] == (key >> np.uint64(32)).astype(np.uint32))
        score[known] = rates.scores[level][place[known]]
    return score.astype(np.float64) - COST


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one text, in one pass over its positive words."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[tuple[int, int, float, float]] = []
    for p in np.flatnonzero(score > 0).tolist():
        start, low, high = p, float(total[p]), float(total[p + 1])
        while found:
            # The latest segment that starts lower decides: it either ends below `high` and joins, or stands apart.
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, p + 1, low, high))
    return [(a, z, high - low) for a, z, low, high in found]


def discounted(score: np.ndarray, word: np.ndarray, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The segments with scores that count the k-th place of a positive word in a segment 1/k."""
    if not found:
        return found
    place = np.flatnonzero(score > 0)
    # Every positive word lies in a segment.
    segment = np.searchsorted(np.array([a for a, _, _ in found]), place, "right") - 1
    order = np.lexsort((place, word[place], segment))
    at, own = segment[order], word[place][order]
    new = np.ones(len(order), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    number = np.arange(len(order))
    turn = number - np.maximum.accumulate(np.where(new, number, 0)) + 1
    gain = score[place][order]
    share = np.bincount(at, gain / turn, len(found)) / np.bincount(at, gain, len(found))
    return [(a, z, s * share[i]) for i, (a, z, s) in enumerate(found)]


def _merged(rows: list[tuple]) -> tuple:
    """Counts of equal cells added up."""
    cell, unit, above, fold, toxic, n = (np.concatenate(column) for column in zip(*rows))
    cells, at, back = np.unique(cell, return_index=True, return_inverse=True)
    add = lambda values: np.bincount(back, values, len(cells)).astype(np.int64)
    return cells, unit[at], above[at], fold[at], add(toxic), add(n)


def _counted(level: int, rows: list[tuple]):
    """Batches of the merged counts of a level."""
    _, k, above, fold, t, n = _merged(rows)
    for a in range(0, len(k), 100_000):
        z = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k[z]), level, np.int32)), pa.array(k[z].astype(np.int64)), pa.array(above[z].astype(np.int64)),
             pa.array(fold[z].astype(np.int32)), pa.array(t[z]), pa.array(n[z])],
            names=["level", "unit", "above", "fold", "toxic", "n"])


def _count(batches):
    """Texts and toxic texts per fold and unit, with the unit's next shorter prefix; given on whenever a level has `_HELD` rows."""
    kept: list[list] = [[] for _ in range(LEVELS)]

    for batch in batches:
        toxic, fold = batch["toxic"].to_numpy(zero_copy_only=False), batch["fold"].to_numpy(zero_copy_only=False)
        for first, _end, data, offsets in byte_slices(batch["text"]):
            firsts, levels = units(data, offsets)
            text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            parent = np.zeros(len(text), np.uint64)
            for level, (key, has) in enumerate(levels):
                _, once = np.unique(mix(key[has] + text[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                k, above, t = key[has][once], parent[has][once], text[has][once] + first
                cell = mix(k + fold[t].astype(np.uint64))
                kept[level].append((cell, k, above, fold[t], toxic[t], np.ones(len(t), np.int64)))
                if sum(len(x[0]) for x in kept[level]) > _HELD:
                    yield from _counted(level, kept[level])
                    kept[level] = []
                parent = np.where(has, key, parent)
    for level, rows in enumerate(kept):
        if rows:
            yield from _counted(level, rows)


def _rates(counts: dict, folds, base: float) -> Rates:
    """Hierarchical rates from the counts of some folds, as tables of log-odds against the rate of all texts."""
    tags, scores = np.zeros((LEVELS, _TABLE), np.uint32), np.zeros((LEVELS, _TABLE), np.float32)
    logit = lambda p: np.log(p / (1 - p))
    above_units, above_rates, above_sure = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for level in range(LEVELS):
        at = counts["level"] == level
        unit, above = counts["unit"][at], counts["above"][at]
        n = sum(counts[f"n{f}"][at] for f in folds).astype(float)
        toxic = sum(counts[f"t{f}"][at] for f in folds).astype(float)
        prior, inherited = np.full(len(unit), base), np.zeros(len(unit))
        if len(above_units):
            place = np.minimum(np.searchsorted(above_units, above), len(above_units) - 1)
            prior = np.where(above_units[place] == above, above_rates[place], base)
            inherited = np.where(above_units[place] == above, above_sure[place], 0.0)
        for_, against = toxic + PRIOR * prior, n - toxic + PRIOR * (1 - prior)
        step = np.log(for_ / against) - logit(prior)
        # A longer unit moves away from its prefix by what is left of the step after `CAUTION` standard errors.
        sure = inherited + np.sign(step) * np.maximum(0, np.abs(step) - CAUTION * np.sqrt(1 / for_ + 1 / against))
        rate = for_ / (for_ + against)
        keep = np.argsort(n, kind="stable")
        keep = keep[n[keep] > 0]
        key = unit[keep].astype(np.uint64)
        place = key & np.uint64(_TABLE - 1)
        tags[level][place] = (key >> np.uint64(32)).astype(np.uint32)
        scores[level][place] = np.clip(sure[keep], *RANGE)
        known = np.concatenate([above_units, unit])
        rates, sures = np.concatenate([above_rates, rate]), np.concatenate([above_sure, sure])
        order = np.argsort(known, kind="stable")
        above_units, above_rates, above_sure = known[order], rates[order], sures[order]
    return Rates(tags, scores)


def _evidence(n: np.ndarray, found: list, scale: float, k: float) -> np.ndarray:
    """Per text: 1, what the best segment has beyond chance, and the log of what all significant ones have."""
    out = np.zeros((len(n), 3))
    out[:, 0] = 1
    for i, scores in enumerate(found):
        beyond = scale * np.asarray(scores, float) - np.log(max(k * max(n[i], 1), 1e-9))
        out[i, 1] = np.clip(beyond.max(), -10, 30) / 10 if len(beyond) else -1.0
        out[i, 2] = np.log1p(beyond[beyond > 0].sum())
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, toxic, fold of about `per_class` labelled rows of each label that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = [(r["toxic"], per_class / r["count"]) for r in known.groupBy("toxic").count().collect()]
    picked = known.where(in_shares(F.col("toxic"), F.xxhash64("doc_id"), shares)).select(
        F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    # At most about 2 * per_class ids and labels: bounded, so it can go to every task.
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(_FOLDS)).cast("int").alias("fold"))


def without_copies(rows: DataFrame) -> DataFrame:
    """The labelled rows without those that share a band with a row of the same label and a smaller id."""
    def sign(batches):
        for batch in batches:
            keys = [None] * len(batch)
            for first, _end, data, offsets in byte_slices(batch["text"]):
                values, firsts = shingle_sets(data, offsets)
                full = np.flatnonzero(np.diff(firsts) > 0)
                if len(full):
                    bands = band_keys(extremes(values, firsts, _BANDS * _BAND_ROWS // 2), _BAND_ROWS).view(np.int64)
                    for i, j in enumerate(full):
                        keys[first + j] = bands[i]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "toxic", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = settle(rows.select("doc_id", "toxic", "text").mapInArrow(sign, f"doc_id {kind}, toxic int, bands array<long>")
                    .select("doc_id", "toxic", F.explode("bands").alias("band")), "toxicity-bands")
    least = signed.groupBy("toxic", "band").agg(F.min("doc_id").alias("_least"))
    copies = signed.join(least, ["toxic", "band"]).where(F.col("doc_id") > F.col("_least")).select(F.col("doc_id").alias("_copy")).distinct()
    return rows.join(copies, F.col("doc_id") == F.col("_copy"), "left_anti")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows = settle(without_copies(settle(training_rows(docs, labels, per_class), "toxicity-labelled")), "toxicity-sample")
    totals = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    ones, zeros = (sum(v for (_, t), v in totals.items() if t == x) for x in (1, 0))
    if not ones or not zeros:
        return None
    base = min(max(ones / (ones + zeros), 1e-3), 0.5)
    per_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{a}{f}") for f in range(_FOLDS) for a, c in (("t", "toxic"), ("n", "n"))]
    counted = (
        rows.mapInArrow(_count, "level int, unit long, above long, fold int, toxic long, n long")
        .groupBy("level", "unit").agg(F.max("above").alias("above"), *per_fold).where(F.col("n0") + F.col("n1") >= MIN_TEXTS)
        .toArrow()
    )
    counts = {c: counted[c].to_numpy() for c in counted.column_names}
    order = np.argsort(counts["unit"], kind="stable")
    counts = {c: v[order] for c, v in counts.items()}
    crossed = [_rates(counts, [1 - f], base) for f in range(_FOLDS)]

    def scan(batches):
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            n, found, grid = np.zeros(len(fold), np.int64), [[] for _ in range(len(fold))], np.zeros((len(fold), len(LAMBDAS)))
            for first, end, data, offsets in byte_slices(batch["text"]):
                firsts, levels = units(data, offsets)
                both = [word_scores(r, firsts, levels) for r in crossed]
                for i in range(end - first):
                    z = slice(firsts[i], firsts[i + 1])
                    score = both[fold[first + i]][z]
                    n[first + i] = len(score)
                    found[first + i] = [s for _, _, s in discounted(score, levels[-1][0][z], segments(score)) if s > 0.5]
                    grid[first + i] = [np.exp(v * score).sum() for v in LAMBDAS]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], pa.array(n), pa.array(found, pa.list_(pa.float64())), pa.array(grid.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "n", "found", "grid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = rows.mapInArrow(scan, f"doc_id {kind}, toxic int, n long, found array<double>, grid array<double>").toArrow()
    seen = seen.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    toxic, n = seen["toxic"].to_numpy(), seen["n"].to_numpy()
    grid, found = np.array(seen["grid"].to_pylist()), seen["found"].to_pylist()
    clean = toxic == 0
    mean = grid[clean].sum(axis=0) / max(n[clean].sum(), 1)
    over = np.flatnonzero(mean >= 1)
    scale = float(LAMBDAS[over[0]]) if len(over) else float(LAMBDAS[-1])
    best = np.array([max(f, default=0.0) for f in found])
    k = 1 / max(float((n[clean] * np.exp(-scale * best[clean])).mean()), 1e-9)
    weights = _logistic(_evidence(n, found, scale, k), toxic.astype(float))
    return Model(_rates(counts, range(_FOLDS), base), scale, k, weights)


def scanned(texts: pa.Array, model: Model):
    """Slices of texts: the first's number, scores, and per text its segments (first word, word after the last, score) and words.

    What is kept of a slice goes with it, so memory follows the slice and not the batch.
    """
    for first, end, data, offsets in byte_slices(texts):
        firsts, levels = units(data, offsets)
        score, words = word_scores(model.rates, firsts, levels), levels[-1][0]
        n, found = np.diff(firsts), []
        for a, z in zip(firsts[:-1], firsts[1:]):
            found.append(discounted(score[a:z], words[a:z], segments(score[a:z])))
        x = _evidence(n, [[s for _, _, s in f if s > 0.5] for f in found], model.scale, model.k)
        yield first, 1 / (1 + np.exp(-(x @ model.weights))), found, n


def passages(texts: pa.Array, model: Model) -> tuple[np.ndarray, list]:
    """Words per text, and all its segments."""
    counts, found = [], []
    for _, _, own, n in scanned(texts, model):
        counts += n.tolist()
        found += own
    return np.array(counts, np.int64), found


def scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    """Score per text."""
    out = np.zeros(len(texts))
    for first, score, _, _ in scanned(texts, model) if model else ():
        out[first: first + len(score)] = score
    return out


def predict(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, list]:
    """Score per text, and its significant passages."""
    out, shown = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for first, score, found, n in scanned(texts, model) if model else ():
        out[first: first + len(score)] = score
        level = np.log(np.maximum(model.k * np.maximum(n, 1), 1e-9))
        for i, own in enumerate(found):
            shown[first + i] = [p for p in own if model.scale * p[2] > level[i]]
    return out, shown


def score_documents(docs: DataFrame, model: Model | None, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (first word, word after the last, score) of every row."""
    def run(batches):
        passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            score, shown = predict(batch["text"], model)
            rows = [[{"first": a, "end": z, "score": s} for a, z, s in f] for f in shown]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= toxic_from).astype(np.int32)), pa.array(rows, passage)],
                names=["doc_id", "held_out", "score", "predicted", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<first: int, end: int, score: double>>")


def drop_toxic(docs: DataFrame, model: Model | None, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of `docs`; only texts go to Python, and only verdicts come back."""
    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model) < toxic_from)

    return docs.where(stays(F.col("text").cast("string")))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, read(spark, folder, "labels"))
    return score_documents(docs, model).drop("passages")
