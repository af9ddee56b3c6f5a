"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by gradient descent in numpy.

A text is the average of the embeddings of its byte n-grams; the class scores
are linear in it.  Once trained, embedding and softmax fold into one score per
bucket and language, so a prediction is one pass of look-ups and sums.  Scores
are calibrated by a temperature on rows kept out of training, and a text whose
calibrated score is under the rejection level is rejected.

Training reads about `PER_LANGUAGE` rows of each language (a documented bound);
everything else covers all rows.

Defined cases: a null text or one without a letter is `und` with score 0 and
rejected; without any label to learn from every row is; ties go to the first
language in order; repeated rows are judged alike; an empty table gives an
empty result; other columns are passed through or not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import byte_slices, held_out, labelled_sample, lower_table, letterless_table, read, segment_sums

UNKNOWN = "und"
PER_LANGUAGE = 600
GRAMS = (2, 4)
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 12
RATE = 0.5
#: A score is trusted in full only with many more n-grams than this.
SHORT = 6
#: Texts under this calibrated score are rejected, or under the level that `SPARED` of the labelled rows reach, if lower.
REJECT_BELOW = 0.4
SPARED = 0.999
_SEED = 7


@dataclass(frozen=True)
class Model:
    languages: tuple
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _plain() -> np.ndarray:
    """Lower case for ASCII letters; everything that is no letter is a blank."""
    table = lower_table()
    table[letterless_table()] = 32
    return table


def grams(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray):
    """Per n-gram size: the bucket of the n-gram at each byte, and whether it counts (inside its text, not blank)."""
    letters = plain[data]
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    blank = letters == 32
    place = np.arange(len(letters))
    for n in GRAMS:
        code = np.zeros(len(letters), np.uint32)
        for j in range(n):
            code[: len(letters) - j] |= letters[j:].astype(np.uint32) << np.uint32(8 * j)
        bucket = (code + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)
        counts = place + n <= text_end
        counts[:-1] &= ~(blank[:-1] & blank[1:])
        yield bucket, counts


def _has_letter(texts: pa.Array, first: int, ascii_letters: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without ASCII letters are looked at character by character."""
    found = ascii_letters > 0
    for i in np.flatnonzero(~found):
        text = texts[first + int(i)].as_py()
        found[i] = bool(text) and any(map(str.isalpha, text))
    return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits(texts: pa.Array, scores: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class scores, trust in them and whether there is a letter, per text."""
    plain, letter = _plain(), ~letterless_table()
    letter[128:] = False
    out, trust, lettered = np.zeros((len(texts), len(bias))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for first, end, data, offsets in byte_slices(texts):
        total, sums = np.zeros(end - first), np.zeros((end - first, len(bias)))
        for size, (bucket, counts) in enumerate(grams(data, offsets, plain)):
            bucket = bucket + np.uint32(size * BUCKETS)
            total += segment_sums(counts, offsets)
            for k in range(len(bias)):
                sums[:, k] += segment_sums(scores[k][bucket] * counts, offsets)
        out[first:end] = sums / np.maximum(total, 1)[:, None] + bias
        trust[first:end] = total / (total + SHORT)
        lettered[first:end] = _has_letter(texts, first, segment_sums(letter[data], offsets))
    return out, trust, lettered


def _sparse(texts: pa.Array) -> list:
    """(buckets, weights) of each text, weights adding up to 1."""
    plain, rows = _plain(), []
    for _first, _end, data, offsets in byte_slices(texts):
        parts = [(b + np.uint32(i * BUCKETS), c) for i, (b, c) in enumerate(grams(data, offsets, plain))]
        for a, z in zip(offsets[:-1], offsets[1:]):
            found = np.concatenate([b[a:z][c[a:z]] for b, c in parts])
            buckets, n = np.unique(found, return_counts=True)
            rows.append((buckets.astype(np.int64), n / max(1, n.sum())))
    return rows


def fit(texts: pa.Array, labels: list, seed: int = _SEED) -> Model | None:
    """Train on four fifths of the rows, calibrate on the rest."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows, y = _sparse(texts), np.searchsorted(languages, labels)
    order = rng.permutation(len(rows))
    apart, learn = order[: len(rows) // 5], order[len(rows) // 5:]
    embed = rng.normal(0, 0.1, (BUCKETS * len(GRAMS), WIDTH))
    seen = np.full(len(embed), 1e-8)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            buckets, share = rows[i]
            if not len(buckets):
                continue
            hidden = share @ embed[buckets]
            error = softmax(hidden @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= rate * 0.2 * np.outer(hidden, error)
            bias -= rate * 0.02 * error
            # Steps shrink with what a bucket has learned already, so rare n-grams learn as much as common ones.
            seen[buckets] += share * share * (back @ back)
            embed[buckets] -= rate * np.outer(share / np.sqrt(seen[buckets]), back)
    scores = np.ascontiguousarray((embed @ weights).T.astype(np.float32))
    if len(apart) < 10:
        return Model(languages, scores, bias, 1.0, REJECT_BELOW)
    z, trust, _ = logits(texts.take(pa.array(apart)), scores, bias)
    truth, at = y[apart], np.arange(len(apart))

    def loss(t):
        return -np.log(np.maximum(softmax(z * trust[:, None] / t)[at, truth], 1e-12)).mean()

    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    given = np.sort(softmax(z * trust[:, None] / temperature).max(axis=1))
    return Model(languages, scores, bias, temperature, min(REJECT_BELOW, float(given[int(len(given) * (1 - SPARED))])))


def predict(texts: pa.Array, model: Model | None) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    z, trust, lettered = logits(texts, model.scores, model.bias)
    p = softmax(z * trust[:, None] / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
    return names, score, ~lettered | (score < model.reject_below)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from text and lang of about `per_language` rows of each language that are not held out."""
    sample = labelled_sample(docs.where(F.col("text").isNotNull()), "lang", per_language).select("text", "lang", "doc_id").toArrow()
    order = sorted(range(sample.num_rows), key=lambda i: (sample["doc_id"][i].as_py(), sample["text"][i].as_py()))
    sample = sample.take(pa.array(order, pa.int64()))
    return fit(sample["text"].combine_chunks(), sample["lang"].to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    def run(batches):
        for batch in batches:
            names, score, rejected = predict(batch["text"], model)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose language is not rejected, with the columns of `docs`; only texts go to Python, and only verdicts come back."""
    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        return pa.array(~predict(texts, model)[2])

    return docs.where(known(F.col("text").cast("string")))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
