"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides.

The two words before and the two after a place are embedded, weighed by their
distance, added and passed through tanh; a softmax over groups of words, and one
over the leaves of the group, predict the word between them.  The tree is built
from the company that words keep: every word's neighbours are added up as random
signs, and words with like sums share a group.  In a group the most frequent
words are leaves of their own; the others share leaves by nearness of their sums,
so rare words are predicted from both sides too.  Within a leaf a word has its
share of the counts.  A document's score is the sum of the logarithms of these
conditional probabilities.

Everything is learned from all documents.  The words' counts and sums are a Spark
table by the 64-bit hash of the word; it grows with the vocabulary and is joined,
never gathered.  The tree is laid out over about `LAYOUT` of the most frequent words (a
documented bound); all others go to the nearest leaf.  In each round every
partition trains on masked places of all its documents, from the common
parameters, and the results are averaged by the number of places.  Which places
are masked follows from the leaves and places, so reruns on the same layout of
partitions agree.  The driver sees the parameters, the leaves' totals and the
`LAYOUT` words, all of fixed size.

Documents are dealt into parts of about `PART_BYTES`, each a row in which texts are
numbers of words; a part's distinct words are joined with the word table and come back
to it, packed by task, so that every place has its leaf and share, and no join sees
every occurrence of a word.  The `LAYOUT` words, which most parts have, go along with
the function instead.

Defined cases: a null or empty text has 0 words, likelihood 0 and no mean;
places beyond the ends of a text are a padding word; a word that was not learned
has the leaf that its hash draws, and half an occurrence there; repeated rows
score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import byte_slices, letter_words, mix, read, segment_sums, space_table, word_bounds, word_hashes
from leadloom.session import settle

GROUPS = 64
LEAVES = 64
CLASSES = GROUPS * LEAVES
#: Leaves of a group that hold one frequent word each.
SINGLE = 32
#: A word is embedded as its leaf.
ROWS = CLASSES
WIDTH = 16
#: Random signs by which the words on each side are added up.
SIGNS = 8
LAYOUT = 20_000
PART_BYTES = 1 << 22
#: A task sends what it has found for the parts each time it has so many words.
_GATHERED = 1 << 20
SIDES = (-2, -1, 1, 2)
#: One place in so many is masked in a round.
MASKED = 6
ROUNDS = 2
RATE = 0.3
_BATCH = 1024
#: Scores below it need no maximum taken off before exp.
_STEEP = 60.0
_CHUNK = 2048
_SMOOTH = 0.5


@dataclass(frozen=True)
class WordColumn:
    """A column of the table (word, leaf, n, share); numpy gathers it, which only tests do.  `common` has the rows of the frequent words."""

    table: DataFrame
    name: str
    totals: np.ndarray
    common: pa.Table

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.table.select(self.name).toArrow()[self.name].to_numpy(), dtype)


@dataclass(frozen=True)
class Model:
    """Leaf of each word, log share of each word in its leaf, and the network's parameters in one row."""

    classes: WordColumn
    share: WordColumn
    parameters: np.ndarray


def _split(parameters: np.ndarray):
    """Views: embeddings (the last row pads), weights of the sides, weights and bias of the groups, and those of each group's leaves."""
    shapes = ((ROWS + 1, WIDTH), (len(SIDES), WIDTH), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, LEAVES), (GROUPS, LEAVES))
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    return [part.reshape(shape) for part, shape in zip(np.split(parameters, ends[:-1]), shapes)]


def start(classes: WordColumn, counts: DataFrame, seed: int = 3) -> np.ndarray:
    """First parameters: small random embeddings, and the frequencies of groups and leaves as bias."""
    return _first(_leaf_totals(counts.select("word", "n").join(classes.table.select("word", "leaf"), "word")), seed)


def _first(totals: np.ndarray, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    total = totals.reshape(GROUPS, LEAVES) + _SMOOTH
    parts = [
        rng.normal(0, 0.3, (ROWS + 1) * WIDTH), np.ones(len(SIDES) * WIDTH), rng.normal(0, 0.1, WIDTH * GROUPS), np.log(total.sum(axis=1) / total.sum()),
        rng.normal(0, 0.1, WIDTH * CLASSES), np.log(total / total.sum(axis=1, keepdims=True)).reshape(-1)]
    return np.concatenate(parts).astype(np.float32)


def words(texts: pa.Array):
    """Per slice: first text, the texts' first words, and the hash of every word."""
    letters, spaces = letter_words(fold=True), space_table()
    for first, _end, data, offsets in byte_slices(texts):
        starts, ends, firsts = word_bounds(data, offsets, spaces)
        yield first, firsts, word_hashes(data, starts, ends, letters)


def contexts(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Embedding row (the bits from 40 on) of the word at each side of each place, the padding row beyond the ends of the text."""
    return _beside((hashes >> np.uint64(40)).astype(np.int64) & (ROWS - 1), firsts)


def _beside(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.full((len(SIDES), len(rows)), ROWS, np.int64)
    for own, side in zip(out, SIDES):
        if abs(side) < len(rows):
            here, other = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
            own[here] = rows[other]
        # The places next to an end of their text, also where a text is shorter than the side is far.
        for far in range(abs(side)):
            edge = firsts[:-1] + far if side < 0 else firsts[1:] - 1 - far
            own[edge[(edge >= 0) & (edge < len(rows))]] = ROWS
    return out


def _hidden(parameters: np.ndarray, around: np.ndarray) -> np.ndarray:
    embed, sides = _split(parameters)[:2]
    return np.tanh(sum(embed[around[i]] * sides[i] for i in range(len(SIDES))))


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _grouped(group: np.ndarray):
    """Order of places by group, and (group, first, end) of the groups that occur."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS))
    begins = np.concatenate([[0], ends[:-1]])
    return order, [(g, begins[g], ends[g]) for g in np.flatnonzero(ends > begins).tolist()]


def log_probabilities(parameters: np.ndarray, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the leaf at each place."""
    embed, sides, weights, bias, leaf_weights, leaf_bias = _split(parameters)
    tables = [embed * side for side in sides]
    # Scores of all groups and of one group's leaves come from one product; as |tanh| is at most 1, most models need no maximum before exp.
    both = np.concatenate([np.broadcast_to(weights.T, (GROUPS, GROUPS, WIDTH)), leaf_weights.transpose(0, 2, 1)], axis=1)
    both_bias = np.concatenate([np.broadcast_to(bias, (GROUPS, GROUPS)), leaf_bias], axis=1)[:, :, None]
    steep = not (np.abs(both).sum(axis=2) + np.abs(both_bias[:, :, 0])).max() < _STEEP
    out = np.empty(len(target))
    for a in range(0, len(target), 16 * _BATCH):
        z = slice(a, a + 16 * _BATCH)
        order, present = _grouped(target[z] // LEAVES)
        truth = target[z][order] % LEAVES
        hidden = np.tanh(sum(np.take(table, near[z][order], axis=0) for table, near in zip(tables, around)))
        logs = np.empty(len(truth))
        for g, first, end in present:
            scores = both[g] @ hidden[first:end].T
            scores += both_bias[g]
            if steep:
                scores[:GROUPS] -= scores[:GROUPS].max(axis=0)
                scores[GROUPS:] -= scores[GROUPS:].max(axis=0)
            own = scores[g] + scores[GROUPS + truth[first:end], np.arange(end - first)]
            np.exp(scores, out=scores)
            logs[first:end] = own - np.log(scores[:GROUPS].sum(axis=0)) - np.log(scores[GROUPS:].sum(axis=0))
        out[a + order] = logs
    return out


def descend(parameters: np.ndarray, seen: np.ndarray, around: np.ndarray, target: np.ndarray) -> None:
    """One gradient step per batch of masked places, in place; steps shrink with the gradients `seen` so far."""
    embed, sides, weights, bias, leaf_weights, leaf_bias = _split(parameters)
    seen_embed, seen_sides, seen_weights, seen_bias, seen_leaf_weights, seen_leaf_bias = _split(seen)

    def step(values, known, gradient, rate=0.3):
        known += gradient * gradient
        values -= rate * RATE * gradient / np.sqrt(known + 1e-8)

    for a in range(0, len(target), _BATCH):
        order, present = _grouped(target[a:a + _BATCH] // LEAVES)
        near, truth = around[:, a:a + _BATCH][:, order], target[a:a + _BATCH][order]
        n = len(truth)
        hidden = _hidden(parameters, near)
        error = _softmax(hidden @ weights + bias)
        error[np.arange(n), truth // LEAVES] -= 1
        error /= n
        back = error @ weights.T
        step(weights, seen_weights, hidden.T @ error)
        step(bias, seen_bias, error.sum(axis=0))
        scores = leaf_bias[truth // LEAVES]
        for g, first, end in present:
            scores[first:end] += hidden[first:end] @ leaf_weights[g]
        error = _softmax(scores)
        error[np.arange(n), truth % LEAVES] -= 1
        error /= n
        # Groups that do not occur have a gradient of 0, which changes nothing.
        gradient, bias_gradient = np.zeros_like(leaf_weights), np.zeros_like(leaf_bias)
        for g, first, end in present:
            back[first:end] += error[first:end] @ leaf_weights[g].T
            np.matmul(hidden[first:end].T, error[first:end], out=gradient[g])
        bias_gradient[[g for g, _, _ in present]] = np.add.reduceat(error, [first for _, first, _ in present], axis=0)
        step(leaf_weights, seen_leaf_weights, gradient)
        step(leaf_bias, seen_leaf_bias, bias_gradient)
        back *= 1 - hidden * hidden
        for i in range(len(SIDES)):
            gradient = (back * embed[near[i]]).sum(axis=0)
            by_row = np.argsort(near[i].astype(np.uint16), kind="stable")
            rows = near[i][by_row]
            firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows[firsts]
            change = np.add.reduceat((back * sides[i])[by_row], firsts, axis=0)
            seen_embed[rows] += change * change
            embed[rows] -= 0.3 * RATE * change / np.sqrt(seen_embed[rows] + 1e-8)
            step(sides[i], seen_sides[i], gradient, 0.1)


def _company(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a slice, and per word its count and the sums of the signs of the words on its left and on its right."""
    found, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    bits = mix(found + np.uint64(0x5163))
    signs = (((bits[:, None] >> np.arange(2 * SIGNS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1)
    signs = np.concatenate([signs, np.zeros((1, 2 * SIGNS), np.float32)])
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    sums = np.zeros((len(found), 1 + 2 * SIGNS), np.int64)
    sums[:, 0] = n
    for half, sides in ((0, SIDES[:2]), (SIGNS, SIDES[2:])):
        whose = []
        for side in sides:
            there = np.full(len(hashes), len(found))
            if abs(side) < len(hashes):
                here, other = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
                there[here] = np.where(text[here] == text[other], at[other], len(found))
            whose.append(there)
        for j in range(half, half + SIGNS):
            own = np.ascontiguousarray(signs[:, j])
            sums[:, 1 + j] = np.bincount(at, own[whose[0]] + own[whose[1]], len(found))
    return found, sums


_SUMS = [f"s{j}" for j in range(2 * SIGNS)]
#: Sums of up to this size go four bits each into one long, as those of most words do, and up to the next one eight bits each into two.
_NARROW = 7
_MIDDLE = 127
#: Places whose sums fit an int.
_PLACES = 1 << 29


def count_words(docs: DataFrame) -> DataFrame:
    """word, n and the sums of its neighbours' signs for every word of the whole table."""
    def run(batches):
        kept, size, places = [], 0, 0

        def merged() -> list[tuple]:
            word, sums = np.concatenate([w for w, _ in kept]), np.concatenate([v for _, v in kept])
            order = np.argsort(word, kind="stable")
            found, first = np.unique(word[order], return_index=True)
            return [(found, np.add.reduceat(sums[order], first, axis=0, dtype=sums.dtype))]

        def row_batch(found, sums):
            most = np.abs(sums[:, 1:]).max(axis=1)
            narrow, wide = most <= _NARROW, most > _MIDDLE
            fours = np.zeros(len(found), np.int64)
            for j in range(2 * SIGNS):
                fours |= (sums[:, 1 + j].astype(np.int64) & 15) << (4 * j)
            eights = np.ascontiguousarray(sums[:, 1:].astype(np.int8)).view("<i8")
            ends = np.where(wide, 2 * SIGNS, 0).cumsum()
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~wide, [False]])), pa.array(sums[wide, 1:].reshape(-1)))
            return pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.where(narrow, fours, np.where(wide, 0, eights[:, 0]))), pa.array(sums[:, 0].astype(np.int64)),
                 pa.array(eights[:, 1], mask=narrow | wide), lists], names=["word", "narrow", "n", "more", "wide"])

        for batch in batches:
            for _first, firsts, hashes in words(batch["text"]):
                if len(hashes):
                    found, sums = _company(hashes, firsts)
                    kept.append((found, sums.astype(np.int32)))
                    size += len(kept[-1][0])
                    places += len(hashes)
                if size > 1_000_000 or places > _PLACES:
                    kept = merged()
                    size = len(kept[0][0])
                    if size > 500_000 or places > _PLACES:
                        yield row_batch(*kept[0])
                        kept, size, places = [], 0, 0
        if kept:
            yield row_batch(*merged()[0])

    # The tasks have merged their words, so the packed rows are sent as they are and added up behind the exchange.
    # What differs from row to row stands together, the rest behind it: that takes the least room in an exchange.
    counted = docs.select("text").mapInArrow(run, "word long, narrow long, n long, more long, wide array<int>").repartition("word")

    def unpacked(j: int):
        four = F.shiftright(F.shiftleft("narrow", 60 - 4 * j), 60)
        eight = F.shiftright(F.shiftleft("narrow" if j < SIGNS else "more", 56 - 8 * (j % SIGNS)), 56)
        return F.coalesce(F.col("wide")[j].cast("long"), F.when(F.col("more").isNull(), four).otherwise(eight))

    sums = [F.sum(unpacked(j)).alias(c) for j, c in enumerate(_SUMS)]
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n"), *sums), "lm-words")


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * x @ centers.T, axis=1)


def _centers(x: np.ndarray, k: int) -> np.ndarray:
    """At most `k` means that vectors gather around; the first vectors begin."""
    _, first = np.unique(x, axis=0, return_index=True)
    centers = x[np.sort(first)[:k]].copy()
    for _ in range(10):
        own = _nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, c, len(centers)) for c in x.T], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _leaf_totals(table: DataFrame) -> np.ndarray:
    rows = table.groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(CLASSES, np.int64)
    totals[rows["leaf"].to_numpy()] = rows["n"].to_numpy()
    return totals


def word_classes(counts: DataFrame) -> tuple[WordColumn, WordColumn]:
    """Leaf of each word, and the log of its share in its leaf."""
    def vectors(rows) -> np.ndarray:
        return np.stack([rows[c].to_numpy() for c in _SUMS], axis=1) / rows["n"].to_numpy()[:, None]

    # A count of words per class of frequency says from where on they fit; of the class that fits in part, a hash picks.
    step = F.floor(F.log2("n") * 8)
    left, most, share = LAYOUT, 1 << 10, 0.0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        most, share = row["step"], min(1.0, left / row["count"])
        left -= row["count"]
        if left <= 0:
            break
    picked = (step > most) | ((step == most) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000)))
    top = counts.where(picked).toArrow().combine_chunks()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    x = vectors(top) if top.num_rows else np.zeros((1, 2 * SIGNS))
    groups = _centers(x, GROUPS)
    own = _nearest(x, groups)
    single, single_leaf, inner = [], [], []
    for g in range(len(groups)):
        members = np.flatnonzero(own == g)
        if top.num_rows:
            single.append(top["word"].to_numpy()[members[:SINGLE]])
            single_leaf.append(g * LEAVES + np.arange(len(single[-1])))
        rest = members[SINGLE:] if len(members) > SINGLE else members[-1:]
        inner.append(_centers(x[rest], LEAVES - SINGLE) if len(rest) else groups[g:g + 1])
    single = np.concatenate([*single, np.zeros(0, np.int64)])
    single_leaf = np.concatenate([*single_leaf, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(single, kind="stable")
    single, single_leaf = single[order], single_leaf[order]

    def place(batches):
        for batch in batches:
            x, word = vectors(batch), batch["word"].to_numpy()
            group = _nearest(x, groups)
            leaf = np.zeros(len(word), np.int64)
            for g in np.unique(group).tolist():
                leaf[group == g] = g * LEAVES + SINGLE + _nearest(x[group == g], inner[g])
            if len(single):
                at = np.minimum(np.searchsorted(single, word), len(single) - 1)
                leaf = np.where(single[at] == word, single_leaf[at], leaf)
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(leaf.astype(np.int32))], names=["word", "n", "leaf"])

    placed = settle(counts.mapInArrow(place, "word long, n long, leaf int"), "lm-leaves")
    totals = _leaf_totals(placed)
    logs = F.array(*[F.lit(float(v)) for v in np.log(np.maximum(totals, 1))])
    columns = ["word", "leaf", "n", (F.log("n") - F.element_at(logs, F.col("leaf") + 1)).cast("float").alias("share")]
    common = placed.where(picked).select(*columns).toArrow().combine_chunks().sort_by("word")
    # A share follows from the row and the totals, so it is worked out where it is read and not written again.
    table = placed.select(*columns)
    return WordColumn(table, "leaf", totals, common), WordColumn(table, "share", totals, common)


def encode(docs: DataFrame, classes: WordColumn) -> DataFrame:
    """doc_id, the leaf of every word, and the sum of the words' log shares, of every row."""
    kind, totals, common = docs.schema["doc_id"].dataType.simpleString(), classes.totals, classes.common
    frequent = common["word"].to_numpy()

    def numbered(rows: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        """The texts of a part as one row of numbers of words: from 1 on of the frequent ones, then of those with several places, the
        most frequent of the part first; 0 is the next of the others, which are asked for in the order of their places."""
        hashes, lengths = [np.zeros(0, np.uint64)], []
        for _first, firsts, found in words(pa.chunked_array([r["text"] for r in rows], pa.string())):
            hashes.append(found)
            lengths.append(np.diff(firsts))
        found, at, n = np.unique(np.concatenate(hashes).view(np.int64), return_inverse=True, return_counts=True)
        number = 1 + np.searchsorted(frequent, found)
        other = ~np.isin(found, frequent)
        rest, once = np.flatnonzero(other & (n > 1)), other & (n == 1)
        rest = rest[np.argsort(-n[rest], kind="stable")]
        number[rest] = 1 + len(frequent) + np.arange(len(rest))
        number[once] = 0
        doc_id, asked = pa.concat_arrays([r["doc_id"] for r in rows]), found[np.concatenate([rest, at[once[at]]])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (doc_id, pa.array(np.concatenate(lengths).astype(np.int32)), pa.array(asked))]
        return pa.RecordBatch.from_arrays(
            [*lists[:2], pa.array([_packed(number[at].astype(np.int32))], pa.binary()), pa.array([part]), lists[2]],
            names=["doc_id", "lengths", "places", "part", "asked"])

    def deal(batches):
        from pyspark import TaskContext

        part, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = np.array([len(t) if t else 0 for t in batch["text"].to_pylist()], np.int64)
            ends, first = np.cumsum(lengths), 0
            while first < batch.num_rows:
                before = int(ends[first] - lengths[first])
                end = min(int(np.searchsorted(ends, before + PART_BYTES - size)) + 1, batch.num_rows)
                rows.append(batch.slice(first, end - first))
                size += int(ends[end - 1]) - before
                first = end
                if size >= PART_BYTES:
                    yield numbered(rows, part)
                    part, rows, size = part + 1, [], 0
        if rows:
            yield numbered(rows, part)

    def gather(batches):
        """What a task has found for a part, in one row."""
        kept, size = [], 0

        def gathered() -> pa.RecordBatch:
            of, at, leaf, n = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(np.unique(of, return_inverse=True)[1] << 32 | at)
            of, at, leaf, n = of[order], at[order], leaf[order], n[order]
            firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            columns = [pa.array([_packed(c[a:z]) for a, z in zip(firsts[:-1], firsts[1:])], pa.binary()) for c in (at, leaf, n)]
            return pa.RecordBatch.from_arrays([pa.array(of[firsts[:-1]]), *columns], names=["of", "at", "leaf", "n"])

        for batch in batches:
            if batch.num_rows:
                kept.append([batch[c].to_numpy().astype(t) for c, t in (("of", np.int64), ("at", np.int32), ("leaf", np.int16), ("n", np.int64))])
                size += batch.num_rows
            if size >= _GATHERED:
                yield gathered()
                kept, size = [], 0
        if kept:
            yield gathered()

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        at, near, n = (np.concatenate([np.zeros(0, t), *[_unpacked(v, t) for v in right[c].to_pylist()]]) for c, t in (("at", np.int32), ("leaf", np.int16), ("n", np.int64)))
        leaf, share = (np.concatenate([common[c].to_numpy(), np.zeros(len(at), t)]) for c, t in (("leaf", np.int16), ("share", np.float64)))
        leaf = leaf.astype(np.int16)
        learned = (np.log(np.maximum(n, 1)) - np.log(np.maximum(totals[near], 1))).astype(np.float32)
        at = len(frequent) + at
        leaf[at], share[at] = near, np.where(n > 0, learned, np.log(_SMOOTH / (totals[near] + _SMOOTH)))
        doc_id, lengths = (left[c].combine_chunks().flatten() for c in ("doc_id", "lengths"))
        number = _unpacked(left["places"][0].as_py(), np.int32) - 1
        once = np.flatnonzero(number < 0)
        number[once] = len(leaf) - len(once) + np.arange(len(once))
        firsts = np.concatenate([[0], np.cumsum(lengths.to_numpy().astype(np.int64))])
        coded = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(leaf[number]))
        return pa.table({"doc_id": doc_id, "leaves": coded, "share": segment_sums(share[number], firsts)})

    row = f"doc_id array<{kind}>, lengths array<int>, places binary, part long, asked array<long>"
    parts = settle(docs.select("doc_id", "text").mapInArrow(deal, row), "lm-parts")
    asked = parts.select(F.col("part").alias("of"), F.posexplode("asked").alias("at", "word")).select("word", "at", "of")
    drawn = F.col("word").bitwiseAND(F.lit(CLASSES - 1)).cast("int")
    met = asked.join(classes.table.select("word", "leaf", "n"), "word", "left").select("of", "at", F.coalesce("leaf", drawn).alias("leaf"), F.coalesce("n", F.lit(0)).alias("n"))
    found = met.mapInArrow(gather, "of long, at binary, leaf binary, n binary")
    coded = parts.drop("asked").groupBy("part").cogroup(found.groupBy("of")).applyInArrow(fill, f"doc_id {kind}, leaves array<short>, share double")
    return settle(coded, "lm-coded")


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, the first bytes of all before the second ones; the size stands in front."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, len(planes) // width).T).view(kind).reshape(-1)


def _coded(batch: pa.RecordBatch):
    """First text, first words of the texts and the leaf of every word, in slices of about a million words of a batch."""
    lists = batch["leaves"]
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    leaf = lists.flatten().to_numpy().astype(np.int64)
    first = 0
    while first < len(lists):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 20), "right")) - 1)
        yield first, ends[first:end + 1] - ends[first], leaf[ends[first]:ends[end]]
        first = end


def _around(leaf: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return _beside(leaf, firsts)


def _add_up(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of the vectors of each group, in order of part."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending")])
        vectors = np.stack([np.asarray(v, np.float64) for v in table["vector"].to_pylist()]).sum(axis=0)
        return pa.table({
            "chunk": table["chunk"][:1], "part": pa.chunked_array([pa.array([table["part"][0].as_py()], pa.int32())]),
            "vector": pa.array([vectors], pa.list_(pa.float64())), "weight": pa.array([sum(table["weight"].to_pylist())], pa.float64())})

    return groups.groupBy(*keys).applyInArrow(run, "chunk int, part int, vector array<double>, weight double")


def _round(coded: DataFrame, parameters: np.ndarray, turn: int) -> np.ndarray:
    """The average of what every partition makes of the parameters on its masked places."""
    def run(batches):
        from pyspark import TaskContext

        own, seen, places = parameters.copy(), np.full(len(parameters), 1e-3, np.float32), 0
        for batch in batches:
            for _first, firsts, leaf in _coded(batch):
                place = np.arange(len(leaf), dtype=np.uint64)
                masked = np.flatnonzero(mix(leaf.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(MASKED) == 0)
                descend(own, seen, _around(leaf, firsts)[:, masked], leaf[masked])
                places += len(masked)
        part = TaskContext.get().partitionId()
        chunks = [own[a:a + _CHUNK].astype(np.float64) * places for a in range(0, len(own), _CHUNK)] if places else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array(chunks, pa.list_(pa.float64())),
             pa.array([float(places)] * len(chunks), pa.float64())], names=["chunk", "part", "vector", "weight"])

    trained = coded.select("leaves").mapInArrow(run, "chunk int, part int, vector array<double>, weight double")
    # Two levels of sums, so that no group grows with the number of partitions beyond its square root's order.
    halfway = _add_up(trained.withColumn("_some", F.col("part") % 64), ["chunk", "_some"])
    rows = _add_up(halfway, ["chunk"]).toArrow().sort_by([("chunk", "ascending")])
    if not rows.num_rows:
        return parameters
    vectors, weights = rows["vector"].to_pylist(), rows["weight"].to_pylist()
    return np.concatenate([np.asarray(v) / w for v, w in zip(vectors, weights)]).astype(np.float32)


def _learned(docs: DataFrame, rounds: int) -> tuple[Model, DataFrame]:
    counts = count_words(docs)
    classes, share = word_classes(counts)
    # The leaves' totals are those of the counts, so the first parameters need no join with them.
    coded, parameters = encode(docs, classes), _first(classes.totals)
    for turn in range(rounds):
        parameters = _round(coded, parameters, turn)
    return Model(classes, share, parameters), coded


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    return _learned(docs, rounds)[0]


def _scored(coded: DataFrame, parameters: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), batch["share"].to_numpy().copy()
            for first, firsts, leaf in _coded(batch):
                logs = log_probabilities(parameters, _around(leaf, firsts), leaf)
                n[first:first + len(firsts) - 1] = np.diff(firsts)
                total[first:first + len(firsts) - 1] += segment_sums(logs, firsts)
            mean = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(total), mean], names=["doc_id", "n_words", "log_likelihood", "per_word"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(run, f"doc_id {kind}, n_words long, log_likelihood double, per_word double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood and its mean per word of every row."""
    return _scored(encode(docs, model.classes), model.parameters)


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    model, coded = _learned(read(spark, folder, "documents").select("doc_id", "text"), ROUNDS)
    return _scored(coded, model.parameters)
