"""Language identification, toxicity, LM scoring, BPE and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from leadloom.llm import bpe, language_id, lm_score, mixing, near_dedup, toxicity
from leadloom.llm.queries import QUERIES
from odd import ROWS, no_docs, odd_docs, rows_of

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages_held_out(spark):
    found = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, LARGER).collect()}
    rows = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(rows) and all(found[r["doc_id"]]["held_out"] == held(r["doc_id"]) for r in rows)
    out = [r for r in rows if held(r["doc_id"])]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert sum(r["rejected"] for r in found.values()) <= 0.01 * len(rows)


def test_languages_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = language_id.train(docs)
    found = language_id.identify(docs, model).collect()
    texts = {r[0]: r[1] for r in ROWS}
    assert len(found) == len(ROWS)
    for r in found:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not text or not any(map(str.isalpha, text)))
            assert r["held_out"] == held(r["doc_id"])
        assert 0 <= r["score"] <= 1
    assert language_id.keep_known(docs, model).columns == docs.columns
    nothing = language_id.train(no_docs(spark))
    assert nothing is None and language_id.identify(no_docs(spark), nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_subword_scores_by_hand():
    """Folded look-ups equal the average of embeddings computed text by text."""
    texts = pa.array(["the cat", "", None, "ab cd ef" * 50, "éà"])
    rng = np.random.default_rng(0)
    scores, bias = rng.normal(size=(3, language_id.BUCKETS * len(language_id.GRAMS))).astype(np.float32), np.zeros(3)
    z, trust, lettered = language_id.logits(texts, scores, bias)
    for i, (buckets, share) in enumerate(language_id._sparse(texts)):
        assert np.allclose(z[i], scores[:, buckets] @ share if len(buckets) else 0, atol=1e-4)
    assert lettered.tolist() == [True, False, False, True, True] and trust[1] == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = {r["doc_id"]: r for r in toxicity.score_documents(some, toxicity.train(docs, labels)).collect()}
    out = [r for r in labels.collect() if held(r["doc_id"])]
    caught = sum(found[r["doc_id"]]["predicted"] for r in out if r["toxic"])
    wrong = sum(found[r["doc_id"]]["predicted"] for r in out if not r["toxic"])
    toxic = sum(r["toxic"] for r in out)
    assert caught >= 0.8 * toxic and wrong <= 0.01 * (len(out) - toxic)


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 15)] + [(3, 0, 1), (None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score_documents(docs, model)
    assert found.count() == len(ROWS) and all(0 <= r["score"] <= 1 for r in found.collect())
    by_text = {}
    for r in found.where("doc_id IN (5, 9, 10)").collect():
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_text[9] == by_text[10] and len(by_text[5]) == 1
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score_documents(docs, None).collect()} == {0.0}
    assert toxicity.score_documents(no_docs(spark), model).count() == 0


def all_segments(score, offset=0):
    """Maximal scoring segments by their definition: the best segment, then those left and right of it."""
    total, best = np.concatenate([[0.0], np.cumsum(score)]), (1e-12, 0, 0)
    for a in range(len(score)):
        for z in range(a + 1, len(score) + 1):
            gain = total[z] - total[a]
            if gain > best[0] + 1e-12:
                best = (gain, a, z)
    if best[2] == 0:
        return []
    _, a, z = best
    return all_segments(score[:a], offset) + [(offset + a, offset + z)] + all_segments(score[z:], offset + z)


@pytest.mark.parametrize("seed", range(40))
def test_segments_by_definition(seed):
    rng = np.random.default_rng(seed)
    score = rng.normal(-0.2, 1, rng.integers(0, 40))
    assert [(a, z) for a, z, _ in toxicity.segments(score)] == all_segments(score)


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    counts = lm_score.count_words(docs)
    classes, share = lm_score.word_classes(counts)
    untrained, trained = lm_score.Model(classes, share, lm_score.start(classes, counts)), lm_score.train(docs)
    before, after = (
        lm_score.score_documents(docs, m).selectExpr("sum(log_likelihood) / sum(n_words) AS v").first()["v"] for m in (untrained, trained))
    assert after > before
    total = np.bincount(classes, np.exp(share), lm_score.CLASSES)
    assert np.allclose(total[total > 0], 1, atol=1e-3)


def test_lm_of_odd_rows(spark):
    docs = odd_docs(spark)
    found = lm_score.score_documents(docs, lm_score.train(docs)).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert (r["n_words"] == 0) == (r["per_word"] is None) and r["log_likelihood"] <= 0
    assert lm_score.score_documents(no_docs(spark), lm_score.train(no_docs(spark))).count() == 0


def test_lm_contexts_stay_in_their_text():
    hashes = np.arange(1, 8, dtype=np.uint64) << np.uint64(40)
    around = lm_score.contexts(hashes, np.array([0, 3, 3, 7]))
    pad = lm_score.ROWS
    assert around[:, 0].tolist() == [pad, pad, 2, 3] and around[:, 2].tolist() == [1, 2, pad, pad] and around[:, 3].tolist() == [pad, pad, 5, 6]


def tiktoken_digests(texts):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for text in texts:
        ids = encoding.encode_ordinary(text or "")
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
    return out


def test_bpe_of_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    wanted = [(r["doc_id"], *d) for r, d in zip(rows, tiktoken_digests([r["text"] for r in rows]))]
    assert rows_of(QUERIES["op6_byte_bpe"](spark, FOLDER)) == sorted(wanted, key=repr)


def test_bpe_of_odd_texts(spark):
    rng = random.Random(1)
    texts = [
        None, "", " ", "  a", "a  \n b\t\t c ", "it's we'll 'S \x1c\x1d x\x85y  z᠎ w​q", "中文字符" * 200, "aaaa" * 2000, "<|endoftext|> x", "é" * 301,
        "".join(rng.choice("abcdefghij") for _ in range(2000)), "1234567890" * 50, "!!!!" * 300, "\n\n\n\nx   y", "a" * 255 + " " + "b" * 257, "🙂👍🏽" * 30,
        *[r[1] for r in ROWS],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks, pattern = bpe.public_bpe()
    wanted = sorted(((i, *d) for i, d in enumerate(tiktoken_digests(texts))), key=repr)
    assert rows_of(bpe.digests(docs, ranks, pattern)) == wanted
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.digests(no_docs(spark), ranks, pattern).count() == 0


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 8)
    encoder = bpe.Encoder(*bpe.public_bpe())
    texts = [f"some words {i} and more{i} of them" for i in range(12)]
    found = [b"".join(p[2] for p in pieces).decode() for pieces in encoder.texts(texts)]
    assert found == texts


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").withColumn("kept", near_dedup.F.lit(1)).withColumn("rate", near_dedup.F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(200), LARGER).columns == docs.columns


def test_pipeline_by_hand(spark):
    """Each stage's decisions redone row by row, from the operators' own verdicts where they learn."""
    from test_pairs import groups_by_hand

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.identify(docs, language_id.train(docs)).where("rejected").collect()}
    first = docs.where(~docs["doc_id"].isin(list(rejected) or [-1]))
    model = toxicity.train(first, spark.read.parquet(f"{LARGER}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score_documents(first, model).where("predicted = 1").collect()}
    rows = [r for r in first.collect() if r["doc_id"] not in toxic]
    stay = {d for d, _, c in groups_by_hand([(r["doc_id"], r["text"]) for r in rows]) if d == c}
    rows = [r for r in rows if r["doc_id"] in stay]
    report = {r["doc_id"]: r["copies"] for r in mixing.mix_report(spark.createDataFrame(rows, docs.schema)).collect()}
    wanted = [(r["doc_id"], *d) for r, d in zip(rows, tiktoken_digests([r["text"] for r in rows])) for _ in range(report[r["doc_id"]])]
    assert rows_of(corpus_pipeline.run(spark, LARGER)) == sorted(wanted, key=repr)


def test_stages_bear_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_bear_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() >= 0


def test_lm_counts_every_word(spark):
    """More distinct words than any fixed table of 2^18 counts has."""
    rows = [(i, " ".join(f"v{i * 1000 + j}" for j in range(1000))) for i in range(300)]
    assert lm_score.count_words(spark.createDataFrame(rows, "doc_id long, text string")).count() == 300_000


def test_lm_sends_packed_counts(spark, monkeypatch):
    """Four columns a word go through the exchange; small and large sums come out as they went in."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    monkeypatch.setattr(lm_score, "settle", lambda df, name: df)
    counts = lm_score.count_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    sent = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "narrow" in sent.split("RepartitionByExpression")[1] and "s15" not in sent.split("RepartitionByExpression")[1]
    expected = {}
    for _first, firsts, hashes in lm_score.words(pa.array(texts)):
        for word, sums in zip(*lm_score._company(hashes, firsts)):
            expected[int(word.view(np.int64))] = sums.tolist()
    assert {r[0]: list(r[1:]) for r in counts.collect()} == expected
    assert max(abs(v) for sums in expected.values() for v in sums[1:]) > 50


def test_lm_parts_hold_numbers_of_words(spark, monkeypatch):
    """No text goes into a part, and no frequent word is asked for; the leaves are those of the table, or drawn."""
    kept = {}
    settle = lm_score.settle
    monkeypatch.setattr(lm_score, "settle", lambda df, name: kept.setdefault(name, settle(df, name)))
    monkeypatch.setattr(lm_score, "LAYOUT", 100)
    monkeypatch.setattr(lm_score, "PART_BYTES", 2000)
    rng = random.Random(6)
    texts = [None, "", "one"] + [" ".join(f"w{int(rng.expovariate(0.004))}" for _ in range(rng.randrange(300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, share = lm_score.word_classes(lm_score.count_words(docs))
    seen = docs.unionAll(spark.createDataFrame([(1000, "w1 never-seen w2")], docs.schema))
    coded = {r["doc_id"]: r for r in lm_score.encode(seen, classes).collect()}
    table = {r["word"]: r for r in classes.table.collect()}
    asked = [w for r in kept["lm-parts"].where("asked is not null").collect() for w in r["asked"]]
    assert "text" not in kept["lm-parts"].columns and 0 < classes.common.num_rows < 150
    assert not set(asked) & set(classes.common["word"].to_pylist()) and len(set(asked)) + classes.common.num_rows >= len(table)
    for doc_id, text in [*enumerate(texts), (1000, "w1 never-seen w2")]:
        hashes = np.concatenate([h for _f, _firsts, h in lm_score.words(pa.array([text], pa.string()))])
        rows = [(h, table.get(int(h.view(np.int64)))) for h in hashes]
        leaves = [r["leaf"] if r else int(h % np.uint64(lm_score.CLASSES)) for h, r in rows]
        logs = [r["share"] if r else np.log(0.5 / (classes.totals[leaf] + 0.5)) for (_, r), leaf in zip(rows, leaves)]
        assert coded[doc_id]["leaves"] == leaves and coded[doc_id]["share"] == pytest.approx(sum(logs))


def test_lm_sends_middling_sums_as_two_numbers(spark, monkeypatch):
    """Sums of 8 to 127 take no list; each width comes out as it went in."""
    lists = [["a", "b"] * n for n in (2, 30, 300)]
    texts = [" ".join(f"{w}{i}" for w in words) for i, words in enumerate(lists)]
    monkeypatch.setattr(lm_score, "settle", lambda df, name: df)
    counts = lm_score.count_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1))
    assert "more" in counts._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    expected = {}
    for _first, firsts, hashes in lm_score.words(pa.array(texts)):
        for word, sums in zip(*lm_score._company(hashes, firsts)):
            expected[int(word.view(np.int64))] = sums.tolist()
    assert {r[0]: list(r[1:]) for r in counts.collect()} == expected
    most = sorted(max(map(abs, sums[1:])) for sums in expected.values())
    assert most[1] <= 7 < most[2] and most[3] <= 127 < most[4]


def test_lm_parts_take_little_room(spark, monkeypatch):
    """A part is one row; a word of one place takes next to no room in it; answers come back as a row per part and task."""
    kept, plans = {}, {}
    settle = lm_score.settle

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept.setdefault(name, settle(df, name))

    monkeypatch.setattr(lm_score, "settle", keep)
    monkeypatch.setattr(lm_score, "LAYOUT", 10)
    monkeypatch.setattr(lm_score, "_GATHERED", 500)
    rows = [(str(i), " ".join(["often"] * (i % 3) + [f"w{i * 1000 + j}" for j in range(1000)] + ["both"])) for i in range(8)] + [(None, None), ("x", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    classes, _share = lm_score.word_classes(lm_score.count_words(docs))
    coded = {r["doc_id"]: r["leaves"] for r in lm_score.encode(docs, classes).collect()}
    part, = kept["lm-parts"].collect()
    assert part["doc_id"] == [d for d, _ in rows] and len(part["asked"]) > 7900 and len(part["places"]) < 500
    assert "MapInArrow" in plans["lm-coded"].split("Join")[0]
    table = {r["word"]: r["leaf"] for r in classes.table.collect()}
    for doc_id, text in rows:
        hashes = [h for _f, _firsts, found in lm_score.words(pa.array([text], pa.string())) for h in found.view(np.int64).tolist()]
        assert coded[doc_id] == [table[h] for h in hashes]


@pytest.mark.parametrize("kind", [np.int16, np.int32, np.int64])
def test_lm_packs_integers(kind):
    ends = np.iinfo(kind)
    for values in ([], [0], [ends.min, -1, 0, 1, ends.max], range(300)):
        assert lm_score._unpacked(lm_score._packed(np.array(values, kind)), kind).tolist() == list(values)


@pytest.mark.parametrize("steep", [60.0, 0.0])
def test_lm_probabilities_by_the_plain_formula(monkeypatch, steep):
    monkeypatch.setattr(lm_score, "_STEEP", steep)
    rng = np.random.default_rng(7)
    parameters = rng.normal(0, 0.4, len(lm_score._first(np.ones(lm_score.CLASSES)))).astype(np.float32)
    leaf = rng.integers(0, lm_score.CLASSES, 500)
    around = lm_score._around(leaf, np.array([0, 1, 1, 3, 500]))
    embed, sides, weights, bias, leaf_weights, leaf_bias = (p.astype(float) for p in lm_score._split(parameters))
    hidden = np.tanh(sum(embed[near] * side for near, side in zip(around, sides)))
    group, own = leaf // lm_score.LEAVES, leaf % lm_score.LEAVES
    a, b = hidden @ weights + bias, np.einsum("nw,nwl->nl", hidden, leaf_weights[group]) + leaf_bias[group]
    place = np.arange(500)
    plain = a[place, group] - np.log(np.exp(a).sum(axis=1)) + b[place, own] - np.log(np.exp(b).sum(axis=1))
    assert np.allclose(lm_score.log_probabilities(parameters, around, leaf), plain, atol=1e-4)


def test_lm_predicts_rare_words_from_both_sides(spark):
    """Six hundred rare words of two kinds, each kind with its own neighbours."""
    rng = random.Random(4)
    rows = [
        (i, " ".join(f"left{k} {k}rare{rng.randrange(300)} right{k} f{rng.randrange(300)}" for _ in range(50) for k in [rng.randrange(2)]))
        for i in range(800)
    ]
    model = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = [(k * 2 + w, " ".join(f"left{k} {w}rare{j} right{k}" for j in range(300))) for k in (0, 1) for w in (0, 1)]
    found = {r["doc_id"]: r["per_word"] for r in lm_score.score_documents(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert found[0] > found[1] + 0.3 and found[3] > found[2] + 0.3


def test_toxic_passages_after_single_insults():
    """A dense passage is found though its words stood singly before; so is an equal one, and repeats of one word add up."""
    insults, filler = ["zorbak", "quibble", "mundrel", "fraskit"], "plain words of no weight " * 20
    text = filler.join(insults) + " " + filler + " ".join(insults) + " " + filler + " ".join(insults) + " " + filler
    tags, scores = (np.zeros((toxicity.LEVELS, toxicity._TABLE), t) for t in (np.uint32, np.float32))
    data = np.frombuffer(" ".join(insults).encode(), np.uint8)
    for key in toxicity.units(data, np.array([0, len(data)]))[1][-1][0]:
        tags[-1][int(key) % toxicity._TABLE], scores[-1][int(key) % toxicity._TABLE] = int(key) >> 32, 2.0
    model = toxicity.Model(toxicity.Rates(tags, scores), 1.0, 0.1, np.zeros(3))
    found = toxicity.passages(pa.array([text, "zorbak", "zorbak " * 8]), model)[1]
    words = text.split()
    dense = [(a, z) for a, z, s in found[0] if s > 7]
    assert [words[a:z] for a, z in dense] == [insults, insults]
    assert found[2][0][:2] == (0, 8) and 2 * found[1][0][2] < found[2][0][2] < 8 * found[1][0][2]
