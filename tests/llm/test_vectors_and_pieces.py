"""SentencePiece coding, importance resampling and centroid clustering against libraries and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path

from leadloom.llm import centroids, importance, piece_bpe
from leadloom.llm.queries import QUERIES, SQL
from odd import CLASHING, LONG, ROWS, no_docs, odd_docs, rows_of

FOLDER = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Pieces

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceCoder(piece_bpe.public_model())


def coded(coder, texts):
    for found in coder.texts(texts):
        yield [int(i) for _, part, _ in found for i in part.split(" ")], "".join(t for _, _, t in found)[1:]


def by_library(library, doc_id, text):
    ids = library.encode(text or "", add_eos=True)
    return doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))


def test_pieces_of_the_table(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_piece_bpe"](spark, FOLDER)) == sorted((by_library(library, *r) for r in rows), key=repr)


def test_pieces_of_odd_rows(spark, library):
    model = piece_bpe.public_model()
    assert rows_of(piece_bpe.digests(odd_docs(spark), model)) == sorted((by_library(library, *r[:2]) for r in ROWS), key=repr)
    assert piece_bpe.digests(no_docs(spark), model).count() == 0
    ids = piece_bpe.encode(odd_docs(spark), model)
    wanted = sorted(((r[0], library.encode(r[1] or "", add_eos=True)) for r in ROWS), key=repr)
    assert rows_of(ids) == wanted
    assert rows_of(piece_bpe.decode(ids, model)) == sorted(((r[0], library.decode(library.encode(r[1] or ""))) for r in ROWS), key=repr)


def test_pieces_of_random_texts(coder, library):
    rng = random.Random(3)
    pool = [text for text, _, kind in coder.pieces if kind == 1]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdeinrst ▁\n\x00\t1é中🙂") for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["", " ", "▁", "   " * 50 + "word" + " " * 100, "<s> </s> <0x0A> <unk>", "\x00", "a\x00b"]
    for text, (ids, decoded) in zip(texts, coded(coder, texts)):
        assert ids == library.encode(text), text
        assert decoded == library.decode(ids) == coder.decode(ids)


def test_short_chunks_need_no_walk(library, monkeypatch):
    """New words are merged pair by pair; no walk or check of a pair runs for them."""
    rng = random.Random(6)
    coder = piece_bpe.PieceCoder(piece_bpe.public_model())
    monkeypatch.setattr(piece_bpe.PieceCoder, "_walk", None)
    monkeypatch.setattr(piece_bpe.PieceCoder, "_fit", None)
    texts = [" ".join("".join(rng.choice("abcdeinrstéß中") for _ in range(rng.randrange(1, 32))) for _ in range(40)) for _ in range(50)]
    assert [ids for ids, _ in coded(coder, texts)] == library.encode(texts)


def test_pieces_of_an_unbroken_text(coder, library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeinrst") for _ in range(100_000)) + "e" * 20_000
    (ids, decoded), = coded(coder, [text])
    assert ids == library.encode(text) and decoded == text


def test_caches_that_overflow(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT", 50)
    monkeypatch.setattr(piece_bpe, "_SLICE", 200)
    coder = piece_bpe.PieceCoder(piece_bpe.public_model())
    texts = LONG[:20_000].split("7")
    assert [ids for ids, _ in coded(coder, texts)] == library.encode(texts)


def test_any_ids_decode_as_in_the_library(coder, library):
    rng = random.Random(5)
    common = [0, 1, 2, 13, 198, 259, 28705, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD]
    for _ in range(4000):
        ids = [rng.choice(common) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_digests_decode_the_ids(spark, library, monkeypatch):
    """The decoded text comes out of the ids: with every id shown by its number, so is the digest of the text."""
    monkeypatch.setattr(piece_bpe.PieceCoder, "spell", lambda self, codes: "-".join(codes), raising=False)
    coder, texts = piece_bpe.PieceCoder(piece_bpe.public_model()), ["one 两🙂 two", "", " a\x00b"]
    monkeypatch.setattr(piece_bpe, "_coder", lambda model: coder)

    class Here:
        """Runs the work of the tasks in this process."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, kind):
            return [row for batch in run([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts})]) for row in batch.to_pylist()]

    for text, row in zip(texts, piece_bpe.digests(Here(), b"")):
        ids = library.encode(text, add_eos=True)
        assert row["ids_sha256"] == digest(" ".join(map(str, ids))) and row["decoded_sha256"] == digest("-".join(map(str, ids)))


def test_models_of_another_sort_are_refused():
    with pytest.raises(ValueError, match="byte fallback"):
        piece_bpe.PieceCoder(b"")


# Importance

def runs_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [zlib.crc32(" ".join(words[i: i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def resampled(rows, targets, percent=5):
    """doc_id, n_features, weight, score, rank by hand."""
    docs = [(doc_id, *runs_of(text)) for doc_id, text in rows]
    s, t = collections.Counter(b for _, found, _ in docs for b in found), collections.Counter(b for text in targets for b in runs_of(text)[0])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for doc_id, found, words in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found)
        h = int(digest(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def named(df):
    return df.select("doc_id", "n_features", "weight", "score", "rank")


def test_importance_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r[0] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect()]
    wanted = resampled(rows, targets)
    assert rows_of(QUERIES["op12_importance"](spark, FOLDER)) == wanted
    assert sum(r[4] is not None for r in wanted) > 5


@pytest.mark.parametrize("targets", [["The cat sat.", None, "w1x1 w2x2 w3x3"], []])
def test_importance_of_odd_rows(spark, targets):
    docs = odd_docs(spark)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    found = importance.draw(importance.weigh(docs, importance.gains(docs, target)), percent=60)
    assert rows_of(named(found)) == resampled([r[:2] for r in ROWS], targets, 60)
    assert importance.draw(importance.weigh(no_docs(spark), importance.gains(no_docs(spark), target))).count() == 0


def test_importance_of_many_equal_rows(spark):
    """A third of the rows are one text, some ids come twice, and nothing is lost at the edge of the draw."""
    rows = [(i % 700, "one two three four five " * 5 if i % 3 == 0 else f"w{i % 17} x{i % 11} " * 15) for i in range(1000)]
    found = importance.draw(importance.weigh(spark.createDataFrame(rows, "doc_id long, text string"), np.zeros(10_000, np.int64)), percent=30)
    ranks = sorted(r["rank"] for r in found.collect() if r["rank"] is not None)
    assert ranks == list(range(1, 301))


def test_checksums_of_joined_words():
    mover, rng = importance.Mover(), random.Random(6)
    words = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 2, 5, 63, 64, 65, 127, 128, 1000, 70_000)]
    firsts, seconds = zip(*[(a, b) for a in words for b in words])
    sums = [np.array([zlib.crc32(w) for w in part], np.uint32) for part in (firsts, seconds)]
    found = mover.joined(*sums, np.array([len(w) for w in seconds]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in zip(firsts, seconds)]


# Centroids

def clustered(kept, k, rounds):
    """Rows by hand: (vec_id, cluster, distance, cluster_inertia, inertia, centroid digest)."""
    order = sorted(kept, key=lambda r: (r[0] is None, digest(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    middle = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for c, members in groups.items():
            middle[c] = [sum(column) // len(members) for column in zip(*members)]
    rows = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = collections.Counter()
    for _, c, d in rows:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest(",".join(map(str, middle[c])))) for i, c, d in rows), key=repr)


def test_centroids_of_the_table(spark):
    found = QUERIES["op13_centroids"](spark, FOLDER)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    by_sql = con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL['op13_centroids']})").fetchall()
    rows = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(found) == sorted(by_sql, key=repr) == clustered(rows, 16, 3)


@pytest.mark.parametrize("k,rounds", [(1, 2), (2, 3), (7, 5), (40, 4)])
def test_centroids_with_ties_and_clumps(spark, k, rounds):
    """Small whole components make many ties; a third of the rows are equal; some centroids end up empty or equal."""
    rng = random.Random(k)
    rows = [(i, [0, 0, 1] if i % 3 == 0 else [rng.randrange(-3, 4) for _ in range(3)]) for i in range(600)]
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, vector array<int>").repartition(5), k, rounds)
    assert rows_of(centroids.with_inertia(*found)) == clustered(rows, k, rounds)


def test_centroids_spare_searches():
    """Far clumps that do not move need no search in the second round, and results stay exact."""
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.integers(-20, 20, (200, 8)) + 10_000 * c for c in range(6)])
    middle = np.array([np.full(8, 10_000 * c) for c in range(6)])
    best, second = np.zeros(len(vectors), np.int32), np.ones(len(vectors), np.int32)
    upper, lower = np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)
    assert centroids.Search(middle, None).assign(vectors, best, second, upper, lower) == len(vectors)
    assert centroids.Search(middle + 1, middle).assign(vectors, best, second, upper, lower) == 0
    assert best.tolist() == np.repeat(np.arange(6), 200).tolist()


def test_centroids_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, None), (3, []), (4, [0.5, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [-inf, 0.0]),
        (8, [1.0, 2.0, 3.0]), (9, [-0.01, 0.999]), (None, [0.3, -5.0]), (10, [1e30, 0.0]), (11, [-0.0, 0.0]),
    ]
    clash = "".join(f", {c} int" for c in [*CLASHING, "vector", "best", "second", "cluster", "distance"])
    wide = [row + tuple(range(len(CLASHING) + 5)) for row in rows]
    vectors = centroids.scaled(spark.createDataFrame(wide, "vec_id long, embedding array<double>" + clash), dims=2)
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 2 and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    assert rows_of(centroids.with_inertia(*centroids.cluster(vectors, 3, 2))) == clustered(kept, 3, 2)
    assert centroids.with_inertia(*centroids.cluster(vectors.where("false"))).count() == 0
