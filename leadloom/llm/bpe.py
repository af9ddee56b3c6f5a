"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per Python worker.

A text is cut into words by the tokenizer's pattern.  The new words that are not
tokens themselves become token-position rows; a recursive query joins the
neighbours with the merge table and contracts each word's leftmost pair of the
smallest rank until no pair is left.  Words over `LONG` bytes take the same step
in a loop that contracts all places of the smallest pair at once, which gives
the same tokens in fewer rounds.  Decoding joins the ids with the vocabulary
and puts the bytes together by ordered aggregation.  Results of words are kept
for the next texts of a task in two generations of about `KEPT`, so memory is
bounded, and given back at its end.

Defined cases: a null text is empty; an empty text has no tokens and both
digests are those of nothing; special tokens' names are ordinary text; repeated
rows and ties give equal results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm.common import read, worker_state

LONG = 256
KEPT = 200_000
_BATCH_BYTES = 1 << 20
_SHIFT = 1 << 16
#: White space as the tokenizer's pattern means it (fixed values of the Unicode property).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_MERGE = f"""
WITH RECURSIVE words(step, word, ids) AS (
  SELECT 0, word, ids FROM fresh
  UNION ALL
  SELECT step + 1, w.word, w.ids[:best % {_SHIFT} - 1] || [best // {_SHIFT}] || w.ids[best % {_SHIFT} + 2:]
  FROM words w JOIN (
    SELECT word, min(merged * {_SHIFT} + place) AS best FROM (
      SELECT word, unnest(ids[:-2]) AS first, unnest(ids[2:]) AS second, generate_subscripts(ids[2:], 1) AS place FROM words
    ) pairs JOIN merges ON merges.pair = first * {_SHIFT} + second GROUP BY word
  ) b ON b.word = w.word
)
SELECT word, arg_max(ids, step) AS ids FROM words GROUP BY word ORDER BY word
"""
_LONG_STEP = f"""
CREATE OR REPLACE TEMP TABLE next_rows AS
WITH pairs AS (
  SELECT word, place, id, lead(id) OVER w AS second, row_number() OVER w AS turn FROM long_rows WINDOW w AS (PARTITION BY word ORDER BY place)
), ranked AS (
  SELECT pairs.*, merged, min(merged) OVER (PARTITION BY word) AS best FROM pairs LEFT JOIN merges ON merges.pair = id * {_SHIFT} + second
), marked AS (
  SELECT *, coalesce(merged = best, false) AS hit, turn - row_number() OVER (PARTITION BY word, coalesce(merged = best, false) ORDER BY turn) AS run FROM ranked
), chosen AS (
  SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, run ORDER BY turn) % 2 = 1 AS joins FROM marked
), swallowed AS (
  SELECT *, coalesce(lag(joins) OVER (PARTITION BY word ORDER BY turn), false) AS gone FROM chosen
)
SELECT word, place, CASE WHEN joins THEN merged ELSE id END AS id, joins FROM swallowed WHERE NOT gone
"""
_DECODE = """
SELECT word, string_agg(hex, '' ORDER BY place) AS hex
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM encoded) JOIN vocabulary USING (id) GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Merge table, vocabulary and results of words of one worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        found = [
            (left * _SHIFT + right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        self.engine = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs, merged = zip(*found) if found else ((), ())
        self._table("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self._table("vocabulary", pa.table({
            "id": pa.array(list(self.ranks.values()), pa.int64()), "hex": pa.array([token.hex() for token in self.ranks], pa.string())}))
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        exact = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.words = regex.compile(exact).findall
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.engine.register("given", rows)
        self.engine.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.engine.unregister("given")

    def _start(self, words: list[bytes]) -> pa.Table:
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        return pa.table({"word": np.arange(len(words)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(self.bytes[data]))})

    def _merge_short(self, words: list[bytes]) -> list:
        self._table("fresh", self._start(words))
        return self.engine.sql(_MERGE).to_arrow_table()["ids"].combine_chunks()

    def _merge_long(self, words: list[bytes]) -> pa.Array:
        self._table("fresh", self._start(words))
        self.engine.execute("CREATE OR REPLACE TEMP TABLE long_rows AS SELECT word, generate_subscripts(ids, 1) AS place, unnest(ids) AS id FROM fresh")
        while True:
            self.engine.execute(_LONG_STEP)
            if not self.engine.sql("SELECT coalesce(bool_or(joins), false) FROM next_rows").fetchall()[0][0]:
                break
            self.engine.execute("CREATE OR REPLACE TEMP TABLE long_rows AS SELECT word, place, id FROM next_rows")
        return self.engine.sql("SELECT word, list(id ORDER BY place) AS ids FROM long_rows GROUP BY word ORDER BY word").to_arrow_table()["ids"].combine_chunks()

    def _encode_words(self, words: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """Number of ids, the ids as text and the decoded bytes of each word."""
        done, at = {}, 0
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [i for i, w in enumerate(raw) if w in self.ranks]
        groups = [(whole, lambda some: pa.array([[self.ranks[w]] for w in some], pa.list_(pa.int64())))]
        rest = sorted(set(range(len(raw))) - set(whole))
        groups += [([i for i in rest if len(raw[i]) <= LONG], self._merge_short), ([i for i in rest if len(raw[i]) > LONG], self._merge_long)]
        for chosen, merge in groups:
            at = 0
            while at < len(chosen):
                end, size = at, 0
                while end < len(chosen) and (end == at or size + len(raw[chosen[end]]) <= _BATCH_BYTES):
                    size += len(raw[chosen[end]])
                    end += 1
                ids = merge([raw[i] for i in chosen[at:end]])
                encoded = pa.table({"word": np.arange(end - at), "ids": ids})
                self.engine.register("encoded", encoded)
                texts = self.engine.sql("SELECT len(ids) AS n, array_to_string(ids, ' ') AS ids FROM encoded ORDER BY word").to_arrow_table()
                decoded = self.engine.sql(_DECODE).to_arrow_table()["hex"].to_pylist()
                self.engine.unregister("encoded")
                for i, n, t, hexed in zip(chosen[at:end], texts["n"].to_pylist(), texts["ids"].to_pylist(), decoded):
                    done[words[i]] = (n, t, bytes.fromhex(hexed))
                at = end
        return done

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        fresh = []
        for word in words.difference(self.known):
            found = self.older.get(word)
            if found is None:
                fresh.append(word)
            else:
                self.known[word] = found
        if fresh:
            self.known.update(self._encode_words(fresh))

    def forget(self) -> None:
        """Give back what a task has gathered: workers outlive it, and the operators after it need the memory."""
        self.known, self.older = {}, {}
        for name in ("fresh", "long_rows", "next_rows"):
            self.engine.execute(f"DROP TABLE IF EXISTS {name}")
        pa.default_memory_pool().release_unused()

    def texts(self, texts: list):
        """Per text: number of tokens, pieces of the ids as text, pieces of the decoded bytes."""
        at = 0
        while at < len(texts):
            found, seen, size = [], set(), 0
            while at < len(texts) and size < 4 * _BATCH_BYTES and len(seen) < KEPT // 2:
                words = self.words(texts[at] or "")
                found.append(words)
                seen.update(words)
                size += len(texts[at] or "")
                at += 1
            self.learn(seen)
            for words in found:
                yield list(map(self.known.__getitem__, words))


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = "bpe_" + hashlib.sha256(ranks + pattern.encode()).hexdigest()
    return worker_state(key, lambda: Encoder(ranks, pattern))


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and the token ids of every row."""
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            ids = [[int(i) for _, part, _ in pieces for i in part.split(" ")] for pieces in encoder.texts(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids of every row stand for; an id outside the vocabulary gives nothing."""
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            ids = batch["ids"].cast(pa.list_(pa.int64()))
            encoder.engine.register("encoded", pa.table({"word": np.arange(len(batch)), "ids": ids}))
            found = encoder.engine.sql(_DECODE).to_arrow_table()
            encoder.engine.unregister("encoded")
            texts = [b""] * len(batch)
            for i, text in zip(found["word"].to_pylist(), found["hex"].to_pylist()):
                texts[i] = bytes.fromhex(text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.binary())], names=["doc_id", "decoded"])
        encoder.forget()

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every row, in one pass."""
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for pieces in encoder.texts(batch["text"].to_pylist()):
                n.append(sum(p[0] for p in pieces))
                ids.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_bpe() -> tuple[bytes, str]:
    """Rank file and pattern of the public byte-level vocabulary; read on the driver, so workers need no file."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(read(spark, folder, "documents"), *public_bpe())
