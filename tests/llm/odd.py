"""Rows that operators must bear: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
COPY = "one two three four five six seven eight nine ten " * 12
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while, then it left.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b\x0c\r ", "fr", None),
    (5, COPY, "en", "b"),
    (5, COPY, "en", "b"),
    (6, COPY + "eleven", "en", "b"),
    (7, COPY.upper(), "de", "c"),
    (8, LONG, "en", "c"),
    (9, "Le chat est sur la table", "fr", "c"),
    (10, "Le chat est sur la table", "fr", None),
    (None, COPY, "en", "b"),
    (None, None, None, None),
    (11, "word", "en", "a"),
    (12, "a b c d", "en", "a"),
    (13, "###$$$ %%% &&& |||" * 40, "en", "a"),
    (14, "x" * 5000, "de", "b"),
    (15, "é \x85\xa0 　中文 🙂 '" * 50, "zz", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = (
    "kept", "n_words", "component_id", "score", "size", "host", "key", "node", "root", "target", "rate", "label", "fold", "toxic", "held_out", "n", "measure",
    "copies", "a", "b", "cls", "bands", "passages", "ids", "range", "ahead",
)


def odd_docs(spark: SparkSession) -> DataFrame:
    """The rows above with columns whose names clash with those that operators make."""
    wide = [row + tuple(range(len(CLASHING))) for row in ROWS]
    return spark.createDataFrame(wide, SCHEMA + "".join(f", {c} int" for c in CLASHING))


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffled_words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
