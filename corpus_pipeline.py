"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

The stages keep texts of a known language, drop toxic ones, keep one document of
each near-duplicate group, mix the sources, and encode what is left.  All but
the last return the columns of `documents`.

Defined cases: texts that are null, empty or without letters are of no known
language and go at the first stage, so later stages meet none; rows without an
id are kept by the near-duplicate stage, as nothing names them, and are encoded
with a null id; repeated rows with one id and text count as copies of each other
and one of them stays; ties between copies go to the smallest id; a text of any
length is one row throughout; rows without labels or language teach nothing but
are judged; a null source is a source of its own and comes last; the mix may
repeat a row or take none of it; extra columns, also with names that operators
use, pass through to the last stage, which returns doc_id, n_tokens and the two
digests; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe, language_id, mixing, near_dedup, toxicity
from leadloom.llm.common import read
from leadloom.session import settle


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *bpe.public_bpe())


STAGES = [
    ("language_id", known_languages),
    ("toxicity", clean),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Stages learn, hash and encode in ways that SQL cannot express; a brute-force version holds the whole against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
