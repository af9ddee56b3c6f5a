"""Mixing sources to target weights: floor(rate) copies of each document, and one more by a hash-seeded draw.

Sizes are counted in words.  Targets are water-filled: sources share the wanted
total by weight, none above `top` times its own size, the excess going to the
others.  In order of size per weight the sources that reach their top come
first, so the level follows from running sums over the table of sources.

Defined cases: a null text has size 0 and still gets its copies; a null source
is a source of its own, last in order; a source of size 0 has target and rate
0; equal or repeated rows draw alike, because the draw depends on doc_id only;
an empty table gives an empty result.  Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, read
from leadloom.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
TOP = 2
SEED = "mix-1"
_DRAWS = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(_DRAWS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, top: int = TOP) -> DataFrame:
    """source, source_size, target, rate of a table (source, size); one row per source."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    totals = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_turn", (F.row_number().over(by_source) - 1) % len(weights))
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_turn") + 1).cast("int")))
        .withColumn("_top", F.col("source_size") * top)
    )
    filling = Window.orderBy(F.col("_top") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        totals.withColumn("_wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_level", (F.col("_wanted") - F.coalesce(F.sum("_top").over(before), F.lit(0))) / F.sum("_weight").over(after))
        .withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_top"))
        .withColumn("_final", -F.min(F.when(F.col("_open"), F.struct(F.col("_top") / F.col("_weight"), (-F.col("_level")).alias("level")))).over(everything)["level"])
    )
    target = F.least(F.col("_top").cast("double"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_top").cast("double")))
    return levels.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(doc_id, seed) < rate - whole).cast("long")).cast("long")


def with_rates(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, top: int = TOP) -> DataFrame:
    """doc_id, size, source_size, target, rate of every row."""
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, share, top).withColumnRenamed("source", "_source")
    return sizes.join(targets, sizes["source"].eqNullSafe(targets["_source"])).drop("_source")


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, top: int = TOP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rated = with_rates(docs, weights, share, top)
    n = copies(F.col("rate"), F.col("doc_id"), seed)
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, top: int = TOP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `docs`."""
    sizes = settle(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    targets = source_targets(sizes, weights, share, top).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    n = copies(F.col("_rate"), docs["doc_id"], seed)
    return (
        docs.join(targets, docs["source"].eqNullSafe(targets["_source"]))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(True), n.cast("int"))))
        .select(*[docs[c] for c in docs.columns])
    )


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(read(spark, folder, "documents"))


OP8_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * {TOP} AS cap
  FROM totals
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals)::DOUBLE * {SHARE}::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM weighed
), final AS (
  SELECT (SELECT lvl FROM levels WHERE lvl * w <= cap ORDER BY cap::DOUBLE / w, lvl DESC LIMIT 1) AS lvl
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(final.lvl * w, cap::DOUBLE)) AS target FROM weighed, final
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / {_DRAWS}.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM counted
"""
