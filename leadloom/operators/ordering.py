"""Order-dependent building blocks that hold when one key has most rows.

Nothing here sorts a whole key in one task: top-k filters are pruned before
the shuffle (WindowGroupLimit), and running values are built from per-bucket
sums, with buckets of a fixed width of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import settle

BUCKET_WIDTH = 4096
INDEX_WIDTH = 1 << 20


def first_k(df: DataFrame, keys: list, order: list, k: int, rank_name: str | None = None) -> DataFrame:
    """First k rows per key; each map task sends at most k rows per key."""
    rank = rank_name or "__rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    limited = ranked.where(F.col(rank) <= k)
    return limited if rank_name else limited.drop(rank)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return first_k(df, keys, order, 1)


def running_before(df: DataFrame, keys: list[str], pos: str, value: Column, name: str,
                   width: int = BUCKET_WIDTH) -> DataFrame:
    """Sum of `value` over the rows of the same key with a lower position.

    Positions are whole numbers and distinct per key.  Rows are summed per
    (key, pos div width); only those sums are ordered per key, so the largest
    sort is `width` rows or one row in `width` of a key.
    """
    bucketed = df.withColumn("__b", F.floor(F.col(pos) / width)).withColumn("__v", value)
    totals = bucketed.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__b").alias("__ob"),
        F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__off"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__b") == F.col("__ob")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    within = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("__in", F.coalesce(F.sum("__v").over(within), F.lit(0)))
        .join(offsets, condition, "left")
        .withColumn(name, F.col("__in") + F.col("__off"))
        .drop("__b", "__v", "__in", "__ob", "__off", *[f"__k{i}" for i in range(len(keys))])
    )


def spent_before(rows: DataFrame, pos: str, text: str, name: str) -> DataFrame:
    """Characters of `text` in the rows of the same domain with a lower position.

    The rows are written once.  Sums are formed on an index of domain, position
    and length, and joined back by position, so texts cross one shuffle at most.
    """
    written = settle(rows.withColumn("__length", F.length(F.coalesce(F.col(text), F.lit("")))), "sized")
    index = running_before(written.select(F.col("domain").alias("__id"), F.col(pos).alias("__ip"), "__length"), ["__id"], "__ip", F.col("__length"), name)
    same = F.col("domain").eqNullSafe(F.col("__id")) & (F.col(pos) == F.col("__ip"))
    return written.drop("__length").join(index.drop("__length"), same, "left").drop("__id", "__ip")


def global_sum(df: DataFrame, pos: str, value: Column, name: str, width: int = INDEX_WIDTH) -> DataFrame:
    """Sum of `value` over all rows with a lower `pos`, a distinct whole number.

    Sums per bucket of positions are the only thing ordered in one task: one
    row per `width` positions.
    """
    bucketed = df.withColumn("__b", F.floor(F.col(pos) / width)).withColumn("__v", value)
    totals = bucketed.groupBy("__b").agg(F.sum("__v").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__b").alias("__ob"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("__in", F.coalesce(F.sum("__v").over(within), F.lit(0)))
        .join(offsets, F.col("__b") == F.col("__ob"), "left")
        .withColumn(name, F.col("__in") + F.col("__off"))
        .drop("__b", "__v", "__in", "__ob", "__off")
    )


def global_index(df: DataFrame, pos: str, name: str, width: int = INDEX_WIDTH) -> DataFrame:
    """0-based place of each row in the order of `pos`."""
    return global_sum(df, pos, F.lit(1).cast("long"), name, width)
