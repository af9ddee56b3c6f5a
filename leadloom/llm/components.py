"""Connected components by alternating star contractions, and groups of nodes that meet in buckets.

Every node ends up linked to the smallest node of its component.  Each step is
joins and minimums over edges; a node with very many edges is pre-aggregated in
its minimum, and its join is one that adaptive execution can split, as both
sides come from written tables.  Tables of each step go to the shared folder, so
lineage stays short and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import settle

#: A round of drawn meetings is repeated if one in so many gave a link.
WORTH = 10


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour; a node may have very many."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "star-least")
    moved = seen.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return settle(moved.where(F.col("u") != F.col("v")).distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; these are few, as large nodes have been linked away."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return settle(moved.where(F.col("u") != F.col("v")).distinct(), "small-star")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: then each star is a component."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("_v")).distinct(), F.col("u") == F.col("_v"), "left_semi")
    return twice.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge in a table (a, b); the root is the smallest node reachable."""
    known = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    while not _is_star_forest(known):
        known = _small_star(_large_star(known))
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        known.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """key, node, size, center of the buckets of two nodes or more; the center is the smallest node.

    The buckets to keep grow with the data, so the join is never a broadcast.
    """
    centers = settle(
        members.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where(F.col("n") > 1)
        .select(F.col("key").alias("_key"), "center"), "bucket-centers")
    return settle(members.join(centers.hint("merge"), F.col("key") == F.col("_key")).drop("_key"), "buckets")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, size, root, main of the buckets whose nodes are not one component yet; main is the commonest root."""
    placed = settle(
        shared.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
        .select("key", "node", "size", F.coalesce("root", "node").alias("root")), "bucket-roots")
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    split = settle(
        counted.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", -F.col("root"))).alias("main")).where(F.col("parts") > 1)
        .select(F.col("key").alias("_key"), "main"), "bucket-open")
    return settle(placed.join(split, F.col("key") == F.col("_key")).drop("_key"), "bucket-open")


def link_buckets(shared: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """node, root of the graph whose links are the pairs of a bucket that `confirm` lets pass.

    First every node meets the smallest node that it shares most buckets with.
    Then every node of a bucket that is still split meets one node of another
    part of it, drawn by hash, again and again while one meeting in `WORTH`
    gives a link: that joins the parts of large groups.  At last the nodes
    outside a bucket's commonest part meet all nodes of its other parts whose
    size allows a link, so no pair of different parts is left open.
    """
    stars = shared.where(F.col("node") != F.col("center")).groupBy(F.col("node").alias("a"), F.col("center").alias("b")).agg(F.count("*").alias("n"))
    links = settle(confirm(stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))), "links")
    roots, turn = settle(components(links), "roots"), 0
    while True:
        split = _open(shared, roots)
        turn += 1
        # Two nodes of each bucket, so that one of them is of another part for every node that the first shares a part with.
        drawn = settle(
            split.groupBy("key").agg(
                F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(turn), "node")).alias("first"),
                F.min_by(F.struct("node", "root"), F.struct((F.col("root") == F.col("main")).cast("int"), F.xxhash64(F.lit(turn), "node"))).alias("other"))
            .select(F.col("key").alias("_key"), "first", "other"), "drawn")
        met = F.when(F.col("first.root") != F.col("root"), F.col("first.node")).when(F.col("other.root") != F.col("root"), F.col("other.node"))
        meetings = (
            split.join(drawn, F.col("key") == F.col("_key")).select(F.col("node").alias("a"), met.alias("b"), F.xxhash64(F.lit(turn), "key").alias("turn"))
            .where(F.col("b").isNotNull()).groupBy("a").agg(F.min_by("b", "turn").alias("b"))
        )
        meetings = settle(meetings, "meetings")
        links = settle(confirm(meetings), "links")
        found = links.count()
        if found:
            roots = settle(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
        if found * WORTH < meetings.count() or not found:
            break
    if found:
        split = _open(shared, roots)
    x = split.where(F.col("root") != F.col("main")).select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size")])
    y = split.select(F.col("key").alias("_key"), *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "size")])
    close = (F.col("x_root") != F.col("y_root")) & (F.col("x_size") * 100 >= F.col("y_size") * percent) & (F.col("y_size") * 100 >= F.col("x_size") * percent)
    rest = x.join(y, (F.col("key") == F.col("_key")) & close).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    links = settle(confirm(rest), "links")
    if links.isEmpty():
        return roots
    return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
