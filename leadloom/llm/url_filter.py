"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Trees are grown by DataFrame aggregations: per round and level one job sums
gradients per node, feature and bin, and only those sums (nodes x features x
bins) reach the driver, which picks the splits.  Gradients are whole millionths,
so sums do not depend on the order of rows.  The finished model is a SQL
expression.

Defined cases: a null URL or one without `://` has an empty host and path, fits
no rule and is judged by its (zero) features; an empty table gives an empty
result; without labels of both kinds every undecided URL is allowed; repeated
rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import first_of
from leadloom.llm.common import in_shares, read
from leadloom.session import settle

#: (verdict, rule): a rule is a host, then a path that starts with a slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Parts of host names that label a URL as one to block, besides the rules.
SEED_PARTS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: Feature -> (width of a bin, number of bins).
FEATURES = {
    "url_length": (8, 32), "host_length": (2, 32), "host_depth": (1, 16), "longest_label": (1, 32), "host_hyphens": (1, 8),
    "path_depth": (1, 16), "path_length": (4, 32), "digit_ratio": (25, 40), "entropy": (10, 64), "host_entropy": (10, 64),
    "parameters": (1, 16), "suffix_urls": (1, 32), "suffix_hosts": (1, 32),
}
PER_CLASS = 10_000
ROUNDS = 10
RATE = 0.4
RIDGE = 1.0
MIN_GAIN = 1e-3
BLOCK_FROM = 0.7
_UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    names, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        fits = ((host_ == rule[:cut]) | host_.endswith("." + rule[:cut])) & path_.startswith(rule[cut:])
        names.append((fits, F.lit(rule)))
        verdicts.append((fits, F.lit(verdict)))
    return first_of(names, F.lit(None).cast("string")), first_of(verdicts, F.lit(None).cast("string"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.translate(text, mark, ""))


def _entropy(text: Column) -> Column:
    """Hundredths of a bit per character."""
    size = F.greatest(F.length(text), F.lit(1))
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / size)
    bits = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.floor(bits * 100)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the binned features to a table with url, host and path.

    The suffix counts cover all rows: how many URLs, and how many hosts, share
    the last label of the host, as bits of the count.
    """
    suffix = F.element_at(F.split(F.col("host"), r"\."), -1)
    per_suffix = (
        urls.groupBy("host", suffix.alias("_suffix")).agg(F.count("*").alias("n")).groupBy("_suffix")
        .agg(F.sum("n").alias("_urls"), F.count("*").alias("_hosts"))
    )
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = {
        "url_length": F.length(url), "host_length": F.length("host"), "host_depth": _count(F.col("host"), "."),
        "longest_label": F.aggregate(F.split(F.col("host"), r"\."), F.lit(0), lambda acc, x: F.greatest(acc, F.length(x))),
        "host_hyphens": _count(F.col("host"), "-"), "path_depth": _count(F.col("path"), "/"), "path_length": F.length("path"),
        "digit_ratio": F.floor(_count(url, "0123456789") * 1000 / F.greatest(F.length(url), F.lit(1))),
        "entropy": _entropy(url), "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(F.lit(0)),
        "suffix_urls": F.length(F.bin(F.col("_urls"))), "suffix_hosts": F.length(F.bin(F.col("_hosts"))),
    }
    binned = {n: F.least(F.floor(raw[n] / width), F.lit(bins - 1)).cast("int") for n, (width, bins) in FEATURES.items()}
    joined = urls.withColumn("_at", suffix).join(per_suffix, F.col("_at") == F.col("_suffix"), "left")
    return joined.withColumns(binned).drop("_at", "_suffix", "_urls", "_hosts")


@dataclass(frozen=True)
class Tree:
    """Depth two: a split, a split on each side (or none), and the values of the leaves."""

    split: tuple[str, int]
    sides: tuple
    leaves: tuple

    def node(self) -> Column:
        return F.when(F.col(self.split[0]) <= self.split[1], F.lit(0)).otherwise(F.lit(1))

    def value(self) -> Column:
        def side(i):
            a, b = (F.lit(v) for v in self.leaves[i])
            return F.when(F.col(self.sides[i][0]) <= self.sides[i][1], a).otherwise(b) if self.sides[i] else a

        return F.when(F.col(self.split[0]) <= self.split[1], side(0)).otherwise(side(1))


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple

    def logit(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.value()
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


def _histograms(rows: DataFrame, logit: Column, node: Column) -> dict:
    """(node, feature) -> [(bin, gradient, curvature)], in units, from one aggregation."""
    p = 1 / (1 + F.exp(-logit))
    graded = rows.select(
        node.alias("node"), F.round((F.col("label") - p) * _UNIT).cast("long").alias("g"), F.round(p * (1 - p) * _UNIT).cast("long").alias("h"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in FEATURES])).alias("f"))
    sums = graded.groupBy("node", "f.feature", "f.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    found: dict = {}
    for row in sorted(sums):
        found.setdefault((row["node"], row["feature"]), []).append((row["bin"], row["g"] / _UNIT, row["h"] / _UNIT))
    return found


def _best_split(histograms: dict, node: int):
    """((feature, last bin of the left side), value left, value right) of the largest gain, or None, and the value of the whole."""
    best, gain_of_best, whole = None, MIN_GAIN, 0.0
    for feature in FEATURES:
        bins = histograms.get((node, feature), [])
        g_all, h_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
        whole = g_all / (h_all + RIDGE)
        g = h = 0.0
        for at, dg, dh in bins[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
            if gain > gain_of_best:
                best, gain_of_best = ((feature, at), g / (h + RIDGE), (g_all - g) / (h_all - h + RIDGE)), gain
    return best, whole


def train(rows: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Boosted trees for the log odds of label 1; `rows` has the binned features and label, and is bounded."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not totals["n"] or totals["ones"] in (0, totals["n"]):
        return Model(-math.inf if not totals["n"] or not totals["ones"] else math.inf, ())
    model = Model(math.log(totals["ones"] / (totals["n"] - totals["ones"])), ())
    for _ in range(rounds):
        root, _whole = _best_split(_histograms(rows, model.logit(), F.lit(0)), 0)
        if root is None:
            break
        below = _histograms(rows, model.logit(), Tree(root[0], (None, None), ((0.0, 0.0), (0.0, 0.0))).node())
        sides, leaves = [], []
        for node in (0, 1):
            split, whole = _best_split(below, node)
            sides.append(split[0] if split else None)
            leaves.append((rate * split[1], rate * split[2]) if split else (rate * whole, rate * whole))
        model = Model(model.base, (*model.trees, Tree(root[0], tuple(sides), tuple(leaves))))
    return model


def labelled(features: DataFrame, per_class: int = PER_CLASS, seeds=SEED_PARTS) -> DataFrame:
    """Features and label, at most about `per_class` rows of a class.

    A rule or a part of the host name labels a URL as one to block; all others
    count as allowed, so a trait that undecided URLs share blocks none of them.
    """
    seeded = F.arrays_overlap(F.split(F.col("host"), "[.-]"), F.array(*[F.lit(s) for s in seeds]))
    blocked = seeded | F.coalesce(F.col("_verdict") == "block", F.lit(False))
    rows = features.withColumn("label", blocked.cast("int"))
    shares = [(r["label"], per_class / r["count"]) for r in rows.groupBy("label").count().collect()]
    return rows.where(in_shares(F.col("label"), F.xxhash64("url"), shares)).select("label", *FEATURES)


def judge(pages: DataFrame, rules=RULES, per_class: int = PER_CLASS, block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, url, host, path, rule, verdict and the model's probability of every row."""
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    features = settle(with_features(urls.withColumns({"rule": rule, "_verdict": verdict})), "url-features")
    model = train(settle(labelled(features, per_class), "url-labelled"))
    p = model.probability()
    return features.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("_verdict", F.when(p >= block_from, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        p.alias("block_probability"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_probability")
