"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

A sketch is the count of documents per step of a measure (thousandths of a
rate, hundredths of a character), so it has a bounded number of entries, a
fixed error of one step, and merges by adding counts.  Sketches of the sources
merge into those of the languages and of the whole table.  The fences of a
group are its quartiles widened by a multiple of their distance; a group's
fences lean on its language's, and those on the table's, by the weight of
`LEAN` documents, so a small group does not judge itself.  Documents are then
joined with the fences of their group.

Defined cases: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own; repeated rows are judged alike;
an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions.text import bind, first_of
from leadloom.llm.common import WORD, read
from leadloom.session import settle

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
LEAN = 200
#: Measure -> (factor on the quartiles' distance, least distance in steps).
WIDENING = {"symbols": (4, 10), "dup_lines": (4, 100), "repeats": (4, 60), "long_words": (5, 20)}
MEASURES = tuple(WIDENING)
#: Measures with a lower fence too.
LOWER = ("long_words",)
_SPACES = " \t\n\x0b\x0c\r"


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that is found twice or more in the text.

    Windows are sorted by hash, equal ones are then neighbours; only their
    places are sorted again to count what they cover together.
    """
    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct(
            (p + 3).alias("end"), (acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]

    def repeated(windows: Column) -> Column:
        marked = F.transform(windows, lambda w, i: F.when(
            (F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"]), w["p"]))
        return F.sort_array(F.array_compact(marked))

    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return bind(F.sort_array(hashes), lambda windows: covered(repeated(windows)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the four measures of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, _SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, _SPACES, "")) > 0)
    counted = docs.select(
        "doc_id", "lang", "source",
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda found: F.struct(
            F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))).alias("_lines"),
        bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.struct(
            F.size(words).cast("long").alias("n"), repeat_words(words).cast("long").alias("repeats"))).alias("_words"),
    )
    n_words, n_lines = F.col("_words.n"), F.col("_lines.n")

    def rate(part: Column, whole: Column, steps: int) -> Column:
        return F.floor(part * steps / F.greatest(whole, F.lit(1))).cast("long")

    return counted.select(
        "doc_id", "lang", "source", n_words.alias("n_words"), "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_words.repeats").alias("n_repeat_words"),
        ((n_words < MIN_WORDS) | (F.col("_words.repeats") * 100 > n_words * 50)).alias("base_failed"),
        F.least(rate(F.col("n_symbols"), F.col("word_chars"), 1000), F.lit(1000)).alias("symbols"),
        rate(F.col("_lines.dup"), n_lines, 1000).alias("dup_lines"),
        rate(F.col("_words.repeats"), n_words, 1000).alias("repeats"),
        F.least(rate(F.col("word_chars"), n_words, 100), F.lit(10_000)).alias("long_words"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, step, n: one mergeable count per step, of the documents the base rules pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("step")) for m in MEASURES]))
    return (
        measured.where(~F.col("base_failed")).select("lang", "source", stacked.alias("m"))
        .groupBy("lang", "source", "m.measure", "m.step").agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q1, q3 of the merged sketches; a quartile is the first step that a quarter of the documents reach."""
    merged = sketch.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    return counted.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("step"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("step"))).alias("q3"),
    )


def fences(sketch: DataFrame, lean: int = LEAN) -> DataFrame:
    """_lang, _source and an upper and a lower fence per measure, one row per group."""
    def lo_hi(q: DataFrame) -> DataFrame:
        wide = first_of([
            (F.col("measure") == m, F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * factor) for m, (factor, least) in WIDENING.items()
        ], F.lit(None))
        return q.withColumn("hi", (F.col("q3") + wide).cast("double")).withColumn("lo", (F.col("q1") - wide).cast("double"))

    def leaned(own: str, base: str) -> Column:
        return (F.col("total") * F.col(own) + lean * F.col(base)) / (F.col("total") + lean)

    table = lo_hi(quartiles(sketch, [])).select(F.col("measure").alias("_m0"), F.col("hi").alias("hi0"), F.col("lo").alias("lo0"))
    langs = lo_hi(quartiles(sketch, ["lang"]))
    langs = langs.join(table, F.col("measure") == F.col("_m0")).select(
        F.col("lang").alias("_lang1"), F.col("measure").alias("_m1"), leaned("hi", "hi0").alias("hi1"), leaned("lo", "lo0").alias("lo1"))
    groups = lo_hi(quartiles(sketch, ["lang", "source"]))
    groups = groups.join(langs, F.col("lang").eqNullSafe(F.col("_lang1")) & (F.col("measure") == F.col("_m1"))).select(
        "lang", "source", "measure", leaned("hi", "hi1").alias("hi"), leaned("lo", "lo1").alias("lo"))
    one = [F.max(F.when(F.col("measure") == m, F.col("hi"))).alias(f"hi_{m}") for m in MEASURES]
    one += [F.max(F.when(F.col("measure") == m, F.col("lo"))).alias(f"lo_{m}") for m in LOWER]
    return groups.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*one)


def judge(docs: DataFrame, lean: int = LEAN) -> DataFrame:
    """The base counts and the verdict of every row, with the rule that dropped it."""
    measured = settle(measure(docs), "quality-measures")
    limits = fences(settle(sketches(measured), "quality-sketches"), lean)
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"]), "left")
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for m in MEASURES:
        failed = failed.when(F.col(m) > F.col(f"hi_{m}"), F.lit(f"high_{m}"))
    for m in LOWER:
        failed = failed.when(F.col(m) < F.col(f"lo_{m}"), F.lit(f"low_{m}"))
    return joined.withColumn("failed_rule", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "documents"))


def _fence_sql(name: str, keys: str) -> str:
    keyed = f"{keys}, " if keys else ""
    wide = "CASE measure " + " ".join(f"WHEN '{m}' THEN greatest(q3 - q1, {least}) * {factor}" for m, (factor, least) in WIDENING.items()) + " END"
    return f"""{name} AS (
  SELECT {keyed}measure, max(total) AS total, min(step) FILTER (upto * 4 >= total) AS q1, min(step) FILTER (upto * 4 >= total * 3) AS q3,
    (q3 + {wide})::DOUBLE AS hi, (q1 - {wide})::DOUBLE AS lo
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keyed}measure) AS total,
      sum(n) OVER (PARTITION BY {keyed}measure ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM (SELECT {keyed}measure, step, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL))
  GROUP BY {keyed}measure)"""


OP1_SQL = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), keyed AS (SELECT row_number() OVER () AS r, * FROM texts
), windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM keyed)
), again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p + o.k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) o GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM keyed) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM keyed LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), measured AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    least(n_symbols * 1000 // greatest(word_chars, 1), 1000) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, least(word_chars * 100 // greatest(n_words, 1), 10000) AS long_words
  FROM counted
), sketch AS (
  SELECT lang, source, measure, step, count(*) AS n FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS step FROM measured WHERE NOT base_failed" for m in MEASURES)}) GROUP BY ALL
), {_fence_sql("whole", "")}, {_fence_sql("by_lang", "lang")}, {_fence_sql("by_group", "lang, source")},
langs AS (
  SELECT l.lang, l.measure, (l.total * l.hi + {LEAN} * t.hi) / (l.total + {LEAN}) AS hi, (l.total * l.lo + {LEAN} * t.lo) / (l.total + {LEAN}) AS lo
  FROM by_lang l JOIN whole t USING (measure)
), groups AS (
  SELECT g.lang, g.source, g.measure, (g.total * g.hi + {LEAN} * l.hi) / (g.total + {LEAN}) AS hi, (g.total * g.lo + {LEAN} * l.lo) / (g.total + {LEAN}) AS lo
  FROM by_group g JOIN langs l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure
), limits AS (
  SELECT lang, source, {", ".join(f"max(hi) FILTER (measure = '{m}') AS hi_{m}" for m in MEASURES)},
    {", ".join(f"max(lo) FILTER (measure = '{m}') AS lo_{m}" for m in LOWER)}
  FROM groups GROUP BY lang, source
), judged AS (
  SELECT m.*, CASE WHEN base_failed THEN 'base' {" ".join(f"WHEN {m} > hi_{m} THEN 'high_{m}'" for m in MEASURES)}
    {" ".join(f"WHEN {m} < lo_{m} THEN 'low_{m}'" for m in LOWER)} END AS failed_rule
  FROM measured m LEFT JOIN limits f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM judged
"""
