"""Verdicts on queued mails, redrafts and the review set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.functions import quality as Q
from leadloom.functions import responses as R
from leadloom.functions.text import first_of, text_array
from leadloom.operators.ordering import global_sum, running_before


def with_group_key(queue: DataFrame) -> DataFrame:
    """Add the sequence key: domain (of the address when blank) and address."""
    domain = F.coalesce(F.nullif("domain", F.lit("")), A.address_domain(F.coalesce("to_email", F.lit(""))))
    return queue.withColumn("domain", domain).withColumn("email_key", F.lower(F.trim(F.coalesce("to_email", F.lit("")))))


def with_claims(queue: DataFrame, analyses: DataFrame) -> DataFrame:
    """Add `claims`: texts of the domain's hooks and pains, NULL without an analysis."""
    known = analyses.select(
        F.col("domain").alias("__d"), Q.claim_texts(F.col("hooks"), F.col("pains")).alias("claims")
    )
    return queue.join(known, F.col("domain") == F.col("__d"), "left").drop("__d")


def automated_checks(queue: DataFrame, analyses: DataFrame, **limits) -> DataFrame:
    """Add `claims` and `rule_violations`.

    What needs only the mail runs before the join, where rows are spread
    evenly; after it, only opening mails with claims are looked at again.
    """
    ruled = queue.withColumn("__rules", Q.rule_violations("subject", "body", "step", **limits))
    joined = with_claims(ruled, analyses).withColumn("__ground", Q.grounding_violation("body", "step", "claims"))
    found = F.when(F.col("__ground").isNull(), F.col("__rules")).otherwise(F.array_append("__rules", F.col("__ground")))
    return joined.withColumn("rule_violations", found).drop("__rules", "__ground")


def with_scores(items: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Add `scores` from judge answers (keys, raw_text, error); an item
    without an answer counts as a failed call."""
    answers = judged.select(
        *[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)],
        R.read_judge(F.coalesce("raw_text", F.lit("")), "error").alias("scores"),
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & (F.col(k) == F.col(f"__j{i}"))
    return items.join(answers, condition, "left").drop(*[f"__j{i}" for i in range(len(keys))])


def verdicts(items: DataFrame, reviewed_before: int, key: list[Column]) -> DataFrame:
    """Verdict, violations and need for review of each item.

    items: rule_violations, scores, seq (place in order of evaluation, from
    0).  The first items overall are always reviewed; later ones when
    borderline or drawn by a hash of `key`.
    """
    scores = F.col("scores")
    error = F.when(scores.isNull(), F.lit("no answer")).otherwise(scores["error"])
    passes = Q.judge_passes(scores["grounding"], scores["overall"], error)
    verdict = first_of(
        [
            (F.size("rule_violations") > 0, F.lit("fail_automated")),
            (error.isNotNull(), F.lit("fail_judge_error")),
            (passes, F.lit("pass")),
        ],
        F.lit("fail_judge"),
    )
    reasons = first_of(
        [
            (F.col("verdict") == "fail_automated", F.col("rule_violations")),
            (F.col("verdict") == "fail_judge_error", F.array(error)),
            (F.col("verdict") == "fail_judge", F.array(F.coalesce(scores["feedback"], F.lit(fixed.DEFAULT_JUDGE_FEEDBACK)))),
        ],
        text_array([]),
    )
    drawn = needs_sampling(F.col("seq") + reviewed_before, scores["overall"], key)
    return (
        items.withColumn("verdict", verdict)
        .withColumn("violations", reasons)
        .withColumn("needs_human_review", (F.col("verdict") != "pass") | drawn)
    )


def needs_sampling(reviewed_so_far: Column, overall: Column, key: list[Column], always: int = fixed.ALWAYS_REVIEWED,
                   borderline: float = fixed.BORDERLINE_OVERALL, percent: int = fixed.REVIEW_PERCENT) -> Column:
    return (reviewed_so_far < always) | (F.coalesce(overall, F.lit(0)) <= borderline) | Q.hash_sampled(*key, percent=percent)


def evaluation_order(queue: DataFrame, pos: str = "pos") -> DataFrame:
    """Add `seq`: items in order of their sequence's first appearance, then
    of the queue.

    Worked out on the keys alone and joined back by position, so that bodies
    move once.  A sequence's first position comes from a partial aggregate;
    the running index orders only bucket sums in one task.
    """
    keys = queue.select(pos, "domain", "email_key")
    firsts = keys.groupBy(F.col("domain").alias("__gd"), F.col("email_key").alias("__ge")).agg(
        F.min(pos).alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    starts = global_sum(firsts, "__first", F.col("__size"), "__start")
    joined = keys.join(starts, (F.col("domain") == F.col("__gd")) & (F.col("email_key") == F.col("__ge")))
    ordered = running_before(joined, ["domain", "email_key"], pos, F.lit(1), "__place")
    places = ordered.select(F.col(pos).alias("__pos"), (F.col("__start") + F.col("__place")).alias("seq"))
    return queue.join(places, F.col(pos) == F.col("__pos")).drop("__pos")


def opening_results(judged: DataFrame, pos: str = "pos") -> DataFrame:
    """Result of each sequence's first step-1 item, in order of appearance."""
    opener = F.min(F.when(F.col("step") == 1, F.struct(F.col(pos).alias("pos"), "verdict", F.col("scores.feedback").alias("feedback"))))
    return judged.groupBy("domain", "email_key").agg(F.min(pos).alias("first_pos"), opener.alias("opener")).select(
        "domain", "email_key", "first_pos", F.col("opener.verdict").alias("verdict"), F.col("opener.feedback").alias("feedback")
    )


def redraft_requests(openers: DataFrame) -> DataFrame:
    """Sequences whose opening mail the judge turned down, with its reason."""
    return openers.where(F.col("verdict") == "fail_judge").select(
        "domain", "email_key", F.coalesce("feedback", F.lit("")).alias("previous_feedback")
    )


def apply_redrafts(judged: DataFrame, requests: DataFrame, redrafted: DataFrame) -> DataFrame:
    """Replace whole sequences by their judged redraft where one exists.

    `redrafted` has the columns of `judged`; adds `is_redraft`.
    """
    available = redrafted.select("domain", "email_key").distinct()
    replaced = requests.join(available, ["domain", "email_key"], "left_semi").select("domain", "email_key")
    keep = judged.join(replaced, ["domain", "email_key"], "left_anti").withColumn("is_redraft", F.lit(False))
    new = redrafted.join(replaced, ["domain", "email_key"], "left_semi").withColumn("is_redraft", F.lit(True))
    return keep.unionByName(new, allowMissingColumns=True)


def contact_or_default(queue: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each item's contact by lower-case address, the first in list order; a
    bare one when none is known."""
    listed = contacts.select("domain", F.posexplode("contacts").alias("p", "c")).select(
        F.col("domain").alias("__d"), F.lower(F.trim(F.coalesce("c.email", F.lit("")))).alias("__e"),
        F.struct("p", F.col("c.email").alias("email"), F.col("c.matched_name").alias("name"), F.col("c.matched_title").alias("title")).alias("c"),
    ).groupBy("__d", "__e").agg(F.min("c").alias("c"))
    joined = queue.join(listed, (F.col("domain") == F.col("__d")) & (F.col("email_key") == F.col("__e")), "left")
    return joined.select(
        *[F.col(c) for c in queue.columns],
        F.coalesce(F.col("c.email"), F.col("email_key")).alias("contact_email"),
        F.col("c.name").alias("contact_name"), F.col("c.title").alias("contact_title"),
    )


def review_rows(judged: DataFrame) -> DataFrame:
    """Failures and sampled passes, for people to read."""
    return judged.where((F.col("verdict") != "pass") | F.col("needs_human_review")).select(
        "to_email", "domain", "step", "subject", "verdict",
        F.array_join("violations", "; ").alias("violations"), F.col("scores.overall").alias("judge_overall"),
    )


def passed_items(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict") == "pass")


def gate_summary(judged: DataFrame, queue: DataFrame) -> DataFrame:
    """Totals of a gate run.  `total` is the queue as it came in; reviews
    count passes only; judge failures include failed calls."""
    verdict = F.col("verdict")
    results = judged.agg(
        F.count_if(verdict == "pass").alias("passed"),
        F.count_if(verdict == "fail_automated").alias("failed_automated"),
        F.count_if(verdict.isin("fail_judge", "fail_judge_error")).alias("failed_judge"),
        F.count_if((verdict == "pass") & F.col("needs_human_review")).alias("needs_review"),
    )
    total = queue.agg(F.count(F.lit(1))).scalar()
    if "is_redraft" in judged.columns:
        replaced = judged.where("is_redraft").select("domain", "email_key").distinct().agg(F.count(F.lit(1))).scalar()
    else:
        replaced = F.lit(0).cast("long")
    return results.select(
        total.alias("total"), "passed", "failed_automated", "failed_judge", "needs_review", replaced.alias("redrafted")
    )


def reviewed_count(reviewed_before: int, queue: DataFrame, redrafted: DataFrame | None = None) -> DataFrame:
    """The review counter after a run: every evaluated item counts, also
    those of sequences that a redraft replaced."""
    total = queue.agg(F.count(F.lit(1)).alias("n"))
    if redrafted is not None:
        total = total.unionByName(redrafted.agg(F.count(F.lit(1)).alias("n")))
    return total.agg((F.sum("n") + reviewed_before).alias("reviewed_so_far"))
