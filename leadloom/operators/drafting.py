"""Who gets a draft, the prompt for it, and the queue that comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import prompts as P
from leadloom.functions import quality as Q
from leadloom.functions import responses as R
from leadloom.functions.text import first_of, text_array
from leadloom.operators.contacts import best_contact


def placeholder_text(offer: DataFrame) -> Column:
    """First bracketed placeholder in the required values, else NULL."""
    points = F.flatten(F.transform("proof_points", lambda p: F.array(p["claim"], p["detail"])))
    flat = F.concat(
        F.array("your_company_name", "sender_name", "what_you_sell", "icp_description"), points, F.array("cta_style")
    )
    text = F.array_join(F.filter(flat, lambda t: t.isNotNull()), " ")
    pattern = "(?i)" + fixed.PLACEHOLDER_PATTERN
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0))


def offer_problems(offer: DataFrame) -> DataFrame:
    """(missing, placeholder) of each offer row; both empty when it is fit."""
    missing = [
        F.when(
            (F.size(F.col(k)) <= 0) if k == "proof_points" else (F.coalesce(F.col(k), F.lit("")) == ""), F.lit(k)
        )
        for k in fixed.REQUIRED_OFFER_KEYS
    ]
    return offer.select(
        F.filter(F.array(*missing), lambda m: m.isNotNull()).alias("missing"), placeholder_text(offer).alias("placeholder")
    )


def draft_targets(contacts: DataFrame, analyses: DataFrame, require_signal: bool = False) -> DataFrame:
    """Every domain with a contacts result, its best contact, its analysis and
    the reason it is skipped, if any."""
    found = contacts.select(
        "domain",
        F.when(F.col("status") == "ok", F.col("contacts")).alias("__contacts"),
    ).withColumn("contact", best_contact(F.col("__contacts")))
    known = analyses.select(
        F.col("domain").alias("__d"), F.col("status").alias("__status"), "signal_gate", "company_name", "hooks", "pains"
    )
    usable = F.col("__status") == "ok"
    if require_signal:
        usable = usable & (F.col("signal_gate") == "ok")
    return (
        found.join(known, F.col("domain") == F.col("__d"), "left")
        .withColumn(
            "skip_reason",
            first_of(
                [
                    (F.coalesce(F.size("__contacts"), F.lit(0)) <= 0, F.lit("no_contact")),
                    (~F.coalesce(usable, F.lit(False)), F.lit("no_analysis")),
                ],
                F.lit(None).cast("string"),
            ),
        )
        .drop("__contacts", "__d", "__status")
    )


def draft_prompts(targets: DataFrame, offer: DataFrame, few_shot: DataFrame | None = None,
                  template: str = P.DRAFT_TEMPLATE) -> DataFrame:
    """(domain, to_email, prompt) per target that is not skipped.

    The offer is one row (of several, the least) and the few-shot file is as
    long as its writer's limit, so both come in as scalar subqueries; all
    examples of the file are used, in the order of their columns.
    """
    chosen = offer.agg(F.min(F.struct(*offer.columns))).scalar()
    few = F.lit("")
    if few_shot is not None:
        examples = F.array_sort(F.collect_list(F.struct(*few_shot.columns)))
        few = few_shot.agg(examples.alias("x")).select(P.few_shot_block("x")).scalar()
    ready = targets.where(F.col("skip_reason").isNull()).withColumn("__offer", chosen).withColumn("__few", few)
    feedback = F.col("previous_feedback") if "previous_feedback" in targets.columns else F.lit(None).cast("string")
    company = F.coalesce(F.nullif("company_name", F.lit("")), F.col("domain"))
    return ready.select(
        "domain",
        F.col("contact.email").alias("to_email"),
        P.draft_prompt(
            F.col("__offer"), F.col("hooks"), F.col("pains"), company, F.col("contact.matched_name"),
            F.col("contact.matched_title"), F.col("__few"), feedback, template,
        ).alias("prompt"),
    )


def choose_attempts(attempts: DataFrame) -> DataFrame:
    """One sequence per domain: (domain, items).

    attempts: domain, attempt (1 or 2), raw_text.  The second replaces the
    first when the first's opening mail fails its checks and the second is
    not empty; without a first there is nothing.  An opening mail is step 1,
    or the first item when no step is 1.
    """
    items = R.read_draft(F.coalesce("raw_text", F.lit("")))
    opener = F.coalesce(
        F.get(F.filter("items", lambda i: i["step"] == 1), F.lit(0)), F.get("items", F.lit(0))
    )
    read = attempts.select("domain", "attempt", items.alias("items")).withColumn("__o", opener)
    failing = Q.draft_violations(F.col("__o.subject"), F.col("__o.body"), F.col("__o.step"))
    judged = read.withColumn("__bad", F.size(failing) > 0)
    both = judged.groupBy("domain").agg(
        F.max_by("items", F.when(F.col("attempt") == 1, 1)).alias("__first"),
        F.bool_or((F.col("attempt") == 1) & F.col("__bad")).alias("__bad"),
        F.max_by("items", F.when(F.col("attempt") == 2, 1)).alias("__second"),
    )
    second = F.coalesce("__bad", F.lit(False)) & (F.coalesce(F.size("__second"), F.lit(0)) > 0)
    return both.where(F.coalesce(F.size("__first"), F.lit(0)) > 0).select(
        "domain", F.when(second, F.col("__second")).otherwise(F.col("__first")).alias("items")
    )


def draft_queue(targets: DataFrame, sequences: DataFrame) -> DataFrame:
    """Queue items of every drafted domain; step 1 carries its own check."""
    people = targets.where(F.col("skip_reason").isNull()).select(
        F.col("domain").alias("__d"), F.col("contact.email").alias("to_email"),
        F.col("contact.matched_name").alias("to_name"),
    )
    rows = sequences.join(people, F.col("domain") == F.col("__d")).select(
        "to_email", "to_name", "domain", F.posexplode("items").alias("place", "i")
    )
    found = Q.draft_violations(F.col("subject"), F.col("body"), F.col("step"))
    failed = (F.col("step") == 1) & (F.size("__v") > 0)
    return (
        rows.select("to_email", "to_name", F.col("i.subject").alias("subject"), F.col("i.body").alias("body"),
                    F.col("i.step").alias("step"), "domain", "place")
        .withColumn("__v", found)
        .withColumn("_self_check_failed", F.when(failed, F.lit(True)))
        .withColumn("_violations", F.when(failed, F.col("__v")))
        .drop("__v")
    )


def draft_summary(targets: DataFrame, queue: DataFrame) -> DataFrame:
    """Drafted and skipped domains, and drafts that failed their own check."""
    drafted = queue.groupBy("domain").agg(F.bool_or(F.col("_self_check_failed").isNotNull()).alias("__failed"))
    def skipped(reason: str) -> Column:
        return targets.agg(F.count_if(F.col("skip_reason") == reason)).scalar()

    return drafted.agg(
        F.count(F.lit(1)).alias("leads_drafted"), F.count_if("__failed").alias("self_check_failed")
    ).select(
        "leads_drafted", skipped("no_contact").alias("skipped_no_contact"),
        skipped("no_analysis").alias("skipped_no_analysis"), "self_check_failed",
    )
