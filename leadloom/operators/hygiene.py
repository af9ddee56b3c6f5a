"""Which leads are worth work, and why the rest are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import urls
from leadloom.functions.text import first_of, strip
from leadloom.operators.ordering import keep_first

# Reasons in the order in which they are tried.
DROP_REASONS = ["invalid_url", "duplicate", "no_mx", "parked_domain", "globally_suppressed"]


def has_mx(mx: Column) -> Column:
    """A missing or failed look-up counts as no MX."""
    return F.coalesce(F.size(mx) > 0, F.lit(False))


def is_parked(name_servers: Column, markers=None) -> Column:
    """A missing or failed look-up counts as not parked."""
    def parked(host: Column) -> Column:
        clean = F.lower(F.regexp_replace(host, r"\.+$", ""))
        hit = F.lit(False)
        for marker in markers or fixed.PARKING_NAME_SERVERS:
            hit = hit | clean.contains(marker)
        return hit

    return F.coalesce(F.exists(name_servers, parked), F.lit(False))


def with_domain(leads: DataFrame, url_column: str) -> DataFrame:
    """Add `domain`, worked out once per row: conditions on what a generator gives are not
    moved below it, where they would work it out again."""
    domain = urls.registrable_domain(F.coalesce(F.col(url_column), F.lit("")))
    return leads.select("*", F.explode(F.array(domain)).alias("__found")).withColumn("domain", F.col("__found")).drop("__found")


def mark_duplicates(leads: DataFrame, pos: str = "pos", key: str = "domain") -> DataFrame:
    """Add `is_duplicate`: true for all but the first row of a key.

    The first position per key comes from a partial aggregate, so a key with
    a third of all rows costs no more than any other; AQE splits the join.
    """
    firsts = (
        leads.where(F.col(key) != "").groupBy(F.lower(F.col(key)).alias("__key")).agg(F.min(pos).alias("__first"))
    )
    return (
        leads.join(firsts, F.lower(F.col(key)) == F.col("__key"), "left")
        .withColumn("is_duplicate", F.coalesce(F.col(pos) > F.col("__first"), F.lit(False)))
        .drop("__key", "__first")
    )


def dedupe(leads: DataFrame, pos: str = "pos", key: str = "domain") -> DataFrame:
    """First row per lower-case key."""
    lowered = leads.withColumn("__key", F.lower(F.col(key)))
    return keep_first(lowered, ["__key"], [F.col(pos)]).drop("__key")


def domain_suppressions(suppression: DataFrame) -> DataFrame:
    """Distinct suppressed domains.  Address-level entries drop no domain."""
    return suppression.where(F.col("scope") == "domain").select(F.col("value").alias("__stop")).distinct()


def tag_leads(leads: DataFrame, url_column: str, dns_facts: DataFrame, suppression: DataFrame,
              pos: str = "pos") -> DataFrame:
    """Every lead with `domain` and `drop_reason` (NULL when kept).

    Look-ups run once per distinct domain, on a pre-aggregated table that
    also carries the domain's first position; one join brings the verdict
    back to the leads.
    """
    keyed = with_domain(leads, url_column)
    facts = dns_facts.select(
        F.col("domain").alias("__d"), has_mx(F.col("mx")).alias("__mx"), is_parked(F.col("ns")).alias("__parked")
    )
    verdicts = (
        keyed.where(F.col("domain") != "")
        .groupBy(F.col("domain").alias("__domain"))
        .agg(F.min(pos).alias("__first"))
        .join(facts, F.col("__domain") == F.col("__d"), "left")
        .join(domain_suppressions(suppression), F.col("__domain") == F.col("__stop"), "left")
        .select(
            "__domain",
            "__first",
            first_of(
                [
                    (~F.coalesce(F.col("__mx"), F.lit(False)), F.lit("no_mx")),
                    (F.coalesce(F.col("__parked"), F.lit(False)), F.lit("parked_domain")),
                    (F.col("__stop").isNotNull(), F.lit("globally_suppressed")),
                ],
                F.lit(None).cast("string"),
            ).alias("__reason"),
        )
    )
    reason = first_of(
        [(F.col("domain") == "", F.lit("invalid_url")), (F.col(pos) > F.col("__first"), F.lit("duplicate"))],
        F.col("__reason"),
    )
    return (
        keyed.join(verdicts, F.col("domain") == F.col("__domain"), "left")
        .withColumn("drop_reason", reason)
        .drop("__domain", "__first", "__reason")
    )


def kept_leads(tagged: DataFrame, url_column: str) -> DataFrame:
    """Kept rows, ready for the page corpus: `website` becomes the domain."""
    raw = F.coalesce(F.col(url_column), F.lit(""))
    return (
        tagged.where(F.col("drop_reason").isNull())
        .withColumn("original_url_cleaned", urls.strip_tracking(raw))
        .withColumn("geo", urls.geo_tag(F.col("domain")))
        .withColumn("website", F.col("domain"))
        .drop("drop_reason")
    )


def dropped_leads(tagged: DataFrame, url_column: str, emit_duplicates: bool = False) -> DataFrame:
    """Dropped rows and reasons.  An invalid row shows its raw URL as the
    domain; duplicates are counted but listed only on request."""
    dropped = tagged.where(F.col("drop_reason").isNotNull())
    if not emit_duplicates:
        dropped = dropped.where(F.col("drop_reason") != "duplicate")
    raw = strip(F.coalesce(F.col(url_column), F.lit("")))
    return dropped.withColumn("domain", F.when(F.col("drop_reason") == "invalid_url", raw).otherwise(F.col("domain")))


def hygiene_summary(tagged: DataFrame) -> DataFrame:
    reason = F.col("drop_reason")
    return tagged.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if(reason == "duplicate").alias("duplicates_dropped"),
        F.count_if(reason == "invalid_url").alias("invalid_url_dropped"),
        F.count_if(reason == "no_mx").alias("no_mx_dropped"),
        F.count_if(reason == "parked_domain").alias("parked_dropped"),
        F.count_if(reason == "globally_suppressed").alias("suppressed_dropped"),
        F.count_if(reason.isNull()).alias("kept"),
    )
