"""Lead, suppression and counter tables, rewritten by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.functions.text import first_of
from leadloom.operators.ordering import keep_first

STATUS_EVENTS = ["replied", "bounced", "unsubscribed", "completed"]


def upsert_leads(leads: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Existing leads plus the first incoming row of each new address.

    incoming: pos, email, domain, name; a blank domain is the address's own.
    """
    keyed = incoming.withColumn("email", F.lower(F.trim("email")))
    new = keep_first(
        keyed.join(leads.select(F.col("email").alias("__e")), F.col("email") == F.col("__e"), "left_anti"),
        ["email"], [F.col("pos")],
    ).select(
        "email",
        F.coalesce(F.nullif("domain", F.lit("")), A.address_domain("email")).alias("domain"),
        "name",
        F.lit(0).alias("sequence_step"),
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return leads.unionByName(new, allowMissingColumns=True)


def replace_by_key(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which, per key, the incoming row (the latest by `order`) wins."""
    old = current.withColumn("__src", F.lit(1))
    new = incoming.withColumn("__src", F.lit(0))
    return keep_first(old.unionByName(new), keys, [F.col("__src"), F.desc(order)]).drop("__src")


def add_counts(current: DataFrame, incoming: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    return current.unionByName(incoming).groupBy(*keys).agg(F.sum(count).alias(count))


def mailbox_day_counts(send_log: DataFrame) -> DataFrame:
    """Messages sent per mailbox and day."""
    return send_log.where(F.col("status") == "sent").groupBy("mailbox", F.to_date("sent_at").alias("day")).agg(
        F.count(F.lit(1)).alias("count")
    )


def count_on_day(counts: DataFrame, day: Column) -> DataFrame:
    return counts.where(F.col("day") == day).select("mailbox", "count")


def suppression_entries(events: DataFrame, domain_wide: bool = True, free_mail: list[str] | None = None) -> DataFrame:
    """Entries that bounces and opt-outs add: (value, scope, reason, suppressed_at).

    A bounce stops the address; an opt-out stops the address and, unless its
    domain is in `free_mail`, the domain; a reply stops nothing.
    """
    email = F.col("email")
    domain = A.address_domain(email)

    def entry(value: Column, scope: str, reason: str) -> Column:
        return F.struct(value.alias("value"), F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))

    widened = (F.col("kind") == "unsubscribed") & email.contains("@") & F.lit(domain_wide)
    if free_mail:
        widened = widened & ~domain.isin(list(free_mail))
    entries = F.array(
        F.when(F.col("kind") == "bounced", entry(email, "email", "bounced")),
        F.when(F.col("kind") == "unsubscribed", entry(email, "email", "unsubscribed")),
        F.when(widened, entry(domain, "domain", fixed.DOMAIN_STOP_REASON)),
    )
    rows = events.where(F.col("kind").isin("bounced", "unsubscribed")).select(
        F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"), F.col("ts").alias("suppressed_at"), "seq"
    ).select("e.*", "suppressed_at", "seq")
    latest = F.max(F.struct("suppressed_at", "seq", "reason"))
    return rows.groupBy("value", "scope").agg(latest.alias("l")).select(
        "value", "scope", F.col("l.reason").alias("reason"), F.col("l.suppressed_at").alias("suppressed_at")
    )


def send_events(results: DataFrame, as_of: Column) -> DataFrame:
    """State events of carried-out sends: a good one advances the lead, the
    last step also completes it; a failed one changes nothing.

    results: email, step, ok, seq, next_send_at.
    """
    from leadloom.operators.sending import completes

    good = results.where("ok")
    sent = good.select(
        "email", F.lit("sent").alias("kind"), as_of.alias("ts"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("seq"), "step",
        F.col("next_send_at").alias("value_at"),
    )
    done = good.where(completes(F.col("step"))).select(
        "email", F.lit("completed").alias("kind"), as_of.alias("ts"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("seq"),
        F.lit(None).cast("int").alias("step"), F.lit(None).cast("timestamp").alias("value_at"),
    )
    return sent.unionByName(done)


def event_state(events: DataFrame) -> DataFrame:
    """What the events of each address amount to; the last of a sort wins.

    One aggregate with map-side partials: an address with a third of all
    events is reduced before the shuffle.
    """
    kind = F.col("kind")
    order = F.struct("ts", "seq")
    rescheduling = kind.isin("sent", "rescheduled")
    return events.groupBy("email").agg(
        F.max_by("kind", F.when(kind.isin(STATUS_EVENTS), order)).alias("new_status"),
        F.max_by("step", F.when(kind == "sent", order)).alias("new_step"),
        F.max(F.when(kind == "sent", F.col("ts"))).alias("new_sent_at"),
        F.max_by("value_at", F.when(rescheduling, order)).alias("new_next"),
        F.count_if(rescheduling).alias("schedule_events"),
        F.max(F.when(kind == "meeting", F.col("ts"))).alias("new_meeting"),
        F.max("ts").alias("new_updated"),
    )


def apply_events(leads: DataFrame, events: DataFrame) -> DataFrame:
    """Leads after all events; events of unknown addresses change nothing."""
    changes = event_state(events.where(F.col("kind") != "none")).withColumnRenamed("email", "__e")
    joined = leads.join(changes, F.col("email") == F.col("__e"), "left")
    status_set = F.coalesce("new_status", F.col("status"))
    return joined.select(
        "email", "domain", "name",
        F.coalesce("new_step", "sequence_step").alias("sequence_step"),
        status_set.alias("status"),
        F.coalesce("new_sent_at", "last_sent_at").alias("last_sent_at"),
        F.when(F.coalesce("schedule_events", F.lit(0)) > 0, F.col("new_next")).otherwise(F.col("next_send_at")).alias("next_send_at"),
        "created_at",
        F.coalesce("new_updated", "updated_at").alias("updated_at"),
        F.coalesce("new_meeting", "meeting_booked_at").alias("meeting_booked_at"),
    )


def sent_log_rows(results: DataFrame, as_of: Column) -> DataFrame:
    """New send_log rows; a failed send keeps no subject and no message id."""
    ok = F.col("ok")
    return results.select(
        "email", "step", F.when(ok, F.col("subject")).alias("subject"),
        F.when(ok, F.col("message_id")).alias("message_id"), "mailbox", as_of.alias("sent_at"),
        F.when(ok, "sent").otherwise("failed").alias("status"), F.when(~ok, F.col("error")).alias("error"),
    )
