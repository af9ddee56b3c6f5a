"""Inbound mail to classes, leads and state changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import mail as M
from leadloom.functions.text import first_of, strip
from leadloom.operators import state
from leadloom.session import settle


def recent(messages: DataFrame, as_of: Column, days: int = fixed.LOOK_BACK_DAYS) -> DataFrame:
    """Messages since the start of the day `days` days before `as_of`."""
    return messages.where(F.col("received_at") >= look_back(as_of, days))


def look_back(as_of: Column, days: int = fixed.LOOK_BACK_DAYS) -> Column:
    return F.date_sub(F.to_date(as_of), days).cast("timestamp")


def unprocessed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    return messages.join(processed.select(F.col("uid").alias("__u")), F.col("uid") == F.col("__u"), "left_anti")


def fault(messages: DataFrame) -> Column:
    """Why a message cannot be read, else NULL.

    A message without a sender can: its lead may be named in the body.  The
    client that fetches may say what went wrong in `fetch_error`.
    """
    told = F.nullif(F.col("fetch_error"), F.lit("")) if "fetch_error" in messages.columns else F.lit(None).cast("string")
    nothing = F.col("from_addr").isNull() & F.col("subject").isNull() & F.col("body").isNull()
    return F.coalesce(told, F.when(F.coalesce("uid", F.lit("")) == "", F.lit("no uid")), F.when(nothing, F.lit("nothing fetched")))


def fates(messages: DataFrame, pending: DataFrame, marks: DataFrame, as_of: Column, days: int = fixed.LOOK_BACK_DAYS) -> DataFrame:
    """All rows of a poll and all pending ones with one `fate` each, and the `error` of what cannot be read.

    old: from before the look-back.  repeat: its uid is done, or another row
    of the poll stands for it.  failed: it cannot be read.  done: the row that
    stands for its uid, readable rows first, then the earliest.  Which row it is
    comes from one partial minimum per uid, so a uid with a third of all rows is
    never in one task's list.  `waited`: whether a pending row has the uid.
    """
    rows = messages.withColumn("was_pending", F.lit(False)).unionByName(pending.withColumn("was_pending", F.lit(True)), allowMissingColumns=True)
    rows = settle(rows.withColumn("error", fault(rows)).withColumn("__row", F.monotonically_increasing_id()), "poll-rows")
    old = F.coalesce(F.col("received_at") < look_back(as_of, days), F.lit(False))
    place = F.struct(F.col("error").isNotNull().alias("bad"), F.col("received_at").isNull().alias("undated"), "received_at", "was_pending", "__row")
    chosen = rows.where(~old & (F.coalesce("uid", F.lit("")) != "")).groupBy(F.col("uid").alias("__uid")).agg(
        F.min(place).alias("__place"), F.max("was_pending").alias("waited"))
    known = marks.select(F.col("uid").alias("__uid"), F.lit(True).alias("__known"))
    by_uid = chosen.join(known, "__uid", "left").select("__uid", "waited", F.col("__place.__row").alias("__first"), F.coalesce("__known", F.lit(False)).alias("__known"))
    fate = first_of(
        [
            (old, F.lit("old")),
            (F.col("__uid").isNull(), F.lit("failed")),
            (F.col("__known") | (F.col("__row") != F.col("__first")), F.lit("repeat")),
            (F.col("error").isNotNull(), F.lit("failed")),
        ],
        F.lit("done"),
    )
    return rows.drop("waited").join(by_uid, F.col("uid") == F.col("__uid"), "left").withColumn("fate", fate).drop("__uid", "__first", "__known", "__row")


def pending_changes(polled: DataFrame) -> DataFrame:
    """Changes of the pending table: failed rows are put in, `closed` ends those that are done or too old by now."""
    keyed = polled.where(F.coalesce("uid", F.lit("")) != "")
    ended = F.col("waited") & (F.col("fate") == "done") | F.col("was_pending") & (F.col("fate") == "old")
    return keyed.where((F.col("fate") == "failed") | ended).withColumn("closed", F.col("fate") != "failed")


def skipped_counts(polled: DataFrame) -> DataFrame:
    """uid, error and fate of the rows that came to nothing in this poll, and how many there were; pending rows that stay so count each time."""
    return polled.where(F.col("fate") != "done").select("uid", "error", "fate", F.lit(1).cast("long").alias("rows"))


def classify(messages: DataFrame) -> DataFrame:
    """Add `sender` and `kind` (bounce, unsubscribe, ooo, reply)."""
    with_sender = messages.withColumn("sender", M.sender_address("from_addr"))
    return with_sender.withColumn("kind", M.message_class("sender", "subject", "body"))


def match_leads(classified: DataFrame, leads: DataFrame) -> DataFrame:
    """Add `lead_email` and `lead_step`: the sender's lead, else the first
    known lead named in the body; NULL when there is none.

    Addresses of a body are exploded and joined by key; the first hit per
    message is a partial minimum.
    """
    known = leads.select(F.col("email").alias("__le"), F.col("sequence_step").alias("__ls"))
    by_sender = classified.join(known, (F.col("sender") == F.col("__le")) & (F.col("sender") != ""), "left")
    named = F.regexp_extract_all("body", F.lit(fixed.EMAIL_PATTERN), F.lit(0))
    orphans = by_sender.where(F.col("__le").isNull()).select("uid", F.posexplode(named).alias("place", "__a"))
    mentioned = known.select(F.col("__le").alias("__me"), F.col("__ls").alias("__ms"))
    first = (
        orphans.join(mentioned, F.lower(F.trim("__a")) == F.col("__me"))
        .groupBy(F.col("uid").alias("__uid"))
        .agg(F.min(F.struct("place", "__me", "__ms")).alias("__hit"))
    )
    return (
        by_sender.join(first, F.col("uid") == F.col("__uid"), "left")
        .withColumn("lead_email", F.coalesce("__le", F.col("__hit.__me")))
        .withColumn("lead_step", F.coalesce("__ls", F.col("__hit.__ms")))
        .drop("__le", "__ls", "__uid", "__hit")
    )


def outcomes(matched: DataFrame, as_of: Column) -> DataFrame:
    """Add `classification` (with severity, or `<class>:unmatched`) and
    `resume_at` for what is only put off."""
    full = M.outcome(F.col("kind"), F.col("full_text"))
    unmatched = F.col("lead_email").isNull()
    classed = matched.withColumn(
        "classification", F.when(unmatched, F.concat("kind", F.lit(":unmatched"))).otherwise(full)
    )
    resume = first_of(
        [
            (F.col("classification") == "bounce_soft", as_of + F.make_dt_interval(days=F.lit(fixed.SOFT_BOUNCE_DELAY_DAYS))),
            (
                F.col("classification") == "ooo",
                F.coalesce(
                    M.ooo_return_date("body", as_of), as_of + F.make_dt_interval(days=F.lit(fixed.OOO_DELAY_DAYS))
                ),
            ),
        ],
        F.lit(None).cast("timestamp"),
    )
    return classed.withColumn("resume_at", resume)


def process(messages: DataFrame, leads: DataFrame, processed: DataFrame, as_of: Column) -> DataFrame:
    """New messages with lead, classification and resume date."""
    fresh = unprocessed(messages, processed)
    return outcomes(match_leads(classify(fresh), leads), as_of)


POLL_CLASSES = ["bounce_hard", "bounce_soft", "unsubscribe", "ooo", "reply"]


def poll_summary(processed: DataFrame) -> DataFrame:
    """Counts by class; messages that could not be read count as errors."""
    kind = F.col("classification")
    failed = F.col("error").isNotNull() if "error" in processed.columns else F.lit(False)
    return processed.agg(
        *[F.count_if(~failed & (kind == c)).alias(c) for c in POLL_CLASSES],
        F.count_if(~failed & kind.endswith(":unmatched")).alias("skipped_unknown_lead"),
        F.count_if(failed).alias("errors"),
    )


def lead_events(processed: DataFrame) -> DataFrame:
    """State events of matched messages: (email, kind, ts, seq, step, value_at)."""
    kind = first_of(
        [
            (F.col("classification") == "bounce_hard", F.lit("bounced")),
            (F.col("classification") == "unsubscribe", F.lit("unsubscribed")),
            (F.col("classification") == "reply", F.lit("replied")),
        ],
        F.lit("rescheduled"),
    )
    return processed.where(F.col("lead_email").isNotNull()).select(
        F.col("lead_email").alias("email"), kind.alias("kind"), F.col("received_at").alias("ts"),
        F.col("uid").alias("seq"), F.lit(None).cast("int").alias("step"), F.col("resume_at").alias("value_at"),
    )


def captured_replies(processed: DataFrame) -> DataFrame:
    """Reply text with the step the lead was at."""
    return processed.where(F.col("classification") == "reply").select(
        "uid", F.col("lead_email").alias("email"), F.col("lead_step").alias("step"), "subject",
        strip(F.coalesce("body", F.lit(""))).alias("body_text"), "received_at",
    )


def processed_marks(processed: DataFrame, as_of: Column) -> DataFrame:
    return processed.select("uid", as_of.alias("processed_at"), "received_at", "classification")


@dataclass(frozen=True)
class Polled:
    """What the new messages of a poll come to, and the leads they were matched with."""

    done: DataFrame
    leads: DataFrame

    def changed_leads(self, events: DataFrame) -> DataFrame:
        """The rows of the leads that the events change, after them."""
        touched = self.leads.join(events.select("email").distinct(), "email", "left_semi")
        return state.apply_events(touched, events).select(*self.leads.columns)


def stage(messages: DataFrame, leads: DataFrame, as_of: Column) -> Polled:
    """Class, lead, outcome and resume date of readable messages that are new."""
    return Polled(outcomes(match_leads(classify(messages), leads), as_of), leads)
