"""Which queued mails go out today, from which mailbox, in what form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.functions import schedule as S
from leadloom.functions.text import blank_to_null, first_of
from leadloom.operators.ordering import global_index
from leadloom.session import settle


# --------------------------------------------------------------------------
# Suppression
# --------------------------------------------------------------------------
def _stops(suppression: DataFrame, scope: str, name: str) -> DataFrame:
    return suppression.where(F.col("scope") == scope).select(F.col("value").alias(name)).distinct()


def mark_suppressed(rows: DataFrame, suppression: DataFrame, email: str = "email") -> DataFrame:
    """Add `suppressed`: the address or its domain is on the list.

    Two equi-joins on distinct values instead of one join with OR.
    """
    key = F.lower(F.trim(F.col(email)))
    domain = F.when(key.contains("@"), A.address_domain(key)).otherwise("")
    return (
        rows.withColumn("__k", key)
        .withColumn("__dom", domain)
        .join(_stops(suppression, "email", "__se"), F.col("__k") == F.col("__se"), "left")
        .join(_stops(suppression, "domain", "__sd"), F.col("__dom") == F.col("__sd"), "left")
        .withColumn("suppressed", F.col("__se").isNotNull() | F.col("__sd").isNotNull())
        .drop("__k", "__dom", "__se", "__sd")
    )


def not_suppressed(rows: DataFrame, suppression: DataFrame, email: str = "email") -> DataFrame:
    key = F.lower(F.trim(F.col(email)))
    domain = F.when(key.contains("@"), A.address_domain(key)).otherwise("")
    return rows.join(_stops(suppression, "email", "__se"), key == F.col("__se"), "left_anti").join(
        _stops(suppression, "domain", "__sd"), domain == F.col("__sd"), "left_anti"
    )


def due_leads(leads: DataFrame, suppression: DataFrame, as_of: Column) -> DataFrame:
    """Active leads whose next send has come, oldest first."""
    due = leads.where(
        (F.col("status") == "active") & (F.col("next_send_at").isNull() | (F.col("next_send_at") <= as_of))
    )
    return not_suppressed(due, suppression).orderBy("created_at", "email")


# --------------------------------------------------------------------------
# Sequence order
# --------------------------------------------------------------------------
def queue_state(queue: DataFrame, leads: DataFrame, suppression: DataFrame) -> DataFrame:
    """Queue items with the state of their lead; an unknown lead starts at 0."""
    state = leads.select(
        F.col("email").alias("__le"), F.col("status").alias("lead_status"), F.col("sequence_step").alias("lead_step"),
        F.col("next_send_at").alias("lead_next"),
    )
    items = mark_suppressed(queue.withColumn("email", F.lower(F.trim("to_email"))), suppression)
    return (
        items.join(state, F.col("email") == F.col("__le"), "left")
        .withColumn("lead_status", F.coalesce("lead_status", F.lit("active")))
        .withColumn("lead_step", F.coalesce("lead_step", F.lit(0)))
        .drop("__le")
    )


def completes(step: Column) -> Column:
    """The step ends the sequence: the last one, or one without a successor."""
    return (step >= fixed.MAX_SEQUENCE_STEP) | S.step_delay(step).isNull()


def accepted_items(items: DataFrame) -> DataFrame:
    """(email, step, pos) of the items that go out if every send succeeds.

    A lead's next step is the first item with that step after the previous
    accepted one.  A sequence has at most MAX_SEQUENCE_STEP such links; each
    is one join on the address and one partial minimum, all on the same
    partitioning, and nothing gathers a lead's items.
    """
    eligible = items.where(~F.col("suppressed") & (F.col("lead_status") == "active")).select(
        "email", "step", "pos", "lead_step"
    )
    opening = F.min(F.when(F.col("step") == F.col("lead_step") + 1, F.col("pos")))
    chain = eligible.groupBy("email", "lead_step").agg(opening.alias("p1")).where(F.col("p1").isNotNull())
    for n in range(2, fixed.MAX_SEQUENCE_STEP + 1):
        before = [f"p{i}" for i in range(1, n)]
        reached = F.col("lead_step") + (n - 1)
        follow = eligible.select(F.col("email").alias("__e"), F.col("step").alias("__s"), F.col("pos").alias("__p"))
        linked = chain.join(
            follow,
            (F.col("email") == F.col("__e")) & (F.col("__s") == reached + 1) & (F.col("__p") > F.col(f"p{n - 1}"))
            & ~completes(reached),
            "left",
        )
        chain = linked.groupBy("email", "lead_step", *before).agg(F.min("__p").alias(f"p{n}"))
    links = F.array(*[
        F.struct((F.col("lead_step") + n).alias("step"), F.col(f"p{n}").alias("pos"))
        for n in range(1, fixed.MAX_SEQUENCE_STEP + 1)
    ])
    return chain.select("email", F.explode(links).alias("l")).select("email", "l.step", "l.pos").where(
        F.col("pos").isNotNull()
    )


# --------------------------------------------------------------------------
# Mailbox slots
# --------------------------------------------------------------------------
def remaining_capacity(mailboxes: DataFrame, counts_today: DataFrame, today: Column, ramp=None) -> DataFrame:
    """(mailbox, mailbox_pos, remaining); mailboxes carry `pos`."""
    used = counts_today.select(F.col("mailbox").alias("__m"), F.col("count").alias("__used"))
    cap = S.daily_cap("warmup_start_date", "daily_cap_override", today, ramp)
    return mailboxes.join(used, F.col("name") == F.col("__m"), "left").select(
        F.col("name").alias("mailbox"), F.col("pos").alias("mailbox_pos"),
        (cap - F.coalesce("__used", F.lit(0))).cast("int").alias("remaining"),
    )


def mailbox_slots(capacity: DataFrame) -> DataFrame:
    """(slot, mailbox): the order in which sends take mailboxes.

    Always taking the mailbox with most capacity left (the first on a tie) is
    the same as taking single slots by level, highest first, then by mailbox.
    Levels are ranked one by one, so each sort holds one row per mailbox.
    """
    slots = capacity.where(F.col("remaining") > 0).select(
        "mailbox", "mailbox_pos", F.explode(F.sequence(F.lit(1), "remaining")).alias("level")
    )
    sizes = slots.groupBy("level").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("level").alias("__l"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__off"))
    within = F.row_number().over(Window.partitionBy("level").orderBy("mailbox_pos"))
    return slots.withColumn("__in", within - 1).join(offsets, F.col("level") == F.col("__l")).select(
        (F.col("__in") + F.col("__off")).alias("slot"), "mailbox"
    )


# --------------------------------------------------------------------------
# The plan
# --------------------------------------------------------------------------
def plan_sends(queue: DataFrame, leads: DataFrame, suppression: DataFrame, mailboxes: DataFrame,
               counts_today: DataFrame, as_of: Column, limit: int | None = None, enforce_due: bool = False) -> DataFrame:
    """A decision per queue item, in queue order (`pos`), and the mailbox of
    each item to be sent.

    Decisions: sent, suppressed, inactive, out_of_order, cap_reached, and
    not_reached beyond `limit`; not_due only with `enforce_due`.
    """
    columns = ["pos", "email", "step", "suppressed", "lead_status", "lead_step", "lead_next"]
    items = settle(queue_state(queue, leads, suppression).select(*columns), "queue-state")
    early = F.lit(False)
    if enforce_due:
        early = (F.col("lead_status") == "active") & F.coalesce(F.col("lead_next") > as_of, F.lit(False))
    candidates = items.where(~early)
    accepted = settle(global_index(accepted_items(candidates), "pos", "send_rank"), "accepted")
    slots = mailbox_slots(remaining_capacity(mailboxes, counts_today, F.to_date(as_of)))
    capacity = slots.agg(F.count(F.lit(1))).scalar()
    chain = accepted.select(
        F.col("pos").alias("__ap"), F.col("email").alias("__ae"), F.col("step").alias("__as"), "send_rank"
    )
    ended = accepted.where(completes(F.col("step"))).groupBy(F.col("email").alias("__ce")).agg(
        F.min("pos").alias("__done")
    )
    # The first accepted item that finds no slot ends the run there.
    full_at = accepted.where(F.col("send_rank") == capacity).agg(F.min("pos")).scalar()
    stop_after = F.lit(None).cast("long")
    if limit is not None:
        stop_after = accepted.where(F.col("send_rank") == limit - 1).agg(F.min("pos")).scalar()
    decided = (
        items.join(chain, F.col("pos") == F.col("__ap"), "left")
        .join(ended, F.col("email") == F.col("__ce"), "left")
        .join(slots, F.col("send_rank") == F.col("slot"), "left")
        .withColumn("__full", full_at)
        .withColumn("__stop", stop_after)
    )
    unreached = F.lit(limit == 0) | F.coalesce(F.col("pos") > F.col("__stop"), F.lit(False))
    inactive = (F.col("lead_status") != "active") | F.coalesce(F.col("pos") > F.col("__done"), F.lit(False))
    decision = first_of(
        [
            (unreached & ~F.coalesce(F.col("__full") <= F.col("__stop"), F.lit(False)), F.lit("not_reached")),
            (F.coalesce(F.col("pos") >= F.col("__full"), F.lit(False)), F.lit("cap_reached")),
            (F.col("suppressed"), F.lit("suppressed")),
            (inactive, F.lit("inactive")),
            (early, F.lit("not_due")),
            (F.col("send_rank").isNull(), F.lit("out_of_order")),
        ],
        F.lit("sent"),
    )
    sent = F.col("decision") == "sent"
    decisions = (
        decided.withColumn("decision", decision)
        .withColumn("mailbox", F.when(sent, F.col("mailbox")))
        .withColumn("next_send_at", F.when(sent, S.next_send_at("step", as_of)))
        .withColumn("completes", F.when(sent, completes(F.col("step"))))
        .select(F.col("pos").alias("__pos"), "email", "decision", "mailbox", "next_send_at", "completes")
    )
    return queue.join(decisions, F.col("pos") == F.col("__pos")).drop("__pos")


def send_summary(plan: DataFrame, send_results: DataFrame | None = None) -> DataFrame:
    """Counts by decision; with results, failed sends are counted apart."""
    failed = F.lit(False)
    rows = plan
    if send_results is not None:
        rows = plan.join(
            send_results.select(F.col("queue_pos").alias("__q"), "ok"), F.col("pos") == F.col("__q"), "left"
        )
        failed = F.coalesce(~F.col("ok"), F.lit(False))
    sent = F.col("decision") == "sent"
    skips = ["suppressed", "out_of_order", "inactive", "cap_reached"]
    return rows.agg(
        F.count_if(sent & ~failed).alias("sent"),
        *[F.count_if(F.col("decision") == d).alias(f"skipped_{d}") for d in skips],
        F.count_if(sent & failed).alias("failed"),
    )


def thread_starts(send_log: DataFrame) -> DataFrame:
    """First message sent as step 1 to each address: (email, thread_id)."""
    first = F.min(F.struct("sent_at", "id", "message_id"))
    return send_log.where((F.col("step") == 1) & (F.col("status") == "sent")).groupBy("email").agg(
        first.alias("f")
    ).select("email", F.col("f.message_id").alias("thread_id"))


def require_address(physical_address: str) -> None:
    """No plan leaves without a postal address."""
    if not (physical_address or "").strip():
        raise ValueError("a postal address is required before any message is planned")


def planned_messages(plan: DataFrame, mailboxes: DataFrame, send_log: DataFrame, physical_address: str,
                     unsubscribe_text: str = "", unsubscribe_url: str = "") -> DataFrame:
    """Header and body of each message of a plan."""
    require_address(physical_address)
    boxes = mailboxes.select(F.col("name").alias("__n"), "smtp_user", "reply_to", "from_name")
    starts = thread_starts(send_log).select(F.col("email").alias("__te"), "thread_id")
    rows = (
        plan.where(F.col("decision") == "sent")
        .join(boxes, F.col("mailbox") == F.col("__n"))
        .join(starts, F.col("email") == F.col("__te"), "left")
    )
    thread = F.when((F.col("step") != 1) & (F.coalesce("thread_id", F.lit("")) != ""), F.col("thread_id"))
    reply_to = F.coalesce(blank_to_null(F.col("reply_to")), F.col("smtp_user"))
    sender = F.when(
        F.coalesce("from_name", F.lit("")) != "", F.concat("from_name", F.lit(" <"), "smtp_user", F.lit(">"))
    ).otherwise(F.col("smtp_user"))
    mail_target = F.concat(F.lit("<mailto:"), reply_to, F.lit("?subject=unsubscribe>"))
    targets = F.concat(F.lit(f"<{unsubscribe_url}>, "), mail_target) if unsubscribe_url else mail_target
    footer = "\n".join(["", "--", physical_address] + ([unsubscribe_text] if unsubscribe_text else []))
    return rows.select(
        "pos", "email", "step", "mailbox",
        sender.alias("from_header"),
        reply_to.alias("reply_to"),
        S.threaded_subject("subject", thread.isNotNull()).alias("subject"),
        thread.alias("in_reply_to"),
        targets.alias("list_unsubscribe"),
        F.lit("List-Unsubscribe=One-Click" if unsubscribe_url else None).cast("string").alias("list_unsubscribe_post"),
        F.concat(F.regexp_replace("body", r"(?U)\s+$", ""), F.lit("\n" + footer)).alias("body"),
    )


# --------------------------------------------------------------------------
# Deliverability facts
# --------------------------------------------------------------------------
def spf_record(txt: Column) -> Column:
    return F.get(F.filter(txt, lambda t: t.startswith("v=spf1")), F.lit(0))


def dmarc_record(txt: Column) -> Column:
    return F.get(F.filter(txt, lambda t: t.startswith("v=DMARC1")), F.lit(0))


def dmarc_policy(record: Column) -> Column:
    return F.when(record.rlike("p=[a-zA-Z]+"), F.regexp_extract(record, "p=([a-zA-Z]+)", 1))


def health(domains: DataFrame, dns_facts: DataFrame, dnsbl_facts: DataFrame | None = None, selectors=None,
           zones=None) -> DataFrame:
    """SPF, DMARC, DKIM and block-list state per domain (column `ip` for the
    lists).  A missing fact is never reported as listed."""
    selectors = selectors or fixed.DKIM_SELECTORS
    zones = zones or fixed.DNSBL_ZONES
    facts = dns_facts.select(F.col("domain").alias("__d"), "txt", "dmarc_txt", "dkim")
    rows = domains.join(facts, F.col("domain") == F.col("__d"), "left")
    wanted = F.array(*[F.lit(s) for s in selectors])
    spf, dmarc = spf_record(F.col("txt")), dmarc_record(F.col("dmarc_txt"))
    out = rows.select(
        *[F.col(c) for c in domains.columns],
        spf.isNotNull().alias("spf_found"), spf.alias("spf_record"),
        dmarc.isNotNull().alias("dmarc_found"), dmarc.alias("dmarc_record"), dmarc_policy(dmarc).alias("dmarc_policy"),
        F.coalesce(F.array_intersect(wanted, "dkim"), F.array().cast("array<string>")).alias("dkim_selectors_found"),
    )
    if dnsbl_facts is None:
        return out
    listed = dnsbl_facts.where(F.col("listed") & F.col("zone").isin(list(zones))).groupBy(F.col("ip").alias("__ip")).agg(
        F.collect_set("zone").alias("__zones")
    )
    ordered = F.filter(F.array(*[F.lit(z) for z in zones]), lambda z: F.array_contains("__zones", z))
    return out.join(listed, F.col("ip") == F.col("__ip"), "left").withColumn(
        "blacklists", F.coalesce(ordered, F.array().cast("array<string>"))
    ).drop("__ip", "__zones")


def preflight_warnings(mailboxes: DataFrame, dns_facts: DataFrame) -> DataFrame:
    """(domain, warning) per distinct sending domain with a missing record."""
    domains = mailboxes.where(F.col("smtp_user").contains("@")).select(
        F.regexp_extract("smtp_user", "@(.*)$", 1).alias("domain")
    ).distinct()
    checked = health(domains, dns_facts)
    warnings = F.array(
        F.when(~F.col("spf_found"), F.lit("no SPF record found")),
        F.when(~F.col("dmarc_found"), F.lit("no DMARC record found")),
    )
    return checked.select("domain", F.explode(F.filter(warnings, lambda w: w.isNotNull())).alias("warning"))
