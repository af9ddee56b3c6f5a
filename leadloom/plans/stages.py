"""The stages of a full run, composed from the operators.

Each stage takes tables and returns tables, written once in the shared
folder, so that the next stage and a rerun start from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.operators import analysis, contacts, drafting, feedback, gate, hygiene, inbound, pages, people, sending, state
from leadloom.session import settle


@dataclass(frozen=True)
class Settings:
    """Choices of a run; the defaults keep every optional rule off."""

    as_of: Column
    url_column: str = "website"
    agent: str = "leadbot"
    verify: bool = False
    require_signal: bool = False
    enforce_due: bool = False
    send_limit: int | None = None
    reviewed_before: int = 0


def run_hygiene(s: Settings, leads: DataFrame, dns_facts: DataFrame, suppression: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped)"""
    tagged = settle(hygiene.tag_leads(leads, s.url_column, dns_facts, suppression), "tagged")
    return hygiene.kept_leads(tagged, s.url_column), hygiene.dropped_leads(tagged, s.url_column)


def run_crawl(s: Settings, wanted: DataFrame, stored: DataFrame, robots: DataFrame, cached: DataFrame | None = None,
              sitemap: DataFrame | None = None) -> DataFrame:
    """One crawl result per wanted domain, from stored pages; domains with a fresh result keep it.

    stored: domain, url, html, and if known page_type 'home', fetch_sec and
    fetch_error.  Which pages are read follows from the links of the home page
    and the sitemap; a domain without a stored home page fails with its cause.
    """
    domains = wanted.select("domain").distinct()
    todo = pages.stale_domains(domains, cached, s.as_of) if cached is not None else domains
    mine = stored.join(todo, "domain", "left_semi")
    visited = pages.visited_pages(todo, mine, robots, s.agent, sitemap)
    results = pages.crawl_results(pages.read_pages(visited), s.as_of)
    if cached is not None:
        kept = cached.join(domains, "domain", "left_semi").join(todo, "domain", "left_anti")
        results = results.unionByName(kept, allowMissingColumns=True)
    return settle(results, "crawl")


def run_analysis(s: Settings, crawled: DataFrame, responses: DataFrame) -> DataFrame:
    return settle(analysis.analyses(crawled, responses), "analysis")


def run_contacts(s: Settings, crawled: DataFrame, dns_facts: DataFrame, catch_all: DataFrame, probes: DataFrame,
                 officers: DataFrame | None = None) -> DataFrame:
    usable = crawled.where(F.col("status") == "ok")
    listed = usable.select("domain", F.posexplode("team_members").alias("pos", "p")).select("domain", "pos", "p.name", "p.title")
    spoken = people.prose_people(analysis.pages_of(usable))
    filed = people.officers_for(usable, officers) if officers is not None else None
    named = settle(people.named_people(listed, spoken, filed), "people")
    emails = usable.select("domain", F.posexplode("emails").alias("pos", "email"))
    found, pending = contacts.build_candidates(usable, emails, named)
    facts = contacts.domain_facts(dns_facts, catch_all)
    resolved = contacts.resolve_pending(pending, facts, probes, s.verify)
    candidates = found.unionByName(resolved, allowMissingColumns=True)
    ranked = contacts.rank_contacts(contacts.verify_candidates(candidates, facts, probes, s.verify))
    return settle(contacts.contacts_results(crawled, ranked, s.as_of, s.verify), "contacts")


def run_drafts(s: Settings, found: DataFrame, known: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, queue); the queue carries `pos` in order of domain and place."""
    targets = settle(drafting.draft_targets(found, known, s.require_signal), "targets")
    return targets, settle(drafting.draft_queue(targets, drafting.choose_attempts(attempts)), "drafts")


def run_gate(s: Settings, queue: DataFrame, known: DataFrame, judged: DataFrame) -> DataFrame:
    """Verdicts on a queue with `pos`; judged: pos, raw_text, error."""
    checked = gate.automated_checks(gate.with_group_key(queue), known)
    scored = gate.evaluation_order(gate.with_scores(checked, judged, ["pos"]))
    return settle(gate.verdicts(scored, s.reviewed_before, [F.col("email_key"), F.col("step")]), "judged")


def run_feedback(s: Settings, replies: DataFrame, answers: DataFrame, leads: DataFrame, send_log: DataFrame,
                 known: DataFrame, limit: int = fixed.FEW_SHOT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(replies with sentiments, few-shot examples)"""
    done = settle(feedback.classify_replies(replies, answers, s.as_of), "replies")
    return done, feedback.few_shot_examples(done, leads, send_log, known, limit)


def run_send_plan(s: Settings, queue: DataFrame, leads: DataFrame, suppression: DataFrame, mailboxes: DataFrame,
                  counts_today: DataFrame) -> DataFrame:
    plan = sending.plan_sends(
        queue, leads, suppression, mailboxes, counts_today, s.as_of, limit=s.send_limit, enforce_due=s.enforce_due
    )
    return settle(plan, "plan")


def run_inbound(s: Settings, messages: DataFrame, pending: DataFrame, processed: DataFrame, leads: DataFrame, suppression: DataFrame,
                days: int = fixed.LOOK_BACK_DAYS) -> dict[str, DataFrame]:
    """One poll: what came of every message, and the tables after it.

    done, skipped (fate and error of the others), pending (to try again),
    marks, leads, suppression, replies, and the summary in one row.
    """
    polled = settle(inbound.fates(messages, pending, processed, s.as_of, days), "poll")
    found = inbound.stage(polled.where(F.col("fate") == "done"), leads, s.as_of)
    done = settle(found.done, "polled")
    events = settle(inbound.lead_events(done), "poll-events")
    failed = polled.where(F.col("fate") == "failed")
    return {
        "done": done,
        "skipped": polled.where(F.col("fate") != "done"),
        "pending": failed.where(F.coalesce("uid", F.lit("")) != "").drop("fate", "was_pending"),
        "marks": processed.unionByName(inbound.processed_marks(done, s.as_of), allowMissingColumns=True),
        "leads": settle(state.apply_events(leads, events), "leads"),
        "suppression": settle(state.replace_by_key(
            suppression, state.suppression_entries(events), ["value", "scope"], "suppressed_at"), "suppression"),
        "replies": inbound.captured_replies(done),
        "summary": inbound.poll_summary(done.withColumn("error", F.lit(None).cast("string")).unionByName(
            failed.withColumn("classification", F.lit(None).cast("string")), allowMissingColumns=True)),
    }
