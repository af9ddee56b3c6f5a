"""Operators on small fixtures, and order-dependent parts by brute force."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.operators import analysis, contacts, feedback, gate, hygiene, inbound, ordering, pages, people, reports, sending, state
from leadloom.plans import stages
from leadloom.plans.catalog import load_all
from leadloom.session import spread
from leadloom.sources import readers, writers
from leadloom.streaming import inbound_stream as IS
from leadloom.streaming.keyed_table import KeyedTable

T0 = dt.datetime(2026, 3, 1)


def as_of():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


def dns(spark, rows):
    ddl = "domain string, mx array<struct<pref:int,host:string>>, ns array<string>, txt array<string>, dmarc_txt array<string>, dkim array<string>"
    return spark.createDataFrame([(d, [(10, "mx")] if mx else [], ns, [], [], []) for d, mx, ns in rows], ddl)


def suppression(spark, rows=()):
    return spark.createDataFrame([(v, s, "x", T0) for v, s in rows], schemas.SUPPRESSION)


# ------------------------------------------------------------------ hygiene
def test_hygiene(spark):
    leads = spark.createDataFrame(
        [(0, "Acme", "https://www.acme.com/?utm_source=x"), (1, "Acme Dup", "acme.com"), (2, "Other", "other.co.uk"), (3, "No", "nomx.com"),
         (4, "Park", "park.com"), (5, "Stop", "stop.com"), (6, "Bad", " nope "), (7, "Box", "bounced.com"), (8, "Unseen", "unseen.com")],
        "pos long, company string, website string")
    facts = dns(spark, [(d, d != "nomx.com", ["NS1.BODIS.com."] if d == "park.com" else ["ns.x."]) for d in
                        ("acme.com", "other.co.uk", "nomx.com", "park.com", "stop.com", "bounced.com")])
    tagged = hygiene.tag_leads(leads, "website", facts, suppression(spark, [("stop.com", "domain"), ("u@bounced.com", "email")]))
    fate = {r.pos: r.drop_reason for r in tagged.collect()}
    assert fate == {0: None, 1: "duplicate", 2: None, 3: "no_mx", 4: "parked_domain", 5: "globally_suppressed", 6: "invalid_url", 7: None, 8: "no_mx"}
    kept = {r.domain: r for r in hygiene.kept_leads(tagged, "website").collect()}
    assert kept["other.co.uk"].geo == "UK" and kept["acme.com"].original_url_cleaned == "https://www.acme.com/"
    dropped = {r.domain: r.drop_reason for r in hygiene.dropped_leads(tagged, "website").collect()}
    assert dropped["nope"] == "invalid_url" and "acme.com" not in dropped
    assert hygiene.dropped_leads(tagged, "website", emit_duplicates=True).count() == len(dropped) + 1


def test_missing_column(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([("a",)], "x string"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        readers.read_leads(spark, str(tmp_path / "c"), "website")


# ----------------------------------------------------------------- ordering
def test_running_values_over_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", p, rng.randint(0, 50)) for p in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    spent = {(r.k, r.p): r.s for r in ordering.running_before(df, ["k"], "p", F.col("v"), "s", width=64).collect()}
    assert spent == {(k, p): sum(v2 for k2, p2, v2 in rows if k2 == k and p2 < p) for k, p, _ in rows}
    index = {r.p: r.i for r in ordering.global_index(df, "p", "i", width=64).collect()}
    assert index == {p: i for i, p in enumerate(sorted(p for _, p, _ in rows))}


def test_first_k_is_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)], "k string, p int")
    top = ordering.first_k(df, ["k"], [F.col("p")], 3)
    assert [r.p for r in top.orderBy("p").collect()] == [0, 1, 2]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# ----------------------------------------------------------------- contacts
def results_for(spark, emails, people, domain="acme.com"):
    domains = spark.createDataFrame([(domain,)], "domain string")
    mails = spark.createDataFrame([(domain, i, e) for i, e in enumerate(emails)], "domain string, pos int, email string")
    named = spark.createDataFrame([(domain, i, n, t) for i, (n, t) in enumerate(people)], "domain string, pos int, name string, title string")
    found, pending = contacts.build_candidates(domains, mails, named)
    order = ["priority", F.col("source") == "guessed", "email"]
    return found.orderBy(*order).collect(), pending.collect()


def test_candidates(spark):
    found, _ = results_for(spark, ["support@acme.com", "jane.diaz@acme.com", "info@acme.com"], [("Jane Diaz", "Founder")])
    assert [c.email for c in found] == ["jane.diaz@acme.com", "info@acme.com", "support@acme.com"] and found[0].matched_name == "Jane Diaz"
    found, _ = results_for(spark, [], [])
    assert {c.source for c in found} == {"guessed"} and len(found) == 4
    found, pending = results_for(spark, ["jane.diaz@acme.com"], [("Jane Diaz", "Founder"), ("John Smith", "Head of Sales"), ("Cher", "CEO")])
    assert ("john.smith@acme.com", "pattern_derived") in [(c.email, c.source) for c in found] and [p.name for p in pending] == ["Cher"]


def test_matching_by_brute_force(spark):
    rng = random.Random(11)
    first, last = ["jane", "john", "ann", "bo"], ["diaz", "fox", "ann", "lee"]
    people = [("hot.com" if i % 3 else f"d{i % 4}.com", i, f"{rng.choice(first).title()} {rng.choice(last).title()}", "x") for i in range(120)]
    emails = sorted({("hot.com" if rng.random() < 0.6 else f"d{rng.randint(0, 3)}.com",
                      rng.choice("._").join(rng.sample(first + last + ["a", "b", "c", "e", "f"], rng.randint(1, 8))) + "@x.io") for _ in range(200)})
    got = contacts.match_people(
        spark.createDataFrame([(d, i, e) for i, (d, e) in enumerate(emails)], "domain string, pos int, email string"),
        spark.createDataFrame(people, "domain string, pos int, name string, title string"),
    ).collect()

    def brute(domain, email):
        local = email.split("@")[0].replace(".", " ").replace("_", " ")
        for d, _, name, _ in people:
            low = name.lower().split()
            if d == domain and (set(low) <= set(local.split()) or local == low[0]):
                return name
        return None

    assert len(got) == len(emails) and all(r.matched_name == brute(r.domain, r.email) for r in got)


def test_gaps(spark):
    def contact(email, confidence):
        return (email, "other", None, None, "scraped", "not_checked", "", confidence, None)

    found = spark.createDataFrame(
        [("gap.com", T0, "no_contacts_found", [], False), ("low.com", T0, "ok", [contact("i@low.com", "low")], False),
         ("good.com", T0, "ok", [contact("i@good.com", "low"), contact("a@good.com", "high")], False)], schemas.CONTACTS_RESULT)
    assert {r.domain: r.gap_reason for r in contacts.gap_rows(found).collect()} == {"gap.com": "no_contact", "low.com": "low_confidence"}
    filled = spark.createDataFrame(
        [(0, "gap.com", "Jane Diaz", "Founder", "jane@gap.com", "Y", ""), (1, "low.com", "", "", " ", "Y", ""), (2, "no.com", "", "", "a@no.com", "", ""),
         (3, "low.com", "", "", "i@low.com", "n", "")],
        "pos int, domain string, found_name string, found_title string, found_email string, verified_yn string, notes string")
    outcome = contacts.filled_gaps(filled, found)
    assert contacts.import_summary(outcome).first().asDict() == {"imported": 2, "skipped_blank": 1, "skipped_no_domain_dir": 1}
    merged = {r.domain: r for r in contacts.import_gaps(found, outcome).collect()}
    assert merged["gap.com"].status == "ok" and merged["gap.com"].contacts[0].confidence == "high" and merged["gap.com"].contacts[0].source == "manual_lookup"
    assert len(merged["low.com"].contacts) == 1 and len(merged["good.com"].contacts) == 2
    best = {r.domain: r.e for r in found.select("domain", contacts.best_contact(F.col("contacts"))["email"].alias("e")).collect()}
    assert best["good.com"] == "a@good.com"


# ----------------------------------------------------------- quotes and gate
def test_quotes(spark):
    rows = spark.createDataFrame([("a.com", 0, "u", "home", "We’re hiring a Head of  Sales"), ("a.com", 1, "u", "home", "other text")],
                                 "domain string, pos int, url string, page_type string, text string")
    claims = spark.createDataFrame([("a.com", 1, "we're hiring a head of sales", "u"), ("a.com", 2, "cold fusion", "u"), ("a.com", 3, "other text", "u"),
                                    ("a.com", 4, "", "u"), ("a.com", 5, "hiring", None)], "domain string, id int, quote string, source_url string")
    assert {r.id: r.verified for r in analysis.check_quotes(claims, rows).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_gate(spark):
    rows = [(0, "j@a.com", "", "short idea", "a plain note on the pricing page", 1), (1, "j@a.com", "", "idea", "see www.x.io", 2),
            (2, "k@a.com", "a.com", "idea", "see www.x.io", 1), (3, "m@a.com", "a.com", "idea", "cats sat", 1), (4, "n@b.com", "b.com", "idea", "cats sat", 1)]
    queue = spark.createDataFrame(rows, "pos int, to_email string, domain string, subject string, body string, step int")
    known = spark.createDataFrame([("a.com", [("h", "their pricing page", "u", 8)], [])], "domain string, hooks array<struct<hook:string,quote:string,source_url:string,specificity:int>>, pains array<struct<pain:string,quote:string,source_url:string,confidence:int>>")
    scores = [(0, '{"grounding": 9, "overall": 9}', None), (1, '{"grounding": 7, "overall": 9, "feedback": "vague"}', None), (4, "{}", "503")]
    judged = stages.run_gate(stages.Settings(as_of(), reviewed_before=100), queue, known, spark.createDataFrame(scores, "pos int, raw_text string, error string"))
    got = {r.pos: (r.verdict, r.violations) for r in judged.collect()}
    assert got[0] == ("pass", []) and got[1] == ("fail_judge", ["vague"]) and got[4] == ("fail_judge_error", ["503"])
    assert got[2][1][0] == "the first mail holds a link" and got[3] == ("fail_automated", ["the body refers to no verified detail"])
    summary = gate.gate_summary(judged, queue).first()
    assert (summary.total, summary.passed, summary.failed_automated, summary.failed_judge, summary.redrafted) == (5, 1, 2, 2, 0)


# ------------------------------------------------------------------ sending
def greedy(capacity, count):
    left, order = dict(capacity), []
    for _ in range(count):
        best, most = None, 0
        for name, _ in capacity:
            if left[name] > most:
                best, most = name, left[name]
        if best is None:
            break
        left[best] -= 1
        order.append(best)
    return order


def test_slots_equal_greedy_choice(spark):
    rng = random.Random(7)
    for _ in range(3):
        capacity = [(f"m{i}", rng.randint(-1, 5)) for i in range(6)]
        df = spark.createDataFrame([(n, i, c) for i, (n, c) in enumerate(capacity)], "mailbox string, mailbox_pos int, remaining int")
        got = [r.mailbox for r in sending.mailbox_slots(df).orderBy("slot").collect()]
        assert got == greedy(capacity, 99)


def simulate(queue, leads, stopped, capacity, limit=None):
    step = {e: s for e, s, _ in leads}
    status = {e: st for e, _, st in leads}
    left, sent, out = dict(capacity), 0, {}
    for i, (pos, email, want) in enumerate(queue):
        if limit is not None and sent >= limit:
            out.update({p: "not_reached" for p, _, _ in queue[i:]})
            break
        if email in stopped:
            out[pos] = "suppressed"
        elif status.get(email, "active") != "active":
            out[pos] = "inactive"
        elif want != step.get(email, 0) + 1:
            out[pos] = "out_of_order"
        elif max(left.values()) <= 0:
            out.update({p: "cap_reached" for p, _, _ in queue[i:]})
            break
        else:
            best = max(left, key=lambda m: left[m])
            left[best] -= 1
            sent, out[pos], step[email] = sent + 1, "sent", want
            if want >= 4 or want not in (1, 2, 3):
                status[email] = "completed"
    return out


@pytest.mark.parametrize("limit,caps", [(None, 30), (None, 3), (4, 30), (0, 5)])
def test_plan_equals_a_loop(spark, limit, caps):
    rng = random.Random(caps + (limit or 0))
    people = [f"u{i}@d{i % 3}.com" for i in range(9)]
    queue = [(p, "u0@d0.com" if rng.random() < 0.4 else rng.choice(people), rng.randint(1, 5)) for p in range(0, 240, 3)]
    leads = [(e, rng.randint(0, 4), rng.choice(["active", "active", "active", "replied"])) for e in people[:6]]
    stopped = {people[7]}
    boxes = [("a", 0, caps), ("b", 1, caps - 2)]
    df = spark.createDataFrame([(p, e, "s", "b", s) for p, e, s in queue], "pos long, to_email string, subject string, body string, step int")
    state_rows = [(e, "d", None, s, st, None, None, T0, T0, None) for e, s, st in leads]
    mailboxes = spark.createDataFrame([(n, f"{n}@x.io", None, None, None, c, i) for n, i, c in boxes],
                                      "name string, smtp_user string, reply_to string, from_name string, warmup_start_date date, daily_cap_override int, pos int")
    plan = sending.plan_sends(df, spark.createDataFrame(state_rows, schemas.LEADS), suppression(spark, [(e, "email") for e in stopped]), mailboxes,
                              spark.createDataFrame([], "mailbox string, count long"), as_of(), limit=limit)
    got = {r.pos: r.decision for r in plan.collect()}
    assert got == simulate(queue, leads, stopped, {n: c for n, _, c in boxes}, limit)


def test_due_only(spark):
    df = spark.createDataFrame([(0, "a@x.io", "s", "b", 2), (1, "b@x.io", "s", "b", 2)], "pos long, to_email string, subject string, body string, step int")
    late = dt.datetime(2026, 4, 1)
    leads = spark.createDataFrame([("a@x.io", "x", None, 1, "active", None, late, T0, T0, None), ("b@x.io", "x", None, 1, "active", None, None, T0, T0, None)], schemas.LEADS)
    boxes = spark.createDataFrame([("a", "a@x.io", None, None, None, 5, 0)], "name string, smtp_user string, reply_to string, from_name string, warmup_start_date date, daily_cap_override int, pos int")
    none = spark.createDataFrame([], "mailbox string, count long")
    for enforce, want in ((True, {0: "not_due", 1: "sent"}), (False, {0: "sent", 1: "sent"})):
        plan = sending.plan_sends(df, leads, suppression(spark), boxes, none, as_of(), enforce_due=enforce)
        assert {r.pos: r.decision for r in plan.collect()} == want
    with pytest.raises(ValueError):
        sending.planned_messages(plan, boxes, spark.createDataFrame([], schemas.SEND_LOG), " ")


# ------------------------------------------------------------ mail and state
def test_inbound(spark):
    rows = [("101", "Jane <jane@acme.com>", "Re: quick q", "Please unsubscribe me, not interested.", "", T0),
            ("102", "mailer-daemon@mail.acme.com", "Undelivered Mail Returned to Sender", "x JANE@acme.com: 550 5.1.1 user unknown", "user unknown", T0),
            ("106", "mailer-daemon@mail.acme.com", "Delivery Status Notification (Delay)", "jane@acme.com 450", "450 4.2.2 mailbox full, try again later", T0),
            ("103", "jane@acme.com", "Re: quick question", "Interested, tell me more.\n", "", T0), ("104", "who@x.io", "hi", "hello", "", T0),
            ("105", "jane@acme.com", "x", "again", "", T0)]
    leads = spark.createDataFrame([("jane@acme.com", "acme.com", None, 2, "active", None, None, T0, T0, None)], schemas.LEADS)
    seen = spark.createDataFrame([("105", T0, "reply")], schemas.PROCESSED_REPLIES)
    done = inbound.process(spark.createDataFrame(rows, schemas.INBOUND), leads, seen, as_of())
    got = {r.uid: r.classification for r in done.collect()}
    assert got == {"101": "unsubscribe", "102": "bounce_hard", "106": "bounce_soft", "103": "reply", "104": "reply:unmatched"}
    reply = inbound.captured_replies(done).first()
    assert (reply.email, reply.step, reply.body_text) == ("jane@acme.com", 2, "Interested, tell me more.")
    entries = {(r.value, r.scope) for r in state.suppression_entries(inbound.lead_events(done)).collect()}
    assert entries == {("jane@acme.com", "email"), ("acme.com", "domain")}
    spared = state.suppression_entries(inbound.lead_events(done), free_mail=["acme.com"])
    assert {r.scope for r in spared.collect()} == {"email"}


def test_last_event_wins(spark):
    def event(kind, minute, step=None, at=None):
        return ("j@a.com", kind, T0 + dt.timedelta(minutes=minute), f"{minute:020d}", step, at)

    later = dt.datetime(2026, 5, 1)
    events = [event("replied", 3), event("bounced", 9), event("sent", 1, 1, T0), event("sent", 2, 2, later), event("meeting", 5), event("rescheduled", 4, None, later)]
    leads = spark.createDataFrame([("j@a.com", "a.com", None, 0, "active", None, None, T0, T0, None)], schemas.LEADS)
    df = spark.createDataFrame(events, "email string, kind string, ts timestamp, seq string, step int, value_at timestamp")
    lead = state.apply_events(leads, df).first()
    assert (lead.status, lead.sequence_step, lead.next_send_at) == ("bounced", 2, later)
    assert lead.meeting_booked_at == T0 + dt.timedelta(minutes=5)


def mail(spark, *rows):
    """Rows of (uid, from, subject, body, received_at, fetch_error)."""
    return spark.createDataFrame([(u, f, s, b, b, at, e) for u, f, s, b, at, e in rows],
                                 "uid string, from_addr string, subject string, body string, full_text string, received_at timestamp, fetch_error string")


def active(spark, *emails):
    return spark.createDataFrame([(e, e.split("@")[1], None, 1, "active", None, None, T0, T0, None) for e in emails], schemas.LEADS)


def test_mail_over_three_runs(spark, tmp_path):
    """Every row ends in one place: repeats, late and too old mail, mail that fails, then comes again or never does."""
    leads = active(spark, "j@a.com", "k@b.com", "m@c.com")
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    now, late, old = T0, T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=30)
    runs = [
        [("1", "j@a.com", "s", "hello", now, None), ("2", None, None, None, now, "timeout"), ("3", None, None, None, now, None), ("", "x@y.z", "s", "b", now, None),
         (None, "x@y.z", "s", "b", now, None)],
        [("1", "j@a.com", "s", "hello", now, None), ("2", "k@b.com", "s", "please unsubscribe", now, None), ("4", None, "s", "about k@b.com", now, None)],
        [("5", "m@c.com", "s", "out of the office", late, None), ("6", "m@c.com", "s", "hello", old, None), ("2", "k@b.com", "s", "hello", now, None),
         ("7", "m@c.com", "s", "hello", None, None), ("7", "m@c.com", "s", "hello", None, None)],
    ]
    schema = mail(spark, *runs[0]).schema
    tables = IS.inbound_tables(spark, str(tmp_path / "out"), schema, leads.schema, fold_every=2)
    tables.load(leads)
    seen = []
    for rows in runs:
        mail(spark, *rows).write.mode("append").parquet(source)
        IS.start_poll(spark.readStream.schema(schema).parquet(source), tables, as_of(), mark).awaitTermination()
        seen.append((tables.done.read().count(), sorted(r.uid for r in tables.pending.read().collect()), sum(r["rows"] for r in tables.skipped.read().collect())))
    assert {r.uid: r.classification for r in tables.done.read().collect()} == {"1": "reply", "2": "unsubscribe", "4": "reply", "5": "ooo", "7": "reply"}
    # Rows of a run and what was pending before it: 5, 3 + 2, 5 + 1; each is done or counted as skipped.
    assert seen == [(1, ["2", "3"], 4), (3, ["3"], 7), (5, ["3"], 11)]
    assert [done + skipped for done, _, skipped in seen] == [5, 5 + 5, 5 + 5 + 6]
    skipped = {(r.uid, r.fate): r["rows"] for r in tables.skipped.read().collect()}
    assert skipped == {("2", "failed"): 1, ("3", "failed"): 3, ("", "failed"): 1, (None, "failed"): 1, ("1", "repeat"): 1, ("2", "repeat"): 1, ("6", "old"): 1, ("7", "repeat"): 1}
    assert {r.email: r.status for r in tables.leads.read().collect()} == {"j@a.com": "replied", "k@b.com": "replied", "m@c.com": "replied"}
    assert {r.value for r in tables.suppression.read().collect()} == {"k@b.com", "b.com"}
    assert sorted(r.uid for r in tables.replies.read().collect()) == ["1", "4", "7"]
    assert sorted(r.uid for r in tables.marks.read().collect()) == ["1", "2", "4", "5", "7"]


def test_a_batch_that_runs_twice_changes_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n long")
    for kind, wanted in (("add", {"a": 30, "b": 50}), ("replace", {"a": 2, "b": 5}), ("insert", {"a": 1, "b": 5})):
        table = KeyedTable(spark, str(tmp_path / kind), rows.schema, ["k"], kind, None if kind == "add" else "n", fold_every=3)
        for batch in range(10):
            table.change(rows, batch)
            table.change(rows, batch)
        assert {r.k: r.n for r in table.read().collect()} == wanted
        assert table.read(9).count() == 2


def test_a_table_with_a_long_history_reads_little(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 5)], "k string, n long")
    table = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], "add", fold_every=4)
    for batch in range(30):
        table.change(rows, batch)
    parts = [p.rsplit("/", 1)[1] for p in table._parts(None)]
    assert parts == ["upto=27", "batch=28", "batch=29"]
    assert {r.k: r.n for r in table.read().collect()} == {"a": 30, "b": 150}
    assert len(os.listdir(tmp_path / "t" / "delta")) <= 8 and len(os.listdir(tmp_path / "t" / "base")) == 2


def test_rows_that_are_gone_leave_the_base(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, closed boolean").schema, ["k"], "replace", fold_every=2, gone="closed")
    table.change(spark.createDataFrame([("a", False), ("b", False)], "k string, closed boolean"), 0)
    table.change(spark.createDataFrame([("a", True)], "k string, closed boolean"), 1)
    assert [r.k for r in table.read().collect()] == ["b"]
    assert spark.read.parquet(str(tmp_path / "t" / "base" / "upto=1")).count() == 1


def test_the_inbound_stage(spark):
    s = stages.Settings(as_of())
    leads = active(spark, "j@a.com", "k@b.com")
    rows = mail(spark, ("1", "j@a.com", "s", "please unsubscribe", T0, None), ("2", "k@b.com", "s", "hi", T0, None), ("3", None, None, None, T0, "lost"))
    pending = mail(spark, ("9", "k@b.com", "s", "hi again", T0, None))
    found = stages.run_inbound(s, rows, pending, spark.createDataFrame([("2", "reply")], "uid string, classification string"), leads, suppression(spark))
    assert sorted(r.uid for r in found["done"].collect()) == ["1", "9"]
    assert sorted((r.uid, r.fate) for r in found["skipped"].collect()) == [("2", "repeat"), ("3", "failed")]
    assert [r.uid for r in found["pending"].collect()] == ["3"]
    assert {r.email: r.status for r in found["leads"].collect()} == {"j@a.com": "unsubscribed", "k@b.com": "replied"}
    summary = found["summary"].first()
    assert (summary.unsubscribe, summary.reply, summary.errors) == (1, 1, 1)
    assert sorted(r.uid for r in found["marks"].collect()) == ["1", "2", "9"]


# ------------------------------------------------------- reports and feedback
def log_row(i, email, step, subject, status="sent"):
    return (i, email, step, subject, f"m{i}", "box", T0 + dt.timedelta(hours=i), status, None)


def test_reports_and_variants(spark):
    log = spark.createDataFrame([log_row(1, "a@x.io", 1, "Quick Q"), log_row(2, "b@x.io", 1, "Other"), log_row(3, "a@x.io", 2, "Re: quick q", "failed")], schemas.SEND_LOG)
    leads = spark.createDataFrame([("a@x.io", "x.io", None, 1, "replied", None, None, T0, T0, None), ("b@x.io", "x.io", None, 1, "active", None, None, T0, T0, None)], schemas.LEADS)
    replies = spark.createDataFrame([(1, "a@x.io", 1, "Re", "yes", T0, "positive", 9.0, T0), (2, "b@x.io", 1, "Re", "no", T0, "negative", 9.0, T0)], schemas.REPLIES)
    summary = reports.campaign_summary(leads, log).first()
    assert (summary.reply_rate, summary.total_sent, summary.total_failed) == (0.5, 2, 1)
    assert reports.campaign_summary(leads, log.limit(0)).first().reply_rate == 0.0
    metrics = {r.variant: r for r in feedback.variant_metrics(log, leads, replies).collect()}
    assert metrics["quick q"].positive_rate == 1.0 and metrics["quick q"].reply_rate == 1.0 and not metrics["quick q"].sufficient_sample
    warned = feedback.health_warnings(feedback.variant_metrics(log, leads, replies, min_sample=1)).where("variant = 'other'").first()
    assert warned.warnings == ["reply rate 0.0% is under 5.0%", "rate of positive replies 0.0% is under 1.0%"]
    known = spark.createDataFrame([("x.io", "X", [("h", "q1", "u", 8), ("h", "q2", "u", 8)])], "domain string, company_name string, hooks array<struct<hook:string,quote:string,source_url:string,specificity:int>>")
    shot = feedback.few_shot_examples(replies, leads, log, known).collect()
    assert [(s.subject, s.grounding, s.reply_text) for s in shot] == [("quick q", "q1; q2", "yes")]


# --------------------------------------------------------------------- crawl
def stored_pages(spark, *rows):
    """Rows of (domain, url, page_type, html, fetch_sec, fetch_error)."""
    return spark.createDataFrame(list(rows), "domain string, url string, page_type string, html string, fetch_sec double, fetch_error string")


def test_the_crawl_follows_the_home_page(spark):
    """Links choose the pages; stored pages that nothing links to are not read, wanted domains without pages fail with their cause."""
    text = "<p>We run a pricing desk for shops of every size, and we have done so for years.</p>"
    home = text + '<a href="/about-us">About us</a><a href="/team">Our team</a>'
    stored = stored_pages(
        spark, ("a.com", "https://www.a.com/", None, home, 1.5, None), ("a.com", "https://www.a.com/about-us", None, "<p>About</p> x@a.com", 0.25, None),
        ("a.com", "https://www.a.com/hidden", None, "<p>y@a.com</p>", 9.0, None), ("b.com", "https://b.com", None, None, 3.0, "timeout"),
        ("c.com", "https://c.com", None, "<p>Checking your browser before access</p>", 0.5, None), ("d.com", "http://d.com", None, text, 0.5, None),
        ("f.com", "https://f.com", None, "<p></p>", 0.5, None))
    robots = spark.createDataFrame([("d.com", "*", 1, False, "/"), ("a.com", "*", 1, False, "/team")], "domain string, agent string, pos int, allow boolean, path string")
    wanted = spark.createDataFrame([(d,) for d in ("a.com", "b.com", "c.com", "d.com", "e.com", "f.com", "a.com")], "domain string")
    done = stages.run_crawl(stages.Settings(as_of()), wanted, stored, robots)
    rows = {r.domain: r for r in done.collect()}
    assert {d: (r.status, r.error) for d, r in rows.items()} == {
        "a.com": ("ok", None), "b.com": ("crawl_failed", "home page not fetched: timeout"), "c.com": ("blocked", "home page is behind a bot wall"),
        "d.com": ("robots_disallowed", "robots rules refuse the home page"), "e.com": ("crawl_failed", "home page not fetched: unknown"),
        "f.com": ("crawl_failed", "no text, address or person on any page")}
    assert [p.url for p in rows["a.com"].pages] == ["https://www.a.com/", "https://www.a.com/about-us"]
    assert rows["a.com"].emails == ["x@a.com"] and rows["a.com"].robots_skipped == ["https://www.a.com/team"] and rows["a.com"].duration_sec == 1.75
    summary = {r.domain: r for r in pages.run_summary(done).collect()}
    assert summary["b.com"].duration_sec == 3.0 and summary["e.com"].pages == 0


def test_the_sitemap_tops_up_the_links(spark):
    home = '<p>Hello there, this is home.</p><a href="/about">About</a>'
    stored = stored_pages(spark, ("a.com", "https://a.com", "home", home, None, None), ("a.com", "https://a.com/pricing", None, "<p>Prices are low.</p>", None, None))
    sitemap = spark.createDataFrame([("a.com", 1, "/pricing"), ("z.com", 1, "/about")], "domain string, pos long, loc string")
    none = spark.createDataFrame([], "domain string, agent string, pos int, allow boolean, path string")
    done = stages.run_crawl(stages.Settings(as_of()), stored.select("domain"), stored, none, sitemap=sitemap)
    assert [p.url for p in done.first().pages] == ["https://a.com", "https://a.com/pricing"]


def test_a_document_gives_the_addresses_within_the_budget(spark):
    read = spark.createDataFrame(
        [("a.com", 1, "https://a.com", "home", "0123456789", ["h@a.com"], None), ("a.com", 2, "https://a.com/x.pdf", "about", "in@a.com and out@a.com", ["in@a.com", "out@a.com"], "pdf")],
        "domain string, visit_pos int, url string, page_type string, text string, emails array<string>, source_type string")
    rest = read.selectExpr("*", "true as allowed", "false as blocked", "true as fetched", "cast(array() as array<struct<name:string,title:string>>) as people")
    assert pages.crawl_results(rest, as_of(), budget=20).first().emails == ["h@a.com", "in@a.com"]


def test_robots_keys_follow_rule_lengths(spark):
    site = spark.createDataFrame([("a.com", f"https://a.com/{'x' * n}") for n in range(200)], "domain string, url string")
    listed = [("a.com", "*", i, i % 2 == 0, path) for i, path in enumerate(["/xx", "/xxxx", "/yyyy", "", "/"])]
    found = spark.createDataFrame(listed, "domain string, agent string, pos int, allow boolean, path string")
    keys = pages.rule_keys(site, found, "bot")
    assert keys.count() <= 200 * 4 and keys.groupBy("__u").count().agg(F.max("count")).first()[0] == 4
    verdicts = {r.url: r.allowed for r in pages.robots_verdicts(site, found, "bot").collect()}
    for url, allowed in verdicts.items():
        path = url.removeprefix("https://a.com")
        first = next((allow or not rule for _, _, _, allow, rule in listed if path.startswith(rule)), True)
        assert allowed == first


def test_one_row_group_is_spread_over_all_tasks(spark, tmp_path):
    """A file of one row group has many splits, of which one has all the rows."""
    spark.range(64).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 50).alias("text")).coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "t"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= 8
        held = spread(df).groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= 8 and max(r["count"] for r in held) <= 16
        assert sorted(r.id for r in spread(df).collect()) == list(range(64))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_domains_are_worked_out_once(spark):
    leads = spark.createDataFrame([(0, "a.com"), (1, None), (2, "https://www.a.com/x"), (3, "b.com")], "pos long, website string")
    keyed = hygiene.with_domain(leads, "website").where(F.col("domain") != "")
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("[^/?#]*@") == 1
    assert sorted(tuple(r) for r in keyed.collect()) == [(0, "a.com", "a.com"), (2, "https://www.a.com/x", "a.com"), (3, "b.com", "b.com")]
    tagged = hygiene.tag_leads(leads, "website", dns(spark, []), suppression(spark))
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("[^/?#]*@") == 2


def test_prose_is_searched_once(spark):
    site = spark.createDataFrame([("a.com", 1, "about", "Jane Diaz, Founder of A. CEO: Adam Stone."), ("a.com", 2, "about", "nothing"), ("b.com", 3, "home", None)], "domain string, pos long, page_type string, text string")
    spoken = people.prose_people(site)
    assert spoken._jdf.queryExecution().optimizedPlan().toString().count("(?iu)founder") == 1
    assert [(r.domain, r.pos, r.place, r.name) for r in spoken.orderBy("place").collect()] == [("a.com", 1, 0, "Jane Diaz"), ("a.com", 1, 1, "Adam Stone")]
    listed = spark.createDataFrame([], "domain string, pos long, name string, title string")
    filed = spark.createDataFrame([("a.com", 1, "No One", "Director"), ("b.com", 2, "Ruth Levi", "Director")], "domain string, pos long, name string, title string")
    named = people.named_people(listed, spoken, filed)
    assert "(?iu)founder" not in named._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.domain, r.name) for r in named.collect()) == [("a.com", "Adam Stone"), ("a.com", "Jane Diaz"), ("b.com", "Ruth Levi")]


def test_files_of_verdicts_judge_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    once = F.udf(look, "string")
    rows = spark.createDataFrame([(i, f"{i}.com", "pass" if i % 2 else "fail_judge") for i in range(10)], "pos long, domain string, verdict string")
    judged = rows.select("pos", F.lit("a@b.c").alias("to_email"), "domain", F.lit(1).alias("step"), F.lit("s").alias("subject"), once("verdict").alias("verdict"),
                         F.array(F.lit("v")).alias("violations"), F.struct(F.lit(7.0).alias("overall")).alias("scores"), F.lit(False).alias("needs_human_review"))
    writers.write_gate(judged, str(tmp_path / "passed"), str(tmp_path / "review"), ["pos", "domain"])
    assert seen.value == 10
    assert spark.read.json(str(tmp_path / "passed")).count() == readers.read_csv(spark, str(tmp_path / "review")).count() == 5
    before = seen.value
    tagged = rows.select("pos", "domain", F.col("domain").alias("website"), F.nullif(once("verdict"), F.lit("pass")).alias("drop_reason"))
    writers.write_hygiene(tagged, "website", str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert seen.value - before == 10
    assert readers.read_csv(spark, str(tmp_path / "kept")).count() == readers.read_csv(spark, str(tmp_path / "dropped")).count() == 5


def test_rule_prefix_query_judges_every_page(spark):
    """jn_19 joins the keys with the rules and gives every page its verdict, also pages that share a URL or meet no rule."""
    tables = {
        "v_site_pages": spark.createDataFrame(
            [(i, d, f"https://{d}{p}") for i, (d, p) in enumerate([("a.com", "/en/1"), ("a.com", "/en/1"), ("a.com", "/en/2"), ("a.com", "/x"), ("b.com", "/en"), ("c.com", "")])],
            "pos long, domain string, url string"),
        "v_robots": spark.createDataFrame(
            [("a.com", "*", 1, True, "/en/1"), ("a.com", "*", 2, False, "/en"), ("b.com", "*", 1, True, "/en"), ("b.com", "LeadBot", 1, False, "/")],
            "domain string, agent string, pos int, allow boolean, path string"),
    }
    found = load_all()["jn_19_rule_prefix"].run(tables.__getitem__)
    assert sorted(tuple(r) for r in found.collect()) == [(False, 2), (True, 4)]


def test_text_is_extracted_once(spark):
    """The plan that writes the pages holds the text's last step once, and the budget reads what was written."""
    visited = spark.createDataFrame(
        [("a.com", "https://a.com", "home", 1, "<p>x</p>", True, True)], "domain string, url string, page_type string, visit_pos int, html string, allowed boolean, fetched boolean")
    read = pages.read_pages(visited)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("address|article") == 1
    spent = pages.apply_text_budget(read)._jdf.queryExecution().optimizedPlan().toString()
    assert "address|article" not in spent


# -------------------------------------------------------------- whole stages
def test_stages_end_to_end(spark):
    s = stages.Settings(as_of())
    leads = spark.createDataFrame([(0, "acme.com"), (1, "dead.com")], "pos long, website string")
    facts = dns(spark, [("acme.com", True, ["ns.x."])])
    kept, dropped = stages.run_hygiene(s, leads, facts, suppression(spark))
    assert [r.drop_reason for r in dropped.collect()] == ["no_mx"]
    page = ("<p>We run a pricing desk for shops of every size.</p><p>Jane Diaz, Founder of Acme.</p><p>John Smith, Head of Sales</p>"
            "<p>jane.diaz@acme.com</p>")
    stored = spark.createDataFrame([("acme.com", 0, "home", "https://acme.com", page, "text/html")], "domain string, pos long, page_type string, url string, html string, content_type string")
    robots = spark.createDataFrame([("acme.com", "*", 1, False, "/private")], "domain string, agent string, pos int, allow boolean, path string")
    crawled = stages.run_crawl(s, kept, stored, robots)
    assert crawled.first().status == "ok" and crawled.first().emails == ["jane.diaz@acme.com"]
    answer = '{"company_name": "Acme", "hooks": [{"hook": "pricing desk", "quote": "run a pricing desk", "source_url": "https://acme.com", "specificity": 8}, {"hook": "x", "quote": "made up", "source_url": "https://acme.com", "specificity": 9}]}'
    known = stages.run_analysis(s, crawled, spark.createDataFrame([("acme.com", answer, None)], "domain string, raw_text string, error string"))
    row = known.first()
    assert (row.status, row.signal_gate, row.quotes_dropped, len(row.hooks)) == ("ok", "ok", 1, 1)
    found = stages.run_contacts(s, crawled, facts, spark.createDataFrame([], "domain string, catch_all boolean"), spark.createDataFrame([], "email string, status string, note string"))
    assert [(c.email, c.source, c.confidence) for c in found.first().contacts] == [("jane.diaz@acme.com", "scraped", "medium"), ("john.smith@acme.com", "pattern_derived", "medium")]
    draft = '[{"step": 1, "subject": "idea", "body": "Saw your pricing desk."}, {"step": 2, "subject": "idea", "body": "more"}]'
    targets, queue = stages.run_drafts(s, found, known, spark.createDataFrame([("acme.com", 1, draft)], "domain string, attempt int, raw_text string"))
    numbered = queue.withColumn("pos", F.col("place").cast("long"))
    scores = spark.createDataFrame([(0, '{"grounding": 9, "overall": 8}', None), (1, '{"grounding": 9, "overall": 8}', None)], "pos long, raw_text string, error string")
    judged = stages.run_gate(s, numbered, known, scores)
    passed = gate.passed_items(judged)
    assert passed.count() == 2
    boxes = spark.createDataFrame([("a", "a@x.io", None, None, None, 5, 0)], "name string, smtp_user string, reply_to string, from_name string, warmup_start_date date, daily_cap_override int, pos int")
    plan = stages.run_send_plan(s, passed.select("pos", "to_email", "subject", "body", "step"), spark.createDataFrame([], schemas.LEADS), suppression(spark), boxes,
                                spark.createDataFrame([], "mailbox string, count long"))
    assert [r.decision for r in plan.orderBy("pos").collect()] == ["sent", "sent"]


# ----------------------------------------------------------------- artefacts
def test_artefacts_by_domain_and_by_bucket(spark, tmp_path):
    """A folder per domain, whose name decides, and buckets of lines read alike."""
    for domain in ("a.com", "domain=b.com"):
        (tmp_path / "one" / domain).mkdir(parents=True)
        (tmp_path / "one" / domain / "crawl_result.json").write_text('{"domain": "other",\n "status": "ok",\n "emails": ["x@y.z"]}')
    by_domain = readers.read_crawl_results(spark, str(tmp_path / "one"))
    assert sorted((r.domain, r.status, r.emails) for r in by_domain.collect()) == [("a.com", "ok", ["x@y.z"]), ("b.com", "ok", ["x@y.z"])]
    rows = spark.createDataFrame([(f"{i}.com", "ok", [f"m@{i}.com"]) for i in range(50)], "domain string, status string, emails array<string>")
    writers.write_json_artefacts(rows, str(tmp_path / "many"), buckets=4)
    back = readers.read_crawl_results(spark, str(tmp_path / "many"), bucketed=True)
    assert sorted((r.domain, r.emails) for r in back.collect()) == sorted((f"{i}.com", [f"m@{i}.com"]) for i in range(50))
