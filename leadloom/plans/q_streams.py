"""Sources and sinks by round trip, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import contacts as C
from leadloom.operators import hygiene
from leadloom.operators import state as ST
from leadloom.plans import stages
from leadloom.plans.catalog import Inputs, query
from leadloom.plans.inputs import AS_OF
from leadloom.plans.q_analysis import counted, drafted, offer, QUEUE, ANALYSES, analyses
from leadloom.plans.q_contacts import GAPS, RESULTS, contact_lists, results
from leadloom.plans.q_hygiene import TAGGED_SQL, URL, tagged
from leadloom.plans.q_pages import CRAWL, crawl
from leadloom.plans.q_quality import VERDICTS, judged_queue
from leadloom.plans.q_reports import FEW, examples
from leadloom.plans.q_sending import FOLD, MATCHED, POLL, RETURN, SQL_NOW, messages, now, sql_time, text_time
from leadloom.session import new_work_path
from leadloom.sources import readers as RD
from leadloom.sources import writers as WR
from leadloom.streaming import inbound_stream as IS
from leadloom.streaming import send_stream as SS
from leadloom.streaming.keyed_table import KeyedTable
from leadloom import fixed_values as fixed
from leadloom import schemas


def path(t: Inputs, name: str) -> str:
    return new_work_path(t.spark, name)


def blank(c: str):
    return F.coalesce(c, F.lit("")).alias(c)


# ------------------------------------------------------------------- sources
@query("src_01_read_leads", """
    SELECT row_number() OVER (ORDER BY k) - 1 AS pos, website, company FROM (SELECT k, concat('a "q", ', name) AS company, trim(website) AS website FROM <<v_keys>> v JOIN <<v_leads_raw>> r ON r.pos = v.k) x""")
def src_01(t):
    out = path(t, "leads")
    rows = t("v_leads_raw").repartitionByRange(4, "pos").sortWithinPartitions("pos")
    marked = rows.select(F.trim("website").alias("﻿website"), F.concat(F.lit('a "q", '), "company").alias("company"))
    WR.write_csv(marked, out)
    return RD.read_leads(t.spark, out, URL).select("pos", blank("website"), "company")


@query("src_02_domain_list", "SELECT trim(website) AS domain, count(*) AS times FROM <<v_leads_raw>> WHERE trim(website) <> '' GROUP BY 1")
def src_02(t):
    return RD.domain_list(t("v_leads_raw"), URL).groupBy("domain").agg(F.count(F.lit(1)).alias("times"))


@query("src_03_domain_filter", "SELECT DISTINCT trim(website) AS domain FROM <<v_leads_raw>> WHERE trim(website) <> ''")
def src_03(t):
    return RD.domain_filter(t("v_leads_raw"), URL)


@query("jn_04_only_domains", "SELECT k, domain FROM <<v_keys>> WHERE domain IN (SELECT value FROM <<v_suppression>> WHERE scope = 'domain')")
def jn_04(t):
    wanted = t("v_suppression").where(F.col("scope") == "domain").select(F.concat(F.lit(" "), "value").alias("column"))
    return RD.only_domains(t("v_keys").select("k", "domain"), RD.domain_filter(wanted, "column"))


@query("src_04_crawl_artefacts", f"WITH {CRAWL} SELECT domain, status, CASE WHEN usable THEN pages ELSE 0 END AS pages FROM o_crawl")
def src_04(t):
    out = path(t, "artefacts")
    WR.write_json_artefacts(crawl(t), out, buckets=8)
    back = RD.read_crawl_results(t.spark, out, bucketed=True)
    return back.select("domain", "status", F.size("pages").cast("long").alias("pages"))


@query("src_05_contacts_artefacts", f"WITH {RESULTS} SELECT domain, status, contacts_found, best_email FROM o_results")
def src_05(t):
    out = path(t, "contacts")
    WR.write_json_artefacts(results(t), out, buckets=8)
    back = C.contacts_summary(RD.read_contacts_results(t.spark, out, bucketed=True))
    return back.select("domain", "status", F.col("contacts_found").cast("long").alias("contacts_found"), "best_email")


@query("src_06_analysis_artefacts", f"WITH {ANALYSES} SELECT domain, status, hooks FROM o_final")
def src_06(t):
    out = path(t, "analyses")
    WR.write_json_artefacts(analyses(t), out, buckets=8)
    back = RD.read_analyses(t.spark, out, bucketed=True)
    return back.select("domain", "status", F.when(F.col("hooks").isNull(), -1).otherwise(F.size("hooks")).alias("hooks"))


@query("src_07_read_queue", "SELECT to_email, subject, body, step FROM <<v_queue>>")
def src_07(t):
    out = path(t, "queue")
    WR.write_queue(t("v_queue").drop("pos"), out)
    return RD.read_queue(t.spark, out).select("to_email", "subject", "body", "step")


@query("src_08_read_mailboxes", """
    SELECT name, CASE WHEN reply_to = '' THEN smtp_user ELSE reply_to END AS reply_to, from_name, strftime(warmup_start_date, '%Y-%m-%d') AS start, coalesce(daily_cap_override, -1) AS override FROM <<v_mailboxes>>""")
def src_08(t):
    out = path(t, "mailboxes")
    WR.write_json(t("v_mailboxes").drop("pos"), out)
    rows = RD.read_mailboxes(t.spark, out, multi_line=False)
    return rows.select(
        "name", "reply_to", "from_name", F.col("warmup_start_date").cast("string").alias("start"),
        F.coalesce("daily_cap_override", F.lit(-1)).alias("override"),
    )


@query("src_10_read_few_shot", f"WITH {FEW} SELECT domain, company_name, subject, grounding, reply_text FROM o_examples")
def src_10(t):
    out = path(t, "few-shot")
    WR.write_few_shot(examples(t), out)
    return RD.read_few_shot(t.spark, out)


@query("src_11_read_filled_gaps", "SELECT trim(domain) AS domain, trim(found_email) AS found_email, found_name, notes FROM <<v_filled>>")
def src_11(t):
    out = path(t, "filled")
    WR.write_csv(t("v_filled").drop("pos"), out)
    rows = RD.read_filled_gaps(t.spark, out)
    return rows.select(F.trim(F.coalesce("domain", F.lit(""))).alias("domain"), F.trim(F.coalesce("found_email", F.lit(""))).alias("found_email"), blank("found_name"), "notes")


@query("src_12_read_state_table", "SELECT email, status, sequence_step, true AS no_meeting FROM <<v_leads>>")
def src_12(t):
    folder = path(t, "state")
    WR.write_table(t("v_leads").drop("meeting_booked_at"), f"{folder}/leads")
    return RD.read_table(t.spark, folder, "leads").select(
        "email", "status", "sequence_step", F.col("meeting_booked_at").isNull().alias("no_meeting")
    )


@query("src_13_read_pages", "SELECT domain, page_type, count(*) AS pages FROM <<v_site_pages>> GROUP BY 1, 2")
def src_13(t):
    out = path(t, "pages")
    WR.write_table(t("v_site_pages"), out)
    return RD.read_pages(t.spark, out).groupBy("domain", "page_type").agg(F.count(F.lit(1)).alias("pages"))


def raw_parts(t: Inputs):
    def part(ctype, name, text):
        return F.struct(F.lit(ctype).alias("ctype"), F.lit(name).cast("string").alias("filename"), text.alias("text"))

    alone = F.array(part("text/html", None, F.col("body")))
    several = F.array(
        part("text/html", None, F.lit("<p>x</p>")), part("text/plain", "a.txt", F.lit("attached")),
        part("text/plain", None, F.col("body")), part("message/delivery-status", None, F.col("dsn")),
    )
    many = F.substring("uid", -1, 1) < "5"
    return messages(t).drop("full_text").withColumn("is_multipart", many).withColumn("parts", F.when(many, several).otherwise(alone)).drop("body")


@query("src_15_plain_body", "SELECT uid, body FROM <<v_inbound>>")
def src_15(t):
    return RD.messages_from_parts(raw_parts(t)).select("uid", "body")


@query("src_16_full_text", """
    SELECT uid, CASE WHEN substr(uid, -1, 1) < '5' THEN concat('<p>x</p>', chr(10), 'attached', chr(10), body, CASE WHEN dsn <> '' THEN concat(chr(10), dsn) ELSE '' END) ELSE body END AS full_text FROM <<v_inbound>>""")
def src_16(t):
    return RD.messages_from_parts(raw_parts(t)).select("uid", "full_text")


# --------------------------------------------------------------------- sinks
@query("snk_01_hygiene_files", f"""
    WITH {TAGGED_SQL}
    SELECT coalesce(drop_reason, 'kept') AS fate, count(*) AS leads, count(DISTINCT domain) AS domains FROM o_tagged WHERE coalesce(drop_reason, '') NOT IN ('duplicate', 'invalid_url') GROUP BY 1""")
def snk_01(t):
    kept, dropped = path(t, "kept"), path(t, "dropped")
    WR.write_hygiene(tagged(t), URL, kept, dropped)
    good = RD.read_csv(t.spark, kept).select("domain", F.lit("kept").alias("fate"))
    bad = RD.read_csv(t.spark, dropped).select("domain", F.col("drop_reason").alias("fate")).where(F.col("fate") != "invalid_url")
    return good.unionByName(bad).groupBy("fate").agg(F.count(F.lit(1)).alias("leads"), F.countDistinct("domain").alias("domains"))


@query("snk_02_run_summary", f"WITH {CRAWL} SELECT domain, status, CAST(CASE WHEN usable THEN pages ELSE 0 END AS VARCHAR) AS pages FROM o_crawl")
def snk_02(t):
    out = path(t, "run-summary")
    WR.write_run_summary(crawl(t), out)
    return RD.read_csv(t.spark, out).select("domain", "status", "pages")


@query("snk_03_contacts_summary", f"WITH {RESULTS} SELECT domain, status, CAST(contacts_found AS VARCHAR) AS contacts_found, best_email, best_confidence FROM o_results")
def snk_03(t):
    out = path(t, "contacts-summary")
    WR.write_contacts_summary(results(t), out)
    return RD.read_csv(t.spark, out).select("domain", "status", "contacts_found", blank("best_email"), blank("best_confidence"))


@query("snk_04_artefacts", f"WITH {ANALYSES} SELECT domain, status, quotes_dropped FROM o_final")
def snk_04(t):
    out = path(t, "bucketed")
    WR.write_artefacts(analyses(t), out)
    return t.spark.read.parquet(out).select("domain", "status", F.coalesce("quotes_dropped", F.lit(-1)).alias("quotes_dropped"))


@query("snk_05_draft_queue", f"WITH {QUEUE} SELECT to_email, step, subject, body FROM o_queue")
def snk_05(t):
    out = path(t, "drafts")
    WR.write_queue(drafted(t).drop("place"), out)
    return RD.read_queue(t.spark, out).select("to_email", "step", "subject", "body")


@query("snk_06_gate_files", f"WITH {VERDICTS} SELECT verdict, count(*) AS items FROM o_verdicts GROUP BY verdict")
def snk_06(t):
    passed, review = path(t, "passed"), path(t, "review")
    WR.write_gate(judged_queue(t), passed, review, ["pos", "to_email", "subject", "body", "step", "domain"])
    good = t.spark.read.json(passed).select(F.lit("pass").alias("verdict"))
    bad = RD.read_csv(t.spark, review).select("verdict").where(F.col("verdict") != "pass")
    return good.unionByName(bad).groupBy("verdict").agg(F.count(F.lit(1)).alias("items"))


@query("snk_07_gaps_file", f"WITH {GAPS} SELECT domain, gap_reason, coalesce(email, '') AS existing_best_email FROM o_gaps WHERE gap_reason IS NOT NULL")
def snk_07(t):
    out = path(t, "gaps")
    WR.write_gaps(contact_lists(t), out)
    return RD.read_csv(t.spark, out).select("domain", "gap_reason", blank("existing_best_email"))


@query("snk_08_few_shot_file", f"WITH {FEW} SELECT subject, count(*) AS examples FROM o_examples GROUP BY subject")
def snk_08(t):
    out = path(t, "few-shot")
    WR.write_few_shot(examples(t), out)
    return t.spark.read.schema(schemas.FEW_SHOT).json(out).groupBy("subject").agg(F.count(F.lit(1)).alias("examples"))


# ------------------------------------------------------------------- streams
def as_stream(t: Inputs, rows, name: str):
    """Write rows as the files of a source and read them as a stream."""
    out = path(t, name)
    rows.write.parquet(out)
    return t.spark.readStream.schema(rows.schema).parquet(out)


def run(start, *args):
    handle = start(*args)
    handle.awaitTermination()


#: Mail comes in three runs.  Some of it cannot be fetched at first; half of that comes again, whole, in the last run.
#: The last run has the oldest mail too, and all of the first run once more.
RUNS = f"""
    {MATCHED},
    o_runs AS (SELECT *, subject = 'Automatic reply: hello' AS fails, CAST(uid AS BIGINT) % 2 = 0 AS comes_again, 1 + CAST(uid AS BIGINT) % 3 AS run FROM o_outcome),
    o_done AS (SELECT *, CASE WHEN fails THEN 3 ELSE run END AS done_run,
                      CASE classification WHEN 'bounce_hard' THEN 'bounced' WHEN 'unsubscribe' THEN 'unsubscribed' WHEN 'reply' THEN 'replied' ELSE 'rescheduled' END AS event,
                      CASE classification WHEN 'bounce_soft' THEN {SQL_NOW} + INTERVAL 2 DAY WHEN 'ooo' THEN coalesce({RETURN}, {SQL_NOW} + INTERVAL 7 DAY) END AS resume_at
               FROM o_runs WHERE NOT fails OR comes_again)
"""


def mail_runs(t: Inputs):
    """The rows that come in each run."""
    number = F.col("uid").cast("long")
    fails = F.col("subject") == "Automatic reply: hello"
    rows = messages(t)
    broken = [F.when(fails, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in ("from_addr", "subject", "body")]
    kept = [c for c in rows.columns if c not in ("from_addr", "subject", "body")]
    first = rows.select(*kept, *broken, F.when(fails, F.lit("timeout")).alias("fetch_error")).withColumn("run", 1 + number % 3)
    again = rows.where(fails & (number % 2 == 0)).withColumn("fetch_error", F.lit(None).cast("string")).withColumn("run", F.lit(3).cast("long"))
    repeated = first.where("run = 1").withColumn("run", F.lit(3).cast("long"))
    return first.unionByName(again).unionByName(repeated)


def polled(t: Inputs, days: int = 30):
    """The tables after three runs over one growing folder of mail."""
    out, rows = path(t, "poll"), mail_runs(t)
    tables = IS.inbound_tables(t.spark, f"{out}/tables", rows.drop("run").schema, t("v_leads").schema, fold_every=2)
    tables.load(t("v_leads"), t("v_suppression"))
    for number in (1, 2, 3):
        rows.where(F.col("run") == number).drop("run").write.mode("append").parquet(f"{out}/inbox")
        run(IS.start_poll, t.spark.readStream.schema(rows.drop("run").schema).parquet(f"{out}/inbox"), tables, now(), f"{out}/checkpoint", days)
    return tables


@query("st_01_poll_stream", f"WITH {RUNS} SELECT uid, classification FROM o_done")
def st_01_stream(t):
    return polled(t).done.read().select("uid", "classification")


@query("st_12_dead_letters", f"WITH {RUNS} SELECT uid, 'timeout' AS error FROM o_runs WHERE fails AND NOT comes_again")
def st_12(t):
    return polled(t).pending.read().select("uid", "error")


@query("jn_15_marks_of_runs", f"WITH {RUNS} SELECT uid, classification, {sql_time('received_at')} AS received_at FROM o_done")
def jn_15_runs(t):
    return polled(t).marks.read().select("uid", "classification", text_time("received_at").alias("received_at"))


@query("st_12_rows_of_runs", f"""
    WITH {RUNS}
    SELECT fate, CAST(sum(n) AS BIGINT) AS rows FROM (
        SELECT 'failed' AS fate, CASE WHEN comes_again THEN 3 - run ELSE 4 - run END AS n FROM o_runs WHERE fails
        UNION ALL SELECT 'repeat' AS fate, CASE WHEN run = 1 THEN 1 ELSE 0 END + CASE WHEN fails AND comes_again THEN 1 ELSE 0 END AS n FROM o_runs) x
    GROUP BY fate HAVING sum(n) > 0""")
def st_12_rows(t):
    """Rows that came to nothing, over all runs; pending rows count in each run that tries them."""
    return polled(t).skipped.read().groupBy("fate").agg(F.sum("rows").alias("rows"))


@query("inbound_lead_state", f"""
    WITH {RUNS}, o_last AS (
        SELECT lead_email, arg_max(event, row(done_run, received_at, uid)) FILTER (WHERE event <> 'rescheduled') AS status,
               arg_max(resume_at, row(done_run, received_at, uid)) FILTER (WHERE event = 'rescheduled') AS next_at
        FROM o_done WHERE lead_email IS NOT NULL GROUP BY lead_email)
    SELECT l.email, coalesce(o.status, l.status) AS status, l.sequence_step, {sql_time('coalesce(o.next_at, l.next_send_at)')} AS next_send_at
    FROM <<v_leads>> l LEFT JOIN o_last o ON o.lead_email = l.email""")
def inbound_lead_state(t):
    return polled(t).leads.read().select("email", "status", "sequence_step", text_time("next_send_at").alias("next_send_at"))


@query("inbound_suppression", f"""
    WITH {RUNS}, o_stops AS (
        SELECT lead_email AS value, 'email' AS scope, event AS reason, done_run, received_at, uid FROM o_done WHERE event IN ('bounced', 'unsubscribed')
        UNION ALL SELECT split_part(lead_email, '@', -1) AS value, 'domain' AS scope, '{fixed.DOMAIN_STOP_REASON}' AS reason, done_run, received_at, uid
        FROM o_done WHERE event = 'unsubscribed'),
    o_new AS (SELECT value, scope, arg_max(reason, row(done_run, received_at, uid)) AS reason FROM o_stops WHERE value IS NOT NULL GROUP BY value, scope)
    SELECT value, scope, reason FROM o_new
    UNION ALL SELECT value, scope, reason FROM <<v_suppression>> s WHERE NOT EXISTS (SELECT 1 FROM o_new n WHERE n.value = s.value AND n.scope = s.scope)""")
def inbound_suppression(t):
    return polled(t).suppression.read().select("value", "scope", "reason")


STAGE = f"""
    {MATCHED},
    o_fate AS (SELECT *, CASE WHEN received_at < CAST(CAST({SQL_NOW} AS DATE) - INTERVAL 10 DAY AS TIMESTAMP) THEN 'old'
                              WHEN uid IN (SELECT uid FROM <<v_processed>>) THEN 'repeat' ELSE 'done' END AS fate FROM o_outcome)
"""


def polled_once(t: Inputs):
    settings = stages.Settings(now())
    none = messages(t).limit(0)
    return stages.run_inbound(settings, messages(t), none, t("v_processed"), t("v_leads"), t("v_suppression"))


@query("inbound_stage_fates", f"WITH {STAGE} SELECT uid, CASE WHEN fate = 'done' THEN classification ELSE fate END AS fate FROM o_fate")
def inbound_stage_fates(t):
    found = polled_once(t)
    return found["done"].select("uid", F.col("classification").alias("fate")).unionByName(found["skipped"].select("uid", "fate"))


@query("inbound_stage_summary", f"""
    WITH {STAGE} SELECT {POLL}, count(*) FILTER (WHERE classification LIKE '%:unmatched') AS skipped_unknown_lead, CAST(0 AS BIGINT) AS errors
    FROM o_fate WHERE fate = 'done'""")
def inbound_stage_summary(t):
    return polled_once(t)["summary"]


@query("st_02_lead_state_stream", f"""
    WITH {FOLD}, o_emails AS (SELECT DISTINCT email FROM <<v_lead_events>>)
    SELECT e.email, coalesce(s.status, '-') AS status, coalesce(x.step, -1) AS step, {sql_time('n.next_at')} AS next_send_at
    FROM o_emails e LEFT JOIN o_status s ON s.email = e.email LEFT JOIN o_sent x ON x.email = e.email LEFT JOIN o_next n ON n.email = e.email""")
def st_02(t):
    out, events = path(t, "lead-state"), t("v_lead_events")
    table = KeyedTable(t.spark, f"{out}/table", ST.event_state(events).schema, ["email"])
    run(IS.start_event_state, as_stream(t, events, "lead-events"), table, f"{out}/checkpoint")
    return table.read().select(
        "email", F.coalesce("new_status", F.lit("-")).alias("status"), F.coalesce("new_step", F.lit(-1)).alias("step"),
        text_time("new_next").alias("next_send_at"),
    )


def in_batches(t: Inputs, rows, number, table, start, batches: int = 7):
    """Run a job once per batch of rows, all into one table that is folded on the way."""
    out = path(t, "batches")
    schema = rows.schema
    for n in range(batches):
        rows.where(F.pmod(number, F.lit(batches)) == n).write.mode("append").parquet(f"{out}/rows")
        run(start, t.spark.readStream.schema(schema).parquet(f"{out}/rows"), table, f"{out}/checkpoint")
    return table


@query("st_08_daily_counts_stream", "SELECT mailbox, CAST(CAST(sent_at AS DATE) AS VARCHAR) AS day, count(*) AS count FROM <<v_send_log>> WHERE status = 'sent' GROUP BY 1, 2")
def st_08(t):
    """Counters over seven runs, folded after every third."""
    sends = t("v_send_log")
    table = KeyedTable(t.spark, path(t, "daily-counts"), SS.daily_counts(sends).schema, ["mailbox", "day"], "add", fold_every=3)
    return in_batches(t, sends, F.col("id"), table, SS.start_daily_counts).read().withColumn("day", F.col("day").cast("string"))


def entries_twice(t: Inputs):
    """Every entry twice, the older one with another reason."""
    current = t("v_suppression")
    older = current.withColumn("reason", F.lit("older")).withColumn("suppressed_at", F.col("suppressed_at") - F.expr("INTERVAL 1 DAY"))
    return older.unionByName(current)


@query("snk_09_upsert_stream", "SELECT value, scope, reason FROM <<v_suppression>>")
def snk_09(t):
    rows = entries_twice(t)
    table = KeyedTable(t.spark, path(t, "upserts"), rows.schema, ["value", "scope"], "replace", "suppressed_at", fold_every=2)
    return in_batches(t, rows, F.dayofyear("suppressed_at"), table, IS.start_upserts, 1).read().select("value", "scope", "reason")


@query("snk_09_insert_stream", "SELECT value, scope, CASE WHEN scope = 'email' THEN 'older' ELSE reason END AS reason FROM <<v_suppression>>")
def snk_09_insert(t):
    """The first row of a key stays: for addresses the older one, for domains the one that is there before the stream starts."""
    rows = entries_twice(t)
    table = KeyedTable(t.spark, path(t, "inserts"), rows.schema, ["value", "scope"], "insert", "suppressed_at", fold_every=2)
    table.load(t("v_suppression").where("scope = 'domain'"))
    return in_batches(t, rows, F.length("value"), table, IS.start_upserts, 3).read().select("value", "scope", "reason")


@query("st_05_reply_stream", f"""
    WITH {RUNS} SELECT o.uid, o.lead_email AS email, l.sequence_step AS step FROM o_done o JOIN <<v_leads>> l ON l.email = o.lead_email
    WHERE o.classification = 'reply'""")
def st_05_stream(t):
    return polled(t).replies.read().select("uid", "email", "step")
