"""Campaign reports, sentiment, variants and few-shot examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import prompts as P
from leadloom.functions import responses as R
from leadloom.functions import schedule as S
from leadloom.functions.text import strip
from leadloom.operators import feedback as B
from leadloom.operators import reports as RP
from leadloom.operators import state
from leadloom.operators.ordering import first_k
from leadloom.plans.catalog import Inputs, query
from leadloom.plans.inputs import AS_OF
from leadloom.plans.q_quality import facts_table



def now():
    return F.lit(AS_OF).cast("timestamp")

VARIANT = "lower(trim(regexp_replace(trim(subject), '^(re:\\s*)+', '', 'i')))"
TIME = "yyyy-MM-dd HH:mm:ss"


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round(CAST({part} AS DOUBLE) / {whole}, 4) END"


def log_and_leads(t: Inputs):
    return t("v_send_log"), t("v_leads")


@query("fb_01_variant_key", f"SELECT id, {VARIANT} AS variant FROM <<v_send_log>>")
def fb_01(t):
    return t("v_send_log").select("id", S.variant_key("subject").alias("variant"))


@query("fb_03_reply_text", "SELECT id, trim(body, concat(' ', chr(9), chr(10), chr(13))) AS body_text FROM (SELECT id, concat('  ', body_text, chr(10), ' ') AS body FROM <<v_replies>>) r")
def fb_03(t):
    raw = t("v_replies").select("id", F.concat(F.lit("  "), "body_text", F.lit("\n ")).alias("body"))
    return raw.select("id", strip(F.col("body")).alias("body_text"))


@query("ag_09_campaign_summary", f"""
    SELECT total_leads, total_sent, total_failed, replied, bounced, unsubscribed,
           {rate('replied', 'total_sent')} AS reply_rate, {rate('bounced', 'total_sent')} AS bounce_rate
    FROM (SELECT count(*) AS total_leads, count(*) FILTER (WHERE status = 'replied') AS replied,
                 count(*) FILTER (WHERE status = 'bounced') AS bounced, count(*) FILTER (WHERE status = 'unsubscribed') AS unsubscribed FROM <<v_leads>>) l,
         (SELECT count(*) FILTER (WHERE status = 'sent') AS total_sent, count(*) FILTER (WHERE status = 'failed') AS total_failed FROM <<v_send_log>>) s""")
def ag_09(t):
    log, leads = log_and_leads(t)
    return RP.campaign_summary(leads, log)


@query("ag_09_status_breakdown", "SELECT status, count(*) AS leads FROM <<v_leads>> GROUP BY status")
def ag_09_status(t):
    return RP.status_breakdown(t("v_leads"))


@query("ag_10_mailbox_breakdown", """
    SELECT mailbox, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed FROM <<v_send_log>> GROUP BY mailbox""")
def ag_10(t):
    return RP.mailbox_breakdown(t("v_send_log"))


@query("ag_11_daily_volume", """
    SELECT CAST(day AS VARCHAR) AS day, total FROM (
        SELECT CAST(sent_at AS DATE) AS day, count(*) AS total FROM <<v_send_log>> WHERE status = 'sent' GROUP BY 1 ORDER BY 1 DESC LIMIT 14) d""")
def ag_11(t):
    counts = state.mailbox_day_counts(t("v_send_log"))
    return RP.daily_volume(counts).select(F.col("day").cast("string").alias("day"), "total")


@query("ag_18_mailbox_day_counts", "SELECT mailbox, CAST(CAST(sent_at AS DATE) AS VARCHAR) AS day, count(*) AS count FROM <<v_send_log>> WHERE status = 'sent' GROUP BY 1, 2")
def ag_18(t):
    return state.mailbox_day_counts(t("v_send_log")).withColumn("day", F.col("day").cast("string"))


METRICS = f"""
    o_sent AS (SELECT email, {VARIANT} AS variant FROM <<v_send_log>> WHERE step = 1 AND status = 'sent'),
    o_cohort AS (SELECT variant, count(*) AS sent, count(*) FILTER (WHERE l.status = 'bounced') AS bounced, count(*) FILTER (WHERE l.status = 'replied') AS replied
                 FROM o_sent s LEFT JOIN <<v_leads>> l ON l.email = s.email GROUP BY variant),
    o_first AS (SELECT email, {VARIANT} AS variant FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM <<v_send_log>> WHERE step = 1) f WHERE rn = 1),
    o_positive AS (SELECT f.variant, count(*) AS positive FROM <<v_replies>> r JOIN o_first f ON f.email = r.email WHERE r.sentiment = 'positive' GROUP BY 1),
    o_metrics AS (SELECT c.variant, sent, bounced, replied, coalesce(positive, 0) AS positive, {rate('bounced', 'sent')} AS bounce_rate,
                         {rate('replied', 'sent')} AS reply_rate, {rate('coalesce(positive, 0)', 'sent')} AS positive_rate, sent >= 200 AS sufficient_sample
                  FROM o_cohort c LEFT JOIN o_positive p ON p.variant = c.variant)
"""


def metrics(t: Inputs):
    log, leads = log_and_leads(t)
    return B.variant_metrics(log, leads, t("v_replies"))


@query("ag_16_variant_metrics", f"WITH {METRICS} SELECT * FROM o_metrics")
def ag_16(t):
    return metrics(t)


@query("jn_16_sends_with_status", """
    SELECT s.id, s.email, coalesce(l.status, '-') AS lead_status FROM <<v_send_log>> s LEFT JOIN <<v_leads>> l ON l.email = s.email
    WHERE s.step = 1 AND s.status = 'sent'""")
def jn_16(t):
    status = t("v_leads").select(F.col("email").alias("__e"), F.col("status").alias("lead_status"))
    return B.opening_sends(t("v_send_log")).join(status, F.col("email") == F.col("__e"), "left").select(
        "id", "email", F.coalesce("lead_status", F.lit("-")).alias("lead_status")
    )


@query("fb_02_health_warnings", f"""
    WITH {METRICS}
    SELECT variant, CASE WHEN NOT sufficient_sample THEN concat('only ', sent, ' sent of the 200 that rates need to be reliable')
        ELSE array_to_string(list_filter([
            CASE WHEN bounce_rate > 0.02 THEN concat('bounce rate ', printf('%.1f%%', bounce_rate * 100), ' is over 2.0%: pause this variant, then look at the list and the mailboxes') END,
            CASE WHEN reply_rate < 0.05 THEN concat('reply rate ', printf('%.1f%%', reply_rate * 100), ' is under 5.0%') END,
            CASE WHEN positive_rate < 0.01 THEN concat('rate of positive replies ', printf('%.1f%%', positive_rate * 100), ' is under 1.0%') END
        ], lambda w : w IS NOT NULL), '; ') END AS warnings FROM o_metrics""")
def fb_02(t):
    return B.health_warnings(metrics(t)).select("variant", F.array_join("warnings", "; ").alias("warnings"))


ANALYSES = """
    o_facts AS (SELECT domain, concat('Co ', domain) AS company_name,
                       CASE WHEN claims IN (1, 2) THEN hook_quote ELSE '' END AS grounding, CASE WHEN claims IN (1, 2) THEN 1 ELSE 0 END AS hooks FROM <<v_facts>>)
"""


def known_analyses(t: Inputs):
    return facts_table(t).withColumn("company_name", F.concat(F.lit("Co "), "domain"))


FEW = f"""
    {ANALYSES},
    o_start AS (SELECT email, subject FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM <<v_send_log>> WHERE step = 1 AND status = 'sent') f WHERE rn = 1),
    o_examples AS (
        SELECT r.id, r.received_at, l.domain, a.company_name, {VARIANT.replace('subject', 's.subject')} AS subject, a.grounding, r.body_text AS reply_text
        FROM <<v_replies>> r JOIN <<v_leads>> l ON l.email = r.email JOIN o_start s ON s.email = r.email JOIN o_facts a ON a.domain = l.domain
        WHERE r.sentiment = 'positive' ORDER BY r.received_at DESC, r.id DESC LIMIT 5)
"""


def examples(t: Inputs, limit: int = 5):
    log, leads = log_and_leads(t)
    return B.few_shot_examples(t("v_replies"), leads, log, known_analyses(t), limit)


@query("jn_17_few_shot", f"WITH {FEW} SELECT domain, company_name, subject, grounding, reply_text FROM o_examples")
def jn_17(t):
    return examples(t)


@query("an_15_few_shot_block", f"""
    WITH {FEW} SELECT concat('Emails that got a positive reply (style only, no facts from them):', chr(10),
        string_agg(concat(chr(10), '- For: ', company_name, chr(10), '  Built on: ', grounding, chr(10), '  Subject line: "', subject, '"', chr(10),
                          '  Answer: "', substr(reply_text, 1, 150), '"'), chr(10) ORDER BY received_at DESC, id DESC)) AS block FROM o_examples""")
def an_15(t):
    return examples(t).agg(
        P.few_shot_block(F.collect_list(F.struct("domain", "company_name", "subject", "grounding", "reply_text"))).alias("block")
    )


@query("sl_03_newest_positives", "SELECT id, rn FROM (SELECT id, row_number() OVER (ORDER BY received_at DESC, id DESC) AS rn FROM <<v_replies>> WHERE sentiment = 'positive') r WHERE rn <= 5")
def sl_03(t):
    top = B.by_sentiment(t("v_replies")).limit(5).withColumn("all", F.lit(1))
    return first_k(top, ["all"], [F.desc("received_at"), F.desc("id")], 5, "rn").select("id", "rn")


@query("sl_04_oldest_unclassified", "SELECT id, email FROM <<v_replies>> WHERE sentiment IS NULL")
def sl_04(t):
    return B.unclassified(t("v_replies")).select("id", "email")


CLEAN = r"regexp_replace(regexp_replace(trim(raw_text, concat(' ', chr(10))), '^```(json)?\s*', ''), '\s*```$', '')"
SENTIMENTS = f"""
    o_read AS (SELECT id, problem, CASE WHEN problem IS NULL THEN coalesce(json_extract_string(j, '$.sentiment'), 'neutral') END AS sentiment,
                      CASE WHEN problem IS NULL THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence
               FROM (SELECT id, CASE WHEN json_valid(body) THEN body END AS j, CASE WHEN error IS NOT NULL THEN error WHEN NOT json_valid(body) THEN 'invalid JSON' END AS problem
                     FROM (SELECT id, error, {CLEAN} AS body FROM <<v_reply_answers>>) a) b)
"""


def stored_replies(t: Inputs):
    nothing = F.lit(None)
    return t("v_replies").withColumn("sentiment_confidence", nothing.cast("double")).withColumn(
        "classified_at", nothing.cast("timestamp")
    )


@query("an_14_read_sentiment", f"WITH {SENTIMENTS} SELECT id, coalesce(sentiment, '-') AS sentiment, coalesce(confidence, -1) AS confidence, coalesce(problem, '-') AS error FROM o_read")
def an_14(t):
    read = t("v_reply_answers").select("id", R.read_sentiment("raw_text", "error").alias("s"))
    return read.select(
        "id", F.coalesce("s.sentiment", F.lit("-")).alias("sentiment"), F.coalesce("s.confidence", F.lit(-1)).alias("confidence"),
        F.coalesce("s.error", F.lit("-")).alias("error"),
    )


@query("an_13_sentiment_prompt", f"""
    SELECT id, concat('{P.SENTIMENT_TEMPLATE.split('{reply_text}')[0]}', body_text, '{P.SENTIMENT_TEMPLATE.split('{reply_text}')[1]}') AS prompt FROM <<v_replies>>""")
def an_13(t):
    return t("v_replies").select("id", P.sentiment_prompt(F.col("body_text")).alias("prompt"))


@query("st_09_classify_replies", f"""
    WITH {SENTIMENTS}
    SELECT r.id, coalesce(CASE WHEN r.sentiment IS NULL AND a.problem IS NULL THEN a.sentiment ELSE r.sentiment END, '-') AS sentiment,
           r.sentiment IS NULL AND a.problem IS NULL AS newly
    FROM <<v_replies>> r JOIN o_read a ON a.id = r.id""")
def st_09(t):
    done = B.classify_replies(stored_replies(t), t("v_reply_answers"), now())
    return done.select("id", F.coalesce("sentiment", F.lit("-")).alias("sentiment"), F.col("classified_at").isNotNull().alias("newly"))


@query("ag_17_sentiment_summary", f"""
    WITH {SENTIMENTS} SELECT count(*) FILTER (WHERE a.problem IS NULL) AS classified, count(*) FILTER (WHERE a.problem IS NOT NULL) AS api_errors
    FROM <<v_replies>> r JOIN o_read a ON a.id = r.id WHERE r.sentiment IS NULL""")
def ag_17(t):
    return B.sentiment_summary(B.answer_pending(t("v_replies"), t("v_reply_answers")))


@query("ag_21_feedback_summary", f"""
    WITH {SENTIMENTS}, {FEW}
    SELECT (SELECT count(*) FROM <<v_replies>> r JOIN o_read a ON a.id = r.id WHERE r.sentiment IS NULL AND a.problem IS NULL) AS classified,
           (SELECT count(*) FROM o_examples) AS few_shot_exported""")
def ag_21(t):
    return B.feedback_stage_summary(B.answer_pending(t("v_replies"), t("v_reply_answers")), examples(t))
