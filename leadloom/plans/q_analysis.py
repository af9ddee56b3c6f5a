"""Prompts, model answers, quote checks and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import prompts as P
from leadloom.functions import quality as Q
from leadloom.functions import responses as R
from leadloom.operators import analysis as AN
from leadloom.operators import drafting as D
from leadloom.operators import gate as G
from leadloom.plans.catalog import Inputs, query
from leadloom.plans.q_contacts import BEST, contact_lists
from leadloom.plans.q_quality import BANNED, LINKS, WORDS, facts_table, leak_list

PROMPT_CHARS = 60_000
# The limit of the query that tests the cut itself.
SMALL_PROMPT_CHARS = 20_000


def text(value: str) -> str:
    """A Python text as SQL: line breaks through chr(10)."""
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in value.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ", '')"


def filled(template: str, **slots: str) -> str:
    pieces, rest = [], template
    while rest:
        before, brace, rest = rest.partition("{")
        if before:
            pieces.append(text(before))
        if brace:
            name, _, rest = rest.partition("}")
            pieces.append(f"coalesce(CAST({slots[name]} AS VARCHAR), '')")
    return "concat(" + ", ".join(pieces) + ")"


def crawled(t: Inputs):
    """Crawl results without their pages, which stay in rows."""
    return t("v_site_status")


# ------------------------------------------------------------------- prompts
CHUNKS = f"""
    o_chunks AS (
        SELECT domain, pos, substr(chunk, 1, {PROMPT_CHARS} - CAST(spent AS BIGINT)) AS chunk FROM (
            SELECT domain, pos, chunk, coalesce(sum(length(chunk)) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
            FROM (SELECT domain, pos, concat(chr(10), '[URL: ', url, '] [page_type: ', page_type, ']', chr(10), text) AS chunk FROM <<v_crawl_pages>>) c) s WHERE spent < {PROMPT_CHARS})
"""
PROMPTS = f"""
    {CHUNKS},
    o_prompts AS (SELECT s.domain, {filled(P.EXTRACTION_TEMPLATE, pages_text='x.body', domain='s.domain')} AS prompt
                  FROM <<v_site_status>> s LEFT JOIN (SELECT domain, string_agg(chunk, chr(10) ORDER BY pos) AS body FROM o_chunks GROUP BY domain) x ON x.domain = s.domain WHERE s.status = 'ok')
"""


def prompts(t: Inputs):
    """Extraction prompts straight from page rows, so that a domain of any
    size is cut to its budget before it is gathered."""
    return AN.extraction_prompts_of(t("v_site_status"), t("v_crawl_pages"), PROMPT_CHARS)


@query("wn_15_prompt_budget", f"WITH {CHUNKS.replace(str(PROMPT_CHARS), str(SMALL_PROMPT_CHARS))} SELECT domain, pos, length(chunk) AS chars FROM o_chunks")
def wn_15(t):
    chunks = AN.prompt_chunks(t("v_crawl_pages"), SMALL_PROMPT_CHARS)
    return chunks.select("domain", "pos", F.length("chunk").cast("long").alias("chars"))


@query("an_01_extraction_prompts", f"WITH {PROMPTS} SELECT domain, prompt FROM o_prompts")
def an_01(t):
    return prompts(t)


@query("an_16_prompt_sizes", f"WITH {PROMPTS} SELECT domain, length(prompt) AS prompt_chars FROM o_prompts")
def an_16(t):
    return AN.prompt_sizes(prompts(t)).withColumn("prompt_chars", F.col("prompt_chars").cast("long"))


# ------------------------------------------------------------------- answers
_BODY = r"regexp_replace(regexp_replace(trim(raw_text, concat(' ', chr(10))), '^```(json)?\s*', ''), '\s*```$', '')"
READ = f"""
    o_read AS (SELECT domain, lead_pos, error, good, bad, url, specificity, disqualified, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body END AS j
               FROM (SELECT *, CASE WHEN starts_with({_BODY}, '{{') THEN {_BODY} ELSE concat('{{', {_BODY}) END AS body FROM <<v_extractions>>) e)
"""


@query("an_02_read_extraction", f"""
    WITH {READ} SELECT domain, NOT valid AS parse_error, coalesce(json_extract_string(j, '$.company_name'), '') AS company_name, coalesce(json_extract_string(j, '$.what_they_do'), '') AS what_they_do,
        coalesce(json_array_length(j, '$.services'), 0) AS services, coalesce(json_array_length(j, '$.hooks'), 0) AS hooks, coalesce(json_array_length(j, '$.disqualifiers'), 0) AS disqualifiers,
        coalesce(json_extract_string(j, '$.hooks[0].quote'), '') AS first_quote FROM o_read""")
def an_02(t):
    read = t("v_extractions").select("domain", R.read_extraction("raw_text").alias("x"))
    return read.select(
        "domain", "x.parse_error", "x.company_name", "x.what_they_do", F.size("x.services").cast("long").alias("services"),
        F.size("x.hooks").cast("long").alias("hooks"), F.size("x.disqualifiers").cast("long").alias("disqualifiers"),
        F.coalesce(F.get("x.hooks", F.lit(0))["quote"], F.lit("")).alias("first_quote"),
    )


def norm(c: str) -> str:
    return f"regexp_replace(lower(trim(replace(replace({c}, '’', ''''), '‘', ''''), concat(' ', chr(10), chr(9)))), '\\s+', ' ', 'g')"


@query("an_03_normalize_quote", f"SELECT pos, field, {norm('quote')} AS normalized FROM (SELECT pos, field, concat(' ’', quote, '‘ X', chr(10)) AS quote FROM <<v_claims>>) c")
def an_03(t):
    dressed = F.concat(F.lit(" ’"), "quote", F.lit("‘ X\n"))
    return t("v_claims").select("pos", "field", R.normalize_quote(dressed).alias("normalized"))


CHECKED = f"""
    o_sources AS (SELECT domain, url, text FROM (SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY pos) AS rn FROM <<v_crawl_pages>>) p WHERE rn = 1),
    o_checked AS (SELECT c.domain, c.pos, c.field, coalesce(c.quote <> '' AND c.source_url <> '' AND contains({norm('s.text')}, {norm('c.quote')}), false) AS verified
                  FROM <<v_claims>> c LEFT JOIN o_sources s ON s.domain = c.domain AND s.url = c.source_url)
"""


def checked(t: Inputs):
    return AN.check_quotes(t("v_claims"), t("v_crawl_pages"))


@query("an_04_check_quotes", f"WITH {CHECKED} SELECT domain, pos, field, verified FROM o_checked")
def an_04(t):
    return checked(t).select("domain", "pos", "field", "verified")


@query("jn_09_quote_pages", """
    SELECT c.domain, c.pos, c.field, s.url IS NOT NULL AS has_page FROM <<v_claims>> c
    LEFT JOIN (SELECT DISTINCT domain, url FROM <<v_crawl_pages>>) s ON s.domain = c.domain AND s.url = c.source_url""")
def jn_09(t):
    sources = AN.first_page_per_url(t("v_crawl_pages")).select(F.col("domain").alias("__d"), F.col("url").alias("__u"))
    joined = t("v_claims").join(sources, (F.col("domain") == F.col("__d")) & (F.col("source_url") == F.col("__u")), "left")
    return joined.select("domain", "pos", "field", F.col("__u").isNotNull().alias("has_page"))


@query("ag_08_quotes_dropped", f"WITH {CHECKED} SELECT domain, count(*) FILTER (WHERE NOT verified) AS dropped FROM o_checked GROUP BY domain")
def ag_08(t):
    return checked(t).groupBy("domain").agg(F.count_if(~F.col("verified")).alias("dropped"))


ANALYSES = f"""
    {READ},
    o_sources AS (SELECT domain, url, text FROM (SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY pos) AS rn FROM <<v_crawl_pages>>) p WHERE rn = 1),
    o_verify AS (SELECT r.*, contains({norm('s.text')}, {norm('good')}) AND good <> '' AS good_ok, contains({norm('s.text')}, {norm('bad')}) AND bad <> '' AS bad_ok
                 FROM o_read r JOIN o_sources s ON s.domain = r.domain AND s.url = r.url),
    o_analyses AS (
        SELECT s.domain, CASE WHEN s.status <> 'ok' THEN 'no_crawl_data' WHEN v.error IS NOT NULL OR v.domain IS NULL THEN 'api_error' WHEN NOT v.valid THEN 'parse_error' ELSE 'ok' END AS status,
               CAST(good_ok AS INT) + CAST(bad_ok AS INT) AS hooks, CAST(good_ok AS INT) AS pains, 4 - 2 * CAST(good_ok AS INT) - CAST(bad_ok AS INT) AS quotes_dropped,
               CASE WHEN disqualified THEN 'low_signal' WHEN (good_ok AND specificity >= 7) OR bad_ok THEN 'ok' ELSE 'low_signal' END AS gate
        FROM <<v_site_status>> s LEFT JOIN o_verify v ON v.domain = s.domain),
    o_final AS (SELECT domain, status, CASE WHEN status = 'ok' THEN hooks ELSE -1 END AS hooks, CASE WHEN status = 'ok' THEN pains ELSE -1 END AS pains,
                       CASE WHEN status = 'ok' THEN quotes_dropped ELSE -1 END AS quotes_dropped, CASE WHEN status = 'ok' THEN gate ELSE '-' END AS signal_gate FROM o_analyses)
"""


def analyses(t: Inputs):
    return AN.analyses_of(t("v_site_status"), t("v_crawl_pages"), t("v_extractions").select("domain", "raw_text", "error"))


def counted(t: Inputs):
    def size(c):
        return F.when(F.col(c).isNull(), -1).otherwise(F.size(c))

    return analyses(t).select(
        "domain", "status", size("hooks").alias("hooks"), size("pains").alias("pains"),
        F.coalesce("quotes_dropped", F.lit(-1)).alias("quotes_dropped"), F.coalesce("signal_gate", F.lit("-")).alias("signal_gate"),
    )


@query("an_05_clamp", f"WITH {ANALYSES} SELECT domain, hooks, pains, quotes_dropped FROM o_final")
def an_05(t):
    return counted(t).select("domain", "hooks", "pains", "quotes_dropped")


@query("an_06_signal_gate", f"WITH {ANALYSES} SELECT domain, signal_gate FROM o_final")
def an_06(t):
    return counted(t).select("domain", "signal_gate")


@query("an_07_analysis_status", f"WITH {ANALYSES} SELECT domain, status FROM o_final")
def an_07(t):
    return counted(t).select("domain", "status")


@query("ag_06_analysis_summary", f"""
    WITH {ANALYSES} SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'ok' AND signal_gate = 'low_signal') AS low_signal, count(*) FILTER (WHERE status = 'no_crawl_data') AS no_crawl_data,
        count(*) FILTER (WHERE status = 'api_error') AS api_error, count(*) FILTER (WHERE status = 'parse_error') AS parse_error FROM o_final""")
def ag_06(t):
    return AN.analysis_summary(analyses(t))


# -------------------------------------------------------------------- drafts
def lab_analyses(t: Inputs):
    """An analysis per contact domain, out of the facts of a lead domain."""
    flat = t("v_contact_domains").join(
        facts_table(t).join(t("v_dns").select(F.col("domain").alias("__d"), "n"), F.col("domain") == F.col("__d")).select("n", "hooks", "pains"),
        F.col("k") + 2 == F.col("n"), "left",
    )
    return flat.select(
        "domain", F.when(F.col("k") % 7 == 6, "api_error").otherwise("ok").alias("status"), F.lit("low_signal").alias("signal_gate"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("Co "), "k")).otherwise("").alias("company_name"), "hooks", "pains", "k",
    ).where(F.col("hooks").isNotNull())


LAB = f"""
    {BEST},
    o_lab AS (SELECT d.domain, d.k, CASE WHEN d.k % 7 = 6 THEN 'api_error' ELSE 'ok' END AS status, CASE WHEN d.k % 2 = 0 THEN concat('Co ', d.k) ELSE '' END AS company_name, f.*  EXCLUDE (domain, n)
              FROM <<v_contact_domains>> d JOIN <<v_facts>> f ON f.n = d.k + 2),
    o_targets AS (SELECT d.domain, b.email, b.matched_name, l.company_name, l.hook_quote, l.pain_quote, l.claims,
                         CASE WHEN d.status <> 'ok' OR b.email IS NULL THEN 'no_contact' WHEN coalesce(l.status, '') <> 'ok' THEN 'no_analysis' END AS skip_reason
                  FROM <<v_contact_domains>> d LEFT JOIN o_best b ON b.domain = d.domain LEFT JOIN o_lab l ON l.domain = d.domain)
"""


def targets(t: Inputs):
    return D.draft_targets(contact_lists(t), lab_analyses(t))


@query("jn_08_draft_targets", f"WITH {LAB} SELECT domain, coalesce(skip_reason, '-') AS skip_reason, CASE WHEN skip_reason IS NULL THEN email ELSE '-' END AS email FROM o_targets")
def jn_08(t):
    rows = targets(t)
    email = F.when(F.col("skip_reason").isNull(), F.col("contact.email")).otherwise("-")
    return rows.select("domain", F.coalesce("skip_reason", F.lit("-")).alias("skip_reason"), email.alias("email"))


def offer(t: Inputs):
    point = F.struct(F.lit("30% less waste").alias("claim"), F.concat(F.lit("over "), "nations").alias("detail"))
    style = F.struct(F.lit("hello").alias("subject"), F.lit("short").alias("body"))
    return t("v_offer").select(
        "your_company_name", "sender_name", "what_you_sell", "icp_description", "cta_style",
        F.array(point).alias("proof_points"), F.array(style).alias("example_emails"),
    )


GROUNDS = """coalesce(nullif(array_to_string(list_filter([CASE WHEN claims IN (1, 2) THEN concat('- ', hook_quote) END, CASE WHEN claims IN (2, 3) THEN concat('- ', pain_quote) END], lambda x : x IS NOT NULL), chr(10)), ''), '{none}')"""


@query("an_08_draft_prompts", f"""
    WITH {LAB} SELECT domain, email AS to_email, {filled(P.DRAFT_TEMPLATE, your_company_name='o.your_company_name', sender_name='o.sender_name', what_you_sell='o.what_you_sell',
        icp_description='o.icp_description', cta_style='o.cta_style', proof_points_text="concat('- 30% less waste (over ', o.nations, ')')",
        example_emails_section=f"concat(chr(10), 'Style examples (tone only, no facts from them):', chr(10), '- Subject: ', chr(34), 'hello', chr(34), chr(10), '  Body: short', chr(10))",
        few_shot_section="''", previous_feedback_section="''", contact_name="coalesce(matched_name, 'there')", contact_title="''",
        company_name="CASE WHEN company_name = '' THEN domain ELSE company_name END", grounding_text=GROUNDS.format(none=P.NO_GROUNDING_DRAFT), sequence_length='4')} AS prompt
    FROM o_targets, <<v_offer>> o WHERE skip_reason IS NULL""")
def an_08(t):
    return D.draft_prompts(targets(t), offer(t))


@query("an_12_judge_prompts", f"""
    SELECT q.pos, {filled(P.JUDGE_TEMPLATE, subject='q.subject', body='q.body', grounding_source=GROUNDS.format(none=P.NO_GROUNDING_JUDGE))} AS prompt
    FROM <<v_queue_keyed>> q LEFT JOIN <<v_facts>> f ON f.domain = q.domain""")
def an_12(t):
    facts = facts_table(t).select(F.col("domain").alias("__d"), "hooks", "pains")
    rows = G.with_group_key(t("v_queue")).join(facts, F.col("domain") == F.col("__d"), "left")
    return rows.select("pos", P.judge_prompt(F.col("subject"), F.col("body"), F.col("hooks"), F.col("pains")).alias("prompt"))


DRAFTS = f"""
    o_bodies AS (SELECT domain, attempt, CASE WHEN starts_with({_BODY}, '[') THEN {_BODY} ELSE concat('[', {_BODY}) END AS b FROM <<v_draft_answers>>),
    o_items AS (SELECT domain, attempt, CASE WHEN json_valid(b) THEN coalesce(json_array_length(b), 0) ELSE 0 END AS n, CASE WHEN json_valid(b) THEN b END AS j FROM o_bodies),
    o_first AS (SELECT domain, attempt, n, j, coalesce(json_extract_string(j, '$[0].subject'), '') AS subject, coalesce(json_extract_string(j, '$[0].body'), '') AS body, 1 AS step FROM o_items),
    o_flaw AS (SELECT *, {LINKS} OR len({BANNED}) > 0 OR {WORDS} > 90 AS flawed FROM o_first),
    o_chosen AS (SELECT a.domain, CASE WHEN a.flawed AND coalesce(b.n, 0) > 0 THEN b.j ELSE a.j END AS j, CASE WHEN a.flawed AND coalesce(b.n, 0) > 0 THEN 2 ELSE 1 END AS attempt
                 FROM o_flaw a LEFT JOIN o_flaw b ON b.domain = a.domain AND b.attempt = 2 WHERE a.attempt = 1 AND a.n > 0)
"""


@query("an_09_read_drafts", f"WITH {DRAFTS} SELECT domain, attempt, n AS items, subject, body FROM o_first")
def an_09(t):
    items = t("v_draft_answers").select("domain", "attempt", R.read_draft("raw_text").alias("i"))
    first = F.get("i", F.lit(0))
    return items.select(
        "domain", "attempt", F.size("i").cast("long").alias("items"), F.coalesce(first["subject"], F.lit("")).alias("subject"),
        F.coalesce(first["body"], F.lit("")).alias("body"),
    )


@query("an_11_choose_attempt", f"WITH {DRAFTS} SELECT domain, json_extract_string(j, '$[0].body') AS opening FROM o_chosen")
def an_11(t):
    chosen = D.choose_attempts(t("v_draft_answers"))
    return chosen.select("domain", F.get("items", F.lit(0))["body"].alias("opening"))


QUEUE = f"""
    {DRAFTS}, {LAB},
    o_queue AS (SELECT t.email AS to_email, t.matched_name AS to_name, c.domain, s AS step, json_extract_string(c.j, concat('$[', s - 1, '].subject')) AS subject, json_extract_string(c.j, concat('$[', s - 1, '].body')) AS body
                FROM o_chosen c JOIN o_targets t ON t.domain = c.domain AND t.skip_reason IS NULL, (SELECT unnest([1, 2, 3, 4]) AS s) n)
"""


def drafted(t: Inputs):
    return D.draft_queue(targets(t), D.choose_attempts(t("v_draft_answers")))


@query("an_10_draft_queue", f"""
    WITH {QUEUE} SELECT to_email, coalesce(to_name, '-') AS to_name, domain, step, subject, body, step = 1 AND ({LINKS} OR len({BANNED}) > 0) AS self_check_failed FROM o_queue""")
def an_10(t):
    rows = drafted(t)
    return rows.select(
        "to_email", F.coalesce("to_name", F.lit("-")).alias("to_name"), "domain", "step", "subject", "body",
        F.coalesce("_self_check_failed", F.lit(False)).alias("self_check_failed"),
    )


@query("ag_12_draft_summary", f"""
    WITH {QUEUE} SELECT (SELECT count(DISTINCT domain) FROM o_queue) AS leads_drafted, (SELECT count(*) FROM o_targets WHERE skip_reason = 'no_contact') AS skipped_no_contact,
        (SELECT count(*) FROM o_targets WHERE skip_reason = 'no_analysis') AS skipped_no_analysis, (SELECT count(DISTINCT domain) FROM o_queue WHERE step = 1 AND ({LINKS} OR len({BANNED}) > 0)) AS self_check_failed""")
def ag_12(t):
    return D.draft_summary(targets(t), drafted(t))


@query("jn_11_contact_or_default", """
    SELECT q.domain, q.email_key, coalesce(r.email, q.email_key) AS contact_email, coalesce(r.matched_name, '-') AS contact_name
    FROM (SELECT domain, lower(concat('JANE@x', k, '.com')) AS email_key FROM <<v_contact_domains>>) q
    LEFT JOIN <<v_contact_rows>> r ON r.domain = q.domain AND lower(trim(r.email)) = q.email_key""")
def jn_11(t):
    queue = t("v_contact_domains").select("domain", F.lower(F.concat(F.lit("JANE@x"), "k", F.lit(".com"))).alias("email_key"))
    found = G.contact_or_default(queue, contact_lists(t))
    return found.select("domain", "email_key", "contact_email", F.coalesce("contact_name", F.lit("-")).alias("contact_name"))


@query("src_09_offer_check", "SELECT '' AS missing, '[nation_0 name]' AS placeholder FROM <<v_offer>>")
def src_09(t):
    broken = offer(t).withColumn("cta_style", F.concat(F.lit("ask ["), F.lower("sender_name"), F.lit(" name]")))
    return D.offer_problems(broken).select(F.array_join("missing", ",").alias("missing"), "placeholder")
