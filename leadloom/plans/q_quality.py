"""Text checks, verdicts and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import quality as Q
from leadloom.functions import responses as R
from leadloom.operators import gate as G
from leadloom.plans.catalog import Inputs, query
from leadloom.session import settle

WORDS = "len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w : w <> ''))"
LINKS = "regexp_matches(body, 'https?://|www\\.', 'i')"
IMAGES = "(regexp_matches(body, '!\\[[^\\]]*\\]\\([^)]*\\)') OR regexp_matches(body, '<img\\b', 'i'))"


def leak_list(text: str) -> str:
    items = []
    for label, pattern, ignore in fixed.LEAK_PATTERNS:
        escaped, flag = pattern.replace("'", "''"), ", 'i'" if ignore else ""
        group = ", 0, 'i'" if ignore else ""
        items.append(
            f"CASE WHEN regexp_matches({text}, '{escaped}'{flag}) THEN concat('{label}: ''', "
            f"regexp_extract({text}, '{escaped}'{group}), '''') END"
        )
    return f"list_filter([{', '.join(items)}], lambda x : x IS NOT NULL)"


BANNED = "list_filter([" + ", ".join(f"'{p}'" for p in fixed.BANNED_PHRASES) + "], lambda p : contains(lower(body), p))"


def syllable_sql(w: str) -> str:
    clean = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    runs = f"len(regexp_extract_all({clean}, '[aeiouy]+'))"
    return (
        f"CASE WHEN {clean} = '' THEN 0 ELSE greatest({runs} - CASE WHEN {clean} LIKE '%e' AND {runs} > 1 THEN 1 ELSE 0 END, 1) END"
    )


def grade_sql(source: str, key: str) -> str:
    """(key, grade) of `body` in `source`."""
    return f"""
        SELECT {key}, CASE WHEN n_words = 0 OR n_sentences = 0 THEN 0.0
                 ELSE round(greatest(0.39 * (CAST(n_words AS DOUBLE) / n_sentences) + 11.8 * (CAST(n_syllables AS DOUBLE) / n_words) - 15.59, 0.0), 1) END AS grade
        FROM (SELECT {key}, len(ws) AS n_words,
                     len(list_filter(regexp_split_to_array(trim(body), '[.!?]+'), lambda s : regexp_matches(s, '\\S'))) AS n_sentences,
                     coalesce(list_sum(list_transform(ws, lambda w : {syllable_sql('w')})), 0) AS n_syllables
              FROM (SELECT {key}, body, regexp_extract_all(body, '[A-Za-z'']+') AS ws FROM {source}) a) b"""


STOPS = ", ".join(f"'{w}'" for w in fixed.GROUNDING_STOP_WORDS)


def keyword_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-zA-Z'']+')), lambda w : length(w) >= 5 AND w NOT IN ({STOPS}))"


CLAIMS = """
    o_claims AS (
        SELECT domain, concat(hook_quote, ' ', hook) AS claim FROM <<v_facts>> WHERE claims IN (1, 2)
        UNION ALL SELECT domain, concat(pain_quote, ' ', pain) AS claim FROM <<v_facts>> WHERE claims IN (2, 3))
"""
GROUNDED = f"""
    o_hits AS (
        SELECT q.pos, bool_or((trim(lower(c.claim)) <> '' AND contains(lower(q.body), trim(lower(c.claim))))
                              OR len(list_filter({keyword_sql('c.claim')}, lambda w : contains(lower(q.body), w))) > 0) AS grounded
        FROM <<v_queue_keyed>> q JOIN o_claims c ON c.domain = q.domain GROUP BY q.pos)
"""
RULES = f"""
    {CLAIMS}, {GROUNDED}, o_grades AS ({grade_sql('<<v_queue_keyed>>', 'pos')}),
    o_rules AS (
        SELECT q.*, list_filter([
            CASE WHEN {WORDS} > 90 THEN concat('body over 90 words (', {WORDS}, ' words)') END,
            CASE WHEN step = 1 AND {LINKS} THEN '{fixed.VIOLATION_LINKS}' END,
            CASE WHEN {IMAGES} THEN '{fixed.VIOLATION_IMAGE}' END,
            CASE WHEN len({leak_list("concat(subject, ' ', body)")}) > 0 THEN concat('unfilled template parts: ["', array_to_string({leak_list("concat(subject, ' ', body)")}, '", "'), '"]') END,
            CASE WHEN len({BANNED}) > 0 THEN concat('phrases not allowed: [''', array_to_string({BANNED}, ''', '''), ''']') END,
            CASE WHEN g.grade > 8 THEN concat('reading grade over the limit (', g.grade, ', max 8)') END,
            CASE WHEN step = 1 AND h.grounded IS NOT NULL AND NOT h.grounded THEN '{fixed.VIOLATION_UNGROUNDED}' END
        ], lambda v : v IS NOT NULL) AS rule_violations
        FROM <<v_queue_keyed>> q JOIN o_grades g ON g.pos = q.pos LEFT JOIN o_hits h ON h.pos = q.pos)
"""
CLEAN_JUDGE = r"regexp_replace(regexp_replace(trim(raw_text), '^```(json)?\s*', ''), '\s*```$', '')"
SCORES = f"""
    o_scores AS (
        SELECT pos, problem, CASE WHEN problem IS NULL THEN CAST(json_extract_string(j, '$.grounding') AS DOUBLE) END AS grounding,
               CASE WHEN problem IS NULL THEN CAST(json_extract_string(j, '$.overall') AS DOUBLE) END AS overall,
               CASE WHEN problem IS NULL THEN json_extract_string(j, '$.feedback') END AS feedback
        FROM (SELECT pos, CASE WHEN json_valid(body) THEN body END AS j,
                     CASE WHEN error IS NOT NULL THEN error WHEN NOT json_valid(body) THEN 'invalid JSON' END AS problem
              FROM (SELECT pos, error, {CLEAN_JUDGE} AS body FROM <<v_judge>>) a) b)
"""
BEFORE = 20
VERDICTS = f"""
    {RULES}, {SCORES},
    o_groups AS (SELECT domain, email_key, min(pos) AS first FROM <<v_queue_keyed>> GROUP BY 1, 2),
    o_order AS (SELECT q.pos, row_number() OVER (ORDER BY g.first, q.pos) - 1 AS seq
                FROM <<v_queue_keyed>> q JOIN o_groups g ON g.domain = q.domain AND g.email_key = q.email_key),
    o_verdicts AS (
        SELECT *, CASE verdict WHEN 'fail_automated' THEN array_to_string(rule_violations, '; ') WHEN 'fail_judge_error' THEN problem
                       WHEN 'fail_judge' THEN coalesce(feedback, '{fixed.DEFAULT_JUDGE_FEEDBACK}') ELSE '' END AS violations,
               verdict <> 'pass' OR seq + {BEFORE} < 50 OR coalesce(overall, 0) <= 7 AS surely_reviewed,
               CAST(concat('0x', substr(md5(concat(email_key, '|', CAST(step AS VARCHAR))), 1, 8)) AS BIGINT) % 100 < {fixed.REVIEW_PERCENT} AS drawn
        FROM (SELECT r.*, s.problem, s.grounding, s.overall, s.feedback, o.seq,
                     CASE WHEN len(rule_violations) > 0 THEN 'fail_automated' WHEN s.problem IS NOT NULL THEN 'fail_judge_error'
                          WHEN coalesce(s.grounding, 0) >= 8 AND coalesce(s.overall, 0) >= 7 THEN 'pass' ELSE 'fail_judge' END AS verdict
              FROM o_rules r JOIN o_scores s ON s.pos = r.pos JOIN o_order o ON o.pos = r.pos) v)
"""


def facts_table(t: Inputs) -> DataFrame:
    """Analyses with hooks and pains out of the flat facts view."""
    hook = F.struct(F.col("hook").alias("hook"), F.col("hook_quote").alias("quote"), F.lit(8).alias("specificity"))
    pain = F.struct(F.col("pain").alias("pain"), F.col("pain_quote").alias("quote"), F.lit(5).alias("confidence"))
    return t("v_facts").select(
        "domain",
        F.when(F.col("claims").isin(1, 2), F.array(hook)).otherwise(F.slice(F.array(hook), 1, 0)).alias("hooks"),
        F.when(F.col("claims").isin(2, 3), F.array(pain)).otherwise(F.slice(F.array(pain), 1, 0)).alias("pains"),
    )


def checked_queue(t: Inputs) -> DataFrame:
    return G.automated_checks(G.with_group_key(t("v_queue")), facts_table(t))


def judged_queue(t: Inputs) -> DataFrame:
    scored = G.with_scores(checked_queue(t), t("v_judge"), ["pos"])
    return G.verdicts(G.evaluation_order(scored), BEFORE, [F.col("email_key"), F.col("step")])


# -------------------------------------------------------------- text checks
@query("qa_01_word_count", f"SELECT pos, {WORDS} AS words, {WORDS} <= 90 AS fits FROM <<v_queue>>")
def qa_01(t):
    return t("v_queue").select(
        "pos", Q.word_count("body").cast("long").alias("words"), Q.length_violation(F.col("body")).isNull().alias("fits")
    )


@query("qa_02_no_links", f"SELECT pos, NOT {LINKS} AS clean FROM <<v_queue>>")
def qa_02(t):
    return t("v_queue").select("pos", Q.has_no_links("body").alias("clean"))


@query("qa_03_no_images", f"SELECT pos, NOT {IMAGES} AS clean FROM <<v_queue>>")
def qa_03(t):
    return t("v_queue").select("pos", Q.has_no_images("body").alias("clean"))


@query("qa_04_leaks", f"SELECT pos, array_to_string({leak_list('body')}, '|') AS leaks FROM (SELECT pos, concat(subject, ' ', body) AS body FROM <<v_queue>>) q")
def qa_04(t):
    text = F.concat("subject", F.lit(" "), "body")
    return t("v_queue").select("pos", text.alias("x")).select("pos", F.array_join(Q.leaks("x"), "|").alias("leaks"))


@query("qa_05_banned", f"SELECT pos, array_to_string({BANNED}, '|') AS banned FROM <<v_queue>>")
def qa_05(t):
    return t("v_queue").select("pos", F.array_join(Q.banned_phrases("body"), "|").alias("banned"))


@query("qa_06_syllables", f"""
    SELECT word, {syllable_sql('word')} AS syllables, count(*) AS uses
    FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS word FROM <<documents>>) w GROUP BY word""")
def qa_06(t):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0))
    uses = t("documents").select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return uses.select("word", Q.syllables("word").cast("long").alias("syllables"), "uses")


@query("qa_07_reading_grade", grade_sql("(SELECT doc_id, text AS body FROM <<documents>>) d", "doc_id"))
def qa_07(t):
    return t("documents").select("doc_id", Q.reading_grade("text").alias("grade"))


@query("qa_08_keywords", f"SELECT item_id, array_to_string(list_sort({keyword_sql('text')}), ' ') AS keywords FROM <<benchmark>>")
def qa_08(t):
    return t("benchmark").select("item_id", F.array_join(F.array_sort(Q.keywords("text")), " ").alias("keywords"))


@query("qa_09_grounding", f"WITH {CLAIMS}, {GROUNDED} SELECT q.pos, coalesce(h.grounded, false) AS grounded FROM <<v_queue_keyed>> q LEFT JOIN o_hits h ON h.pos = q.pos")
def qa_09(t):
    with_claims = G.with_claims(G.with_group_key(t("v_queue")), facts_table(t))
    return with_claims.select("pos", Q.is_grounded("body", "claims").alias("grounded"))


@query("qa_10_draft_check", f"""
    SELECT pos, array_to_string(list_filter([
            CASE WHEN {WORDS} > 90 THEN concat('body over 90 words (', {WORDS}, ' words)') END,
            CASE WHEN step = 1 AND {LINKS} THEN '{fixed.VIOLATION_LINKS}' END,
            CASE WHEN len({leak_list("concat(subject, ' ', body)")}) > 0 THEN concat('unfilled template parts: ["', array_to_string({leak_list("concat(subject, ' ', body)")}, '", "'), '"]') END,
            CASE WHEN len({BANNED}) > 0 THEN concat('phrases not allowed: [''', array_to_string({BANNED}, ''', '''), ''']') END
        ], lambda v : v IS NOT NULL), '; ') AS violations FROM <<v_queue>>""")
def qa_10(t):
    return t("v_queue").select("pos", F.array_join(Q.draft_violations("subject", "body", "step"), "; ").alias("violations"))


@query("qa_11_gate_checks", f"WITH {RULES} SELECT pos, array_to_string(rule_violations, '; ') AS violations FROM o_rules")
def qa_11(t):
    return checked_queue(t).select("pos", F.array_join("rule_violations", "; ").alias("violations"))


@query("qa_12_judge_pass", f"WITH {SCORES} SELECT pos, problem IS NULL AND coalesce(grounding, 0) >= 8 AND coalesce(overall, 0) >= 7 AS passes FROM o_scores")
def qa_12(t):
    read = t("v_judge").select("pos", R.read_judge("raw_text", "error").alias("s"))
    return read.select("pos", Q.judge_passes(F.col("s.grounding"), F.col("s.overall"), F.col("s.error")).alias("passes"))


@query("qa_13_review_sampling", f"WITH {VERDICTS} SELECT pos, surely_reviewed FROM o_verdicts")
def qa_13(t):
    """Everything but the hash draw, which other engines hash differently."""
    sure = (F.col("verdict") != "pass") | (F.col("seq") + BEFORE < fixed.ALWAYS_REVIEWED) | (
        F.coalesce("scores.overall", F.lit(0)) <= fixed.BORDERLINE_OVERALL
    )
    return judged_queue(t).select("pos", sure.alias("surely_reviewed"))


@query("qa_13_review_draw", f"WITH {VERDICTS} SELECT pos, drawn FROM o_verdicts")
def qa_13_draw(t):
    """Which items the repeatable draw picks."""
    return judged_queue(t).select("pos", Q.hash_sampled(F.col("email_key"), F.col("step")).alias("drawn"))


@query("qa_14_verdicts", f"WITH {VERDICTS} SELECT pos, verdict, violations, surely_reviewed OR drawn AS needs_human_review FROM o_verdicts")
def qa_14(t):
    return judged_queue(t).select("pos", "verdict", F.array_join("violations", "; ").alias("violations"), "needs_human_review")


# ------------------------------------------------------------------ the gate
def redrafted_queue(t: Inputs) -> DataFrame:
    """Judged redrafts: each sequence again, with a short body that passes."""
    keyed = G.with_group_key(t("v_queue"))
    again = keyed.withColumn("body", F.concat(F.lit("A short note on hook about and growing pains. "), F.col("email_key"))).withColumn(
        "subject", F.concat(F.lit("again "), F.col("step"))
    )
    scored = G.with_scores(G.automated_checks(again, facts_table(t)), t("v_judge"), ["pos"])
    return G.verdicts(G.evaluation_order(scored), 1000, [F.col("email_key"), F.col("step")])


OPENERS = f"""
    o_openers AS (
        SELECT domain, email_key, min(pos) AS first_pos, arg_min(verdict, pos) FILTER (WHERE step = 1) AS verdict,
               arg_min(feedback, pos) FILTER (WHERE step = 1 AND feedback IS NOT NULL) AS any_feedback
        FROM o_verdicts GROUP BY 1, 2)
"""


@query("wn_16_opening_results", f"WITH {VERDICTS}, {OPENERS} SELECT domain, email_key, first_pos, coalesce(verdict, '-') AS verdict FROM o_openers")
def wn_16(t):
    return G.opening_results(judged_queue(t)).select("domain", "email_key", "first_pos", F.coalesce("verdict", F.lit("-")).alias("verdict"))


@query("qa_15_redrafts", f"""
    WITH {VERDICTS}, {OPENERS}
    SELECT v.pos, CASE WHEN o.verdict = 'fail_judge' THEN concat('again ', v.step) ELSE v.subject END AS subject, coalesce(o.verdict = 'fail_judge', false) AS is_redraft
    FROM o_verdicts v JOIN o_openers o ON o.domain = v.domain AND o.email_key = v.email_key""")
def qa_15(t):
    judged = settle(judged_queue(t), "judged")
    requests = G.redraft_requests(G.opening_results(judged))
    return G.apply_redrafts(judged, requests, redrafted_queue(t)).select("pos", "subject", "is_redraft")


@query("wn_12_evaluation_order", """
    SELECT q.pos, row_number() OVER (ORDER BY g.first, q.pos) - 1 AS seq
    FROM <<v_queue_keyed>> q JOIN (SELECT domain, email_key, min(pos) AS first FROM <<v_queue_keyed>> GROUP BY 1, 2) g
      ON g.domain = q.domain AND g.email_key = q.email_key""")
def wn_12(t):
    return G.evaluation_order(G.with_group_key(t("v_queue"))).select("pos", "seq")


@query("wn_12_reviewed_count", f"SELECT {BEFORE} + count(*) AS reviewed_so_far FROM <<v_queue>>")
def wn_12_count(t):
    return G.reviewed_count(BEFORE, t("v_queue"))


@query("jn_10_queue_with_analysis", """
    SELECT q.pos, q.domain, CASE WHEN f.domain IS NULL THEN -1 WHEN f.claims = 2 THEN 2 WHEN f.claims IN (1, 3) THEN 1 ELSE 0 END AS claims
    FROM <<v_queue_keyed>> q LEFT JOIN <<v_facts>> f ON f.domain = q.domain""")
def jn_10(t):
    joined = G.with_claims(G.with_group_key(t("v_queue")), facts_table(t))
    return joined.select("pos", "domain", F.coalesce(F.size("claims"), F.lit(-1)).alias("claims"))


@query("ag_13_gate_summary", f"""
    WITH {VERDICTS}
    SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail_automated') AS failed_automated,
           count(*) FILTER (WHERE verdict IN ('fail_judge', 'fail_judge_error')) AS failed_judge,
           count(*) FILTER (WHERE verdict = 'pass' AND (surely_reviewed OR drawn)) AS needs_review, CAST(0 AS BIGINT) AS redrafted FROM o_verdicts""")
def ag_13(t):
    summary = G.gate_summary(judged_queue(t), t("v_queue"))
    return summary.select("total", "passed", "failed_automated", "failed_judge", "needs_review", "redrafted")


@query("set_04_review_set", f"WITH {VERDICTS} SELECT pos, verdict FROM o_verdicts WHERE surely_reviewed")
def set_04(t):
    sure = (F.col("verdict") != "pass") | (F.col("seq") + BEFORE < fixed.ALWAYS_REVIEWED) | (
        F.coalesce("scores.overall", F.lit(0)) <= fixed.BORDERLINE_OVERALL
    )
    return judged_queue(t).where(F.col("needs_human_review") & sure).select("pos", "verdict")
