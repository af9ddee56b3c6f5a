"""People, address patterns, contacts and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.operators import contacts as C
from leadloom.operators import people as PE
from leadloom.operators.ordering import first_k
from leadloom.plans.catalog import Inputs, query
from leadloom.plans.inputs import AS_OF
from leadloom.plans.q_functions import DISPLAY_SQL, FIRST_SQL, LAST_SQL, PRIORITY_SQL, ROLE_SQL, SENIORITY_SQL, TEMPLATE_SQL, plus_sql
from leadloom.plans.q_hygiene import dns_table


# ------------------------------------------------------------- named people
def q(pattern: str) -> str:
    return pattern.replace("'", "''")


AFTER = "((?s:.{0,40}))"


def mention_sql(pattern: str, name: int, title: int, kind: int, flags: str) -> str:
    """Mentions of one pattern, cut out of the text one by one so that the
    text after each is seen without look-ahead."""
    return f"""
        SELECT domain, pos, {kind} AS kind, n, regexp_extract(hit, '{q(pattern)}', {name}{flags}) AS name, regexp_extract(hit, '{q(pattern)}', {title}{flags}) AS title,
               substr(list_reduce(list_prepend(text, hits[1:n]), lambda rest, h : substr(rest, strpos(rest, h) + length(h))), 1, 40) AS after
        FROM (SELECT domain, pos, text, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS n
              FROM (SELECT domain, pos, text, regexp_extract_all(text, '{q(pattern)}', 0{flags}) AS hits FROM <<v_crawl_pages>>
                    WHERE page_type IN ('about', 'team', 'contact', 'careers', 'home')) a) b"""


COMPANY = "regexp_replace(lower(split_part(domain, '.', 1)), '[^a-z0-9]', '', 'g')"
MENTIONS = f"""
    o_mentions AS ({mention_sql(fixed.NAME_THEN_TITLE, 1, 2, 0, '')} UNION ALL {mention_sql(fixed.TITLE_THEN_NAME, 2, 1, 1, '')}
                   UNION ALL {mention_sql(fixed.SELF_INTRODUCTION, 1, 2, 2, ", 'i'")}),
    o_named AS (SELECT *, lower(regexp_replace(regexp_extract(after, '{q(fixed.TRAILING_COMPANY)}', 1), '[^a-zA-Z0-9]', '', 'g')) AS other, {COMPANY} AS own FROM o_mentions),
    o_prose AS (SELECT *, other <> '' AND own <> '' AND NOT contains(other, own) AND NOT contains(own, other) AS foreign_company FROM o_named)
"""


def prose(t: Inputs):
    return PE.prose_people(t("v_crawl_pages"))


@query("ct_02_prose_people", f"WITH {MENTIONS} SELECT domain, pos, trim(name) AS name, trim(title) AS title FROM o_mentions")
def ct_02(t):
    pages = t("v_crawl_pages").where(F.col("page_type").isin(fixed.PROSE_PAGE_TYPES))
    rows = pages.select("domain", "pos", F.explode(PE.prose_mentions("text")).alias("m"))
    return rows.select("domain", "pos", F.trim("m.name").alias("name"), F.trim("m.title").alias("title"))


@query("ct_03_own_company_only", f"WITH {MENTIONS} SELECT domain, pos, trim(name) AS name, trim(title) AS title FROM o_prose WHERE NOT foreign_company")
def ct_03(t):
    return prose(t).select("domain", "pos", "name", "title")


OFFICERS = """
    o_officers AS (SELECT company_guess, pos, trim(name) AS name, CASE WHEN coalesce(position, '') = '' THEN 'Officer' ELSE position END AS title
                   FROM (SELECT *, row_number() OVER (PARTITION BY company_guess, lower(trim(name)) ORDER BY pos) AS rn FROM <<v_officers>> WHERE trim(name) <> '') o WHERE rn = 1)
"""


@query("ct_17_officers", f"WITH {OFFICERS} SELECT company_guess, pos, name, title FROM o_officers")
def ct_17(t):
    return PE.officer_people(t("v_officers"))


STRUCTURAL = "SELECT concat(split_part(domain, '.', 1), '.com') AS domain, pos, name, title FROM <<v_people>>"


def all_people(t: Inputs):
    structural = t("v_people").select(F.concat(F.split_part("domain", F.lit("."), F.lit(1)), F.lit(".com")).alias("domain"), "pos", "name", "title")
    spoken = prose(t).withColumn("domain", F.replace("domain", F.lit("site"), F.lit("c")))
    numbers = t("v_dns").select(F.concat(F.lit("c"), F.col("n") + 20, F.lit(".com")).alias("domain"))
    officers = PE.officers_for(numbers, t("v_officers"))
    return PE.named_people(structural, spoken, officers)


PEOPLE = f"""
    {MENTIONS}, {OFFICERS},
    o_found AS (SELECT domain, 0 AS src, pos, 0 AS kind, 0 AS n, name, title FROM ({STRUCTURAL}) s
                UNION ALL SELECT replace(domain, 'site', 'c') AS domain, 1 AS src, pos, kind, n, trim(name) AS name, trim(title) AS title FROM o_prose WHERE NOT foreign_company),
    o_union AS (SELECT * FROM o_found
                UNION ALL SELECT d.domain, 2 AS src, o.pos, 0 AS kind, 0 AS n, o.name, o.title FROM (SELECT DISTINCT concat('c', n + 20, '.com') AS domain FROM <<v_dns>>) d
                JOIN o_officers o ON o.company_guess = concat('C', substr(split_part(d.domain, '.', 1), 2)) WHERE d.domain NOT IN (SELECT domain FROM o_found)),
    o_everyone AS (SELECT domain, name, title, src FROM (SELECT *, row_number() OVER (PARTITION BY domain, lower(name) ORDER BY src, pos, kind, n) AS rn FROM o_union) u WHERE rn = 1)
"""


@query("ct_04_named_people", f"WITH {PEOPLE} SELECT domain, name, title, src FROM o_everyone")
def ct_04(t):
    return all_people(t).select("domain", "name", "title", F.col("pos.source").alias("src"))


@query("set_03_people_sources", f"WITH {PEOPLE} SELECT domain, count(*) AS people, count(DISTINCT src) AS sources FROM o_everyone GROUP BY domain")
def set_03(t):
    return all_people(t).groupBy("domain").agg(F.count(F.lit(1)).alias("people"), F.countDistinct("pos.source").alias("sources"))


# ------------------------------------------------------- matching, patterns
MATCHED = """
    o_first_people AS (SELECT domain, pos, name, title FROM (SELECT *, row_number() OVER (PARTITION BY domain, lower(name) ORDER BY pos) AS rn FROM <<v_people>>) p WHERE rn = 1),
    o_hits AS (
        SELECT e.domain, e.email, min(p.pos) AS who
        FROM (SELECT domain, email, list_distinct(list_filter(string_split(lower(regexp_replace(split_part(email, '@', 1), '[._]', ' ', 'g')), ' '), lambda w : w <> '')) AS tokens,
                     lower(regexp_replace(split_part(email, '@', 1), '[._]', ' ', 'g')) AS plain FROM <<v_emails>>) e
        JOIN (SELECT domain, pos, string_split(lower(name), ' ') AS words FROM o_first_people) p ON p.domain = e.domain
         AND (list_has_all(e.tokens, p.words) OR e.plain = p.words[1])
        GROUP BY e.domain, e.email),
    o_matched AS (SELECT e.domain, e.email, e.pos, p.name AS matched_name, p.title AS matched_title
                  FROM <<v_emails>> e LEFT JOIN o_hits h ON h.domain = e.domain AND h.email = e.email LEFT JOIN o_first_people p ON p.domain = h.domain AND p.pos = h.who)
"""
VOTES = f"""
    {MATCHED},
    o_fit AS (SELECT domain, pos, coalesce(list_position({TEMPLATE_SQL}, lower(split_part(email, '@', 1))), 0) AS template
              FROM (SELECT domain, pos, email, {FIRST_SQL.replace('name', 'matched_name')} AS f, {LAST_SQL.replace('name', 'matched_name')} AS l FROM o_matched WHERE matched_name IS NOT NULL) m),
    o_votes AS (SELECT domain, template, count(*) AS votes, min(pos) AS first_pos FROM o_fit WHERE template > 0 GROUP BY 1, 2),
    o_templates AS (SELECT domain, template FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY votes DESC, first_pos) AS rn FROM o_votes) v WHERE rn = 1)
"""
CANDIDATES = f"""
    {VOTES},
    o_open AS (SELECT p.domain, p.pos, p.name, p.title, t.template, {TEMPLATE_SQL}[t.template] AS local
               FROM (SELECT *, {FIRST_SQL} AS f, {LAST_SQL} AS l FROM o_first_people) p LEFT JOIN o_templates t ON t.domain = p.domain
               WHERE NOT EXISTS (SELECT 1 FROM o_matched m WHERE m.domain = p.domain AND lower(m.matched_name) = lower(p.name))),
    o_pending AS (SELECT domain, pos, name, title FROM o_open WHERE local IS NULL),
    o_derived AS (SELECT domain, email, name, title FROM (
                      SELECT *, row_number() OVER (PARTITION BY domain, email ORDER BY pos) AS rn FROM (SELECT *, concat(local, '@', domain) AS email FROM o_open WHERE local IS NOT NULL) d
                      WHERE NOT EXISTS (SELECT 1 FROM o_matched m WHERE m.domain = d.domain AND m.email = d.email)) x WHERE rn = 1),
    o_rows AS (
        SELECT domain, email, matched_name, matched_title, 'scraped' AS source, CASE WHEN matched_name IS NULL THEN 0 ELSE -1 END AS delta FROM o_matched
        UNION ALL SELECT domain, email, name, title, 'pattern_derived' AS source, -1 AS delta FROM o_derived
        UNION ALL SELECT domain, concat(x, '@', domain) AS email, NULL, NULL, 'guessed' AS source, 3 AS delta
        FROM (SELECT domain, unnest(['info', 'contact', 'sales', 'hello']) AS x FROM <<v_people_domains>> WHERE domain NOT IN (SELECT domain FROM <<v_emails>>)) g),
    o_candidates AS (SELECT domain, email, {ROLE_SQL} AS role, {PRIORITY_SQL} + delta AS priority, matched_name, matched_title, source FROM o_rows)
"""
TOP = f"""
    o_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, pos) AS place FROM (
                  SELECT *, {SENIORITY_SQL} AS rank FROM o_pending WHERE regexp_matches(title, '{fixed.DECISION_MAKER_PATTERN}', 'i')) r) s WHERE place <= 5)
"""


def resolved_sql(verify: bool) -> str:
    catch = "coalesce(d.catch_all, false)" if verify else "false"
    return f"""
    {TOP},
    o_asked AS (SELECT t.*, coalesce(d.mx_host1 IS NOT NULL, false) AS has_mx, {catch} AS catch_all, {FIRST_SQL} AS f, {LAST_SQL} AS l FROM o_top t LEFT JOIN <<v_dns>> d ON d.domain = t.domain),
    o_tried AS (SELECT *, concat(local, '@', domain) AS email FROM (SELECT *, unnest({TEMPLATE_SQL}[1:5]) AS local, generate_subscripts({TEMPLATE_SQL}[1:5], 1) AS place2 FROM o_asked WHERE {verify} AND has_mx AND NOT catch_all) a),
    o_resolved AS (
        SELECT domain, email, name AS matched_name, title AS matched_title, 'pattern_bruteforce_verified' AS source, 'valid' AS verification, note AS verification_note, 0 AS priority
        FROM (SELECT t.*, p.note, row_number() OVER (PARTITION BY t.domain, t.pos ORDER BY place2) AS rn FROM o_tried t JOIN <<v_probe>> p ON p.email = t.email AND p.status = 'valid') b WHERE rn = 1
        UNION ALL
        SELECT domain, concat(f, '.', l, '@', domain) AS email, name, title, 'pattern_guessed' AS source, CASE WHEN catch_all THEN 'catch_all' ELSE 'unverified' END AS verification,
               CASE WHEN catch_all THEN '{fixed.NOTE_GUESS_CATCH_ALL}' WHEN NOT has_mx THEN '{fixed.NOTE_GUESS_NO_MX}' ELSE '{fixed.NOTE_GUESS_SPECULATIVE}' END AS verification_note, 3 AS priority
        FROM o_asked WHERE NOT ({verify} AND has_mx AND NOT catch_all) AND f <> '' AND l <> '')
"""


def verified_sql(verify: bool) -> str:
    status = "CASE WHEN coalesce(d.catch_all, false) THEN 'catch_all' ELSE coalesce(p.status, 'unverified') END" if verify else "'not_checked'"
    note = f"CASE WHEN coalesce(d.catch_all, false) THEN '{fixed.NOTE_CATCH_ALL}' ELSE coalesce(p.note, '') END" if verify else f"'{fixed.NOTE_NOT_CHECKED}'"
    return f"""
    {CANDIDATES}, {resolved_sql(verify)},
    o_all AS (SELECT *, NULL AS verification, NULL AS verification_note FROM o_candidates
              UNION ALL SELECT domain, email, {ROLE_SQL} AS role, priority, matched_name, matched_title, source, verification, verification_note FROM o_resolved),
    o_verified AS (SELECT a.* EXCLUDE (verification, verification_note), CASE WHEN a.verification IS NOT NULL THEN a.verification WHEN d.mx_host1 IS NULL THEN 'unverified' ELSE {status} END AS verification,
                          CASE WHEN a.verification IS NOT NULL THEN a.verification_note WHEN d.mx_host1 IS NULL THEN '{fixed.NOTE_NO_MX}' ELSE {note} END AS verification_note
                   FROM o_all a LEFT JOIN <<v_dns>> d ON d.domain = split_part(a.email, '@', -1) LEFT JOIN <<v_probe>> p ON p.email = a.email),
    o_ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority, source IN ('guessed', 'pattern_guessed'), email, coalesce(matched_name, '')) AS rank
                                FROM o_verified WHERE verification <> 'invalid') r WHERE rank <= 2),
    o_contacts AS (SELECT *, CASE WHEN source IN ('guessed', 'pattern_guessed') THEN 'low' WHEN verification = 'valid' THEN CASE WHEN matched_name IS NULL THEN 'medium' ELSE 'high' END
                                  WHEN verification = 'not_checked' THEN 'medium' WHEN matched_name IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM o_ranked)
"""


def people(t: Inputs):
    rows = t("v_people").withColumn("key", F.lower("name"))
    return first_k(rows, ["domain", "key"], [F.col("pos")], 1).drop("key")


def matched(t: Inputs):
    return C.match_people(t("v_emails"), people(t))


def candidates(t: Inputs):
    return C.build_candidates(t("v_people_domains"), t("v_emails"), people(t))


def facts(t: Inputs):
    return C.domain_facts(dns_table(t), t("v_dns").select("domain", "catch_all"))


def verified(t: Inputs, verify: bool):
    found, pending = candidates(t)
    resolved = C.resolve_pending(pending, facts(t), t("v_probe"), verify)
    nothing = F.lit(None).cast("string")
    both = found.withColumn("verification", nothing).withColumn("verification_note", nothing).unionByName(resolved)
    return C.verify_candidates(both, facts(t), t("v_probe"), verify)


def shown(c: str):
    return F.coalesce(c, F.lit("-")).alias(c)


@query("jn_06_match_people", f"WITH {MATCHED} SELECT domain, email, coalesce(matched_name, '-') AS matched_name, coalesce(matched_title, '-') AS matched_title FROM o_matched")
def jn_06(t):
    return matched(t).select("domain", "email", shown("matched_name"), shown("matched_title"))


@query("ct_07_domain_template", f"WITH {VOTES} SELECT domain, template FROM o_templates")
def ct_07(t):
    best = C.domain_templates(C.template_votes(matched(t)))
    return best.select("domain", F.col("template").cast("long").alias("template"))


@query("ag_07_template_votes", f"WITH {VOTES} SELECT domain, template, votes, first_pos FROM o_votes")
def ag_07(t):
    votes = C.template_votes(matched(t))
    return votes.select("domain", F.col("template").cast("long").alias("template"), "votes", "first_pos")


@query("ct_10_candidates", f"WITH {CANDIDATES} SELECT domain, email, role, priority, coalesce(matched_name, '-') AS matched_name, source FROM o_candidates")
def ct_10(t):
    return candidates(t)[0].select("domain", "email", "role", "priority", shown("matched_name"), "source")


@query("wn_09_top_pending", f"WITH {CANDIDATES}, {TOP} SELECT domain, name, rank AS seniority FROM o_top")
def wn_09(t):
    return C.top_pending(candidates(t)[1]).select("domain", "name", "seniority")


@query("ct_11_resolve_pending", f"WITH {CANDIDATES}, {resolved_sql(True)} SELECT domain, email, matched_name, source, verification, verification_note FROM o_resolved")
def ct_11(t):
    rows = C.resolve_pending(candidates(t)[1], facts(t), t("v_probe"), True)
    return rows.select("domain", "email", "matched_name", "source", "verification", "verification_note")


@query("ct_12_verification", f"WITH {verified_sql(True)} SELECT domain, email, source, coalesce(matched_name, '-') AS matched_name, verification, verification_note FROM o_verified")
def ct_12(t):
    return verified(t, True).select("domain", "email", "source", shown("matched_name"), "verification", "verification_note")


@query("ct_12_verification_off", f"WITH {verified_sql(False)} SELECT domain, email, source, coalesce(matched_name, '-') AS matched_name, verification, verification_note FROM o_verified")
def ct_12_off(t):
    return verified(t, False).select("domain", "email", "source", shown("matched_name"), "verification", "verification_note")


@query("jn_07_address_facts", """
    SELECT e.domain, e.email, coalesce(d.mx_host1 IS NOT NULL, false) AS has_mx, coalesce(d.catch_all, false) AS catch_all
    FROM <<v_emails>> e LEFT JOIN <<v_dns>> d ON d.domain = split_part(e.email, '@', -1)""")
def jn_07(t):
    known = facts(t).select(F.col("domain").alias("__d"), "has_mx", "catch_all")
    joined = t("v_emails").join(known, A.address_domain("email") == F.col("__d"), "left")
    return joined.select(
        "domain", "email", F.coalesce("has_mx", F.lit(False)).alias("has_mx"), F.coalesce("catch_all", F.lit(False)).alias("catch_all")
    )


@query("wn_05_top_contacts", f"WITH {verified_sql(True)} SELECT domain, rank, email, source, verification FROM o_ranked")
def wn_05(t):
    return C.rank_contacts(verified(t, True)).select("domain", "rank", "email", "source", "verification")


@query("ct_13_confidence", f"""
    WITH {verified_sql(True)} SELECT domain, rank, email, confidence,
        CASE WHEN matched_name IS NULL THEN '-' ELSE concat('https://www.google.com/search?q=', {plus_sql("concat('\"', matched_name, '\" ', domain, ' site:linkedin.com/in')")}) END AS linkedin_lookup_url FROM o_contacts""")
def ct_13(t):
    return C.rank_contacts(verified(t, True)).select("domain", "rank", "email", "confidence", shown("linkedin_lookup_url"))


@query("sl_01_candidate_order", f"""
    WITH {CANDIDATES} SELECT domain, email, source, rn AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority, source = 'guessed', email, coalesce(matched_name, '')) AS rn FROM o_candidates) c WHERE rn <= 10""")
def sl_01(t):
    order = [F.col("priority"), F.col("source") == "guessed", F.col("email"), F.coalesce("matched_name", F.lit(""))]
    return first_k(candidates(t)[0], ["domain"], order, 10, "place").select("domain", "email", "source", "place")


RESULTS = f"""
    {verified_sql(True)},
    o_lists AS (SELECT domain, count(*) AS n, arg_min(email, rank) AS best_email, arg_min(confidence, rank) AS best_confidence, arg_min(verification, rank) AS best_verification FROM o_contacts GROUP BY 1),
    o_results AS (SELECT s.domain, CASE WHEN s.n % 9 = 4 THEN 'no_crawl_data' WHEN coalesce(l.n, 0) > 0 THEN 'ok' ELSE 'no_contacts_found' END AS status,
                         CASE WHEN s.n % 9 = 4 THEN 0 ELSE coalesce(l.n, 0) END AS contacts_found, CASE WHEN s.n % 9 = 4 THEN '' ELSE coalesce(best_email, '') END AS best_email,
                         CASE WHEN s.n % 9 = 4 THEN '' ELSE coalesce(best_confidence, '') END AS best_confidence, CASE WHEN s.n % 9 = 4 THEN '' ELSE coalesce(best_verification, '') END AS best_verification
                  FROM <<v_people_domains>> s LEFT JOIN o_lists l ON l.domain = s.domain)
"""


def results(t: Inputs):
    crawled = t("v_people_domains").select("domain", F.when(F.col("n") % 9 == 4, "blocked").otherwise("ok").alias("status"))
    return C.contacts_results(crawled, C.rank_contacts(verified(t, True)), F.lit(AS_OF).cast("timestamp"), True)


@query("ag_04_contacts_summary", f"WITH {RESULTS} SELECT * FROM o_results")
def ag_04(t):
    summary = C.contacts_summary(results(t))
    return summary.withColumn("contacts_found", F.col("contacts_found").cast("long"))


@query("ag_05_contact_status", f"WITH {RESULTS} SELECT status, count(*) AS domains FROM o_results GROUP BY status")
def ag_05(t):
    return C.status_counts(results(t))


# --------------------------------------------------------------------- gaps
def contact_lists(t: Inputs):
    """The flat contact view in the shape of contacts results."""
    nothing = F.lit(None).cast("string")
    entry = F.struct(
        "rank", "email", F.lit("other").alias("role"), "matched_name", nothing.alias("matched_title"), F.lit("scraped").alias("source"),
        F.lit("not_checked").alias("verification"), F.lit("").alias("verification_note"), "confidence", nothing.alias("linkedin_lookup_url"),
    )
    lists = t("v_contact_rows").groupBy(F.col("domain").alias("__d")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    plain = F.transform("l", lambda c: F.struct(*[c[n].alias(n) for n in C.CONTACT_FIELDS]))
    joined = t("v_contact_domains").join(lists, F.col("domain") == F.col("__d"), "left")
    return joined.select("domain", "status", F.coalesce(plain, F.slice(plain, 1, 0), F.array().cast(C.CONTACTS)).alias("contacts"))


GAPS = """
    o_lists AS (SELECT d.domain, d.status, count(r.email) AS n, count(*) FILTER (WHERE r.confidence = 'low') AS lows, arg_min(r.email, r.rank) AS email,
                       max(CASE WHEN r.rank = 1 THEN r.matched_name END) AS name
                FROM <<v_contact_domains>> d LEFT JOIN <<v_contact_rows>> r ON r.domain = d.domain GROUP BY 1, 2),
    o_gaps AS (SELECT *, CASE WHEN status IN ('no_contacts_found', 'no_crawl_data') THEN 'no_contact' WHEN n > 0 AND n = lows THEN 'low_confidence' END AS gap_reason FROM o_lists)
"""


@query("ct_15_gap_reason", f"WITH {GAPS} SELECT domain, coalesce(gap_reason, '-') AS gap_reason FROM o_gaps")
def ct_15(t):
    return contact_lists(t).select("domain", F.coalesce(C.gap_reason(F.col("status"), F.col("contacts")), F.lit("-")).alias("gap_reason"))


@query("ct_16_gap_rows", f"""
    WITH {GAPS} SELECT domain, company AS company_name_guess, gap_reason, coalesce(name, '') AS existing_best_name, coalesce(email, '') AS existing_best_email,
        concat('https://www.google.com/search?q=', {plus_sql("concat('\"', company, '\" founder OR CEO OR \"head of sales\"')")}) AS google_search_url,
        concat('https://www.google.com/search?q=', {plus_sql("concat('\"', company, '\" ', domain, ' site:linkedin.com/in')")}) AS linkedin_search_url,
        '' AS found_name, '' AS found_title, '' AS found_email, '' AS verified_yn, '' AS notes
    FROM (SELECT *, {DISPLAY_SQL} AS company FROM o_gaps WHERE gap_reason IS NOT NULL) g""")
def ct_16(t):
    return C.gap_rows(contact_lists(t))


FILLED = """
    o_filled AS (SELECT pos, trim(domain) AS domain, trim(found_email) AS email, upper(trim(verified_yn)) = 'Y' AS verified,
                        CASE WHEN trim(found_email) = '' THEN 'skipped_blank' WHEN trim(domain) NOT IN (SELECT domain FROM <<v_contact_domains>>) THEN 'skipped_no_domain_dir' ELSE 'imported' END AS outcome
                 FROM <<v_filled>>)
"""


def outcomes(t: Inputs):
    return C.filled_gaps(t("v_filled"), t("v_contact_domains"))


@query("jn_18_import_gaps", f"""
    WITH {FILLED},
    o_new AS (SELECT domain, email, verified FROM (SELECT *, row_number() OVER (PARTITION BY domain, email ORDER BY pos) AS rn FROM o_filled WHERE outcome = 'imported') f WHERE rn = 1),
    o_both AS (SELECT domain, email, rank AS place, confidence, 'scraped' AS source FROM <<v_contact_rows>>
               UNION ALL SELECT n.domain, n.email, 3 AS place, CASE WHEN verified THEN 'high' ELSE 'medium' END AS confidence, 'manual_lookup' AS source FROM o_new n
               WHERE NOT EXISTS (SELECT 1 FROM <<v_contact_rows>> r WHERE r.domain = n.domain AND r.email = n.email))
    SELECT d.domain, CASE WHEN d.domain IN (SELECT domain FROM o_new) THEN 'ok' ELSE d.status END AS status,
           coalesce(array_to_string(list_sort(list(concat(b.email, ' ', b.confidence, ' ', b.source)) FILTER (WHERE b.email IS NOT NULL)), ','), '') AS contacts
    FROM <<v_contact_domains>> d LEFT JOIN o_both b ON b.domain = d.domain GROUP BY 1, 2""")
def jn_18(t):
    merged = C.import_gaps(contact_lists(t), outcomes(t))
    lines = F.transform("contacts", lambda c: F.concat_ws(" ", c["email"], c["confidence"], c["source"]))
    return merged.select("domain", "status", F.array_join(F.array_sort(lines), ",").alias("contacts"))


@query("set_08_gap_merge", f"""
    WITH {FILLED} SELECT d.domain, count(DISTINCT f.email) AS offered FROM <<v_contact_domains>> d JOIN o_filled f ON f.domain = d.domain AND f.outcome = 'imported' GROUP BY 1""")
def set_08(t):
    imported = outcomes(t).where(F.col("outcome") == "imported")
    return imported.groupBy("domain").agg(F.countDistinct("email").alias("offered"))


@query("ag_19_gap_counts", f"""
    WITH {FILLED}, {GAPS} SELECT count(*) FILTER (WHERE outcome = 'imported') AS imported, count(*) FILTER (WHERE outcome = 'skipped_blank') AS skipped_blank,
        count(*) FILTER (WHERE outcome = 'skipped_no_domain_dir') AS skipped_no_domain_dir, (SELECT count(*) FROM o_gaps WHERE gap_reason IS NOT NULL) AS exported FROM o_filled""")
def ag_19(t):
    exported = C.gap_rows(contact_lists(t)).agg(F.count(F.lit(1))).scalar()
    return C.import_summary(outcomes(t)).withColumn("exported", exported)


BEST = """
    o_best AS (SELECT domain, email, matched_name, confidence FROM (
                   SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, rank) AS rn FROM <<v_contact_rows>>) r WHERE rn = 1)
"""


@query("wn_06_best_contact", f"WITH {BEST} SELECT domain, email, confidence FROM o_best")
def wn_06(t):
    best = contact_lists(t).select("domain", C.best_contact(F.col("contacts")).alias("c"))
    return best.where(F.col("c").isNotNull()).select("domain", "c.email", "c.confidence")
