"""Page corpus: text, addresses, links, people, robots, crawl results."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import html as H
from leadloom.functions import urls
from leadloom.functions.own_text import short_own_texts
from leadloom.operators import pages as P
from leadloom.plans import stages
from leadloom.plans.catalog import Inputs, query
from leadloom.plans.inputs import AS_OF
from leadloom.plans.q_functions import type_case

BUDGET = 60_000
# The budget of the query that tests the cut itself.
SMALL_BUDGET = 6000
TYPE_ORDER = "[" + ", ".join(f"'{n}'" for n, _ in fixed.PAGE_TYPE_PATTERNS) + "]"


# --------------------------------------------------------------------- SQL
def _map_sql(entries: dict) -> str:
    quoted = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in entries.items())
    return f"MAP {{{quoted}}}"


_OLD_NAMES = "|".join(sorted(H.OLD_NAMES, key=len, reverse=True))


def decode_sql(text: str) -> str:
    """The text as a list of references and what lies between, each reference looked up once."""
    number = "try_cast(regexp_extract(p, '^&#([0-9]+)', 1) AS BIGINT)"
    hexed = "try_cast(concat('0x', regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1)) AS BIGINT)"
    code = f"coalesce(CASE WHEN lower(p[3]) = 'x' THEN {hexed} ELSE {number} END, 0)"
    sign = f"""CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533)
                    ELSE coalesce({_map_sql({str(n): t for n, t in H.CODE_PAGE.items()})}[CAST({code} AS VARCHAR)], chr(CAST({code} AS INT))) END"""
    old = f"regexp_extract(p, '^&({_OLD_NAMES})', 1)"
    named = f"coalesce({_map_sql(H.NAMED_REFERENCES)}[p[2:]], CASE WHEN {old} <> '' THEN concat({_map_sql(H.OLD_NAMES)}[{old}], p[length({old}) + 2:]) END, p)"
    pieces = f"regexp_extract_all({text}, '{H.REFERENCE}|[^&]+|&')"
    one = f"CASE WHEN starts_with(p, '&#') THEN {sign} WHEN regexp_full_match(p, '{H.REFERENCE}') THEN {named} ELSE p END"
    return f"array_to_string(list_transform({pieces}, lambda p : {one}), '')"


def drop_sql(text: str, names) -> str:
    for name in names:
        text = f"regexp_replace({text}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    return text


LIVE = drop_sql("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", ["script", "style", "template"])
PAGES = f"""
    o_live AS (SELECT *, regexp_extract(url, '//([^/?#]*)', 1) AS netloc, lower(url) LIKE '%.pdf' AS doc, {LIVE} AS live FROM <<v_site_pages>>),
    o_visible AS (SELECT *, {decode_sql("ltrim(regexp_replace(live, '(<[a-zA-Z/!?][^>]*>)+', ' ', 'g'))")} AS visible FROM o_live)
"""
EMAIL = fixed.EMAIL_PATTERN
JUNK = ", ".join(f"'{d}'" for d in fixed.JUNK_EMAIL_DOMAINS)
ADDRESSES = f"""
    {PAGES},
    o_raw AS (SELECT *, list_distinct(list_concat(
                  list_filter(list_transform(regexp_extract_all(live, 'href="mailto:([^"]*)"', 1), lambda h : lower(trim(split_part(h, '?', 1)))), lambda a : regexp_full_match(a, '{EMAIL}')),
                  list_transform(regexp_extract_all(visible, '{EMAIL}'), lambda a : lower(a)))) AS raw FROM o_visible),
    o_emails AS (SELECT *, list_filter(raw, lambda a : NOT regexp_matches(a, '\\.(png|jpg|jpeg|gif|svg)$') AND split_part(a, '@', -1) NOT IN ({JUNK})
                                              AND NOT regexp_matches(split_part(a, '@', -1), '^(example|test|sample|yourcompany|yourdomain)\\b')) AS emails FROM o_raw)
"""
OWN_FIRST = "list_concat(list_sort(list_filter(emails, lambda a : ends_with(a, concat('@', domain)))), list_sort(list_filter(emails, lambda a : NOT ends_with(a, concat('@', domain)))))"
LINKS = f"""
    {PAGES},
    o_tags AS (SELECT domain, pos, url, netloc, regexp_extract_all(live, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) AS hrefs,
                      regexp_extract_all(live, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS inners FROM o_live),
    o_links AS (SELECT domain, pos, url, netloc, i, {decode_sql('href')} AS href,
                       array_to_string(list_transform(regexp_split_to_array(inner_html, '<[^>]*>'), lambda s : trim({decode_sql('s')})), '') AS text
                FROM (SELECT domain, pos, url, netloc, unnest(hrefs) AS href, unnest(inners) AS inner_html, generate_subscripts(hrefs, 1) AS i FROM o_tags) x)
"""
PICKS = f"""
    {LINKS},
    o_resolved AS (
        SELECT domain, pos, netloc, row_number() OVER (PARTITION BY pos ORDER BY i) AS n, types, full_url FROM (
            SELECT *, {type_case("regexp_extract(regexp_replace(href, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?', ''), '^[^?#]*')", 'text')} AS types,
                   CASE WHEN regexp_matches(cut, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN cut WHEN starts_with(cut, '//') THEN concat(scheme, ':', cut)
                        WHEN starts_with(cut, '/') THEN concat(scheme, '://', netloc, cut)
                        WHEN starts_with(cut, '../') THEN concat(scheme, '://', netloc, regexp_replace(folder, '[^/]+/$', ''), substr(cut, 4))
                        ELSE concat(scheme, '://', netloc, folder, cut) END AS full_url
            FROM (SELECT *, regexp_extract(href, '^[^?#]*') AS cut, split_part(url, ':', 1) AS scheme,
                         CASE WHEN regexp_extract(url, '//[^/?#]*(/[^?#]*/)', 1) = '' THEN '/' ELSE regexp_extract(url, '//[^/?#]*(/[^?#]*/)', 1) END AS folder FROM o_links) a) b
        WHERE len(types) > 0 AND regexp_extract(full_url, '//([^/?#]*)', 1) = netloc),
    o_walk AS (
        SELECT pos, domain, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS picks FROM o_live
        UNION ALL
        SELECT w.pos, w.domain, r.n, CASE WHEN len(list_filter(picks, lambda p : split_part(p, ' ', 2) = full_url)) = 0
                   AND len(list_filter(types, lambda t : len(list_filter(picks, lambda p : split_part(p, ' ', 1) = t)) < CASE WHEN t = 'blog' THEN 2 ELSE 1 END)) > 0
               THEN list_append(picks, concat(list_filter(types, lambda t : len(list_filter(picks, lambda p : split_part(p, ' ', 1) = t)) < CASE WHEN t = 'blog' THEN 2 ELSE 1 END)[1], ' ', full_url))
               ELSE picks END
        FROM o_walk w JOIN o_resolved r ON r.pos = w.pos AND r.n = w.n + 1),
    o_picks AS (SELECT w.pos, w.domain, w.picks FROM o_walk w JOIN (SELECT pos, max(n) AS n FROM o_walk GROUP BY pos) m ON m.pos = w.pos AND m.n = w.n)
"""
SITEMAP = f"""
    o_locs AS (SELECT domain, pos, CASE WHEN regexp_matches(loc, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN loc ELSE concat('https://', domain, loc) END AS url
               FROM (SELECT domain, pos, trim(loc) AS loc FROM <<v_sitemap>>) l WHERE pos <= 300),
    o_typed AS (SELECT domain, url, t AS page_type, min(pos) AS pos
                FROM (SELECT domain, pos, url, unnest({type_case("regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '^[^?#]*')")}) AS t FROM o_locs) x GROUP BY 1, 2, 3),
    o_site AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, page_type ORDER BY pos) AS slot FROM o_typed) y
               WHERE slot <= CASE WHEN page_type = 'blog' THEN 2 ELSE 1 END)
"""
MERGED = f"""
    {PICKS}, {SITEMAP},
    o_nav AS (SELECT p.domain, split_part(x, ' ', 1) AS page_type, split_part(x, ' ', 2) AS url, i
              FROM (SELECT o.domain, unnest(o.picks) AS x, generate_subscripts(o.picks, 1) AS i, o.pos FROM o_picks o) p
              JOIN <<v_site_pages>> s ON s.pos = p.pos WHERE s.page_type = 'home'),
    o_both AS (SELECT domain, page_type, url, min(struct_pack(src := src, slot := slot)) AS k
               FROM (SELECT domain, page_type, url, 0 AS src, i AS slot FROM o_nav UNION ALL SELECT domain, page_type, url, 1 AS src, slot FROM o_site) b GROUP BY 1, 2, 3),
    o_merged AS (SELECT domain, page_type, url, k, n FROM (SELECT *, row_number() OVER (PARTITION BY domain, page_type ORDER BY k) AS n FROM o_both) c
                 WHERE n <= CASE WHEN page_type = 'blog' THEN 2 ELSE 1 END),
    o_nav_types AS (SELECT domain, page_type, min(i) AS f FROM o_nav GROUP BY 1, 2),
    o_site_types AS (SELECT domain, page_type, min(pos) AS f FROM o_site GROUP BY 1, 2),
    o_placed AS (SELECT m.domain, m.page_type, m.url, m.n, CASE WHEN a.f IS NOT NULL THEN 0 ELSE 1 END AS src, coalesce(a.f, b.f) AS f, list_position({TYPE_ORDER}, m.page_type) AS o
                 FROM o_merged m LEFT JOIN o_nav_types a ON a.domain = m.domain AND a.page_type = m.page_type LEFT JOIN o_site_types b ON b.domain = m.domain AND b.page_type = m.page_type)
"""
_CLEAN = drop_sql(drop_sql("live", ["head"]), H.DROPPED_ELEMENTS)
_BLOCKS = "|".join(H.BLOCK_ELEMENTS)


def clean_sql(markdown: bool = False) -> str:
    body = f"regexp_replace({_CLEAN}, '\\s+', ' ', 'g')"
    if markdown:
        for level in range(1, 7):
            body = f"regexp_replace({body}, '(?i)<h{level}\\b[^>]*>\\s*', '<p>{'#' * level} ', 'g')"
        for pattern, mark in (("<li\\b[^>]*>\\s*", "<li>- "), ("</?(b|strong)\\b[^>]*>", "**"), ("</?(i|em)\\b[^>]*>", "*"),
                              ('<a\\s[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', "[\\2](\\1)")):
            body = f"regexp_replace({body}, '(?i){pattern}', '{mark}', 'g')"
    body = f"regexp_replace({body}, '(?i)</t[dh]>\\s*<t[dh]\\b[^>]*>', ' | ', 'g')"
    body = f"regexp_replace(regexp_replace({body}, '(?i)</?({_BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')"
    lines = f"list_transform(string_split({decode_sql(body)}, chr(10)), lambda s : trim(regexp_replace(s, '\\s+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda s : s <> ''), chr(10))"


CLEAN = clean_sql()
BLOCKED = f"regexp_matches(substr(visible, 1, 3000), '{fixed.BLOCK_WALL_PATTERN}', 'i')"
STOPS = ", ".join(f"'{w}'" for w in fixed.CARD_NAME_STOP_WORDS)
CARDS = f"""
    o_runs AS (SELECT pos, list_filter(list_transform(regexp_extract_all(live, '>([^<>]+)<', 1), lambda s : trim(regexp_replace({decode_sql('s')}, '\\s+', ' ', 'g'))), lambda s : s <> '' AND length(s) <= 60) AS runs FROM o_live WHERE NOT doc),
    o_kinds AS (SELECT pos, i, run, CASE WHEN len(string_split(run, ' ')) <= 6 AND regexp_matches(run, '{fixed.CARD_TITLE_PATTERN}', 'i') THEN 'title'
                        WHEN regexp_matches(run, '{fixed.CARD_NAME_PATTERN.replace(chr(39), chr(39) * 2)}') AND lower(string_split(run, ' ')[1]) NOT IN ({STOPS}) AND lower(string_split(run, ' ')[-1]) NOT IN ({STOPS}) THEN 'name' END AS kind
                FROM (SELECT pos, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM o_runs) r),
    o_pairs AS (SELECT pos, run AS name, title, i FROM (
                    SELECT *, lead(kind) OVER (PARTITION BY pos ORDER BY i) AS next_kind, lead(run) OVER (PARTITION BY pos ORDER BY i) AS title FROM o_kinds WHERE kind IS NOT NULL) k
                WHERE kind = 'name' AND next_kind = 'title'),
    o_cards AS (SELECT pos, name, title, i FROM (SELECT *, row_number() OVER (PARTITION BY pos, lower(name) ORDER BY i) AS rn FROM o_pairs) p WHERE rn = 1)
"""
LD = """
    o_ld AS (SELECT pos, 'Ann Solo' AS name, 'Founder' AS title, 1 AS i FROM o_live WHERE html LIKE '%"employees":%'
             UNION ALL SELECT pos, concat(regexp_extract(html, '"name":"([^"]*) Ld"', 1), ' Ld') AS name, 'CTO' AS title, 2 AS i FROM o_live WHERE html LIKE '%"employees":%'
             UNION ALL SELECT pos, 'Gil Graph' AS name, 'Member' AS title, 1 AS i FROM o_live WHERE html LIKE '%"@graph":%')
"""
RULE_PATH = "CASE WHEN regexp_replace(p.url, '^[a-z]+://[^/?#]*', '') = '' THEN '/' ELSE regexp_extract(regexp_replace(p.url, '^[a-z]+://[^/?#]*', ''), '^[^#]*') END"
ROBOTS = f"""
    o_rules AS (SELECT r.* FROM <<v_robots>> r WHERE r.agent = 'LeadBot' OR (r.agent = '*' AND NOT EXISTS (SELECT 1 FROM <<v_robots>> x WHERE x.domain = r.domain AND x.agent = 'LeadBot'))),
    o_allowed AS (SELECT p.pos, coalesce(arg_min(r.allow OR r.path = '', r.pos), true) AS allowed
                  FROM <<v_site_pages>> p LEFT JOIN o_rules r ON r.domain = p.domain AND starts_with({RULE_PATH}, r.path) GROUP BY p.pos)
"""
FETCHED = "p.pos % 23 <> 4"
CRAWL = f"""
    {ADDRESSES}, {CARDS}, {LD}, {ROBOTS},
    o_visit AS (SELECT p.*, a.allowed, {FETCHED} AS fetched, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN page_type = 'home' THEN 0 ELSE 1 END, p.pos) AS visit_pos
                FROM o_emails p JOIN o_allowed a ON a.pos = p.pos),
    o_read AS (SELECT *, allowed AND fetched AND NOT doc AND {BLOCKED} AS blocked, CASE WHEN NOT allowed OR NOT fetched THEN '' WHEN doc THEN html WHEN {BLOCKED} THEN '' ELSE {CLEAN} END AS text,
                      allowed AND fetched AND (doc OR NOT {BLOCKED}) AS readable
               FROM o_visit WHERE visit_pos <= 8),
    o_spent AS (SELECT *, {BUDGET} - coalesce(sum(length(text)) OVER (PARTITION BY domain ORDER BY visit_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget_left FROM o_read),
    o_cut AS (SELECT *, greatest(0, least(length(text), budget_left)) AS chars FROM o_spent WHERE budget_left > 0),
    o_people AS (SELECT pos, lower(name) AS name FROM o_cards UNION SELECT pos, lower(name) FROM o_ld),
    o_page_people AS (SELECT c.domain, c.pos, n.name FROM o_cut c JOIN (SELECT pos, lower(name) AS name, 'card' AS src FROM o_cards UNION ALL SELECT pos, lower(name), 'ld' FROM o_ld) n ON n.pos = c.pos
                      WHERE c.readable AND NOT c.doc AND (n.src = 'ld' OR c.page_type IN ('team', 'about'))),
    o_domains AS (SELECT c.domain, bool_or(page_type = 'home' AND NOT allowed) AS refused, bool_or(page_type = 'home' AND blocked) AS walled, bool_or(page_type = 'home' AND fetched) AS home,
                         count(*) FILTER (WHERE chars > 0) AS pages, CAST(sum(chars) AS BIGINT) AS total_chars,
                         list_distinct(flatten(list(CASE WHEN readable THEN emails ELSE [] END))) AS emails,
                         list_sort(list(url) FILTER (WHERE blocked AND page_type <> 'home')) AS blocked_pages, list_sort(list(url) FILTER (WHERE NOT allowed AND page_type <> 'home')) AS robots_skipped
                  FROM o_cut c GROUP BY c.domain),
    o_crawl AS (SELECT d.*, coalesce(n.people, 0) AS people,
                       CASE WHEN refused THEN 'robots_disallowed' WHEN NOT home THEN 'crawl_failed' WHEN walled THEN 'blocked'
                            WHEN pages > 0 OR len(emails) > 0 OR coalesce(n.people, 0) > 0 THEN 'ok' ELSE 'crawl_failed' END AS status, NOT refused AND home AND NOT walled AS usable
                FROM o_domains d LEFT JOIN (SELECT domain, count(DISTINCT name) AS people FROM o_page_people GROUP BY 1) n ON n.domain = d.domain)
"""

# The stage: which pages are read follows from the home page's links and the sitemap.
_READ_ON = CRAWL[CRAWL.index("    o_read AS"):]
CRAWL_STAGE = f"""
    {ADDRESSES}, {MERGED.replace(PAGES + ",", "")}, {CARDS}, {LD},
    o_rules AS (SELECT r.* FROM <<v_robots>> r WHERE r.agent = 'LeadBot' OR (r.agent = '*' AND NOT EXISTS (SELECT 1 FROM <<v_robots>> x WHERE x.domain = r.domain AND x.agent = 'LeadBot'))),
    o_wanted AS (SELECT DISTINCT domain FROM <<v_wanted>>),
    o_first AS (SELECT w.domain, h.pos, coalesce(h.url, concat('https://', w.domain)) AS url, h.html IS NOT NULL AS fetched, coalesce({BLOCKED}, false) AS walled
                FROM o_wanted w LEFT JOIN o_visible h ON h.domain = w.domain AND h.page_type = 'home'),
    o_home AS (SELECT f.domain, f.pos, f.url, f.fetched, f.walled, coalesce((SELECT arg_min(r.allow OR r.path = '', r.pos) FROM o_rules r WHERE r.domain = f.domain AND starts_with({RULE_PATH.replace("p.url", "f.url")}, r.path)), true) AS allowed FROM o_first f),
    o_open AS (SELECT domain FROM o_home WHERE allowed AND fetched AND NOT walled),
    o_list AS (SELECT domain, page_type, url, visit_pos FROM (
                   SELECT domain, page_type, url, 1 + row_number() OVER (PARTITION BY domain ORDER BY src, f, o, n) AS visit_pos FROM o_placed WHERE domain IN (SELECT domain FROM o_open)) x WHERE visit_pos <= 8),
    o_copy AS (SELECT domain, url, arg_min(pos, row(html IS NULL, pos)) AS pos FROM <<v_store>> GROUP BY domain, url),
    o_targets AS (SELECT l.*, c.pos FROM o_list l LEFT JOIN o_copy c ON c.domain = l.domain AND c.url = l.url),
    o_targets_allowed AS (SELECT t.domain, t.page_type, t.url, t.visit_pos, t.pos, coalesce(arg_min(r.allow OR r.path = '', r.pos), true) AS allowed
                          FROM o_targets t LEFT JOIN o_rules r ON r.domain = t.domain AND starts_with({RULE_PATH.replace("p.url", "t.url")}, r.path) GROUP BY ALL),
    o_visit AS (SELECT a.domain, a.page_type, a.url, a.visit_pos, a.allowed, a.pos, lower(a.url) LIKE '%.pdf' AS doc, e.html IS NOT NULL AS fetched, e.html, e.live, e.visible, coalesce(e.emails, []) AS emails,
                       s.fetch_sec, s.fetch_error
                FROM (SELECT domain, 'home' AS page_type, url, 1 AS visit_pos, allowed, pos FROM o_home
                      UNION ALL SELECT domain, page_type, url, visit_pos, allowed, pos FROM o_targets_allowed) a
                LEFT JOIN o_emails e ON e.pos = a.pos LEFT JOIN <<v_store>> s ON s.pos = a.pos),
    {_READ_ON.strip()},
    o_times AS (SELECT domain, round(coalesce(sum(fetch_sec), 0), 2) AS duration_sec, max(fetch_error) FILTER (WHERE page_type = 'home') AS cause FROM o_cut GROUP BY domain)
""".replace("<<v_site_pages>>", "<<v_store>>")

SMALL_CRAWL = CRAWL.replace(f"{BUDGET} - coalesce", f"{SMALL_BUDGET} - coalesce")


# -------------------------------------------------------------- page by page
def site(t: Inputs):
    return t("v_site_pages")


def html_pages(t: Inputs):
    return site(t).where(~urls.is_pdf("url"))


@query("ex_01_block_wall", f"WITH {PAGES} SELECT pos, {BLOCKED} AS blocked FROM o_visible")
def ex_01(t):
    return site(t).select("pos", H.looks_blocked("html").alias("blocked"))


@query("ex_02_raw_addresses", f"WITH {ADDRESSES} SELECT pos, array_to_string(list_sort(raw), ',') AS emails FROM o_raw")
def ex_02(t):
    return site(t).select("pos", F.array_join(F.array_sort(H.raw_addresses("html")), ",").alias("emails"))


@query("ex_03_real_addresses", f"WITH {ADDRESSES} SELECT pos, array_to_string(list_sort(emails), ',') AS emails FROM o_emails")
def ex_03(t):
    real = H.real_addresses(H.raw_addresses("html"))
    return site(t).select("pos", F.array_join(F.array_sort(real), ",").alias("emails"))


@query("ex_04_own_domain_first", f"WITH {ADDRESSES} SELECT pos, array_to_string({OWN_FIRST}, ',') AS emails FROM o_emails")
def ex_04(t):
    return site(t).select("pos", F.array_join(H.page_addresses("html", "domain"), ",").alias("emails"))


@query("ex_05_links", f"WITH {LINKS} SELECT pos, i, href, text FROM o_links")
def ex_05(t):
    rows = site(t).select("pos", F.posexplode(H.links("html")).alias("i", "a"))
    return rows.select("pos", (F.col("i") + 1).alias("i"), "a.href", "a.text")


@query("ex_06_pick_links", f"WITH RECURSIVE {PICKS} SELECT pos, array_to_string(picks, ',') AS picks FROM o_picks")
def ex_06(t):
    picks = H.pick_links(F.col("url"), H.links("html"))
    shown = F.transform(picks, lambda p: F.concat(p["page_type"], F.lit(" "), p["url"]))
    return site(t).select("pos", F.array_join(shown, ",").alias("picks"))


@query("wn_03_type_cap", f"WITH RECURSIVE {PICKS} SELECT pos, split_part(x, ' ', 1) AS page_type, count(*) AS picked FROM (SELECT pos, unnest(picks) AS x FROM o_picks) p GROUP BY 1, 2")
def wn_03(t):
    picks = H.pick_links(F.col("url"), H.links("html"))
    return site(t).select("pos", F.explode(picks).alias("p")).groupBy("pos", "p.page_type").agg(F.count(F.lit(1)).alias("picked"))


@query("ex_07_sitemap_picks", f"WITH {SITEMAP} SELECT domain, page_type, url, slot FROM o_site")
def ex_07(t):
    return P.sitemap_picks(t("v_sitemap")).select("domain", "page_type", "url", "slot")


@query("sl_06_sitemap_limit", f"WITH {SITEMAP.replace('pos <= 300', 'pos <= 2')} SELECT domain, page_type, url, slot FROM o_site")
def sl_06(t):
    """A limit so low that it leaves out picks of most sites."""
    return P.sitemap_picks(t("v_sitemap"), max_locations=2).select("domain", "page_type", "url", "slot")


def merged(t: Inputs):
    homes = site(t).where(F.col("page_type") == "home")
    return P.merge_picks(P.nav_picks(homes), P.sitemap_picks(t("v_sitemap")))


@query("ex_08_merge_picks", f"WITH RECURSIVE {MERGED} SELECT domain, page_type, url, n AS slot FROM o_merged")
def ex_08(t):
    return merged(t).select("domain", "page_type", "url", "slot")


@query("set_02_visit_list", f"""
    WITH RECURSIVE {MERGED}
    SELECT domain, page_type, url, rn AS visit_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY src, f, o, n) AS rn
        FROM (SELECT domain, page_type, url, src, f, o, n FROM o_placed
              UNION ALL SELECT domain, 'home' AS page_type, url, -1 AS src, 0 AS f, 0 AS o, 0 AS n FROM <<v_site_pages>> WHERE page_type = 'home') u) v WHERE rn <= 8""")
def set_02(t):
    homes = site(t).where(F.col("page_type") == "home")
    return P.visit_list(homes, merged(t)).select("domain", "page_type", "url", "visit_pos")


@query("ex_09_clean_text", f"WITH {PAGES} SELECT pos, {CLEAN} AS text FROM o_live")
def ex_09(t):
    return site(t).select("pos", H.clean_text("html").alias("text"))


@query("ex_09_clean_markdown", f"WITH {PAGES} SELECT pos, {clean_sql(markdown=True)} AS text FROM o_live")
def ex_09_markdown(t):
    return site(t).select("pos", H.clean_text("html", markdown=True).alias("text"))


@query("ex_10_team_cards", f"WITH {PAGES}, {CARDS} SELECT pos, name, title FROM o_cards")
def ex_10(t):
    people = P.pair_cards(P.card_candidates(F.col("texts")))
    return html_pages(t).select("pos", short_own_texts("html").alias("texts")).select(
        "pos", F.explode(people).alias("p")).select("pos", "p.name", "p.title")


@query("wn_07_look_ahead", f"""
    WITH {PAGES}, {CARDS}, o_names AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS at FROM o_kinds WHERE kind IS NOT NULL)
    SELECT n.pos, n.run AS name, t.run AS title FROM o_names n JOIN o_names t ON t.pos = n.pos AND t.at = n.at + 1 WHERE n.kind = 'name' AND t.kind = 'title'""")
def wn_07(t):
    """Pairs before repeated names are dropped: a name goes with the next candidate, if that is a title."""
    found = html_pages(t).select("pos", short_own_texts("html").alias("texts"))
    return found.select("pos", F.explode(P.followed_by_titles(P.card_candidates(F.col("texts")))).alias("p")).select("pos", "p.name", "p.title")


@query("sl_07_people_cap", f"""
    WITH {PAGES}, {CARDS} SELECT pos, count(*) AS people FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS rn FROM o_cards) c WHERE rn <= 1 GROUP BY pos""")
def sl_07(t):
    people = P.pair_cards(P.card_candidates(F.col("texts")), max_people=1)
    return html_pages(t).select("pos", short_own_texts("html").alias("texts")).select(
        "pos", F.size(people).cast("long").alias("people")).where("people > 0")


@query("ex_11_jsonld_people", f"WITH {PAGES}, {LD} SELECT pos, name, title, i FROM o_ld")
def ex_11(t):
    rows = site(t).select("pos", F.posexplode(P.jsonld_people("html")).alias("i", "p"))
    return rows.select("pos", "p.name", "p.title", (F.col("i") + 1).alias("i"))


# --------------------------------------------------------------- whole crawl
def visited(t: Inputs):
    allowed = P.robots_verdicts(site(t), t("v_robots"), "LeadBot")
    fetched = allowed.withColumn("fetched", F.col("pos") % 23 != 4).withColumn(
        "html", F.when(F.col("fetched"), F.col("html"))
    )
    return P.cap_pages(fetched)


def crawl(t: Inputs):
    return P.crawl_results(P.read_pages(visited(t)), F.lit(AS_OF).cast("timestamp"), budget=BUDGET)


@query("ex_14_robots_rules", f"WITH {ROBOTS} SELECT pos, allowed FROM o_allowed")
def ex_14(t):
    return P.robots_verdicts(site(t), t("v_robots"), "LeadBot").select("pos", "allowed")


@query("jn_19_rule_prefix", f"WITH {ROBOTS} SELECT allowed, count(*) AS pages FROM o_allowed GROUP BY allowed")
def jn_19(t):
    verdicts = P.robots_verdicts(site(t), t("v_robots"), "LeadBot")
    return verdicts.groupBy("allowed").agg(F.count(F.lit(1)).alias("pages"))


@query("wn_04_page_cap", f"WITH {CRAWL} SELECT pos, domain, visit_pos FROM o_visit WHERE visit_pos <= 8")
def wn_04(t):
    return P.cap_pages(site(t)).select("pos", "domain", "visit_pos")


@query("ex_12_page_eligibility", f"""
    WITH {CRAWL} SELECT c.pos, count(DISTINCT n.name) AS people FROM o_read c LEFT JOIN (
        SELECT pos, lower(name) AS name, 'card' AS src FROM o_cards UNION ALL SELECT pos, lower(name), 'ld' FROM o_ld) n
      ON n.pos = c.pos AND c.readable AND NOT c.doc AND (n.src = 'ld' OR c.page_type IN ('team', 'about')) GROUP BY c.pos""")
def ex_12(t):
    read = P.read_pages(visited(t))
    return read.select("pos", F.size(P.distinct_people(F.col("people"))).cast("long").alias("people"))


@query("wn_02_text_budget", f"WITH {SMALL_CRAWL} SELECT pos, chars, budget_left FROM o_cut")
def wn_02(t):
    spent = P.apply_text_budget(P.read_pages(visited(t)), SMALL_BUDGET).where("budget_left > 0")
    return spent.select("pos", F.col("chars").cast("long").alias("chars"), F.col("budget_left").cast("long").alias("budget_left"))


@query("wn_02_document_budget", f"""
    SELECT pos, greatest(0, least(length(text), 60000 - spent)) AS chars FROM (
        SELECT pos, text, coalesce(sum(length(text)) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM <<v_crawl_pages>>) p""")
def wn_02_documents(t):
    """The budget without a page cap, over a domain with a third of the pages."""
    spent = P.apply_text_budget(t("v_crawl_pages"), pos="pos")
    return spent.select("pos", F.col("chars").cast("long").alias("chars"))


@query("ex_13_low_content", f"WITH {CRAWL} SELECT pos, page_type = 'home' AND chars < 150 AND NOT doc AS low_content FROM o_cut")
def ex_13(t):
    spent = P.apply_text_budget(P.read_pages(visited(t)), BUDGET).where("budget_left > 0")
    flag = P.low_content(F.col("page_type"), F.col("chars"), F.col("source_type").isNotNull())
    return spent.select("pos", flag.alias("low_content"))


@query("ex_15_crawl_status", f"WITH {CRAWL} SELECT domain, status FROM o_crawl")
def ex_15(t):
    return crawl(t).select("domain", "status")


@query("ex_16_skipped_urls", f"""
    WITH {CRAWL} SELECT domain, CASE WHEN usable THEN coalesce(array_to_string(blocked_pages, ','), '') ELSE '' END AS blocked_pages,
                        CASE WHEN usable THEN coalesce(array_to_string(robots_skipped, ','), '') ELSE '' END AS robots_skipped FROM o_crawl""")
def ex_16(t):
    return crawl(t).select(
        "domain", F.array_join(F.array_sort("blocked_pages"), ",").alias("blocked_pages"),
        F.array_join(F.array_sort("robots_skipped"), ",").alias("robots_skipped"),
    )


@query("ex_17_documents", f"WITH {CRAWL} SELECT pos, text, array_to_string(list_sort(CASE WHEN readable THEN emails ELSE [] END), ',') AS emails FROM o_read WHERE doc")
def ex_17(t):
    read = P.read_pages(visited(t)).where(F.col("source_type") == "pdf")
    return read.select("pos", "text", F.array_join(F.array_sort("emails"), ",").alias("emails"))


@query("ag_02_status_rollup", f"""
    WITH {CRAWL} SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status NOT IN ('ok', 'blocked', 'robots_disallowed')) AS failed,
                        count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'robots_disallowed') AS robots_disallowed FROM o_crawl""")
def ag_02(t):
    return P.status_rollup(crawl(t))


@query("ag_03_crawl_rows", f"""
    WITH {CRAWL} SELECT domain, status, CASE WHEN usable THEN pages ELSE 0 END AS pages, CASE WHEN usable THEN total_chars ELSE 0 END AS total_chars,
                        CASE WHEN usable THEN len(emails) ELSE 0 END AS emails_found FROM o_crawl""")
def ag_03(t):
    rows = P.run_summary(crawl(t))
    return rows.select("domain", "status", F.col("pages").cast("long"), F.col("total_chars").cast("long"), F.col("emails_found").cast("long"))


@query("crawl_stage", f"""
    WITH RECURSIVE {CRAWL_STAGE}
    SELECT c.domain, c.status, CASE WHEN usable THEN pages ELSE 0 END AS pages, CASE WHEN usable THEN total_chars ELSE 0 END AS total_chars,
           CASE WHEN usable THEN len(emails) ELSE 0 END AS emails_found, t.duration_sec,
           CASE WHEN status = 'robots_disallowed' THEN 'robots rules refuse the home page' WHEN status = 'blocked' THEN 'home page is behind a bot wall'
                WHEN status = 'crawl_failed' AND NOT home THEN concat('home page not fetched: ', coalesce(t.cause, 'unknown'))
                WHEN status = 'crawl_failed' THEN 'no text, address or person on any page' ELSE '' END AS error
    FROM o_crawl c JOIN o_times t ON t.domain = c.domain""")
def crawl_stage(t):
    """Wanted domains with and without stored pages; the summary runs on the stage's own output."""
    done = stages.run_crawl(stages.Settings(F.lit(AS_OF).cast("timestamp"), agent="LeadBot"), t("v_wanted"), t("v_store"), t("v_robots"), sitemap=t("v_sitemap"))
    return P.run_summary(done).select(
        "domain", "status", F.col("pages").cast("long"), F.col("total_chars").cast("long"), F.col("emails_found").cast("long"), "duration_sec", "error")


@query("ag_20_domain_addresses", f"WITH {CRAWL} SELECT domain, CASE WHEN usable THEN array_to_string({OWN_FIRST}, ',') ELSE '' END AS emails FROM o_crawl")
def ag_20(t):
    return crawl(t).select("domain", F.array_join("emails", ",").alias("emails"))


@query("wn_08_domain_people", f"WITH {CRAWL} SELECT domain, CASE WHEN usable THEN least(people, 40) ELSE 0 END AS people FROM o_crawl")
def wn_08(t):
    return crawl(t).select("domain", F.size("team_members").cast("long").alias("people"))


@query("jn_05_stale_domains", """
    SELECT domain FROM <<v_dns>> d WHERE domain NOT IN (
        SELECT domain FROM (SELECT domain, CASE WHEN n % 4 = 0 THEN 'blocked' ELSE 'ok' END AS status,
                                   CAST('2024-03-01 00:00:00' AS TIMESTAMP) - n * INTERVAL 6 HOUR AS crawled_at FROM <<v_dns>>) c
        WHERE status = 'ok' AND floor(epoch(CAST('2024-03-01 00:00:00' AS TIMESTAMP) - crawled_at) / 86400) < 30)""")
def jn_05(t):
    as_of = F.lit(AS_OF).cast("timestamp")
    crawled = t("v_dns").select(
        "domain", F.when(F.col("n") % 4 == 0, "blocked").otherwise("ok").alias("status"),
        (as_of - F.make_dt_interval(hours=(F.col("n") * 6).cast("int"))).alias("crawled_at"),
    )
    return P.stale_domains(t("v_dns").select("domain"), crawled, as_of)
