"""URL, address and name functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import addresses as A
from leadloom.functions import urls
from leadloom.operators import pages as P
from leadloom.plans.catalog import query
from leadloom.plans.q_hygiene import dns_table

PATH = r"regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*', ''), '^[^?#]*')"


def type_case(path: str, text: str | None = None) -> str:
    """List of page types in table order."""
    items = []
    for name, pattern in fixed.PAGE_TYPE_PATTERNS:
        hit = f"regexp_matches({path}, '{pattern}', 'i')"
        if text:
            hit = f"({hit} OR (len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w : w <> '')) <= 4 AND regexp_matches({text}, '{pattern}', 'i')))"
        items.append(f"CASE WHEN {hit} THEN '{name}' END")
    return f"list_filter([{', '.join(items)}], lambda t : t IS NOT NULL)"


def plus_sql(text: str) -> str:
    return f"replace(replace(url_encode({text}), '%20', '+'), '*', '%2A')"


def local_sql(email: str = "email") -> str:
    return f"split_part({email}, '@', 1)"


ROLE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({local_sql()}, '{p}', 'i') THEN '{name}'" for name, _, p in fixed.ROLE_PATTERNS
) + f" ELSE '{fixed.DEFAULT_ROLE[0]}' END"
PRIORITY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({local_sql()}, '{p}', 'i') THEN {rank}" for _, rank, p in fixed.ROLE_PATTERNS
) + f" ELSE {fixed.DEFAULT_ROLE[1]} END"
SENIORITY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(title, '{p}', 'i') THEN {rank}" for rank, p in fixed.SENIORITY_PATTERNS
) + f" ELSE {fixed.LOWEST_SENIORITY} END"
FIRST_SQL = "lower(regexp_replace(string_split(name, ' ')[1], '[^a-zA-Z]', '', 'g'))"
LAST_SQL = "lower(regexp_replace(string_split(name, ' ')[-1], '[^a-zA-Z]', '', 'g'))"
TEMPLATE_SQL = (
    "[concat(f, '.', l), concat(f, l), concat(substr(f, 1, 1), l), f, concat(f, '_', l), concat(l, '.', f), "
    "concat(f, '.', substr(l, 1, 1)), concat(substr(f, 1, 1), '.', l)]"
)


@query("fn_04_is_pdf", f"SELECT pos, lower({PATH}) LIKE '%.pdf' AS is_pdf FROM <<v_site_pages>>")
def fn_04(t):
    return t("v_site_pages").select("pos", urls.is_pdf("url").alias("is_pdf"))


@query("fn_05_root_url", "SELECT DISTINCT domain, concat('https://', domain) AS root, concat('http://', domain) AS plain FROM <<v_site_pages>>")
def fn_05(t):
    return t("v_site_pages").select(
        "domain", urls.root_url("domain").alias("root"), urls.root_url("domain", "http").alias("plain")
    ).distinct()


RESOLVED = r"""
    SELECT pos, loc, CASE WHEN regexp_matches(cut, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN cut
                          WHEN starts_with(cut, '/') THEN concat('https://', domain, cut)
                          ELSE concat('https://', domain, '/base/', cut) END AS resolved
    FROM (SELECT *, regexp_extract(loc, '^[^?#]*') AS cut
          FROM (SELECT pos, domain, trim(loc) AS loc FROM <<v_sitemap>>) a) b"""


@query("fn_06_resolve_link", f"SELECT pos, loc, resolved FROM ({RESOLVED}) r")
def fn_06(t):
    base = F.concat(F.lit("https://"), "domain", F.lit("/base/index.html"))
    return t("v_sitemap").select("pos", "domain", F.trim("loc").alias("loc")).select(
        "pos", "loc", urls.resolve_link(base, "loc").alias("resolved")
    )


@query("fn_07_page_types", f"SELECT pos, array_to_string({type_case(PATH, 'loc')}, ',') AS types FROM (SELECT pos, trim(loc) AS loc, trim(loc) AS url FROM <<v_sitemap>>) s")
def fn_07(t):
    trimmed = t("v_sitemap").select("pos", F.trim("loc").alias("loc"))
    return trimmed.select("pos", F.array_join(urls.page_types(urls.path_of("loc"), "loc"), ",").alias("types"))


@query("fn_08_company_key", "SELECT domain, regexp_replace(lower(split_part(domain, '.', 1)), '[^a-z0-9]', '', 'g') AS company FROM <<v_contact_domains>>")
def fn_08(t):
    return t("v_contact_domains").select("domain", urls.company_key("domain").alias("company"))


DISPLAY_SQL = "array_to_string(list_transform(list_filter(regexp_split_to_array(split_part(domain, '.', 1), '[-_]'), lambda w : w <> ''), lambda w : concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')"


@query("fn_09_company_display", f"SELECT domain, {DISPLAY_SQL} AS company FROM <<v_contact_domains>>")
def fn_09(t):
    return t("v_contact_domains").select("domain", urls.company_display("domain").alias("company"))


@query("fn_10_search_urls", f"""
    SELECT pos, concat('https://www.google.com/search?q=', {plus_sql("concat('\"', name, '\" ', domain, ' site:linkedin.com/in')")}) AS person_url,
           concat('https://www.google.com/search?q=', {plus_sql("concat(title, ' & ', name, ' ~*')")}) AS web_url
    FROM <<v_people>>""")
def fn_10(t):
    return t("v_people").select(
        "pos", urls.person_search_url("name", "domain").alias("person_url"),
        urls.web_search_url(F.concat("title", F.lit(" & "), "name", F.lit(" ~*"))).alias("web_url"),
    )


ERRORS = "CASE event_type WHEN 'error' THEN concat('net::ERR_NAME_NOT_RESOLVED at ', event_id) WHEN 'view' THEN 'ERR_INVALID_URL' ELSE concat('Timeout ', event_id) END"


@query("fn_11_error_class", "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'permanent' ELSE 'transient' END AS error_class FROM <<events>>")
def fn_11(t):
    return t("events").select("event_id", urls.error_class(F.expr(ERRORS)).alias("error_class"))


@query("fn_12_reverse_ip", "SELECT domain, array_to_string(list_reverse(string_split(ip, '.')), '.') AS reversed FROM <<v_dns>>")
def fn_12(t):
    return t("v_dns").select("domain", urls.reverse_ip("ip").alias("reversed"))


@query("ct_01_role", f"SELECT domain, email, {ROLE_SQL} AS role, {PRIORITY_SQL} AS priority FROM <<v_emails>>")
def ct_01(t):
    role = A.role_of("email")
    return t("v_emails").select("domain", "email", role["role"].alias("role"), role["priority"].alias("priority"))


@query("ct_05_name_parts", f"SELECT pos, {FIRST_SQL} AS first, {LAST_SQL} AS last FROM <<v_people>>")
def ct_05(t):
    parts = A.name_parts("name")
    return t("v_people").select("pos", parts["first"].alias("first"), parts["last"].alias("last"))


@query("ct_06_fill_templates", f"""
    SELECT pos, array_to_string({TEMPLATE_SQL}, ' ') AS locals
    FROM (SELECT pos, {FIRST_SQL} AS f, {LAST_SQL} AS l FROM <<v_people>>) p""")
def ct_06(t):
    return t("v_people").select("pos", F.array_join(A.template_locals("name"), " ").alias("locals"))


@query("ct_08_seniority", f"SELECT pos, title, {SENIORITY_SQL} AS seniority FROM <<v_people>>")
def ct_08(t):
    return t("v_people").select("pos", "title", A.seniority("title").alias("seniority"))


@query("ct_09_decision_maker", f"SELECT pos, regexp_matches(title, '{fixed.DECISION_MAKER_PATTERN}', 'i') AS decides FROM <<v_people>>")
def ct_09(t):
    return t("v_people").select("pos", A.is_decision_maker("title").alias("decides"))


@query("ct_14_mx_order", """
    SELECT domain, CASE WHEN mx_host1 IS NULL THEN '' WHEN mx_host2 IS NULL THEN mx_host1
                        WHEN mx_pref2 < mx_pref1 OR (mx_pref2 = mx_pref1 AND mx_host2 < mx_host1) THEN concat(mx_host2, ',', mx_host1)
                        ELSE concat(mx_host1, ',', mx_host2) END AS hosts
    FROM <<v_dns>>""")
def ct_14(t):
    return dns_table(t).select("domain", F.array_join(A.mx_hosts(F.col("mx")), ",").alias("hosts"))
