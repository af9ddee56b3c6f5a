"""Hygiene: sources, URL functions, joins with facts, kept and dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import urls
from leadloom.functions.suffixes import default_rules
from leadloom.operators import hygiene, sending
from leadloom.plans.catalog import Inputs, query

URL = "website"


def dns_table(t: Inputs) -> DataFrame:
    """The flat facts view in the shape of dns_facts."""
    def listed(*columns):
        return F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())

    mx = [
        F.when(F.col(f"mx_host{i}").isNotNull(), F.struct(F.col(f"mx_pref{i}").alias("pref"), F.col(f"mx_host{i}").alias("host")))
        for i in (1, 2)
    ]
    return t("v_dns").select(
        "domain", "n", F.filter(F.array(*mx), lambda m: m.isNotNull()).alias("mx"), listed("ns1", "ns2").alias("ns"),
        listed("txt1", "txt2").alias("txt"), listed("dmarc1").alias("dmarc_txt"), listed("dkim1", "dkim2").alias("dkim"),
        "ip", "catch_all",
    )


def tagged(t: Inputs) -> DataFrame:
    return hygiene.tag_leads(t("v_leads_raw"), URL, dns_table(t), t("v_suppression"))


# --------------------------------------------------------------------- SQL
def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def host_sql(url: str) -> str:
    return (
        f"lower(rtrim(trim(split_part(regexp_extract(regexp_extract(regexp_replace({url}, "
        r"'^([a-zA-Z0-9+.\-]+:)?//', ''), '^[^/?#]*'), '[^@]*$'), ':', 1)), '.'))"
    )


RULES = default_rules()


def _rules_in(kind: str, n: int) -> str:
    """The names of n labels with rules of a kind, as SQL; none is no name."""
    return _in(name for name in RULES.named(kind) if name.count(".") + 1 == n) or "'-'"


def suffix_sql(host: str) -> str:
    """One case per number of labels, the longest first; exceptions before all."""
    labels = f"string_split({host}, '.')"
    cases = [rf"CASE WHEN regexp_matches({host}, '^\d+(\.\d+){{3}}$') THEN ''"]

    def tail(n: int) -> str:
        return f"array_to_string({labels}[-{n}:], '.')" if n else "''"

    for n in range(RULES.depth, 0, -1):
        cases.append(f"WHEN len({labels}) >= {n} AND {tail(n)} IN ({_rules_in('x', n)}) THEN {tail(n - 1)}")
    for n in range(RULES.depth + 1, 0, -1):
        cases.append(f"WHEN len({labels}) >= {n} AND ({tail(n)} IN ({_rules_in('p', n)}) OR {tail(n - 1)} IN ({_rules_in('w', n - 1)})) THEN {tail(n)}")
    return " ".join(cases) + " ELSE '' END"


def domain_sql(source: str, raw: str) -> str:
    """Rows of `source` with `o_domain` added."""
    return f"""
        SELECT * EXCLUDE (o_raw, o_host, o_suffix),
               CASE WHEN o_raw = '' OR o_suffix = '' OR length(o_host) <= length(o_suffix) + 1 THEN ''
                    ELSE array_to_string(string_split(o_host, '.')[-(len(string_split(o_suffix, '.')) + 1):], '.') END AS o_domain
        FROM (SELECT *, {suffix_sql('o_host')} AS o_suffix
              FROM (SELECT *, {host_sql("CASE WHEN starts_with(o_raw, 'http') THEN o_raw ELSE concat('https://', o_raw) END")} AS o_host
                    FROM (SELECT *, trim({raw}) AS o_raw FROM {source}) x1) x2) x3"""


GEO_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.COUNTRY_BY_SUFFIX_LABEL.items())
PARKED = " OR ".join(f"contains(lower(rtrim(h, '.')), '{m}')" for m in fixed.PARKING_NAME_SERVERS)
STRIPPED = r"""
        SELECT pos, website, CASE WHEN q = '' THEN website ELSE
                 concat(regexp_replace(regexp_extract(ltrim(front), '^([a-zA-Z][a-zA-Z0-9+.\-]*):'), '.*', lower(regexp_extract(ltrim(front), '^([a-zA-Z][a-zA-Z0-9+.\-]*):'))),
                        regexp_replace(ltrim(front), '^([a-zA-Z][a-zA-Z0-9+.\-]*):', ''),
                        CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END,
                        CASE WHEN frag <> '' THEN concat('#', frag) ELSE '' END) END AS cleaned
        FROM (SELECT pos, website, front, q, frag,
                     list_transform(list_filter(list_filter(string_split(q, '&'), lambda p : p <> ''),
                         lambda p : NOT (lower(url_decode(split_part(p, '=', 1))) IN (%s) OR starts_with(lower(url_decode(split_part(p, '=', 1))), 'utm_'))),
                         lambda p : concat(replace(url_encode(url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' '))), '%%20', '+'), '=',
                                      replace(url_encode(url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' '))), '%%20', '+'))) AS kept
              FROM (SELECT pos, website, split_part(split_part(website, '#', 1), '?', 1) AS front,
                           regexp_extract(split_part(website, '#', 1), '^[^?]*\?(.*)$', 1) AS q,
                           regexp_extract(website, '#(.+)$', 1) AS frag FROM <<v_leads_raw>>) a) b
""" % _in(fixed.TRACKING_NAMES)

TAGGED_SQL = f"""
    o_keyed AS ({domain_sql('<<v_leads_raw>>', 'website')}),
    o_firsts AS (SELECT o_domain AS fd, min(pos) AS fp FROM o_keyed WHERE o_domain <> '' GROUP BY 1),
    o_tagged AS (
        SELECT k.pos, k.company, k.segment, k.website, k.o_domain AS domain,
               CASE WHEN k.o_domain = '' THEN 'invalid_url' WHEN k.pos > f.fp THEN 'duplicate'
                    WHEN d.mx_host1 IS NULL THEN 'no_mx'
                    WHEN len(list_filter([d.ns1, d.ns2], lambda h : {PARKED})) > 0 THEN 'parked_domain'
                    WHEN EXISTS (SELECT 1 FROM <<v_suppression>> s WHERE s.scope = 'domain' AND s.value = k.o_domain) THEN 'globally_suppressed'
               END AS drop_reason
        FROM o_keyed k LEFT JOIN o_firsts f ON f.fd = k.o_domain LEFT JOIN <<v_dns>> d ON d.domain = k.o_domain)
"""
GEO_SQL = f"""coalesce(list_filter(list_transform(string_split({suffix_sql('domain')}, '.'), lambda l : CASE l {GEO_CASE} END), lambda g : g IS NOT NULL)[1], 'unknown')"""


# ---------------------------------------------------------------- functions
@query("fn_01_registrable_domain", f"SELECT pos, o_domain AS domain FROM ({domain_sql('<<v_leads_raw>>', 'website')}) r")
def fn_01(t):
    return t("v_leads_raw").select("pos", urls.registrable_domain(URL).alias("domain"))


@query("fn_02_strip_tracking", f"SELECT pos, cleaned FROM ({STRIPPED}) r")
def fn_02(t):
    return t("v_leads_raw").select("pos", urls.strip_tracking(URL).alias("cleaned"))


@query("fn_03_geo_tag", f"SELECT domain, {GEO_SQL} AS geo FROM <<v_dns>>")
def fn_03(t):
    return t("v_dns").select("domain", urls.geo_tag("domain").alias("geo"))


@query("wn_01_keep_first", f"""
    WITH o_keyed AS ({domain_sql('<<v_leads_raw>>', 'website')})
    SELECT pos, o_domain AS domain FROM (
        SELECT *, row_number() OVER (PARTITION BY o_domain ORDER BY pos) AS rn FROM o_keyed WHERE o_domain <> '') r WHERE rn = 1""")
def wn_01(t):
    keyed = hygiene.with_domain(t("v_leads_raw"), URL).where(F.col("domain") != "")
    return hygiene.dedupe(keyed).select("pos", "domain")


@query("sd_09_parked", f"SELECT domain, len(list_filter([ns1, ns2], lambda h : {PARKED})) > 0 AS parked FROM <<v_dns>>")
def sd_09(t):
    return dns_table(t).select("domain", hygiene.is_parked(F.col("ns")).alias("parked"))


@query("sd_10_has_mx", "SELECT domain, mx_host1 IS NOT NULL AS has_mx FROM <<v_dns>>")
def sd_10(t):
    return dns_table(t).select("domain", hygiene.has_mx(F.col("mx")).alias("has_mx"))


# -------------------------------------------------------------------- joins
@query("jn_01_leads_not_suppressed", f"""
    WITH o_keyed AS ({domain_sql('<<v_leads_raw>>', 'website')})
    SELECT pos, o_domain AS domain FROM o_keyed k
    WHERE NOT EXISTS (SELECT 1 FROM <<v_suppression>> s WHERE s.scope = 'domain' AND s.value = k.o_domain)""")
def jn_01(t):
    keyed = hygiene.with_domain(t("v_leads_raw"), URL)
    stops = hygiene.domain_suppressions(t("v_suppression"))
    return keyed.join(stops, F.lower("domain") == F.col("__stop"), "left_anti").select("pos", "domain")


@query("jn_03_leads_with_dns", f"""
    WITH o_keyed AS ({domain_sql('<<v_leads_raw>>', 'website')})
    SELECT k.pos, k.o_domain AS domain, coalesce(d.mx_host1 IS NOT NULL, false) AS has_mx,
           coalesce(len(list_filter([d.ns1, d.ns2], lambda h : {PARKED})) > 0, false) AS parked
    FROM o_keyed k LEFT JOIN <<v_dns>> d ON d.domain = k.o_domain""")
def jn_03(t):
    keyed = hygiene.with_domain(t("v_leads_raw"), URL).select("pos", "domain")
    facts = dns_table(t).select(F.col("domain").alias("__d"), "mx", "ns")
    return keyed.join(facts, F.col("domain") == F.col("__d"), "left").select(
        "pos", "domain", hygiene.has_mx(F.col("mx")).alias("has_mx"), hygiene.is_parked(F.col("ns")).alias("parked")
    )


# ---------------------------------------------------- partition and summary
@query("set_01_kept_leads", f"""
    WITH {TAGGED_SQL}, o_clean AS ({STRIPPED})
    SELECT g.pos, g.company, g.domain, g.domain AS website, c.cleaned AS original_url_cleaned, {GEO_SQL} AS geo
    FROM o_tagged g JOIN o_clean c ON c.pos = g.pos WHERE drop_reason IS NULL""")
def set_01_kept(t):
    return hygiene.kept_leads(tagged(t), URL).select("pos", "company", "domain", "website", "original_url_cleaned", "geo")


@query("set_01_dropped_leads", f"""
    WITH {TAGGED_SQL}
    SELECT pos, company, website, CASE WHEN drop_reason = 'invalid_url' THEN trim(website) ELSE domain END AS domain, drop_reason
    FROM o_tagged WHERE drop_reason IS NOT NULL AND drop_reason <> 'duplicate'""")
def set_01_dropped(t):
    return hygiene.dropped_leads(tagged(t), URL).select("pos", "company", "website", "domain", "drop_reason")


@query("ag_01_hygiene_summary", f"""
    WITH {TAGGED_SQL}
    SELECT count(*) AS total_input, count(*) FILTER (WHERE drop_reason = 'duplicate') AS duplicates_dropped,
           count(*) FILTER (WHERE drop_reason = 'invalid_url') AS invalid_url_dropped,
           count(*) FILTER (WHERE drop_reason = 'no_mx') AS no_mx_dropped,
           count(*) FILTER (WHERE drop_reason = 'parked_domain') AS parked_dropped,
           count(*) FILTER (WHERE drop_reason = 'globally_suppressed') AS suppressed_dropped,
           count(*) FILTER (WHERE drop_reason IS NULL) AS kept
    FROM o_tagged""")
def ag_01(t):
    return hygiene.hygiene_summary(tagged(t))


@query("hygiene_lead_fate", f"""
    WITH {TAGGED_SQL} SELECT pos, domain, coalesce(drop_reason, 'kept') AS fate FROM o_tagged""")
def lead_fate(t):
    """Flagship: which leads survive, and why the rest drop."""
    return tagged(t).select("pos", "domain", F.coalesce("drop_reason", F.lit("kept")).alias("fate"))
