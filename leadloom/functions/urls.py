"""URLs, hosts and registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.suffixes import SuffixRules, default_rules, suffix_labels
from leadloom.functions.text import (
    as_col, bind, blank_to_null, first_of, matches, quote_plus, strip, unquote_plus, words,
)


def host_of(url: Column | str) -> Column:
    """Host in lower case, without user, port or trailing dots."""
    found = F.regexp_extract(as_col(url), r"^(?:(?:[a-zA-Z0-9+.\-]+:)?//)?(?:[^/?#]*@)?([^/?#@:]*)", 1)
    return F.lower(F.rtrim(F.trim(found), F.lit(".")))


def _last_labels(host: Column, n: Column) -> Column:
    """The last n labels of a host; an empty string for none."""
    labels = F.split(host, r"\.")
    return F.when(n > 0, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")).otherwise("")


def suffix_of(host: Column, rules: SuffixRules | None = None) -> Column:
    """Longest public suffix of a host, or an empty string."""
    return bind(host, lambda h: bind(suffix_labels(h, rules or default_rules()), lambda n: _last_labels(h, n)))


def registrable_domain(raw: Column | str, rules: SuffixRules | None = None) -> Column:
    """The domain a lead is keyed by; an empty string when there is none.

    A text that does not start with "http" gets a scheme in front.
    """
    text = strip(as_col(raw))

    def with_label(h: Column) -> Column:
        def cut(n: Column) -> Column:
            domain = _last_labels(h, n + 1)
            return F.when((n > 0) & (F.size(F.split(h, r"\.")) > n) & ~domain.startswith("."), domain).otherwise("")

        return bind(suffix_labels(h, rules or default_rules()), cut)

    return bind(host_of(F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))), with_label)


def geo_tag(domain: Column | str, rules: SuffixRules | None = None, countries: dict | None = None) -> Column:
    countries = countries or fixed.COUNTRY_BY_SUFFIX_LABEL
    table = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])
    tags = F.transform(F.split(suffix_of(host_of(domain), rules), r"\."), lambda label: table[label])
    return F.coalesce(F.get(F.filter(tags, lambda t: t.isNotNull()), F.lit(0)), F.lit("unknown"))


def strip_tracking(url: Column | str, prefixes=None, names=None) -> Column:
    """Remove tracking parameters and re-encode the rest of the query."""
    url = as_col(url)
    prefixes, names = prefixes or fixed.TRACKING_PREFIXES, names or fixed.TRACKING_NAMES
    base = F.split_part(url, F.lit("#"), F.lit(1))
    fragment = F.regexp_extract(url, r"#(.+)$", 1)
    query = F.regexp_extract(base, r"^[^?]*\?(.*)$", 1)

    def decoded(part: Column) -> Column:
        key, value = F.regexp_extract(part, "^([^=]*)", 1), F.regexp_extract(part, "=(.*)$", 1)
        return F.struct(unquote_plus(key).alias("k"), unquote_plus(value).alias("v"))

    def wanted(pair: Column) -> Column:
        key = F.lower(pair["k"])
        tracked = key.isin(list(names))
        for prefix in prefixes:
            tracked = tracked | key.startswith(prefix)
        return ~tracked

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), decoded)
    rebuilt = F.array_join(
        F.transform(F.filter(pairs, wanted), lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))),
        "&",
    )
    front = F.ltrim(F.split_part(base, F.lit("?"), F.lit(1)))
    scheme = F.regexp_extract(front, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    front = F.concat(F.lower(scheme), F.substr(front, F.length(scheme) + 1))
    cleaned = F.concat(
        front,
        F.when(rebuilt != "", F.concat(F.lit("?"), rebuilt)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(query == "", url).otherwise(F.regexp_replace(cleaned, r"\?+$", ""))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def path_of(url: Column | str) -> Column:
    """Path part of an absolute or relative URL, as written."""
    url = as_col(url)
    rest = F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def is_pdf(url: Column | str) -> Column:
    return F.lower(path_of(url)).endswith(".pdf")


def root_url(domain: Column | str, scheme: str = "https") -> Column:
    return F.concat(F.lit(f"{scheme}://"), as_col(domain))


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(path, "/")
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: first_of(
            [
                (seg == ".", acc),
                (seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))),
            ],
            F.array_append(acc, seg),
        ),
    )
    closed = F.when(path.rlike(r"(^|/)\.\.?$"), F.array_append(resolved, F.lit(""))).otherwise(resolved)
    return F.coalesce(blank_to_null(F.array_join(closed, "/")), F.lit("/"))


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """href against base, cut at the query and the fragment."""
    base, href = as_col(base), as_col(href)
    cut = F.regexp_extract(href, r"^([^?#]*)", 1)
    origin = F.concat(scheme_of(base), F.lit("://"), netloc_of(base))
    base_path = path_of(base)
    folder = F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1)
    joined = F.concat(F.coalesce(blank_to_null(folder), F.lit("/")), cut)
    dotted = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(joined)).otherwise(joined)
    rooted = F.when(cut.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(cut)).otherwise(cut)
    return first_of(
        [
            (cut.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), cut),
            (cut == "", F.concat(origin, base_path)),
            (cut.startswith("//"), F.concat(scheme_of(base), F.lit(":"), cut)),
            (cut.startswith("/"), F.concat(origin, rooted)),
        ],
        F.concat(origin, F.regexp_replace(dotted, "(?<=/)/+", "")),
    )


def same_site(base: Column, url: Column) -> Column:
    return netloc_of(base) == netloc_of(url)


def page_types(path: Column | str, link_text: Column | str | None = None, patterns=None) -> Column:
    """Array of page types a link fits, in the order of the table.

    Link text counts only when it reads like a menu item (four words or fewer).
    """
    path = as_col(path)
    patterns = patterns or fixed.PAGE_TYPE_PATTERNS
    nav_text = None
    if link_text is not None:
        text = as_col(link_text)
        nav_text = F.when(F.size(words(text)) <= 4, text).otherwise("")
    hits = []
    for name, pattern in patterns:
        hit = matches(path, pattern)
        if nav_text is not None:
            hit = hit | matches(nav_text, pattern)
        hits.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def company_key(domain: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.split_part(as_col(domain), F.lit("."), F.lit(1))), "[^a-z0-9]", "")


def company_display(domain: Column | str) -> Column:
    parts = F.split(F.split_part(as_col(domain), F.lit("."), F.lit(1)), "[-_]")
    return F.array_join(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.initcap(w)), " ")


def web_search_url(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="), quote_plus(query))


def person_search_url(name: Column | str, domain: Column | str) -> Column:
    return web_search_url(
        F.concat(F.lit('"'), as_col(name), F.lit('" '), as_col(domain), F.lit(" site:linkedin.com/in"))
    )


def error_class(message: Column | str, markers=None) -> Column:
    message = as_col(message)
    hit = F.lit(False)
    for marker in markers or fixed.PERMANENT_ERROR_MARKERS:
        hit = hit | F.coalesce(message.contains(marker), F.lit(False))
    return F.when(hit, "permanent").otherwise("transient")


def reverse_ip(ip: Column | str) -> Column:
    return F.array_join(F.reverse(F.split(as_col(ip), r"\.")), ".")
