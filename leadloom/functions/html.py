"""Text, links and addresses out of stored HTML, as column expressions.

Markup is read with regular expressions on the JVM; only the own-text
tokeniser of team cards (operators.pages) needs a parser with a stack.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import urls
from leadloom.functions.dictionary import Dictionary
from leadloom.functions.text import as_col, bind, collapse_space, first_of, matches, strip

#: A character reference, or a text that starts like one.
REFERENCE = "&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: Characters by name, as the standard has them; old names may lack the semicolon.
NAMED_REFERENCES = {name: text for name, text in html5.items()}
OLD_NAMES = {name: text for name, text in html5.items() if not name.endswith(";")}
_OLD_START = "^(" + "|".join(sorted(OLD_NAMES, key=len, reverse=True)) + ")"
#: What most references of a page are; tried before the whole table.
COMMON_REFERENCES = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "rsquo;", "ndash;", "mdash;", "copy;")
#: What numbers of control characters stand for on pages: the characters that one old code page has there.
CODE_PAGE = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}
DROPPED_ELEMENTS = ["nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button", "select"]
BLOCK_ELEMENTS = [
    "address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "title", "tr", "ul",
]
_NAMED, _OLD = Dictionary(NAMED_REFERENCES), Dictionary(OLD_NAMES)
_CODE_PAGE = Dictionary({str(n): text for n, text in CODE_PAGE.items()})
TAG = r"<[a-zA-Z/!?][^>]*>"
# Possessive, so that a run of any length takes no stack.
TAG_RUN = r"(?s)(?:<[a-zA-Z/!?][^>]*+>)++"


def decode_entities(text: Column) -> Column:
    """Character references decoded in one pass, so what a reference gives is never read as one again.

    The text is cut before each reference; each is looked up once, by name or
    number.  Old names without a semicolon count as far as they go; unknown
    names stay; numbers that are no character become the replacement mark.
    """
    def numbered(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
        number = F.when(F.length(digits) <= 7, F.when(code == "", "0").otherwise(code).cast("int")).otherwise(0)
        bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(number.between(0x80, 0x9F), F.coalesce(_CODE_PAGE.value(number.cast("string")), sign)).otherwise(sign)

    def named(reference: Column) -> Column:
        name = F.substr(reference, F.lit(2))
        start = F.regexp_extract(name, _OLD_START, 1)
        old = F.when(start != "", F.concat(_OLD.value(start), F.substr(name, F.length(start) + 1)))
        return first_of([(name == n, F.lit(NAMED_REFERENCES[n])) for n in COMMON_REFERENCES], F.coalesce(_NAMED.value(name), old, reference))

    def decoded(cut: Column) -> Column:
        reference, part = cut["reference"], cut["part"]
        sign = F.when(reference.startswith("&#"), numbered(reference)).otherwise(named(reference))
        return F.when(reference == "", part).otherwise(F.concat(sign, F.substr(part, F.length(reference) + 1)))

    def whole(t: Column) -> Column:
        # No function in here refers to `t`: a Python function's input may hold nested functions, but not such references.
        parts = F.transform(F.split(t, "(?=&[#A-Za-z])"), lambda p: F.struct(F.regexp_extract(p, f"^{REFERENCE}", 0).alias("reference"), p.alias("part")))
        return F.when(t.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(t)

    return bind(text, whole)


def without_elements(html: Column, names: list[str]) -> Column:
    """Elements cut out; one that is never closed ends with the page, as in a parser."""
    return F.regexp_replace(html, rf"(?is)<({'|'.join(names)})\b[^>]*+>.*?(?:</\1\s*+>|\z)", " ")


def live_markup(html: Column | str) -> Column:
    """HTML without comments, scripts, styles and templates."""
    bare = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", "")
    return without_elements(bare, ["script", "style", "template"])


def visible_text(html: Column | str) -> Column:
    """Every visible string, tags replaced by one blank."""
    return visible_of(live_markup(html))


def visible_of(live: Column) -> Column:
    return decode_entities(F.ltrim(F.regexp_replace(live, TAG_RUN, " ")))


def looks_blocked(html: Column | str, sample_chars: int = fixed.BLOCK_SAMPLE_CHARS) -> Column:
    return is_wall(visible_text(html), sample_chars)


def is_wall(visible: Column, sample_chars: int = fixed.BLOCK_SAMPLE_CHARS) -> Column:
    """Whether visible text is that of a page that keeps robots out."""
    return matches(F.substring(visible, 1, sample_chars), fixed.BLOCK_WALL_PATTERN)


def links(html: Column | str) -> Column:
    """array<struct<href, text>> in document order."""
    def parts(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"(?is)^<a\s[^>]*>(.*?)(?:</a|$)", 1)
        strings = F.transform(F.split(inner, rf"(?s){TAG}"), lambda s: strip(decode_entities(s)))
        return F.struct(_target(piece).alias("href"), F.array_join(strings, "").alias("text"))

    return F.transform(_anchors(live_markup(html)), parts)


def _anchors(live: Column) -> Column:
    """Pieces of markup that start with a link's tag."""
    return F.filter(F.split(live, r"(?i)(?=<a\s)"), lambda piece: piece.rlike(r"(?is)^<a\s[^>]*?\bhref\s*="))


def _target(piece: Column) -> Column:
    opening = F.regexp_extract(piece, r"(?s)^(<a\s[^>]*>)", 1)
    found = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return decode_entities(F.concat(*[F.regexp_extract(opening, found, g) for g in (1, 2, 3)]))


def is_real_address(address: Column, junk_domains=None) -> Column:
    domain = F.regexp_extract(address, "@([^@]*)$", 1)
    return ~(
        address.rlike(fixed.IMAGE_SUFFIX_PATTERN)
        | domain.isin(list(junk_domains or fixed.JUNK_EMAIL_DOMAINS))
        | domain.rlike("(?U)" + fixed.PLACEHOLDER_DOMAIN_PATTERN)
    )


def real_addresses(addresses: Column, junk_domains=None) -> Column:
    return F.filter(addresses, lambda a: is_real_address(a, junk_domains))


def addresses_in_text(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(as_col(text), F.lit(fixed.EMAIL_PATTERN), F.lit(0)), lambda a: F.lower(a))


def raw_addresses(html: Column | str) -> Column:
    """Distinct lower-case addresses of mailto links and of the visible text."""
    return bind(live_markup(html), lambda live: addresses_of(live, visible_of(live)))


def addresses_of(live: Column, visible: Column) -> Column:
    """The same from live markup and its visible text."""
    targets = F.transform(
        F.filter(F.transform(_anchors(live), _target), lambda href: F.lower(href).startswith("mailto:")),
        lambda href: strip(F.split_part(F.substr(href, F.lit(8)), F.lit("?"), F.lit(1))),
    )
    linked = F.transform(
        F.filter(targets, lambda t: t.rlike(f"^(?:{fixed.EMAIL_PATTERN})$")), lambda t: F.lower(t)
    )
    return F.array_union(linked, addresses_in_text(visible))


def own_domain_first(addresses: Column, site_domain: Column) -> Column:
    """Addresses on the site's own domain first, then by alphabet."""
    keyed = F.transform(
        addresses, lambda a: F.struct((~a.endswith(F.concat(F.lit("@"), site_domain))).alias("other"), a.alias("a"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def page_addresses(html: Column | str, site_domain: Column | str) -> Column:
    return own_domain_first(real_addresses(raw_addresses(html)), as_col(site_domain))


def clean_text(html: Column | str, markdown: bool = False) -> Column:
    """Running text of a page: chrome dropped, one block per line, table
    cells split by a bar; with `markdown`, headings, list items, links and
    emphasis keep their marks.  The rules are this library's own."""
    return text_of(live_markup(html), markdown)


def text_of(live: Column, markdown: bool = False) -> Column:
    """The same from live markup."""
    body = without_elements(without_elements(live, ["head"]), DROPPED_ELEMENTS)
    body = F.regexp_replace(body, r"(?U)\s+", " ")
    if markdown:
        for level in range(1, 7):
            body = F.regexp_replace(body, rf"(?i)<h{level}\b[^>]*>\s*", f"<p>{'#' * level} ")
        body = F.regexp_replace(body, r"(?i)<li\b[^>]*>\s*", "<li>- ")
        body = F.regexp_replace(body, r"(?i)</?(?:b|strong)\b[^>]*>", "**")
        body = F.regexp_replace(body, r"(?i)</?(?:i|em)\b[^>]*>", "*")
        body = F.regexp_replace(body, r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    body = F.regexp_replace(body, r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | ")
    body = F.regexp_replace(body, rf"(?i)</?(?:{'|'.join(BLOCK_ELEMENTS)})\b[^>]*>", "\n")
    lines = F.split(decode_entities(F.regexp_replace(body, TAG, "")), "\n")
    return F.array_join(F.filter(F.transform(lines, collapse_space), lambda line: line != ""), "\n")


def pick_links(base: Column | str, found: Column | str, patterns=None, limits=None) -> Column:
    """Choose pages to visit from one page's links, in document order.

    Each link goes to the first page type it fits that still has room; a URL
    is used once.  Returns array<struct<page_type, url>>.
    """
    base, found = as_col(base), as_col(found)
    limits = fixed.PAGES_PER_TYPE if limits is None else limits
    picks = F.array().cast("array<struct<page_type:string,url:string>>")
    candidates = F.filter(
        F.transform(
            found,
            lambda a: F.struct(
                urls.page_types(urls.path_of(a["href"]), a["text"], patterns).alias("types"),
                urls.resolve_link(base, a["href"]).alias("url"),
            ),
        ),
        lambda c: (F.size(c["types"]) > 0) & urls.same_site(base, c["url"]),
    )

    def step(acc: Column, c: Column) -> Column:
        def room(t: Column) -> Column:
            taken = F.size(F.filter(acc, lambda p: p["page_type"] == t))
            return taken < page_limit(t, limits)

        open_types = F.filter(c["types"], room)
        fresh = ~F.exists(acc, lambda p: p["url"] == c["url"]) & (F.size(open_types) > 0)
        pick = F.struct(F.get(open_types, F.lit(0)).alias("page_type"), c["url"].alias("url"))
        return F.when(fresh, F.array_append(acc, pick)).otherwise(acc)

    return F.aggregate(candidates, picks, step)


def page_limit(page_type: Column, limits=None) -> Column:
    limits = fixed.PAGES_PER_TYPE if limits is None else limits
    chain = F.lit(fixed.DEFAULT_PAGES_PER_TYPE)
    for name, limit in limits.items():
        chain = F.when(page_type == name, F.lit(limit)).otherwise(chain)
    return chain
