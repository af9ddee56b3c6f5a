"""Stored pages to text, addresses, people and crawl results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import html as H
from leadloom.functions import urls
from leadloom.functions.own_text import short_own_texts
from leadloom.functions.text import as_col, bind, first_of, matches, strip, words
from leadloom.operators.ordering import first_k, keep_first, spent_before
from leadloom.session import settle

# --------------------------------------------------------------------------
# People on a page
# --------------------------------------------------------------------------
def card_candidates(texts: Column) -> Column:
    """array<struct<kind, text>>: titles are tested before names, since a
    role such as 'Senior Engineer' is shaped like a name."""
    stops = fixed.CARD_NAME_STOP_WORDS

    def tagged(text: Column) -> Column:
        parts = F.transform(F.split(text, " "), lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", ""))
        is_title = (F.size(words(text)) <= fixed.CARD_MAX_TITLE_WORDS) & matches(text, fixed.CARD_TITLE_PATTERN)
        is_name = (
            text.rlike(fixed.CARD_NAME_PATTERN)
            & ~F.get(parts, F.lit(0)).isin(stops)
            & ~F.element_at(parts, -1).isin(stops)
        )
        kind = F.when(is_title, "title").when(is_name, "name")
        return F.struct(kind.alias("kind"), text.alias("text"))

    return F.filter(F.transform(texts, tagged), lambda c: c["kind"].isNotNull())


def followed_by_titles(candidates: Column) -> Column:
    """Each name with the title that comes next.

    The look-ahead for a title stops at the next name, and candidates are
    names or titles only, so a name is paired exactly when a title follows.
    """
    def paired(cards: Column) -> Column:
        following = F.transform(
            cards,
            lambda c, i: F.struct(c["kind"].alias("kind"), c["text"].alias("name"), F.get(cards, i + 1).alias("next")),
        )
        pairs = F.filter(following, lambda c: (c["kind"] == "name") & (c["next"]["kind"] == "title"))
        return F.transform(pairs, lambda c: F.struct(c["name"].alias("name"), c["next"]["text"].alias("title")))

    return bind(candidates, paired)


def pair_cards(candidates: Column, max_people: int = fixed.MAX_PEOPLE_PER_PAGE) -> Column:
    """Name and title pairs of a page, the first of each name."""
    return F.slice(distinct_people(followed_by_titles(candidates)), 1, max_people)


def distinct_people(people: Column) -> Column:
    """First entry per lower-case name of array<struct<name, title>>."""
    def firsts(listed: Column) -> Column:
        names = F.transform(listed, lambda p: F.lower(p["name"]))
        return bind(names, lambda ns: F.filter(listed, lambda p, i: F.array_position(ns, F.lower(p["name"])) == i + 1))

    return bind(people, firsts)


def jsonld_people(markup: Column | str, relations=None) -> Column:
    """Persons named in JSON-LD: array<struct<name, title>>."""
    relations = relations or fixed.PERSON_RELATIONS
    scripts = F.regexp_extract_all(
        as_col(markup),
        F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""),
        F.lit(1),
    )
    variants = F.filter(F.transform(scripts, lambda s: F.try_parse_json(strip(s))), lambda v: v.isNotNull())

    def as_list(v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def nodes(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return F.coalesce(graph, as_list(v), F.array(v))

    def of_relation(relation: str):
        def people(node: Column) -> Column:
            value = F.try_variant_get(node, f"$.{relation}", "variant")
            entries = F.coalesce(as_list(value), F.array(value))
            persons = F.filter(
                entries, lambda p: F.coalesce(F.try_variant_get(p, "$['@type']", "string") == "Person", F.lit(False))
            )
            return F.transform(
                persons,
                lambda p: F.struct(
                    strip(F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit(""))).alias("name"),
                    F.coalesce(
                        F.nullif(F.try_variant_get(p, "$.jobTitle", "string"), F.lit("")),
                        F.lit(relation.rstrip("s").capitalize()),
                    ).alias("title"),
                ),
            )
        return people

    def all_relations(node: Column) -> Column:
        return F.concat(*[of_relation(r)(node) for r in relations])

    found = F.flatten(F.transform(F.flatten(F.transform(variants, nodes)), all_relations))
    return distinct_people(F.filter(found, lambda p: p["name"] != ""))


# --------------------------------------------------------------------------
# Robots rules and page choice
# --------------------------------------------------------------------------
def robots_verdicts(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Add `allowed`.  Of one site's rules for the agent (or, without any, for
    `*`), the first whose path starts the URL's path decides; none allows.

    The lengths that a site's rules have come first; a URL gives one key per
    such length, so it has no more rows than its site's rules have lengths.
    """
    first_rule = (
        rule_keys(pages, rules, agent).join(
            chosen_rules(rules, agent), (F.col("__d") == F.col("__rd")) & (F.col("__p") == F.col("__prefix")))
        .groupBy("__d", "__u")
        .agg(F.min("__rule").alias("__first"))
    )
    return (
        pages.join(first_rule, (F.col("domain") == F.col("__d")) & (F.col("url") == F.col("__u")), "left")
        .withColumn("allowed", F.coalesce(F.col("__first.allow"), F.lit(True)))
        .drop("__d", "__u", "__first")
    )


def chosen_rules(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for the agent, by site and path."""
    named = rules.where(F.lower("agent") == agent.lower())
    own_sites = named.select(F.col("domain").alias("__od")).distinct()
    general = rules.where(F.col("agent") == "*").join(own_sites, F.col("domain") == F.col("__od"), "left_anti")
    return named.unionByName(general).select(
        F.col("domain").alias("__rd"),
        F.col("path").alias("__prefix"),
        F.struct(F.col("pos").alias("pos"), (F.col("allow") | (F.col("path") == "")).alias("allow")).alias("__rule"),
    )


def rule_keys(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Each URL's starts of the lengths that its site's rules have: (__d, __u, __p)."""
    lengths = chosen_rules(rules, agent).groupBy(F.col("__rd").alias("__ld")).agg(F.collect_set(F.length("__prefix")).alias("__lengths"))
    target = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    target = F.when(target == "", "/").otherwise(target)
    keyed = pages.select("domain", "url").distinct().withColumn("__t", target).join(lengths, F.col("domain") == F.col("__ld"))
    fitting = F.filter("__lengths", lambda n: n <= F.length("__t"))
    return keyed.select(
        F.col("domain").alias("__d"), F.col("url").alias("__u"), F.explode(F.transform(fitting, lambda n: F.left(F.col("__t"), n))).alias("__p"))


def nav_picks(home_pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages picked from each home page's links:
    (domain, page_type, type_pos, slot, url)."""
    picked = home_pages.select("domain", H.pick_links(F.col(url), H.links(F.col(html))).alias("picks"))
    types = F.array_distinct(F.transform("picks", lambda p: p["page_type"]))
    rows = picked.select("domain", types.alias("types"), F.posexplode("picks").alias("i", "p"))
    same_type = F.col("p.page_type")
    return rows.select(
        "domain",
        same_type.alias("page_type"),
        F.array_position("types", same_type).cast("int").alias("type_pos"),
        F.col("i").alias("slot"),
        F.col("p.url").alias("url"),
    )


def sitemap_picks(locations: DataFrame, max_locations: int = fixed.MAX_SITEMAP_LOCATIONS) -> DataFrame:
    """Pages picked from sitemap locations by path alone; a URL may serve
    several types, and is used once per type."""
    base = urls.root_url("domain")
    resolved = F.when(
        F.trim("loc").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.trim("loc")
    ).otherwise(_resolve_keeping_query(base, F.trim("loc")))
    typed = (
        locations.where(F.col("pos") <= max_locations)
        .withColumn("url", resolved)
        .select("domain", "pos", "url", F.posexplode(urls.page_types(urls.path_of("url"))).alias("__o", "page_type"))
    )
    order = F.array_position(F.array(*[F.lit(n) for n, _ in fixed.PAGE_TYPE_PATTERNS]), F.col("page_type"))
    distinct = keep_first(typed, ["domain", "page_type", "url"], [F.col("pos")])
    limit = max([fixed.DEFAULT_PAGES_PER_TYPE, *fixed.PAGES_PER_TYPE.values()])
    ranked = first_k(distinct, ["domain", "page_type"], [F.col("pos")], limit, "slot")
    picks = ranked.where(F.col("slot") <= H.page_limit(F.col("page_type"))).withColumn("__order", order)
    # At most a handful of picks per domain remain here.
    first_pos = F.min(F.struct("pos", "__order")).over(Window.partitionBy("domain", "page_type"))
    place = F.dense_rank().over(Window.partitionBy("domain").orderBy("__fp"))
    return (
        picks.withColumn("__fp", first_pos)
        .withColumn("type_pos", place)
        .select("domain", "page_type", "type_pos", "slot", "url")
    )


def _resolve_keeping_query(base: Column, href: Column) -> Column:
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return F.concat(urls.resolve_link(base, href), tail)


def merge_picks(nav: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Navigation first, topped up from the sitemap to each type's limit."""
    both = nav.select("*", F.lit(0).alias("__src")).unionByName(sitemap.select("*", F.lit(1).alias("__src")))
    distinct = keep_first(both, ["domain", "page_type", "url"], [F.col("__src"), F.col("slot")])
    limit = max([fixed.DEFAULT_PAGES_PER_TYPE, *fixed.PAGES_PER_TYPE.values()])
    ranked = first_k(distinct, ["domain", "page_type"], [F.col("__src"), F.col("slot")], limit, "__n")
    kept = ranked.where(F.col("__n") <= H.page_limit(F.col("page_type")))
    place = F.min(F.struct("__src", "type_pos")).over(Window.partitionBy("domain", "page_type"))
    return kept.withColumn("__place", place).select(
        "domain", "page_type", F.col("__n").alias("slot"), "url", F.col("__src").alias("source"), "__place"
    )


def visit_list(home: DataFrame, picks: DataFrame, max_pages: int = fixed.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """Home page, then picks in order of discovery, up to the page cap:
    (domain, visit_pos, page_type, url)."""
    none = F.struct(F.lit(-1).alias("__src"), F.lit(-1).alias("type_pos"))
    start = home.select("domain", F.lit("home").alias("page_type"), "url", none.alias("__place"), F.lit(0).alias("slot"))
    rest = picks.select("domain", "page_type", "url", "__place", "slot")
    ordered = first_k(start.unionByName(rest), ["domain"], [F.col("__place"), F.col("slot")], max_pages, "visit_pos")
    return ordered.select("domain", "visit_pos", "page_type", "url")


def home_pages(domains: DataFrame, stored: DataFrame) -> DataFrame:
    """One home page per domain: (domain, page_type, url, html) and what else is stored.

    Rows marked as home come first, then the root URL, its www form and its
    plain form, each only if fetched; a domain without any has its root URL and
    no HTML, with the error of the first try.
    """
    bare = F.regexp_replace("url", "[/?#]+$", "")
    domain = F.col("domain")
    forms = [urls.root_url(domain), urls.root_url(F.concat(F.lit("www."), domain)), urls.root_url(domain, "http")]
    marked = F.col("page_type") == "home" if "page_type" in stored.columns else F.lit(False)
    form = first_of([(F.coalesce(marked, F.lit(False)), F.lit(0)), *[(bare == f, F.lit(i)) for i, f in enumerate(forms, 1)]], F.lit(None).cast("int"))
    tries = stored.withColumn("__form", form).where(F.col("__form").isNotNull())
    best = keep_first(tries, ["domain"], [F.col("html").isNull(), F.col("__form"), F.col("url")]).drop("__form")
    found = domains.join(best, "domain", "left")
    return found.withColumn("url", F.coalesce("url", urls.root_url(domain))).withColumn("page_type", F.lit("home"))


def visited_pages(domains: DataFrame, stored: DataFrame, robots: DataFrame, agent: str, sitemap: DataFrame | None = None,
                  max_pages: int = fixed.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """The pages a crawl of the domains visits, in order of discovery.

    The home page's links, topped up from the sitemap, choose the pages; the
    stored page with that URL is what a fetch gives, and a URL that is not
    stored is a page that was not fetched.  A home page that robots rules
    refuse, that is missing, or that is a wall is the only row of its domain.
    """
    homes = settle(robots_verdicts(home_pages(domains, stored), robots, agent), "homes")
    open_ = homes.where(F.col("allowed") & F.col("html").isNotNull() & ~H.looks_blocked("html"))
    picks = nav_picks(open_)
    if sitemap is not None:
        listed = sitemap_picks(sitemap.join(open_.select("domain"), "domain", "left_semi"))
        picks = merge_picks(picks, listed)
    else:
        picks = merge_picks(picks, picks.limit(0))
    visits = visit_list(homes, picks, max_pages)
    held = [c for c in stored.columns if c not in ("domain", "url", "page_type", "visit_pos")]
    copies = keep_first(stored, ["domain", "url"], [F.col("html").isNull(), *[F.col(c) for c in ("pos",) if c in stored.columns]])
    others = visits.where(F.col("page_type") != "home").join(copies.select("domain", "url", *held), ["domain", "url"], "left")
    others = robots_verdicts(others, robots, agent)
    first = homes.withColumn("visit_pos", F.lit(1))
    return first.unionByName(others, allowMissingColumns=True).withColumn("fetched", F.col("html").isNotNull())


def cap_pages(pages: DataFrame, max_pages: int = fixed.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """First pages per domain, the home page before the rest."""
    home_first = F.when(F.col("page_type") == "home", 0).otherwise(1)
    return first_k(pages, ["domain"], [home_first, F.col("pos")], max_pages, "visit_pos")


# --------------------------------------------------------------------------
# Text budget and crawl results
# --------------------------------------------------------------------------
def apply_text_budget(pages: DataFrame, budget: int = fixed.MAX_CHARS_PER_DOMAIN, pos: str = "visit_pos",
                      text: str = "text") -> DataFrame:
    """Cut each domain's text at `budget` characters in page order: the page
    that crosses it is shortened.  Adds `chars` and `budget_left`; pages
    reached with nothing left have budget_left <= 0.

    The pages are written once; what was spent before a page comes from an
    index of lengths, so no text is extracted or shuffled for it.
    """
    spent = spent_before(pages, pos, text, "__spent")
    return (
        spent.withColumn("budget_left", F.lit(budget) - F.col("__spent"))
        .withColumn(text, F.expr(f"substring({text}, 1, cast(greatest(budget_left, 0) as int))"))
        .withColumn("chars", F.length(F.coalesce(F.col(text), F.lit(""))))
        .drop("__spent")
    )


def read_pages(visited: DataFrame, markdown: bool = False) -> DataFrame:
    """Extract everything one page holds.  Expects domain, url, page_type,
    visit_pos, html, content_type, allowed; HTML that is a wall or a page
    robots rules forbid gives nothing; documents arrive as text."""
    people_page = F.col("page_type").isin("team", "about")
    no_people = F.array().cast("array<struct<name:string,title:string>>")
    # Each step is a projection that the next reads several times, so markup is cut and decoded once.
    pages = visited.withColumn("__doc", urls.is_pdf("url")).withColumn("__live", H.live_markup("html")).withColumn("__visible", H.visible_of(F.col("__live")))
    pages = pages.withColumn("__wall", ~F.col("__doc") & H.is_wall(F.col("__visible")))
    pages = pages.withColumn("blocked", F.col("allowed") & F.coalesce("__wall", F.lit(False)))
    readable = F.col("allowed") & ~F.col("__wall") & F.col("html").isNotNull()
    pages = pages.withColumn("__document", readable & F.col("__doc")).withColumn("__page", readable & ~F.col("__doc"))
    pages = pages.withColumn("__own", short_own_texts(F.when(F.col("__page") & people_page, F.col("html"))))
    return (
        pages.withColumn("text", first_of([(F.col("__document"), F.col("html")), (F.col("__page"), H.text_of(F.col("__live"), markdown))], F.lit("")))
        .withColumn(
            "emails",
            first_of(
                [
                    (F.col("__page"), H.real_addresses(H.addresses_of(F.col("__live"), F.col("__visible")))),
                    (F.col("__document"), H.real_addresses(F.array_distinct(H.addresses_in_text("html")))),
                ],
                F.array().cast("array<string>"),
            ),
        )
        .withColumn(
            "people",
            F.concat(
                F.when(F.col("__page") & people_page, pair_cards(card_candidates(F.col("__own")))).otherwise(no_people),
                F.when(F.col("__page"), jsonld_people("html")).otherwise(no_people),
            ),
        )
        .withColumn("source_type", F.when(F.col("__doc"), "pdf"))
        .drop("__own", "__doc", "__live", "__visible", "__wall", "__document", "__page", "html")
    )


def low_content(page_type: Column, chars: Column, is_document: Column, limit: int = fixed.LOW_CONTENT_CHARS) -> Column:
    return (page_type == "home") & (chars < limit) & ~is_document


def crawl_results(read: DataFrame, as_of: Column, max_people: int = fixed.MAX_PEOPLE_PER_DOMAIN,
                  budget: int = fixed.MAX_CHARS_PER_DOMAIN) -> DataFrame:
    """One row per domain in the shape of a crawl result.

    Groups hold at most the page cap's rows, so the lists stay small.  Pages
    may carry `fetch_sec` and `fetch_error`.  Addresses of a document are those
    of the text within the budget.
    """
    reached = with_document_addresses(apply_text_budget(read, budget).where(F.col("budget_left") > 0))
    seconds = F.sum("fetch_sec") if "fetch_sec" in read.columns else F.lit(0.0)
    cause = F.max(F.when(F.col("page_type") == "home", F.col("fetch_error"))) if "fetch_error" in read.columns else F.lit(None).cast("string")
    page = F.struct(
        "visit_pos", "url", "page_type", "text", "chars",
        low_content(F.col("page_type"), F.col("chars"), F.col("source_type").isNotNull()).alias("low_content"),
        "source_type",
    )
    listed = F.when(F.col("chars") > 0, page)
    homes = F.col("page_type") == "home"
    rows = reached.groupBy("domain").agg(
        F.array_sort(F.collect_list(listed)).alias("__pages"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("visit_pos", "people"))), lambda r: r["people"])).alias("__people"),
        F.array_distinct(F.flatten(F.collect_list("emails"))).alias("__emails"),
        F.sum("chars").cast("int").alias("total_chars"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("blocked") & ~homes, F.struct("visit_pos", "url")))), lambda r: r["url"]
        ).alias("blocked_pages"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("allowed") & ~homes, F.struct("visit_pos", "url")))), lambda r: r["url"]
        ).alias("robots_skipped"),
        F.bool_or(homes & ~F.col("allowed")).alias("__refused"),
        F.bool_or(homes & F.col("blocked")).alias("__walled"),
        F.bool_or(homes & F.col("fetched")).alias("__home"),
        F.round(F.coalesce(seconds.cast("double"), F.lit(0.0)), 2).alias("duration_sec"),
        cause.alias("__cause"),
    )
    return rows.select("domain", as_of.alias("crawled_at"), *_result_columns(max_people))


def with_document_addresses(reached: DataFrame) -> DataFrame:
    """A document's addresses are taken from what the budget leaves of its text."""
    found = H.real_addresses(F.array_distinct(H.addresses_in_text("text")))
    return reached.withColumn("emails", F.when(F.col("source_type").isNotNull(), found).otherwise(F.col("emails")))


def _result_columns(max_people: int) -> list[Column]:
    """A refused, walled or missing home page leaves the result empty."""
    usable = ~F.col("__refused") & ~F.col("__walled") & F.col("__home")
    status = crawl_status(
        F.col("__refused"), F.col("__walled"), F.col("__home"),
        (F.size("__pages") > 0) | (F.size("__emails") > 0) | (F.size("__people") > 0),
    )
    pages = F.transform(
        "__pages",
        lambda p: F.struct(*[p[n].alias(n) for n in ("url", "page_type", "text", "chars", "low_content", "source_type")]),
    )
    people = F.slice(distinct_people(F.col("__people")), 1, max_people)
    emails = H.own_domain_first(F.col("__emails"), F.col("domain"))
    return [
        status.alias("status"),
        F.when(usable, pages).otherwise(F.slice(pages, 1, 0)).alias("pages"),
        F.when(usable, emails).otherwise(F.slice(emails, 1, 0)).alias("emails"),
        F.when(usable, people).otherwise(F.slice(people, 1, 0)).alias("team_members"),
        F.when(usable, F.col("total_chars")).otherwise(0).alias("total_chars"),
        F.when(usable, F.col("blocked_pages")).otherwise(F.slice("blocked_pages", 1, 0)).alias("blocked_pages"),
        F.when(usable, F.col("robots_skipped")).otherwise(F.slice("robots_skipped", 1, 0)).alias("robots_skipped"),
        F.col("duration_sec"),
        crawl_error(status, F.col("__home"), F.col("__cause")).alias("error"),
    ]


def crawl_error(status: Column, home_fetched: Column, cause: Column) -> Column:
    """What went wrong, in words; NULL for a good result."""
    return first_of(
        [
            (status == "robots_disallowed", F.lit("robots rules refuse the home page")),
            (status == "blocked", F.lit("home page is behind a bot wall")),
            ((status == "crawl_failed") & ~home_fetched, F.concat(F.lit("home page not fetched: "), F.coalesce(cause, F.lit("unknown")))),
            (status == "crawl_failed", F.lit("no text, address or person on any page")),
        ],
        F.lit(None).cast("string"),
    )


def crawl_status(refused: Column, walled: Column, home_fetched: Column, has_content: Column) -> Column:
    return first_of(
        [
            (refused, F.lit("robots_disallowed")),
            (~home_fetched, F.lit("crawl_failed")),
            (walled, F.lit("blocked")),
            (has_content, F.lit("ok")),
        ],
        F.lit("crawl_failed"),
    )


def stale_domains(domains: DataFrame, crawled: DataFrame, as_of: Column, cache_days: int = fixed.CACHE_DAYS) -> DataFrame:
    """Domains without a good result younger than the cache period."""
    age_days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("crawled_at")) / 86400)
    fresh = crawled.where((F.col("status") == "ok") & (age_days < cache_days)).select(F.col("domain").alias("__fresh"))
    return domains.join(fresh, F.col("domain") == F.col("__fresh"), "left_anti")


def status_rollup(results: DataFrame) -> DataFrame:
    status = F.col("status")
    return results.agg(
        F.count_if(status == "ok").alias("ok"),
        F.count_if(~F.coalesce(status, F.lit("")).isin("ok", "blocked", "robots_disallowed")).alias("failed"),
        F.count_if(status == "blocked").alias("blocked"),
        F.count_if(status == "robots_disallowed").alias("robots_disallowed"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One line per domain of a crawl run."""
    return results.select(
        "domain",
        "status",
        F.size("pages").alias("pages"),
        F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
        F.size("emails").alias("emails_found"),
        F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
