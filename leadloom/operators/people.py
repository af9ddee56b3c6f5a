"""Named people of a site: cards, prose and filed officers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import urls
from leadloom.functions.text import all_matches, any_case, as_col, exact_case, strip
from leadloom.operators.ordering import keep_first
from leadloom.session import settle

# pattern, case-insensitive?, group of the name, group of the title
PROSE_PATTERNS = [
    (fixed.NAME_THEN_TITLE, False, 1, 2),
    (fixed.TITLE_THEN_NAME, False, 2, 1),
    (fixed.SELF_INTRODUCTION, True, 1, 2),
]


# A text without any of these words holds no mention; one pass tells.
TITLE_HINT = (
    r"(?iu)founder|chief executive|ceo|president|owner|director|head of sales|sales manager|vp of sales|"
    r"business development|marketing manager|general manager"
)


def prose_mentions(text: Column | str) -> Column:
    """array<struct<name, title, after>> over the three patterns in turn.

    `after` is the text that follows the match, for the other-company test.
    A look-ahead captures it, so a following match is not consumed.
    """
    text = as_col(text)
    found = []
    for pattern, ignore_case, name_at, title_at in PROSE_PATTERNS:
        flagged = (any_case if ignore_case else exact_case)(f"{pattern}(?=((?s:.{{0,{fixed.TRAILING_CHARS}}})))")
        whole = lambda g, p=flagged: F.regexp_extract_all(text, F.lit(p), F.lit(g))
        found.append(
            F.transform(
                F.arrays_zip(whole(name_at).alias("name"), whole(title_at).alias("title"), whole(3).alias("after")),
                lambda m: F.struct(
                    m["name"].alias("name"), m["title"].alias("title"), m["after"].alias("after")
                ),
            )
        )
    nothing = F.array().cast("array<struct<name:string,title:string,after:string>>")
    return F.when(text.rlike(TITLE_HINT), F.concat(*found)).otherwise(nothing)


def names_other_company(after: Column, own_key: Column) -> Column:
    """The text after a match names a company that is not this one."""
    pattern = exact_case(fixed.TRAILING_COMPANY)
    named = F.lower(F.regexp_replace(F.regexp_extract(after, pattern, 1), "[^a-zA-Z0-9]", ""))
    known = (named != "") & (own_key != "")
    return known & ~named.contains(own_key) & ~own_key.contains(named)


def prose_people(pages: DataFrame, pos: str = "pos") -> DataFrame:
    """(domain, pos, place, name, title) of every accepted mention.

    The outer generator gives a page without mentions one empty row, dropped
    behind it; the plain one would search every text twice, first for whether
    there is any.
    """
    mentions = (
        pages.where(F.col("page_type").isin(fixed.PROSE_PAGE_TYPES))
        .select("domain", F.col(pos).alias("pos"), F.posexplode_outer(prose_mentions("text")).alias("place", "m"))
        .where(F.col("place").isNotNull())
        .select("domain", "pos", "place", F.col("m.name").alias("name"), F.col("m.title").alias("title"),
                F.col("m.after").alias("after"))
    )
    return mentions.where(~names_other_company(F.col("after"), urls.company_key("domain"))).select(
        "domain", "pos", "place", strip(F.col("name")).alias("name"), strip(F.col("title")).alias("title")
    )


def officer_people(officers: DataFrame) -> DataFrame:
    """Filed officers per company: blanks dropped, first per name kept."""
    named = officers.withColumn("name", strip(F.coalesce("name", F.lit("")))).where(F.col("name") != "")
    titled = named.withColumn("title", F.coalesce(F.nullif("position", F.lit("")), F.lit("Officer")))
    return keep_first(titled.withColumn("__key", F.lower("name")), ["company_guess", "__key"], [F.col("pos")]).select(
        "company_guess", "pos", "name", "title"
    )


def officers_for(domains: DataFrame, officers: DataFrame) -> DataFrame:
    """Officer people of each domain, joined by the company guess."""
    guess = F.coalesce(F.nullif(F.initcap(urls.company_key("domain")), F.lit("")), F.col("domain"))
    people = officer_people(officers)
    return domains.select("domain", guess.alias("__guess")).distinct().join(
        people, F.col("__guess") == F.col("company_guess")
    ).select("domain", "pos", "name", "title")


def named_people(structural: DataFrame, prose: DataFrame, officers: DataFrame | None = None) -> DataFrame:
    """Union of the sources, first entry per lower-case name of a domain.

    structural: domain, pos, name, title; prose: domain, pos, place, name,
    title; officers (only for domains that name nobody): domain, pos, name,
    title.  Result: domain, pos, name, title, where pos is a sortable struct.
    With officers the others are written once, since they are read twice.
    """
    def rows(df: DataFrame, source: int, place: Column) -> DataFrame:
        order = F.struct(F.lit(source).alias("source"), F.col("pos").cast("long").alias("pos"), place.cast("int").alias("place"))
        return df.select("domain", order.alias("pos"), "name", F.coalesce("title", F.lit("")).alias("title"))

    found = rows(structural, 0, F.lit(0)).unionByName(rows(prose, 1, F.col("place")))
    if officers is not None:
        found = settle(found, "found-people")
        with_people = found.select(F.col("domain").alias("__d")).distinct()
        silent = officers.join(with_people, F.col("domain") == F.col("__d"), "left_anti")
        found = found.unionByName(rows(silent, 2, F.lit(0)))
    keyed = found.withColumn("__key", F.lower("name"))
    return keep_first(keyed, ["domain", "__key"], [F.col("pos")]).drop("__key")
