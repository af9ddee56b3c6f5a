"""Prompts over crawled pages, and answers checked against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions import prompts as P
from leadloom.functions import responses as R
from leadloom.functions.text import first_of
from leadloom.operators.ordering import keep_first, spent_before
from leadloom.schemas import ANALYSIS_FIELDS

QUOTED_FIELDS = ["recent_events", "pains", "hooks"]


def pages_of(crawled: DataFrame) -> DataFrame:
    """(domain, pos, url, page_type, text) of every page of crawl results."""
    return crawled.select("domain", F.posexplode("pages").alias("pos", "p")).select(
        "domain", "pos", F.col("p.url").alias("url"), F.col("p.page_type").alias("page_type"), F.col("p.text").alias("text")
    )


def prompt_chunks(pages: DataFrame, max_chars: int = fixed.MAX_PROMPT_CHARS) -> DataFrame:
    """Header and text of each page, cut at the domain's budget.

    The newline that joins chunks is not charged.  Every header is at least
    24 characters, so a domain keeps at most max_chars / 24 chunks.
    """
    chunk = F.concat(P.page_header(F.col("url"), F.col("page_type")), F.coalesce("text", F.lit("")))
    sized = pages.select("domain", "pos", "url", chunk.alias("chunk"))
    spent = spent_before(sized, "pos", "chunk", "spent")
    return (
        spent.where(F.col("spent") < max_chars)
        .withColumn("chunk", F.expr(f"substring(chunk, 1, cast({max_chars} - spent as int))"))
        .select("domain", "pos", "url", "chunk")
    )


def extraction_prompts(crawled: DataFrame, max_chars: int = fixed.MAX_PROMPT_CHARS,
                       template: str = P.EXTRACTION_TEMPLATE) -> DataFrame:
    """(domain, prompt) for usable crawl results."""
    return extraction_prompts_of(crawled.select("domain", "status"), pages_of(crawled), max_chars, template)


def extraction_prompts_of(statuses: DataFrame, pages: DataFrame, max_chars: int = fixed.MAX_PROMPT_CHARS,
                          template: str = P.EXTRACTION_TEMPLATE) -> DataFrame:
    """The same from page rows; pages are cut to the budget before a domain's
    chunks are gathered, so a domain of any size gathers max_chars at most."""
    usable = statuses.where(F.col("status") == "ok").select("domain")
    chunks = prompt_chunks(pages.join(usable, "domain", "left_semi"), max_chars)
    texts = chunks.groupBy(F.col("domain").alias("__d")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda c: c["chunk"]), "\n").alias("__t")
    )
    joined = usable.join(texts, F.col("domain") == F.col("__d"), "left")
    return joined.select(
        "domain", P.fill(template, pages_text=F.col("__t"), domain=F.col("domain")).alias("prompt")
    )


def prompt_sizes(prompts: DataFrame, *columns: str) -> DataFrame:
    return prompts.select("domain", *columns, F.length("prompt").alias("prompt_chars"))


def first_page_per_url(pages: DataFrame) -> DataFrame:
    """Only the first page with a URL is searched for quotes."""
    return keep_first(pages, ["domain", "url"], [F.col("pos")])


def check_quotes(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Add `verified`: the quote stands in the first page of that URL.

    claims: domain, quote, source_url and anything else.
    """
    # Normalised before the join: once per page, not once per claim on it.
    sources = first_page_per_url(pages).select(
        F.col("domain").alias("__d"), F.col("url").alias("__u"),
        R.normalize_quote(F.coalesce("text", F.lit(""))).alias("__t"),
    )
    given = (F.coalesce("quote", F.lit("")) != "") & (F.coalesce("source_url", F.lit("")) != "")
    found = F.col("__t").contains(R.normalize_quote("quote"))
    return (
        claims.join(sources, (F.col("domain") == F.col("__d")) & (F.col("source_url") == F.col("__u")), "left")
        .withColumn("verified", F.coalesce(given & found, F.lit(False)))
        .drop("__d", "__u", "__t")
    )


def clamp_extractions(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop unverified events, pains and hooks and count them.

    extractions: domain and the analysis fields, one row per domain.  One
    answer's claims come back together, so the lists are as small as it was.
    """
    claims = None
    for field in QUOTED_FIELDS:
        rows = extractions.select("domain", F.lit(field).alias("field"), F.posexplode(field).alias("place", "c")).select(
            "domain", "field", "place", F.col("c.quote").alias("quote"), F.col("c.source_url").alias("source_url")
        )
        claims = rows if claims is None else claims.unionByName(rows)
    checked = check_quotes(claims, pages)
    verdicts = checked.groupBy(F.col("domain").alias("__d")).agg(
        *[
            F.collect_set(F.when((F.col("field") == f) & F.col("verified"), F.col("place"))).alias(f"__{f}")
            for f in QUOTED_FIELDS
        ],
        F.count_if(~F.col("verified")).cast("int").alias("__dropped"),
    )
    joined = extractions.join(verdicts, F.col("domain") == F.col("__d"), "left")
    for field in QUOTED_FIELDS:
        joined = joined.withColumn(field, F.expr(f"filter({field}, (x, i) -> coalesce(array_contains(__{field}, i), false))"))
    return joined.withColumn("quotes_dropped", F.coalesce("__dropped", F.lit(0))).drop(
        "__d", "__dropped", *[f"__{f}" for f in QUOTED_FIELDS]
    )


def analyses(crawled: DataFrame, responses: DataFrame) -> DataFrame:
    """One analysis per crawled domain.  responses: domain, raw_text, error."""
    return analyses_of(crawled.select("domain", "status"), pages_of(crawled), responses)


def analyses_of(crawled: DataFrame, pages: DataFrame, responses: DataFrame) -> DataFrame:
    """The same from statuses and page rows."""
    answers = responses.select(F.col("domain").alias("__d"), "raw_text", F.col("error").alias("__error"))
    joined = crawled.select("domain", F.col("status").alias("__crawl")).join(
        answers, F.col("domain") == F.col("__d"), "left"
    )
    read = joined.withColumn("__x", R.read_extraction(F.coalesce("raw_text", F.lit(""))))
    status = first_of(
        [
            (F.coalesce("__crawl", F.lit("")) != "ok", F.lit("no_crawl_data")),
            (F.col("__error").isNotNull() | F.col("raw_text").isNull(), F.lit("api_error")),
            (F.col("__x.parse_error"), F.lit("parse_error")),
        ],
        F.lit("ok"),
    )
    error = first_of(
        [
            (F.col("status") == "no_crawl_data",
             F.concat(F.lit("upstream crawl status was '"), F.coalesce("__crawl", F.lit("None")), F.lit("', not 'ok'"))),
            (F.col("status") == "api_error", F.coalesce("__error", F.lit("unknown API error"))),
            (F.col("status") == "parse_error", F.lit("model response was not valid JSON")),
        ],
        F.lit(None).cast("string"),
    )
    flat = read.withColumn("status", status).withColumn("error", error)
    ok = flat.where(F.col("status") == "ok").select(
        "domain", *[F.col(f"__x.{f.name}").alias(f.name) for f in ANALYSIS_FIELDS.fields]
    )
    clamped = clamp_extractions(ok, pages).withColumn(
        "signal_gate", R.signal_gate(F.col("disqualifiers"), F.col("hooks"))
    )
    return flat.select("domain", "status", "error").join(
        clamped.withColumnRenamed("domain", "__cd"), F.col("domain") == F.col("__cd"), "left"
    ).select(
        "domain", "status", "signal_gate", *[f.name for f in ANALYSIS_FIELDS.fields], "quotes_dropped", "error"
    )


def analysis_summary(rows: DataFrame) -> DataFrame:
    """Counts by status; low_signal is counted inside ok."""
    status = F.col("status")
    return rows.agg(
        F.count_if(status == "ok").alias("ok"),
        F.count_if((status == "ok") & (F.col("signal_gate") == "low_signal")).alias("low_signal"),
        *[F.count_if(status == s).alias(s) for s in ("no_crawl_data", "api_error", "parse_error")],
    )
