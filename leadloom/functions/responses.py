"""Reading model answers: fences off, JSON in, defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.text import as_col, bind, collapse_space, first_of, strip_fences
from leadloom.schemas import ANALYSIS_FIELDS, DRAFT_ITEMS, JUDGE_SCORES, SENTIMENT


def _json_body(raw: Column, opening: str) -> Column:
    body = strip_fences(raw)
    return F.when(body.startswith(opening), body).otherwise(F.concat(F.lit(opening), body))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def read_extraction(raw: Column | str) -> Column:
    """struct of the analysis keys plus parse_error.  Missing keys get an
    empty text or an empty array; a field of the wrong type reads as missing."""
    def read(body: Column) -> Column:
        def fields(data: Column) -> Column:
            filled = []
            for field in ANALYSIS_FIELDS.fields:
                empty = F.lit("") if field.name in fixed.ANALYSIS_TEXT_KEYS else F.array().cast(field.dataType)
                filled.append(F.coalesce(data[field.name], empty).alias(field.name))
            return F.struct(*filled, (~is_json(body)).alias("parse_error"))

        return bind(F.from_json(body, ANALYSIS_FIELDS), fields)

    return bind(_json_body(as_col(raw), "{"), read)


def read_draft(raw: Column | str) -> Column:
    """array<struct<step, subject, body>>; anything malformed gives an empty
    array.  A missing step counts as step 1."""
    body = _json_body(as_col(raw), "[")
    items = F.when(is_json(body), F.from_json(body, DRAFT_ITEMS))
    filled = F.transform(
        items,
        lambda i: F.struct(
            F.coalesce(i["step"], F.lit(1)).alias("step"),
            F.coalesce(i["subject"], F.lit("")).alias("subject"),
            F.coalesce(i["body"], F.lit("")).alias("body"),
        ),
    )
    return F.coalesce(filled, F.array().cast(DRAFT_ITEMS))


def read_judge(raw: Column | str, error: Column | str) -> Column:
    """Judge scores; a failed call or bad JSON leaves only `error` set."""
    error = as_col(error)

    def read(body: Column) -> Column:
        bad = _problem(body, error)
        return bind(
            F.from_json(body, JUDGE_SCORES),
            lambda scores: F.struct(
                *[F.when(bad.isNull(), scores[f.name]).alias(f.name) for f in JUDGE_SCORES.fields], bad.alias("error")
            ),
        )

    return bind(strip_fences(as_col(raw)), read)


def _problem(body: Column, error: Column) -> Column:
    """The error of a failed call, or that its answer is no JSON, or NULL."""
    broken = F.when(~F.coalesce(is_json(body), F.lit(False)), F.lit("invalid JSON"))
    return F.coalesce(error, broken)


def read_sentiment(raw: Column | str, error: Column | str) -> Column:
    """Sentiment (neutral when the answer names none) or an error."""
    error = as_col(error)

    def read(body: Column) -> Column:
        bad = _problem(body, error)
        return bind(
            F.from_json(body, SENTIMENT),
            lambda answer: F.struct(
                F.when(bad.isNull(), F.coalesce(answer["sentiment"], F.lit("neutral"))).alias("sentiment"),
                F.when(bad.isNull(), answer["confidence"]).alias("confidence"),
                bad.alias("error"),
            ),
        )

    return bind(strip_fences(as_col(raw)), read)


def normalize_quote(text: Column | str) -> Column:
    straight = F.translate(as_col(text), "’‘", "''")
    return collapse_space(F.lower(straight))


def signal_gate(disqualifiers: Column, hooks: Column, threshold: int = fixed.MIN_HOOK_SPECIFICITY) -> Column:
    strong = F.exists(hooks, lambda h: F.coalesce(h["specificity"], F.lit(0)) >= threshold)
    return first_of(
        [(F.size(disqualifiers) > 0, F.lit("low_signal")), (F.coalesce(strong, F.lit(False)), F.lit("ok"))],
        F.lit("low_signal"),
    )
