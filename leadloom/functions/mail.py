"""Classes, severity and dates of inbound mail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.text import any_case, as_col, first_match, first_of, matches, strip


def sender_address(header: Column | str) -> Column:
    """Address of a From header, lower case."""
    header = as_col(header)
    bracketed = F.regexp_extract(header, r"<([^<>]*)>", 1)
    return F.lower(F.trim(F.when(header.contains("<"), bracketed).otherwise(header)))


def message_class(from_addr: Column | str, subject: Column | str, body: Column | str) -> Column:
    subject = F.coalesce(as_col(subject), F.lit(""))
    both = F.concat(subject, F.lit("\n"), F.coalesce(as_col(body), F.lit("")))
    return first_of(
        [
            (
                matches(as_col(from_addr), fixed.BOUNCE_SENDER_PATTERN)
                | matches(subject, fixed.BOUNCE_SUBJECT_PATTERN),
                F.lit("bounce"),
            ),
            (matches(both, fixed.UNSUBSCRIBE_PATTERN), F.lit("unsubscribe")),
            (matches(both, fixed.OOO_PATTERN), F.lit("ooo")),
        ],
        F.lit("reply"),
    )


def bounce_severity(full_text: Column | str) -> Column:
    """The status code decides; then soft words without hard ones; else hard."""
    text = F.coalesce(as_col(full_text), F.lit(""))
    code = first_match(text, fixed.DSN_STATUS_PATTERN, 1)
    soft = matches(text, fixed.SOFT_BOUNCE_PATTERN) & ~matches(text, fixed.HARD_BOUNCE_PATTERN)
    return first_of([(code == "5", F.lit("hard")), (code == "4", F.lit("soft")), (soft, F.lit("soft"))], F.lit("hard"))


def outcome(kind: Column, full_text: Column | str) -> Column:
    """Class with the severity of a bounce added."""
    return F.when(kind == "bounce", F.concat(F.lit("bounce_"), bounce_severity(full_text))).otherwise(kind)


def ooo_return_date(body: Column | str, as_of: Column) -> Column:
    """Return date named in an auto-reply, NULL when none can be read.

    A date without a year takes the year of `as_of`.
    """
    raw = first_match(F.coalesce(as_col(body), F.lit("")), fixed.OOO_DATE_PATTERN, 1)
    year = F.date_format(as_of, "yyyy")
    month_first = F.initcap(F.regexp_replace(raw, r"\s+", " "))

    def read(text: Column, layout: str, shape: str) -> Column:
        return F.when(raw.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))

    yearless = F.concat(raw, F.lit("/"), year)
    worded = F.concat(month_first, F.lit(" "), year)
    # A yearless 29 February is read against a common year and so fails.
    leap_day = raw.rlike(r"(?i)^(0?2/29|feb[a-z]* +29)$")
    two_digit = F.concat(
        F.regexp_extract(raw, r"^(\d{1,2}/\d{1,2}/)", 1),
        F.when(F.regexp_extract(raw, r"(\d{2})$", 1) >= "69", "19").otherwise("20"),
        F.regexp_extract(raw, r"(\d{2})$", 1),
    )
    return F.coalesce(
        read(raw, "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
        read(two_digit, "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
        read(raw, "M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
        F.when(~leap_day, read(yearless, "M/d/yyyy", r"^\d{1,2}/\d{1,2}$")),
        F.when(~leap_day, read(worded, "MMM d yyyy", r"(?i)^[a-z]{3}\s+\d{1,2}$")),
        F.when(~leap_day, read(worded, "MMMM d yyyy", r"(?i)^[a-z]{3,}\s+\d{1,2}$")),
    ).cast("timestamp")


def plain_body(parts: Column | str, is_multipart: Column | str) -> Column:
    """First text/plain part without a file name; the payload when not
    multipart.  parts: array<struct<ctype, filename, text>>."""
    parts = as_col(parts)
    plain = F.filter(
        parts, lambda p: (p["ctype"] == "text/plain") & (F.coalesce(p["filename"], F.lit("")) == "")
    )
    chosen = F.when(as_col(is_multipart), F.get(plain, F.lit(0))["text"]).otherwise(F.get(parts, F.lit(0))["text"])
    return F.coalesce(chosen, F.lit(""))


def full_text(parts: Column | str) -> Column:
    texts = F.transform(as_col(parts), lambda p: p["text"])
    return F.array_join(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
