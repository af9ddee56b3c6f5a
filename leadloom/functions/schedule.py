"""Warm-up caps, step delays and subject variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.text import any_case, as_col, first_of, strip


def days_since_start(start: Column | str, today: Column | str) -> Column:
    return F.greatest(F.lit(0), F.datediff(as_col(today), as_col(start)))


def ramp_cap(start: Column | str, today: Column | str, ramp=None) -> Column:
    """Cap of the ramp row the offset falls in; the last cap over a gap."""
    ramp = ramp or fixed.WARMUP_RAMP
    offset = days_since_start(start, today)
    cases = []
    for first, end, cap in ramp:
        inside = offset >= first
        cases.append((inside if end is None else inside & (offset < end), F.lit(cap)))
    return first_of(cases, F.lit(ramp[-1][2]))


def daily_cap(start: Column | str, override: Column | str, today: Column | str, ramp=None) -> Column:
    return F.coalesce(as_col(override), ramp_cap(start, today, ramp))


def stage_label(start: Column | str, today: Column | str) -> Column:
    offset = days_since_start(start, today)
    return first_of([(offset < end, F.lit(label)) for end, label in fixed.WARMUP_STAGES], F.lit(fixed.STEADY_STAGE))


def step_delay(step: Column | str, delays=None) -> Column:
    step = as_col(step)
    return first_of(
        [(step == s, F.lit(days)) for s, days in (delays or fixed.STEP_DELAY_DAYS).items()], F.lit(None).cast("int")
    )


def next_send_at(step: Column | str, as_of: Column, delays=None) -> Column:
    return as_of + F.make_dt_interval(days=step_delay(step, delays))


def variant_key(subject: Column | str) -> Column:
    """Base subject shared by every step of one thread."""
    bare = F.regexp_replace(strip(F.coalesce(as_col(subject), F.lit(""))), any_case(r"^(re:\s*)+"), "")
    return F.lower(strip(bare))


def threaded_subject(subject: Column | str, is_threaded: Column) -> Column:
    subject = as_col(subject)
    needs = is_threaded & ~F.lower(subject).startswith("re:")
    return F.when(needs, F.concat(F.lit("Re: "), subject)).otherwise(subject)
