"""Mail addresses, names and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.text import any_case, as_col, first_of, kept, matches, strip, text_array


def local_part(address: Column | str) -> Column:
    return F.split_part(as_col(address), F.lit("@"), F.lit(1))


def address_domain(address: Column | str) -> Column:
    """Text after the last @; the whole value when there is none."""
    return F.split_part(as_col(address), F.lit("@"), F.lit(-1))


def role_of(address: Column | str, roles=None) -> Column:
    """struct<role, priority> by the local part; lower priority is better."""
    local = local_part(address)
    roles = roles or fixed.ROLE_PATTERNS

    def pair(name, priority):
        return F.struct(F.lit(name).alias("role"), F.lit(priority).alias("priority"))

    return first_of([(matches(local, p), pair(name, rank)) for name, rank, p in roles], pair(*fixed.DEFAULT_ROLE))


def name_parts(name: Column | str) -> Column:
    """struct<first, last>, letters only; NULL without two usable words."""
    tokens = F.split(strip(as_col(name)), r"(?U)\s+")
    first = F.lower(F.regexp_replace(F.get(tokens, F.lit(0)), "[^a-zA-Z]", ""))
    last = F.lower(F.regexp_replace(F.element_at(tokens, -1), "[^a-zA-Z]", ""))
    usable = (F.size(tokens) >= 2) & (first != "") & (last != "")
    return F.when(usable, F.struct(first.alias("first"), last.alias("last")))


def _fill(template: str, parts: Column) -> Column:
    values = {
        "f": parts["first"], "l": parts["last"],
        "fi": F.substring(parts["first"], 1, 1), "li": F.substring(parts["last"], 1, 1),
    }
    pieces, rest = [], template
    while rest:
        before, brace, rest = rest.partition("{")
        if before:
            pieces.append(F.lit(before))
        if brace:
            key, _, rest = rest.partition("}")
            pieces.append(values[key])
    return F.concat(*pieces)


def template_locals(name: Column | str, templates=None) -> Column:
    """Local part per template; NULLs when the name has no usable parts.

    The parts are bound once and shared by all templates.
    """
    templates = templates or fixed.ADDRESS_TEMPLATES
    filled = F.transform(F.array(name_parts(name)), lambda p: F.array(*[_fill(t, p) for t in templates]))
    return F.get(filled, F.lit(0))


def fill_template(template: str, name: Column | str) -> Column:
    return F.get(template_locals(name, [template]), F.lit(0))


def template_of(name: Column | str, address: Column | str, templates=None) -> Column:
    """1-based place of the first template that explains the address, or 0."""
    return F.coalesce(
        F.array_position(template_locals(name, templates), F.lower(local_part(address))), F.lit(0)
    ).cast("int")


def fill_by_place(place: Column, name: Column | str, templates=None) -> Column:
    return F.get(template_locals(name, templates), place - 1)


def seniority(title: Column | str, ranks=None) -> Column:
    title = F.coalesce(as_col(title), F.lit(""))
    ranks = ranks or fixed.SENIORITY_PATTERNS
    return first_of([(matches(title, p), F.lit(rank)) for rank, p in ranks], F.lit(fixed.LOWEST_SENIORITY))


def is_decision_maker(title: Column | str) -> Column:
    return matches(as_col(title), fixed.DECISION_MAKER_PATTERN)


def local_tokens(address: Column | str) -> Column:
    """Sorted distinct words of a local part, split at dot and underscore."""
    text = F.lower(F.regexp_replace(local_part(address), "[._]", " "))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))


def name_tokens(name: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(as_col(name)), r"(?U)\s+"), lambda w: w != "")))


def confidence(source: Column, matched_name: Column, verification: Column) -> Column:
    named = matched_name.isNotNull()
    return first_of(
        [
            (verification == "invalid", F.lit("reject")),
            (source.isin("guessed", "pattern_guessed"), F.lit("low")),
            (verification == "valid", F.when(named, "high").otherwise("medium")),
            (verification == "not_checked", F.lit("medium")),
        ],
        F.when(named, "medium").otherwise("low"),
    )


def mx_hosts(mx: Column) -> Column:
    """Hosts of array<struct<pref, host>> by preference."""
    return F.transform(F.array_sort(mx), lambda m: m["host"])


def confidence_rank(value: Column, ranks=None) -> Column:
    chain = F.lit(fixed.UNKNOWN_CONFIDENCE_RANK)
    for name, rank in (ranks or fixed.CONFIDENCE_RANK).items():
        chain = F.when(value == name, F.lit(rank)).otherwise(chain)
    return chain
