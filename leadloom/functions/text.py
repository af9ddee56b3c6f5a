"""Small text expressions shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space of every kind.  The classes test the common letters first, which
# keeps a scan over a long text cheap.
_SPACES = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = rf"[[^!-~\xA1-\u167F]&&[{_SPACES}]]"
NOT_SPACE = rf"[!-~\xA1-\u167F[^{_SPACES}]]"
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_case(pattern: str) -> str:
    """Case-insensitive, with Unicode classes for \\w, \\b and \\s."""
    return "(?iU)" + pattern


def exact_case(pattern: str) -> str:
    return "(?U)" + pattern


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(any_case(pattern) if ignore_case else exact_case(pattern)), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match, or NULL where nothing matches."""
    flagged = any_case(pattern) if ignore_case else exact_case(pattern)
    return F.when(c.rlike(flagged), F.regexp_extract(c, flagged, group))


def all_matches(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    flagged = any_case(pattern) if ignore_case else exact_case(pattern)
    return F.regexp_extract_all(c, F.lit(flagged), F.lit(group))


def text_array(values) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def kept(items: list[Column]) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often `use` and
    the lambdas inside it refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """CASE WHEN chain: the first condition that holds decides."""
    head, *rest = cases
    chain = reduce(lambda acc, case: acc.when(*case), rest, F.when(*head))
    return chain.otherwise(otherwise)


def quote_plus(c: Column) -> Column:
    """Form encoding that keeps `~` and escapes `*`."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def unquote_plus(c: Column) -> Column:
    """Form decoding; a stray percent sign stays as it is."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def listing(items: Column) -> Column:
    """An array of strings as text: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def strip_fences(c: Column) -> Column:
    """Drop a Markdown code fence round a model's answer."""
    opened = F.regexp_replace(strip(c), r"(?U)^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"(?U)\s*```$", "")
