"""Public suffixes with wildcard and exception rules, looked up once per label of a host.

Rules are read from a file in the format of the public list, given by path; the
default is the place where systems put that list, and without one the short list
of `fixed_values`.  The trie of reversed labels is stored as what each node says
about itself, keyed by its name: `p` the name is a suffix, `w` so is every label
under it, `x` it is an exception, and its parent is the suffix.  A host is walked
label by label from its end, one look-up each, as deep as rules can go.
"""

from __future__ import annotations

import os
from functools import cached_property, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom.functions.dictionary import Dictionary
from leadloom.functions.text import bind

#: Where a published copy of the list usually lies.
LIST_PATHS = ("/usr/share/publicsuffix/public_suffix_list.dat", "/usr/share/publicsuffix/effective_tld_names.dat")
_PRIVATE = "===BEGIN PRIVATE DOMAINS==="


class SuffixRules:
    """Flags by name of what rules say."""

    def __init__(self, rules):
        self.flags: dict[str, str] = {}
        for rule in rules:
            for form in {rule, _encoded(rule)}:
                kind = "x" if form.startswith("!") else "w" if form.startswith("*.") else "p"
                name = form.removeprefix("!").removeprefix("*.")
                self.flags[name] = "".join(sorted({*self.flags.get(name, ""), kind}))
        self.depth = max((name.count(".") + 1 for name in self.flags), default=0)

    def named(self, kind: str) -> list[str]:
        return sorted(name for name, flags in self.flags.items() if kind in flags)

    @cached_property
    def dictionary(self) -> Dictionary:
        return Dictionary(self.flags)


def _encoded(rule: str) -> str:
    """The rule with its labels as they are written in requests."""
    def label(text: str) -> str:
        try:
            return text if text.isascii() else text.encode("idna").decode()
        except UnicodeError:
            return text

    return ".".join(label(part) for part in rule.split("."))


def read_rules(path: str, private: bool = False) -> SuffixRules:
    """Rules of a file in the format of the public list; those of private registrants only if asked for."""
    rules = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if _PRIVATE in line and not private:
                break
            rule = line.split()[0] if line.strip() else ""
            if rule and not rule.startswith("//"):
                rules.append(rule.lower())
    return SuffixRules(rules)


@lru_cache(maxsize=1)
def default_rules() -> SuffixRules:
    """The published list of this system, or the short list."""
    for path in LIST_PATHS:
        if os.path.exists(path):
            return read_rules(path)
    nested = [f"{sub}.{cc}" for cc, subs in fixed.SECOND_LEVEL_SUFFIXES.items() for sub in subs.split()]
    return SuffixRules(fixed.GENERIC_SUFFIXES + fixed.COUNTRY_SUFFIXES + nested)


def suffix_labels(host: Column, rules: SuffixRules) -> Column:
    """Number of labels of the public suffix of a host; 0 when no rule fits."""
    def step(seen: Column, label: Column) -> Column:
        name = F.when(seen["n"] == 0, label).otherwise(F.concat(label, F.lit("."), seen["name"]))

        def reached(found: Column) -> Column:
            name, flags, n = found["name"], found["flags"], seen["n"] + 1
            return F.struct(
                name.alias("name"), n.alias("n"), flags.contains("w").alias("wild"),
                F.when(seen["wild"] | flags.contains("p"), n).otherwise(seen["best"]).alias("best"),
                F.coalesce(seen["lifted"], F.when(flags.contains("x"), seen["n"])).alias("lifted"),
            )

        return bind(bind(name, lambda m: F.struct(m.alias("name"), F.coalesce(rules.dictionary.value(m), F.lit("")).alias("flags"))), reached)

    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(False).alias("wild"), F.lit(0).alias("best"), F.lit(None).cast("int").alias("lifted"))
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, rules.depth + 1)
    return F.aggregate(labels, start, step, lambda seen: F.coalesce(seen["lifted"], seen["best"]))
