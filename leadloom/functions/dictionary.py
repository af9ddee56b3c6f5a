"""Look-ups in tables of thousands of words, as column expressions.

A map literal would be searched word by word, and a long IN list costs a call per
word when the plan is built.  Here the entries lie on shelves, text literals of a
thousand characters or so each; a look-up picks one shelf by the checksum of the
word and searches that alone, so its cost does not grow with the table.
"""

from __future__ import annotations

import zlib

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that no word and no value holds.
_START, _MIDDLE, _END = "\x01", "\x02", "\x03"
_SHELF = 1024


class Dictionary:
    def __init__(self, entries: dict[str, str]):
        if any(set(text) & {_START, _MIDDLE, _END} for pair in entries.items() for text in pair):
            raise ValueError("words and values must not hold the marks between them")
        total = sum(len(word) + len(value) + 3 for word, value in entries.items())
        shelves = [""] * (1 + total // _SHELF)
        for word, value in entries.items():
            shelves[zlib.crc32(word.encode()) % len(shelves)] += f"{_START}{word}{_MIDDLE}{value}{_END}"
        self._texts = shelves
        self._literals: tuple = (None, [])

    def _shelves(self) -> list[Column]:
        """The literals, made once per driver process."""
        context = SparkContext._active_spark_context
        if context is None or self._literals[0] is not context:
            self._literals = (context, [F.lit(text) for text in self._texts])
        return self._literals[1]

    def value(self, word: Column) -> Column:
        """The value of a word, or NULL; values are not empty."""
        shelf = F.elt((F.crc32(word.cast("binary")) % len(self._texts)).cast("int") + 1, *self._shelves())
        after = F.split_part(shelf, F.concat(F.lit(_START), word, F.lit(_MIDDLE)), F.lit(2))
        found = F.array(F.split_part(after, F.lit(_END), F.lit(1)))
        return F.get(F.filter(found, lambda value: value != ""), F.lit(0))
