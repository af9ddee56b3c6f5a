"""Own text of a page's elements, as an Arrow-batched function.

Like `text_counts` it runs in Python workers.  It is shipped by value, so
workers need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CHARS = 60
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))


class _OwnText(HTMLParser):
    """Text directly inside each element, in the order elements open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts = []
        self.open = []

    def handle_starttag(self, tag, attrs):
        self.texts.append([])
        if tag not in _VOID:
            self.open.append((tag, len(self.texts) - 1))

    def handle_startendtag(self, tag, attrs):
        self.texts.append([])

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] not in _SILENT:
            self.texts[self.open[-1][1]].append(data)


def own_texts(markup):
    parser = _OwnText()
    parser.feed(markup or "")
    parser.close()
    joined = (" ".join("".join(parts).split()) for parts in parser.texts)
    return [text for text in joined if text and len(text) <= MAX_CHARS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def short_own_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Own texts of at most MAX_CHARS characters, in document order."""
    for batch in batches:
        yield batch.map(own_texts)
