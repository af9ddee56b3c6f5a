"""Words, sentences and syllables of whole texts, counted on their bytes in Arrow batches.

A regular expression that lists every word of a text costs a hundred times what
its bytes cost to read; here a batch's bytes are classed by table look-ups, and
the counts are those of the places where a run begins.  It is shipped by value,
so workers need no copy of the package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes looked at together; a longer text is looked at alone.
SLICE = 1 << 21


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_UPPER_AND_LOWER = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = _table(bytes([*range(9, 14), *range(28, 33)]))
_LETTER = _table(_UPPER_AND_LOWER)
_SPELLED = _table(_UPPER_AND_LOWER + b"'")
_VOWEL = _table(b"aeiouyAEIOUY")
_END = _table(b".!?")


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, also of more than one byte."""
    space = _SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8))
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = lead[general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                space[at + k] = True
    return space


def _run_starts(member: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where runs of members begin; `firsts`, the texts' first bytes, part runs."""
    start = member.copy()
    start[1:] &= ~member[:-1]
    start[firsts] = member[firsts]
    return np.flatnonzero(start)


def _per_text(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(places, offsets))


def _firsts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[1:] > offsets[:-1]]


def _syllables(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per word of letters: runs of vowels, less one for a final e after another run, at least one."""
    marks = data == 0x27
    if marks.any():
        offsets = offsets - np.searchsorted(np.flatnonzero(marks), offsets)
        data = data[~marks]
    firsts, letter = _firsts(offsets), _LETTER[data]
    words = _run_starts(letter, firsts)
    if not len(words):
        return np.zeros(len(offsets) - 1, np.int64)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[firsts[1:] - 1] = letter[firsts[1:] - 1]
    last[-1] = letter[-1]
    ends = np.flatnonzero(last)
    runs = _run_starts(_VOWEL[data], firsts)
    n = np.searchsorted(runs, ends, "right") - np.searchsorted(runs, words)
    final = data[ends] | 0x20
    spoken = np.maximum(n - ((final == 0x65) & (n > 1)), 1)
    return np.diff(np.append(0, np.cumsum(spoken))[np.searchsorted(words, offsets)])


def _sentences(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Stretches between end marks that hold anything but white space."""
    end = _END[data]
    runs = _run_starts(~(space | end), _firsts(offsets))
    stretch = np.searchsorted(np.flatnonzero(end), runs)
    text = np.searchsorted(offsets, runs, "right")
    new = np.ones(len(runs), bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1])
    return _per_text(runs[new], offsets)


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Words, words of letters and apostrophes, sentences and syllables of each text."""
    firsts, space = _firsts(offsets), _spaces(data)
    words = _per_text(_run_starts(~space, firsts), offsets)
    spelled = _per_text(_run_starts(_SPELLED[data], firsts), offsets)
    return [words, spelled, _sentences(data, offsets, space), _syllables(data, offsets)]


_NAMES = ["words", "spelled", "sentences", "syllables"]


@F.arrow_udf(T.StructType([T.StructField(name, T.IntegerType()) for name in _NAMES]))
def text_counts(texts: pa.Array) -> pa.Array:
    """Counts of each text, NULL for none: words between white space, words of letters and apostrophes, sentences, syllables."""
    wide = texts.cast(pa.large_binary())
    places = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8) if places[-1] > places[0] else np.zeros(0, np.uint8)
    found, first = [np.zeros((4, 0), np.int64)], 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(places, places[first] + SLICE, "right")) - 1)
        own = data[places[first]: places[end]]
        found.append(np.stack(counts(own, places[first: end + 1] - places[first])))
        first = end
    columns = [pa.array(c, pa.int32()) for c in np.concatenate(found, axis=1)]
    return pa.StructArray.from_arrays(columns, names=_NAMES, mask=texts.is_null())
