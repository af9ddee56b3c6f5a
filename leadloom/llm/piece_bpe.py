"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The library merges the adjacent pair of the best score, leftmost first, until
none is left.  Here each position takes the longest piece there; one pass of an
Aho-Corasick automaton over all new chunks finds those that follow each other.  It stands if merging its text together with the last piece's
text, from single characters, never joins across their edge; if not, the next
shorter prefix that is a piece is tried, and where none fits the position is
marked in a bitfield of failed positions and the last piece is given up.  Every
pair of neighbours that stands proves the whole: the first merge across an edge
would also be the first within those two pieces.  Pieces that merging never
reaches take no part.  Chunks of up to `_SHORT` characters, most of all, are
merged pair by pair instead, which is quicker there; the walk is linear in
longer ones.  Characters in no piece become their bytes.

A text is cut where no piece can lie across: before spaces, and between letters,
signs, digits and line ends if the model's pieces keep them apart (`_cutting`
looks at all of them when the model is read).  Results of chunks are kept for the next
texts, up to `KEPT` of them, so memory is bounded; so are the checked pairs.

Models: scores of merge type, byte fallback, a space put first, no other change
of the text, no pieces of the user; others are refused.

Defined cases: a null text is empty; an empty text has the end id alone;
names of special pieces in a text are ordinary text; repeated rows and ties give
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm.common import read, worker_state

KEPT = 200_000
_SLICE = 1 << 20
_SHORT = 32
#: Fixed values of the model's format: the sign for a space, kinds of pieces, the mark of bytes that are no character.
_SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BAD = "�"
#: Runs of bytes among decoded pieces and the mark of an id that shows nothing, as code points that no text holds.
_BYTES, _NOTHING = re.compile("[\udc00-\udcff]+"), "\udd00"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, at = number(at)
        else:
            if size is None:
                size, at = number(at)
            value, at = data[at: at + size], at + size
        yield key >> 3, value


def _pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Text, score and kind of every piece by id; ValueError for a model of another sort."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(model):
        if field == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    kinds = {kind for _, _, kind in pieces}
    texts = [text for text, _, kind in pieces if kind == _NORMAL]
    faults = {
        "not of merge type": trainer.get(3, 1) != 2,
        "no byte fallback": not trainer.get(35, 0) or sum(kind == _BYTE for _, _, kind in pieces) != 256,
        "spaces behind words": bool(trainer.get(24, 0)),
        "text is changed first": bool(normalizer.get(2)) or not normalizer.get(3, 1) or bool(normalizer.get(4, 1)) or not normalizer.get(5, 1),
        "pieces of other kinds": not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE},
        "a space inside a piece": any(_SPACE in text.lstrip(_SPACE) for text in texts),
    }
    if any(faults.values()):
        raise ValueError("unfit model: " + ", ".join(name for name, found in faults.items() if found))
    return pieces


def _cutting(texts: list[str]) -> str:
    """A pattern whose matches cut a text only where no piece of two characters or more can lie across.

    Spaces begin a chunk.  Beyond that letters and signs part, and digits and
    line ends stand alone, if no piece joins them.  A few other characters join
    signs in some piece; where one comes next, the chunk goes on to the next space.
    """
    signs = set(string.punctuation)
    alone = set("0123456789\n")
    neighbours = {pair for text in texts for pair in zip(text, text[1:])}
    mixed = {c for a, b in neighbours for c, d in ((a, b), (b, a)) if c != _SPACE and not (c.isascii() and (c.isalpha() or c in signs or c in alone)) and d.isascii() and not d.isalpha()}
    parted = not any(alone & set(pair) or (a in signs and b in string.ascii_letters) or (a in string.ascii_letters and b in signs) for pair in neighbours for a, b in (pair,))
    if not parted:
        return f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+"
    m = "".join(map(re.escape, sorted(mixed))) or "\\Z"
    letters, other = rf"(?:[A-Za-z]|[^\x00-\x7F{_SPACE}{m}])", "[" + re.escape(string.punctuation) + "]"
    return rf"{_SPACE}*+{letters}++(?![{m}])|{_SPACE}*+{other}++(?![{m}])|{_SPACE}++(?=[0-9\n]|\Z)|[0-9]|\n+|{_SPACE}*[^{_SPACE}]+"


class _Shown(dict):
    """What an id, written in decimal, stands for: pieces with the sign for a space, a byte as one code point of `_BYTES`, `_NOTHING` for controls and ids outside the model: they part bytes."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        def shown(text: str, kind: int) -> str:
            if kind == _BYTE:
                return chr(0xDC00 + int(text[1:-1], 16))
            return {_NORMAL: text, _UNKNOWN: " ⁇ "}.get(kind, _NOTHING)

        super().__init__((str(i), shown(text, kind)) for i, (text, _, kind) in enumerate(pieces))

    def __missing__(self, code: str) -> str:
        return _NOTHING


class _Codes(dict):
    """Ids as text by piece; a character that is no piece has those of its bytes."""

    def __init__(self, ids: dict[str, int], byte_ids: list[int]):
        super().__init__((text, str(i)) for text, i in ids.items())
        self.byte_ids = byte_ids

    def __missing__(self, character: str) -> str:
        return " ".join(str(self.byte_ids[b]) for b in character.encode("utf-8", "surrogatepass"))


class PieceCoder:
    """Pieces, automaton and known results of one worker."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces = _pieces(model)
        self.scores = {text: score for text, score, kind in self.pieces if kind == _NORMAL}
        self.ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == _NORMAL}
        self.byte_ids = [0] * 256
        for i, (text, _, kind) in enumerate(self.pieces):
            if kind == _BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
        self.end_id = next(i for i, (text, _, kind) in enumerate(self.pieces) if kind == _CONTROL and text == "</s>")
        reached = {text for text in self.ids if self._merges_to(text, 0)} | {c for text in self.ids for c in text}
        self.shorter = {text: next((text[:n] for n in range(len(text) - 1, 0, -1) if text[:n] in reached), None) for text in reached}
        self.longest_piece = max(map(len, reached))
        alone = {chr(i) for i in range(128)} - {c for text in self.ids if len(text) > 1 for c in text}
        self.parting = min(alone - set(self.ids))
        self.automaton = ahocorasick.Automaton()
        for text in reached | {self.parting}:
            self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        self.codes = _Codes(self.ids, self.byte_ids)
        self.shown = _Shown(self.pieces)
        self.chunks = re.compile(_cutting([text for text in self.ids if len(text) > 1])).findall
        self.pairs: dict[str, dict[str, bool]] = {text: {} for text in reached}
        self.n_pairs = 0
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def _merges_to(self, text: str, edge: int) -> bool:
        """Whether merging `text` ends in its two parts before and from `edge` (in one part, if `edge` is 0)."""
        parts, score, none = list(text), self.scores.get, -float("inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            if at + 1 < edge:
                edge -= 1
            elif at + 1 == edge:
                return False
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return len(parts) == (2 if edge else 1)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short chunk: the best pair is merged, leftmost first, until none is left."""
        parts, score, none = list(text), self.scores.get, -float("inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            del pairs[at]
            one = parts[at] = parts[at] + parts.pop(at + 1)
            if at:
                pairs[at - 1] = score(parts[at - 1] + one, none)
            if at < len(pairs):
                pairs[at] = score(one + parts[at + 1], none)
        return parts

    def _fit(self, left: str, right: str) -> bool:
        found = self._merges_to(left + right, len(left))
        self.pairs.setdefault(left, {})[right] = found
        self.n_pairs += 1
        return found

    def _longest(self, text: str, at: int) -> str:
        """The longest piece that starts at a place, or the character there."""
        ahead = text[at: at + self.longest_piece]
        for n in range(self.automaton.longest_prefix(ahead), 0, -1):
            if ahead[:n] in self.shorter:
                return ahead[:n]
        return ahead[0]

    def _walk(self, text: str, greedy: list[str]) -> list[str]:
        """The pieces of a chunk, by backtracking from the longest matches that follow each other from its start."""
        end, shorter, pairs, fit = len(text), self.shorter, self.pairs, self._fit
        ahead, pos, nothing = {}, 0, {}
        for piece in greedy:
            ahead[pos] = piece
            pos += len(piece)
        failed, found, last, pos = bytearray((end >> 3) + 1), [], None, 0
        piece = ahead.get(0) or self._longest(text, 0)
        while True:
            place = pos + len(piece)
            if not failed[place >> 3] >> (place & 7) & 1 and (
                last is None or (fit(last, piece) if (stands := pairs.get(last, nothing).get(piece)) is None else stands)
            ):
                found.append(piece)
                last, pos = piece, place
                if pos == end:
                    return found
                piece = ahead.get(pos) or self._longest(text, pos)
                continue
            piece = shorter.get(piece)
            while piece is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                given_up = found.pop()
                last = found[-1] if found else None
                pos -= len(given_up)
                piece = shorter.get(given_up)

    def _keep(self, chunk: str, greedy: list[str]) -> None:
        """Encode a new chunk: the longest matches as they are if they stand, else the way back and forth."""
        if "".join(greedy) == chunk:
            pairs, whole = self.pairs, greedy
            for left, right in zip(greedy, greedy[1:]):
                stands = pairs[left].get(right)
                if not (self._fit(left, right) if stands is None else stands):
                    whole = self._walk(chunk, greedy)
                    break
        else:
            whole = self._walk(chunk, [])
        self._note(chunk, whole)

    def _note(self, chunk: str, whole: list[str]) -> None:
        ids = " ".join(map(self.codes.__getitem__, whole))
        self.known[chunk] = (ids.count(" ") + 1, ids, "".join(whole).replace(_SPACE, " "))

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not known yet, with one pass of the automaton over all long ones."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        if self.n_pairs > 4 * KEPT:
            self.pairs, self.n_pairs = {text: {} for text in self.shorter}, 0
        fresh = []
        for chunk in chunks.difference(self.known):
            found = self.older.get(chunk)
            if found is not None:
                self.known[chunk] = found
            elif len(chunk) <= _SHORT:
                self._note(chunk, self._merged(chunk))
            else:
                fresh.append(chunk)
        parting, greedy, turn = self.parting, [], 0
        joined = [c for c in fresh if parting not in c]
        for _, piece in self.automaton.iter_long(parting.join(joined) + parting) if joined else ():
            if piece == parting:
                self._keep(joined[turn], greedy)
                greedy, turn = [], turn + 1
            else:
                greedy.append(piece)
        for chunk in fresh if len(joined) < len(fresh) else ():
            if parting in chunk:
                self._keep(chunk, [])

    def texts(self, texts: list) -> Iterator[list[tuple[int, str, str]]]:
        """The results of the chunks of each text, the space that the library puts first included."""
        at = 0
        while at < len(texts):
            found, seen, size = [], set(), 0
            while at < len(texts) and size < _SLICE:
                text = texts[at] or ""
                chunks = self.chunks((_SPACE + text).replace(" ", _SPACE)) if text else []
                found.append(chunks)
                seen.update(chunks)
                size += len(text)
                at += 1
            self.learn(seen)
            for chunks in found:
                yield list(map(self.known.__getitem__, chunks))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no character become one mark each, an id outside the model nothing."""
        return self.spell(map(str, ids))

    def spell(self, codes: Iterable[str]) -> str:
        """The same from ids in decimal.  The space put first goes where the first id that shows is a piece with one."""
        text = "".join(map(self.shown.__getitem__, codes)).strip(_NOTHING).removeprefix(_SPACE).replace(_SPACE, " ")
        return text if text.isascii() else _BYTES.sub(_characters, text).replace(_NOTHING, "")


def _characters(run: re.Match) -> str:
    """The characters of a run of bytes."""
    data, at, out = bytes(ord(c) - 0xDC00 for c in run[0]), 0, []
    while at < len(data):
        size = next((n for n in (1, 2, 3, 4) if _is_character(data[at: at + n])), 0)
        out.append(data[at: at + size].decode() if size else _BAD)
        at += size or 1
    return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _coder(model: bytes) -> PieceCoder:
    return worker_state("pieces_" + hashlib.sha256(model).hexdigest(), lambda: PieceCoder(model))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the ids of every row, the end id last."""
    def run(batches):
        coder = _coder(model)
        for batch in batches:
            ids = [[int(i) for _, part, _ in found for i in part.split(" ")] + [coder.end_id] for found in coder.texts(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text that the ids of every row stand for; null ids are none."""
    def run(batches):
        coder = _coder(model)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from these ids, of every row in one pass."""
    def run(batches):
        coder = _coder(model)
        end = str(coder.end_id)
        for batch in batches:
            n, ids, decoded = [], [], []
            for found in coder.texts(batch["text"].to_pylist()):
                coded = " ".join([*(part for _, part, _ in found), end])
                codes = coded.split(" ")
                n.append(len(codes))
                ids.append(hashlib.sha256(coded.encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.spell(codes).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_model() -> bytes:
    """The public model's file; read on the driver, so workers need no file."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op11_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(read(spark, folder, "documents"), public_model())
