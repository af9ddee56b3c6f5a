"""Main text of HTML pages, with a suffix array per host for the boilerplate that markup does not name.

A page is read into blocks.  Blocks inside an article or main element are text;
blocks inside elements that are boilerplate by their name or class (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, reader comments)
are not.  The words of all blocks outside articles make the page's token stream.
The streams of a host's pages are joined, sorted as suffixes, and neighbours in
that order with at least `RUN` equal words show which runs repeat on distinct
pages.  A block that is mostly covered by runs of many of the host's pages is
boilerplate; blocks that keep unique runs are text.

Copies are not boilerplate.  Pages of a host with equal streams (with an article:
equal pages) count as one.  A page without an article of whose open words less
than `OWN` would be left is taken as a near copy: the host's runs are counted
again without such pages, so a run is boilerplate only if it repeats on pages
that have text of their own besides.  If nothing would be left of a page even
then, its repeated blocks stay.

A host with many pages is dealt out in blocks of about `PAGES_PER_ARRAY` pages;
the suffix array of each gives counts of pages per run, those on one page
included.  They are added up over the host before the threshold applies, so it
does not matter how pages are dealt, and no task holds more than a block.

Defined cases: a null or empty page has the empty text; a null URL is a host of
its own; equal rows get equal texts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import byte_slices, letter_words, read, space_table, word_bounds, word_hashes
from leadloom.llm.url_filter import host
from leadloom.session import settle

RUN = 4
MIN_PAGES = 3
MIN_SHARE = 0.01
COVERED = 0.8
OWN = 0.1
PAGES_PER_ARRAY = 128

_ARTICLE = frozenset(("article", "main"))
#: Elements that hold the whole page; their names say what else is on it.
_PAGE = frozenset(("html", "body"))
_CHROME = frozenset((
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "template", "noscript", "iframe", "svg", "object", "label",
))
_RAW = frozenset(("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "xmp", "math"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br"
).split())
#: Words of class, id and role that name boilerplate.
_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer discussion disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay popup promo promoted promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary alert"
).split())
#: Names that an article's own parts may carry.
_OWN = frozenset(("header", "notice", "search", "alert"))
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
#: A name with its value, which is consumed whole, so that no word of a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that one of the same name ends.
_SELF_CLOSING = frozenset("p li tr td th dt dd option".split())
ARTICLE, CHROME, PLAIN = 0, 1, 2


def _named(attributes: str, inside_article: bool) -> bool:
    """Whether class, id, role or hidden mark boilerplate."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return True
        if name not in ("class", "id", "role"):
            continue
        parts = {p.lower() for p in _PARTS.findall("".join(values))}
        if parts & (_NAMES - _OWN if inside_article else _NAMES):
            return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; white space is one space, references are decoded.

    One pass: tags are found from left to right, and open elements are counted
    by name, so neither depth nor broken markup costs more than length.
    """
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = []
    counts: Counter = Counter()
    zone, parts, at, html, pattern = PLAIN, [], 0, html or "", _TAG

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((zone, text))

    def pop() -> tuple[str, int]:
        last = open_.pop()
        counts[last[0]] -= 1
        return last

    while True:
        start = html.find("<", at)
        if start < 0:
            parts.append(html[at:])
            break
        parts.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
            continue
        tag = pattern.match(html, start)
        if not tag and pattern is _TAG and _TAG_START.match(html, start):
            # An open quote: from here on a tag ends at the next bracket.
            pattern = _LOOSE_TAG
            tag = pattern.match(html, start)
        if not tag:
            if _TAG_START.match(html, start) and html.find(">", start) < 0:
                parts.append(html[start:])
                break
            parts.append("<")
            at = start + 1
            continue
        at, closing, name, attributes = tag.end(), tag[1], tag[2].lower(), tag[3]
        if name in _RAW and not closing:
            found = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(html, at)
            end = html.find(">", found.start()) if found else -1
            at = len(html) if end < 0 else end + 1
            parts.append(" ")
            continue
        if name in _INLINE and (name in _VOID or closing or not _named(attributes, zone == ARTICLE)):
            if name == "br":
                parts.append(" ")
            if not closing or not counts[name]:
                continue
        flush()
        if closing:
            while counts[name]:
                left, zone = pop()
                if left == name:
                    break
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _SELF_CLOSING and open_ and open_[-1][0] == name:
            zone = pop()[1]
        if name == "body":
            open_, zone = [], PLAIN
            counts.clear()
        inside = counts["article"] + counts["main"] > 0
        open_.append((name, zone))
        counts[name] += 1
        if name in _ARTICLE and not (inside and zone == CHROME):
            zone = ARTICLE
        elif name in _CHROME and not (name == "header" and zone == ARTICLE) or name not in _PAGE and _named(attributes, inside):
            zone = CHROME
    flush()
    return out


def undecided(found: list[tuple[int, str]]) -> set[int]:
    """Blocks that markup leaves open: the plain ones of a page without an article."""
    if any(zone == ARTICLE for zone, _ in found):
        return set()
    return {i for i, (zone, _) in enumerate(found) if zone == PLAIN}


def main_text(found: list[tuple[int, str]], repeated: set[int] = frozenset()) -> str:
    """The text of a page from its blocks, without the undecided ones that repeat over the host."""
    open_ = undecided(found)
    unique = open_ - set(repeated) or open_
    return "\n\n".join(text for i, (zone, text) in enumerate(found) if zone == ARTICLE or i in unique)


def streams(html: pa.Array) -> tuple[list, list]:
    """Word hashes of the blocks outside articles, per page, and the block each word is in (-1 if markup decides on it)."""
    tokens, owners = [], []
    letters, spaces = letter_words(fold=True), space_table()
    for page in html.to_pylist():
        found = blocks(page)
        open_ = undecided(found)
        outside = [(i if i in open_ else -1, text) for i, (zone, text) in enumerate(found) if zone != ARTICLE]
        own, done = ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)]), 0
        for _first, _end, data, offsets in byte_slices(pa.array([t for _, t in outside], pa.string())):
            starts, ends, firsts = word_bounds(data, offsets, spaces)
            own[0].append((word_hashes(data, starts, ends, letters) >> np.uint64(33)).astype(np.int32))
            numbers = np.array([i for i, _ in outside[done: done + len(offsets) - 1]], np.int32)
            own[1].append(np.repeat(numbers, np.diff(firsts)))
            done += len(offsets) - 1
        tokens.append(np.concatenate(own[0]))
        owners.append(np.concatenate(own[1]))
    return tokens, owners


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their next `depth` tokens, by prefix doubling, and the common length with the place before, up to `depth`."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, width = rank.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        later = np.zeros(n, np.int64)
        later[: max(n - width, 0)] = rank[width:]
        order = np.lexsort((later, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (later[order[1:]] != later[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
    common, alike = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        a, b = order[1:] + k, order[:-1] + k
        inside = (a < n) & (b < n)
        alike &= inside & (tokens[np.minimum(a, n - 1)] == tokens[np.minimum(b, n - 1)])
        common[1:] += alike
    return order, common


def _joined(pages: list) -> tuple[np.ndarray, np.ndarray]:
    """One stream of all pages with a token of its own after each, and the page of every token."""
    apart = [np.append(p.astype(np.int64), -1 - i) for i, p in enumerate(pages)]
    return np.concatenate(apart) if apart else np.zeros(0, np.int64), np.repeat(np.arange(len(apart)), [len(p) for p in apart])


def run_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of the run of `RUN` words at each place."""
    key = np.zeros(len(tokens), np.uint64)
    for k in range(RUN):
        there = np.zeros(len(tokens), np.uint64)
        there[: max(len(tokens) - k, 0)] = tokens[k:].astype(np.uint64)
        key = key * np.uint64(0xD1342543DE82EF95) + there + np.uint64(1)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def repeated_runs(pages: list, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs that stand on `least` pages or more, and on how many, from the suffix array of the joined streams."""
    tokens, page = _joined(pages)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, common = suffix_array(tokens, RUN)
    group = np.cumsum(common < RUN) - 1
    cells = np.unique(np.stack([group, page[order]], axis=1), axis=0)
    n = np.bincount(cells[:, 0])
    heads = order[np.searchsorted(group, np.arange(len(n)))]
    # Runs over the end of a page are no runs.
    ends = np.append(np.flatnonzero(tokens < 0), len(tokens))
    whole = ends[np.searchsorted(ends, heads)] - heads >= RUN
    found = np.flatnonzero((n >= least) & whole)
    return run_keys(tokens)[heads[found]], n[found].astype(np.int64)


def covered_blocks(tokens: np.ndarray, owners: np.ndarray, frequent: np.ndarray) -> list[int]:
    """Blocks of a page of whose words at least `COVERED` lie in frequent runs."""
    if len(tokens) < RUN or owners.max() < 0:
        return []
    starts = np.flatnonzero(np.isin(run_keys(tokens.astype(np.int64))[: len(tokens) - RUN + 1], frequent))
    inside = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + RUN, -1)
    covered = np.cumsum(inside[:-1]) > 0
    numbers, back = np.unique(owners, return_inverse=True)
    share = np.bincount(back, covered) / np.bincount(back)
    return numbers[(share >= COVERED) & (numbers >= 0)].tolist()


def _page_key() -> Column:
    return F.xxhash64("url", "html")


def own_share(owners: np.ndarray, repeated: list[int]) -> float:
    """Share of the words of a page's open blocks that stand in blocks that do not repeat."""
    open_ = owners[owners >= 0]
    return 1 - float(np.isin(open_, repeated).mean()) if len(open_) else 1.0


def _frequent(counting: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """host, part, run of the runs on many of the host's pages, for every part of the host."""
    def runs(table: pa.Table) -> pa.Table:
        # The only part of its host can drop what the threshold drops; of others every run goes into the sum.
        least = max(1, min_pages, int(np.ceil(table.num_rows * min_share))) if table["parts"][0].as_py() == 1 else 1
        found, n = repeated_runs([np.asarray(t, np.int64) for t in table["tokens"].to_pylist()], least)
        return pa.table({"host": pa.array([table["host"][0].as_py()] * len(found), pa.string()), "run": found, "n": n})

    hosts = settle(counting.groupBy("host").agg(F.count("*").alias("pages"), F.max("parts").alias("parts")).withColumnRenamed("host", "_host"), "page-counts")
    counted = counting.select("host", "part", "parts", "tokens").groupBy("host", "part").applyInArrow(runs, "host string, run long, n long")
    summed = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    return (
        settle(summed, "page-runs").join(hosts, F.col("host") == F.col("_host"))
        .where(F.col("n") >= F.col("pages") * min_share)
        .select(F.col("host"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "run")
    )


def _covered(dealt: DataFrame, frequent: DataFrame) -> DataFrame:
    """host, stream, repeated and whether text of its own is left, of the pages of which frequent runs cover open blocks."""
    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        runs_ = right["run"].to_numpy() if right.num_rows else np.zeros(0, np.int64)
        owners = [np.asarray(o, np.int64) for o in left["owners"].to_pylist()]
        found = [covered_blocks(np.asarray(t, np.int64), o, runs_) for t, o in zip(left["tokens"].to_pylist(), owners)]
        own = [own_share(o, f) >= OWN for o, f in zip(owners, found)]
        rows = pa.table({"host": left["host"], "stream": left["stream"], "repeated": pa.array(found, pa.list_(pa.int32())), "own": pa.array(own, pa.bool_())})
        return rows.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return dealt.select("host", "part", "stream", "tokens", "owners").groupBy("host", "part").cogroup(frequent.groupBy("host", "part")).applyInArrow(
        cover, "host string, stream long, repeated array<int>, own boolean")


def repeated_blocks(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """_key, _repeated of the pages of which the host's suffix arrays cover plain blocks."""
    def read_streams(batches):
        for batch in batches:
            tokens, owners = streams(batch["html"])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["page"], batch["host"], pa.array(tokens, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int32()))],
                names=["key", "page", "host", "tokens", "owners"])

    keyed = pages.select(_page_key().alias("key"), F.xxhash64("html").alias("page"), host(F.col("url")).alias("host"), "html")
    stream = F.when(F.array_max("owners") >= 0, F.xxhash64("tokens", "owners")).otherwise(F.col("page"))
    read_ = settle(
        keyed.mapInArrow(read_streams, "key long, page long, host string, tokens array<int>, owners array<int>").withColumn("stream", stream).drop("page"),
        "page-streams")
    firsts = read_.dropDuplicates(["host", "stream"]).drop("key")
    hosts = settle(
        read_.select("host", "stream").distinct().groupBy("host").agg(F.count("*").alias("pages"))
        .select(F.col("host").alias("_host"), F.ceil(F.col("pages") / PAGES_PER_ARRAY).cast("int").alias("parts")), "page-hosts")
    dealt = settle(
        firsts.join(hosts, F.col("host") == F.col("_host"))
        .select("host", "stream", F.pmod("stream", F.col("parts").cast("long")).cast("int").alias("part"), "parts", "tokens", "owners"), "page-parts")

    found = settle(_covered(dealt, _frequent(dealt, min_pages, min_share)), "page-covered")
    copies = found.where(~F.col("own")).select(F.col("host").alias("_host"), F.col("stream").alias("_stream"))
    if not copies.isEmpty():
        hosts_ = copies.select("_host").distinct()
        again = settle(dealt.join(hosts_, F.col("host") == F.col("_host"), "left_semi"), "page-again")
        counting = again.join(copies, (F.col("host") == F.col("_host")) & (F.col("stream") == F.col("_stream")), "left_anti")
        second = _covered(again, _frequent(counting, min_pages, min_share))
        found = settle(found.join(hosts_, F.col("host") == F.col("_host"), "left_anti").unionByName(second), "page-recovered")
    found = found.select(F.col("host").alias("_host"), F.col("stream").alias("_stream"), F.col("repeated").alias("_repeated"))
    keys = read_.select("host", "stream", F.col("key").alias("_key")).distinct()
    return keys.join(found, (F.col("host") == F.col("_host")) & (F.col("stream") == F.col("_stream"))).select("_key", "_repeated")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    repeated = settle(repeated_blocks(pages, min_pages, min_share), "page-repeated")

    def run(batches):
        for batch in batches:
            texts = [
                main_text(blocks(page), set(again or [])) for page, again in zip(batch["html"].to_pylist(), batch["_repeated"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = pages.select("page_id", "url", "html", _page_key().alias("_page")).join(repeated, F.col("_page") == F.col("_key"), "left")
    return joined.select("page_id", "url", "html", "_repeated").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages"))
