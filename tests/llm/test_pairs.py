"""Near-duplicates, fingerprints, components and extraction against brute force."""

import hashlib
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadloom.llm import fingerprints, html_extract, near_dedup
from leadloom.llm.components import components
from leadloom.llm.queries import QUERIES
from odd import CLASHING, ROWS, no_docs, odd_docs, rows_of, shuffled_words

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(5)]))


def groups_by_hand(rows):
    """(set size, smallest reachable id) per row of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for g in s for j in holders[g] if j < i and rows[j][0] is not None).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), None if doc_id is None else least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def check_groups(found, rows):
    wanted = [(d, n, c, d is None or d == c) for d, n, c in groups_by_hand(rows)]
    assert rows_of(found) == sorted(wanted, key=repr)


def test_near_groups_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(QUERIES["op3_near_dedup"](spark, FOLDER), rows)


def test_near_groups_of_odd_rows(spark):
    check_groups(near_dedup.near_groups(odd_docs(spark)), [r[:2] for r in ROWS])
    assert near_dedup.near_groups(no_docs(spark)).count() == 0


def test_near_groups_of_many_copies(spark):
    """A large group of near copies around the threshold, exact copies, and texts that share a passage only."""
    rng, base, passage = random.Random(4), shuffled_words(1, 120, 5000), shuffled_words(2, 60, 5000)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]
    rows += [(2000 + i, " ".join(shuffled_words(100 + i, 150, 5000) + passage)) for i in range(60)]
    check_groups(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_pairs_just_under_the_threshold_end_at_their_bitmaps(spark, monkeypatch):
    """Each text has three changes of its own: most pairs have a likeness of 0.65 to 0.7, which sketches cannot rule out."""
    rng, base = random.Random(8), shuffled_words(3, 150, 5000)
    rows = []
    for i in range(60):
        words = list(base)
        for place in rng.sample(range(5, 145), 3):
            words[place] = f"n{i}x{place}"
        rows.append((i, " ".join(words)))
    written, settle = [], near_dedup.settle

    def counted(df, name):
        table = settle(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(near_dedup, "settle", counted)
    check_groups(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert next(n for name, n in written if name == "near-rest") < 200


def test_bitmaps_never_rule_out_a_link(spark):
    rng, sets = np.random.default_rng(6), []
    for size in (1, 5, 146, 600, 4000):
        whole = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        sets += [whole, whole[: max(1, size * 9 // 10)], np.unique(np.append(whole[size // 8:], rng.integers(0, 1 << 63, size // 10, np.uint64)))]
    firsts = np.append(0, np.cumsum([len(s) for s in sets]))
    bits, hidden = near_dedup.bitmaps(np.concatenate(sets), firsts)
    rows = spark.createDataFrame(
        [(i, [int(w) for w in b.view(np.int64)], int(h)) for i, (b, h) in enumerate(zip(bits, hidden))], "i int, bitmap array<long>, hidden long")
    x, y = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "xy")
    for i, j, most in x.crossJoin(y).select("x_i", "y_i", near_dedup.most_shared("x", "y")).collect():
        shared = len(np.intersect1d(sets[i], sets[j]))
        assert shared <= most and (i != j or most == shared)


def test_one_of_each(spark):
    docs = odd_docs(spark)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    stay = {d for d, _, c in groups_by_hand([r[:2] for r in ROWS]) if d == c and d is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(stay)
    assert kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(200, 260)] + [(i, i + 1) for i in range(300, 340)]
    root = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_both_extremes_make_the_signature():
    values, firsts = np.arange(10, 60, dtype=np.uint64), np.array([0, 20, 50])
    same = near_dedup.band_keys(near_dedup.extremes(np.concatenate([values[:20], values[:20]]), np.array([0, 20, 40])))
    assert (same[0] == same[1]).all()
    other = near_dedup.band_keys(near_dedup.extremes(values, firsts))
    assert (other[0] != other[1]).any()


@pytest.mark.parametrize("size", [1, 40, 300, 5_000])
def test_sketches_count_the_bins_that_differ(spark, size):
    rng = np.random.default_rng(size)
    both = rng.integers(0, 1 << 62, max(1, size * 3 // 4)).astype(np.uint64)
    own = [rng.integers(0, 1 << 62, (size - len(both)) // 2).astype(np.uint64) for _ in range(2)]
    x, y = (np.sort(np.concatenate([both, o])) for o in own)
    marks = near_dedup.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    bins = []
    for values in (x, y):
        least = {}
        for v in values.tolist():
            least.setdefault(v % near_dedup.BINS, 1 + (v >> 20) % 15)
        bins.append(least)
    wanted = sum(bins[0].get(b) != bins[1].get(b) for b in range(near_dedup.BINS))
    a, b = marks.view(np.int64).tolist()
    pair = spark.createDataFrame([(a, b, len(x) + len(y))], "a array<long>, b array<long>, size long")
    found = pair.select(near_dedup.differing("a", "b").alias("n"), near_dedup.most_different(F.col("size")).alias("most")).first()
    assert found["n"] == wanted <= found["most"]


def test_the_limit_rules_out_pairs_far_apart(spark):
    rng = np.random.default_rng(9)
    both, own = rng.integers(0, 1 << 62, 100), rng.integers(0, 1 << 62, (2, 100))
    x, y = (np.sort(np.concatenate([both, o])).astype(np.uint64) for o in own)
    marks = near_dedup.sketches(np.concatenate([x, y]), np.array([0, 200, 400])).view(np.int64).tolist()
    pair = spark.createDataFrame([(*marks, 400)], "a array<long>, b array<long>, size long")
    found = pair.select(near_dedup.differing("a", "b").alias("n"), near_dedup.most_different(F.col("size")).alias("most")).first()
    assert found["n"] > found["most"]


def digests_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op5_fingerprints"](spark, FOLDER)
    assert rows_of(found.select("doc_id", "n_chars", "edited_sha256")) == digests_by_hand(rows)
    assert found.where("near_edited > near_next").count() > 0.97 * len(rows)
    odd = fingerprints.fingerprints(odd_docs(spark))
    assert rows_of(odd.select("doc_id", "n_chars", "edited_sha256")) == digests_by_hand([r[:2] for r in ROWS])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in odd.collect())
    prints = {}
    for r in odd.collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[9] == prints[10] and len(prints[5]) == 1
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0


def test_ranges_meet(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 3)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(100)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found.select("doc_id", "n_chars", "edited_sha256")) == digests_by_hand(rows)


def test_walk_by_hand():
    """The vectorised walk writes what a plain loop writes."""
    texts = ["", "a", "hello world, hello again", "abc" * 200]
    stay, sampled = fingerprints.stays(), fingerprints.places()
    walk, digits = fingerprints.embed(texts)
    for text, length, own in zip(texts, walk, digits):
        written, step = [], 0
        for c in text:
            mixed = int(fingerprints.mix(np.array([ord(c)], np.uint64) + np.uint64(0x51ED27))[0])
            n = int(stay[mixed >> 58, step % fingerprints.PHASES])
            written += [mixed & 15] * n
            step += n
        assert step == length
        assert [int(d) for d in own if d != 255] == [written[p] for p in sampled if p < step]
    again = fingerprints.from_text(fingerprints.as_text(walk, digits))
    assert (again[0] == walk).all() and (again[1] == digits).all()


def test_near_prints(spark):
    base = " ".join(shuffled_words(5, 300))
    rows = [(1, base), (2, base[:700] + "!" + base[700:]), (3, " ".join(shuffled_words(6, 300))), (4, base), (None, base)]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r["group_id"] for r in fingerprints.near_groups(prints).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1, None: None}


def article_by_hand(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(p for p in parts if p)


def test_articles_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op2_html_text"](spark, FOLDER).collect():
        assert r["text"] == article_by_hand(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b <!-- x --> c", "a < b c"), ("<script>if (a<b) {}</script>x", "x"),
    ("<nav>m</nav><div id=content><h1>T</h1><p>One\n two<br>three<p>Four</div><div class='site-footer'>f</div>", "T\n\nOne two three\n\nFour"),
    ("<main><p>a<aside>s</aside><p>b<section id=comments><p>c</section></main><p>out", "a\n\nb"),
    ("<header>h</header><article><header><h1>T</h1></header><p>x &eacute;&#233;&nbsp;y<footer>f</footer></article>", "T\n\nx éé y"),
    ("<div hidden>h</div><p>x</p><form>f</form><p>y <b>z", "x\n\ny z"),
    ("<nav>unclosed <li>m <article><p>kept</article>", "kept"), ("<p a='x>y'>t</p><p b=\"", "t\n\n<p b=\""),
])
def test_blocks(page, text):
    assert html_extract.main_text(html_extract.blocks(page)) == text


@pytest.mark.parametrize("page", ["<a " * 60_000, "<div>" * 60_000, "<p class='ad'>" * 30_000, "<" * 100_000, "<a \"" * 60_000, "<nav>" * 30_000 + "</nav>" * 30_000])
def test_broken_pages_take_linear_time(page):
    assert isinstance(html_extract.blocks(page), list)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        tokens = rng.integers(0, 4, n)
        order, common = html_extract.suffix_array(tokens, 8)
        heads = [tuple(tokens[i:i + 8]) for i in order]
        assert heads == sorted(tuple(tokens[i:i + 8]) for i in range(n))
        for i in range(1, n):
            k = 0
            while k < 8 and k < len(heads[i]) and k < len(heads[i - 1]) and heads[i][k] == heads[i - 1][k]:
                k += 1
            assert common[i] == k


def test_runs_on_distinct_pages():
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(8)]
    keys, n = html_extract.repeated_runs(pages)
    holders = Counter(k for p in pages for k in {tuple(p[i:i + 4]) for i in range(len(p) - 3)})
    assert sorted(n) == sorted(v for v in holders.values() if v > 1) and len(set(keys)) == len(keys)


def test_repeated_blocks_of_a_host(spark):
    menu, notice = " ".join(f"Menu{i}" for i in range(8)), "all rights reserved by the owners"
    rows = [
        (i, f"http://{'hot' if i < 400 else 'two'}.example.org/{i}", f"<body><div>{menu}</div><div><p>Own text {i} of page {i * 7} here</p><p>{notice}</p></div>")
        for i in range(402)
    ] + [(900 + i, "http://copy.example.org/", "<p>The same page as all others of this host</p>") for i in range(5)] + [(None, None, None)]
    clash = [f"{i} AS {c}" for i, c in enumerate(CLASHING)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *clash)).collect()}
    assert all(found[i] == f"Own text {i} of page {i * 7} here" for i in range(400))
    assert found[400].startswith(menu) and found[900] == "The same page as all others of this host" and found[None] == ""


def test_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_streams_skip_articles():
    tokens, owners = html_extract.streams(pa.array(["<nav>a b</nav><article>c d e</article>f", "<p>a b<p>c", None]))
    assert [len(t) for t in tokens] == [3, 3, 0]
    assert owners[0].tolist() == [-1, -1, -1] and owners[1].tolist() == [0, 0, 1]


@pytest.mark.parametrize("page, text", [
    ("<article><p>see <a href='/hidden-gems/'>gems</a> and <a href=\"https://x.org/hidden\">this</a> too</article>", "see gems and this too"),
    ("<p title='the hidden cost'>a</p><section aria-label=\"Our hidden fees\">b</section><p data-x='id=menu class=ad'>c", "a\n\nb\n\nc"),
    ("<p hidden>a</p><p title='x' HIDDEN=''>b</p><p data-a=1 class = 'ad'>c</p><p/id=nav>d</p><p>e", "e"),
])
def test_attributes_by_name(page, text):
    assert html_extract.main_text(html_extract.blocks(page)) == text


def test_runs_are_counted_over_the_whole_host(spark):
    """A notice on four of 300 pages is boilerplate of the host, however its pages are dealt."""
    notices = [" ".join(f"n{k}word{j}" for j in range(8)) for k in range(60)]
    rows = [(i, f"http://big.example.org/{i}", f"<p>own{i} text{i} of{i} page{i} here{i}</p><p>{notices[i % 75] if i % 75 < 60 else f'x{i}'}</p>") for i in range(300)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 300 and not any("n" + str(k) + "word" in r["text"] for r in found for k in [r["page_id"] % 75] if k < 60)


def test_runs_on_one_page_end_with_it():
    keys, n = html_extract.repeated_runs([np.arange(5), np.arange(3), np.arange(1, 5)], 1)
    assert sorted(n) == [1, 2] and len(set(keys)) == 2


def test_copies_keep_their_text(spark):
    """Near copies keep what they share, on a host with a menu and on one of copies only; repeated rows do not make their text repeat, or their menu unique."""
    menu, text = " ".join(f"Menu{i}" for i in range(8)), " ".join(f"told{i}" for i in range(60))
    page = lambda own, more="": f"<div>{menu}</div><div><p>{own}</p>{more}</div>"
    rows = [(i, f"http://mixed.example.org/{i}", page(f"own{i} words{i} of{i} this{i} page{i}")) for i in range(40)]
    rows += [(100 + i, f"http://mixed.example.org/c{i}", page(text, f"<p>Seen {i}</p>")) for i in range(3)]
    rows += [(200 + i, f"http://copies.example.org/{i}", f"<p>{text}</p><p>Seen {i} times</p>") for i in range(5)]
    rows += [(300 + i, "http://mixed.example.org/equal", page(f"{text[::-1]} equal")) for i in range(6)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows) and all(found[i] == f"own{i} words{i} of{i} this{i} page{i}" for i in range(40))
    assert all(found[100 + i] == f"{text}\n\nSeen {i}" for i in range(3))
    assert all(found[200 + i] == f"{text}\n\nSeen {i} times" for i in range(5))
    assert all(found[300 + i] == f"{text[::-1]} equal" for i in range(6))


def test_names_on_the_whole_page_cost_no_text():
    page = '<html class="no-js has-search"><body class="home has-sidebar"><div><p>The text.</p></div><div class="sidebar">Menu</div></body></html>'
    assert html_extract.main_text(html_extract.blocks(page)) == "The text."
