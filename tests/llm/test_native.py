"""Quality rules, URL filter and mixing: SQL, brute force and odd rows."""

import hashlib
import re
from collections import Counter

import pytest

from compare import TABLES, ordered
from leadloom.llm import mixing, quality_rules, url_filter
from leadloom.llm.queries import QUERIES, SQL
from odd import CLASHING, ROWS, no_docs, odd_docs, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(SQL[name])
    df = QUERIES[name](spark, FOLDER)
    left, right = ordered(df.columns, [tuple(r) for r in df.collect()]), ordered([c[0] for c in result.description], result.fetchall())
    assert left == right and left[1]


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_of_odd_rows(spark):
    found = quality_rules.judge(odd_docs(spark)).drop("kept", "failed_rule")
    assert rows_of(found) == sorted(((r[0], *base_counts(r[1])) for r in ROWS), key=repr)
    assert quality_rules.judge(no_docs(spark)).count() == 0


def test_sketches_merge_and_fences_adapt(spark):
    """A language that writes longer words gets its own fence; junk within a source fails."""
    short = [(i, " ".join(f"ab{(i * 31 + j * 7) % 97:02d}x" for j in range(80)), "x", f"s{i % 2}") for i in range(600)]
    long_ = [(1000 + i, " ".join(f"abcdefghijkl{(i * 31 + j * 7) % 97:02d}x" for j in range(80)), "y", "s0") for i in range(600)]
    junk = [(5000, " ".join(f"ab{j}#$%" for j in range(80)), "x", "s0"), (5001, " ".join(f"abcdefghijkl{j}" for j in range(80)), "x", "s1")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(short + long_ + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[r[0]] for r in short + long_) and not kept[5000] and not kept[5001]
    sketch = quality_rules.sketches(quality_rules.measure(odd_docs(spark)))
    assert sketch.groupBy("measure").sum("n").distinct().count() == len(quality_rules.MEASURES)


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0), ("d", 300)], "source string, size long")
    found = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    total = sum(r["source_size"] for r in found.values())
    assert abs(sum(r["target"] for r in found.values()) - 1.5 * total) < 1e-6
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in found.values())
    # Sources under their top share one level per weight: a 5, b 2, c 1, d 5, null 2.
    levels = {round(found[s]["target"] / w, 6) for s, w in (("a", 5), ("b", 2), ("c", 1), ("d", 5)) if found[s]["target"] < 2 * found[s]["source_size"] - 1e-9}
    assert len(levels) == 1


def test_mix_copies_rows(spark):
    docs = odd_docs(spark)
    report = mixing.mix_report(docs)
    again = rows_of(mixing.mix_report(docs))
    assert rows_of(report) == again and len(again) == len(ROWS)
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"] for r in report.collect())
    copies = Counter({r: 0 for r in ROWS})
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in report.collect())
    assert {tuple(r)[:4] for r in mixed.collect()} <= set(copies)
    assert mixing.mix_report(no_docs(spark)).count() == 0 and mixing.mix_documents(no_docs(spark)).count() == 0


def test_draw_is_the_digest(spark):
    found = spark.range(50).select("id", mixing.draw(mixing.F.col("id")).alias("u")).collect()
    assert all(r["u"] == int(hashlib.md5(f"{mixing.SEED}:{r['id']}".encode()).hexdigest()[:8], 16) / 2**32 for r in found)


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y=1", "https://example.net/en", "http://x.net", "http://x.net/", "http://notexample.com/de/1",
    "http://www.example.com/de/1#f", "http://example.com/en/1", "http://a.org/fr/1?u=http://b.net/", "http://a.org?x=/fr/", "ftp://casino.spam-bets.info/a/b/c?x=1&y=2",
    "http://EXAMPLE.com/DE/1", "http://a.org/fr/" + "x" * 9000,
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (h := r[: r.index("/")]) and (host == h or host.endswith("." + h)) and path.startswith(r[r.index("/"):])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_of_urls(spark):
    clash = [f"{i} AS {c}" for i, c in enumerate(CLASHING)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, None), (None, URLS[4])], "page_id long, url string").selectExpr("*", *clash)
    for r in url_filter.judge(pages).collect():
        host, path, rule, verdict = by_hand(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages).count() == len(URLS) + 2


def test_trees_learn_a_lexical_trait(spark):
    rows = [(i, f"http://{'free-bets' if i % 4 == 0 else 'plainname'}.x{i % 3}.example.org/en/{i}") for i in range(400)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    verdicts = {r["page_id"]: r["verdict"] for r in found.collect()}
    assert all((v == "block") == (i % 4 == 0) for i, v in verdicts.items())


def test_tree_sums_match_a_plain_count(spark):
    rows = spark.createDataFrame([(i % 2, i % 5) + (0,) * (len(url_filter.FEATURES) - 1) for i in range(100)], ["label", *url_filter.FEATURES])
    found = url_filter._histograms(rows, url_filter.F.lit(0.0), url_filter.F.lit(0))
    name = next(iter(url_filter.FEATURES))
    assert [b[0] for b in found[(0, name)]] == [0, 1, 2, 3, 4]
    assert all(abs(b[2] - 20 * 0.25) < 1e-9 for b in found[(0, name)])
