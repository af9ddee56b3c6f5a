"""Column functions on single cases."""

import datetime as dt
import re
from html import unescape
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from leadloom.functions import addresses as A
from leadloom.functions import html as H
from leadloom.functions import mail as M
from leadloom.functions import quality as Q
from leadloom.functions import responses as R
from leadloom.functions import schedule as S
from leadloom.functions import suffixes, urls
from leadloom.functions.dictionary import Dictionary
from leadloom.functions.text import strip, words
from leadloom.functions.text_counts import text_counts
from leadloom.operators import contacts as C
from leadloom.operators import pages as P
from leadloom.operators import people as PE


def column(spark, values, use, kind="string"):
    """use(col) over a list of values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


def test_registrable_domain(spark):
    cases = {
        "https://www.Acme.com/foo?utm_source=x": "acme.com", "acme.com": "acme.com", " shop.other.co.uk ": "other.co.uk",
        "": "", "localhost": "", "http://10.0.0.1/x": "", "http://user:pw@mail.acme.io:8080/": "acme.io", "co.uk": "",
        "HTTP://ACME.com": "", "acme.com.": "acme.com", "httpbin.org/get": "httpbin.org", "a.b.c.com.au#x": "c.com.au",
    }
    assert column(spark, cases, urls.registrable_domain) == list(cases.values())


def test_strip_tracking(spark):
    cases = {
        "https://a.com/p?utm_source=x&id=1": "https://a.com/p?id=1", "https://a.com/p?UTM_X=1&ref=2": "https://a.com/p",
        "https://a.com/p": "https://a.com/p", "a.com/?k=&x=a+b%20c&gclid=1": "a.com/?k=&x=a+b+c",
        "https://a.com/?q=100%&z=~*": "https://a.com/?q=100%25&z=~%2A", "https://a.com/?id=1&fbclid=2#top": "https://a.com/?id=1#top",
    }
    assert column(spark, cases, urls.strip_tracking) == list(cases.values())


def test_geo_and_names(spark):
    assert column(spark, ["other.co.uk", "x.co.in", "x.com", "x.ca"], urls.geo_tag) == ["UK", "IN", "unknown", "CA"]
    assert column(spark, ["acme-widgets.com", "stripe.com"], urls.company_display) == ["Acme Widgets", "Stripe"]
    assert column(spark, ["acme-widgets.com"], urls.company_key) == ["acmewidgets"]
    assert column(spark, ["1.2.3.4"], urls.reverse_ip) == ["4.3.2.1"]
    assert column(spark, ["/Team.PDF?x=1", "/a.pdf.html"], urls.is_pdf) == [True, False]
    assert column(spark, ["net::ERR_INVALID_URL", "Timeout", None], urls.error_class) == ["permanent", "transient", "transient"]


def test_resolve_link(spark):
    base = F.lit("https://acme.com/a/b?x=1")
    cases = {
        "/about?x=1#y": "https://acme.com/about", "team": "https://acme.com/a/team", "../c": "https://acme.com/c",
        "./d/./e/../f": "https://acme.com/a/d/f", "//other.org/x": "https://other.org/x", "http://z.io/q?1": "http://z.io/q",
        "#top": "https://acme.com/a/b", "mailto:x@y.z": "mailto:x@y.z", "..": "https://acme.com/",
    }
    assert column(spark, cases, lambda c: urls.resolve_link(base, c)) == list(cases.values())


def test_page_types(spark):
    found = column(spark, ["/about-us", "/about_us", "/random", "/our-team/news"], urls.page_types)
    assert found == [["about"], [], [], ["team", "blog"]]


def test_blocks_and_addresses(spark):
    page = (
        '<p>Write <a href="mailto:Jane@acme.com?subject=x">us</a> or sales@acme.com, logo@2x.png, a@sentry.io '
        "b@test-lab.com c@mail5.example.com info&#64;other.org</p><!-- ghost@acme.com --><script>x='s@acme.com'</script>"
    )
    assert column(spark, [page], lambda c: H.page_addresses(c, F.lit("acme.com"))) == [
        ["jane@acme.com", "sales@acme.com", "c@mail5.example.com", "info@other.org"]
    ]
    walls = ["<title>Just a moment...</title>", "<p>" + "word " * 700 + "captcha access denied</p>", "<p>fine</p>"]
    assert column(spark, walls, H.looks_blocked) == [True, False, False]


def test_links_keep_order_and_caps(spark):
    page = (
        '<nav><a href="/about-us">About Us</a><a href="/contact">Contact</a><a href="/random-page">Random</a>'
        '<a href="/about">More about</a><a href="/blog?a=1">Blog</a><a href="/blog?a=2">Blog</a><a href="/news">News</a>'
        '<a href="/insights">Insights</a><a href="/x">we wrote all about the team here</a></nav>'
    )
    picks = column(spark, [page], lambda c: F.transform(
        H.pick_links(F.lit("https://acme.com"), H.links(c)), lambda p: F.concat_ws(" ", p["page_type"], p["url"])))[0]
    assert picks == [
        "about https://acme.com/about-us", "contact https://acme.com/contact", "blog https://acme.com/blog", "blog https://acme.com/news",
    ]


def test_clean_text(spark):
    page = "<head><title>T</title></head><nav>menu</nav><h2>Who</h2><p>One <b>two</b> &amp; three</p><table><tr><td>a</td><td>b</td></tr></table><footer>f</footer>"
    assert column(spark, [page], H.clean_text) == ["Who\nOne two & three\na | b"]
    assert column(spark, [page], lambda c: H.clean_text(c, markdown=True)) == ["## Who\nOne **two** & three\na | b"]


def test_team_cards(spark):
    cards = (
        '<div class="card"><h3><button>Joel Gascoigne</button></h3><div><p>CEO & Co-Founder</p></div></div>'
        "<h3>Adnan Issadeen</h3><p>Senior Engineer</p><h3>Get Started</h3><p>Manager</p><h3>Ann Lone</h3><h3>Joel Gascoigne</h3><p>Owner</p>"
    )
    from leadloom.functions.own_text import short_own_texts

    texts = column(spark, [cards], short_own_texts)
    pairs = column(spark, texts, lambda c: P.pair_cards(P.card_candidates(c)), "array<string>")[0]
    assert [(p.name, p.title) for p in pairs] == [("Joel Gascoigne", "CEO & Co-Founder"), ("Adnan Issadeen", "Senior Engineer")]


def test_jsonld_people(spark):
    script = '<script type="application/ld+json">{}</script>'
    bodies = [
        '{"@type":"Organization","employees":[{"@type":"Person","name":"Jane Diaz","jobTitle":"Founder"}]}',
        '{"@graph":[{"founders":{"@type":"Person","name":"Al Bo"}},{"member":[{"@type":"Thing","name":"No"}]}]}',
        '[{"founder":{"@type":"Person","name":"Cy Do"}},{"employee":{"@type":"Person","name":"cy do","jobTitle":"x"}}]', "{broken", "7",
    ]
    found = column(spark, [script.replace("{}", b) for b in bodies], P.jsonld_people)
    assert [[(p.name, p.title) for p in f] for f in found] == [[("Jane Diaz", "Founder")], [("Al Bo", "Founder")], [("Cy Do", "Founder")], [], []]


def test_prose_people(spark):
    rows = [
        ("acme.com", 1, "about", "Jane Diaz, Founder of Acme."), ("acme.com", 2, "home", "Aaron Levie, CEO at Box Corp."),
        ("acme.com", 3, "about", "Hi. I’m Jason Fried, one of the co-founders here."), ("acme.com", 4, "blog", "Max Hid, CEO"),
        ("acme.com", 5, "team", "CEO: Mary Ann"),
    ]
    pages = spark.createDataFrame(rows, "domain string, pos int, page_type string, text string")
    found = {(r.pos, r.name) for r in PE.prose_people(pages).collect()}
    assert found == {(1, "Jane Diaz"), (3, "Jason Fried"), (5, "Mary Ann")}


def test_roles_and_patterns(spark):
    roles = column(spark, ["sales_team@a.com", "sales.team@a.com", "jane.diaz@a.com", "info@a.com", "zz9@a.com"], lambda c: A.role_of(c)["role"])
    assert roles == ["personal", "sales_bd", "personal", "generic_contact", "other"]
    assert column(spark, ["Jane van Diaz"], A.template_locals) == [
        ["jane.diaz", "janediaz", "jdiaz", "jane", "jane_diaz", "diaz.jane", "jane.d", "j.diaz"]
    ]
    assert column(spark, ["Madonna", "Jane 9"], lambda c: A.fill_template("{f}", c)) == [None, None]
    assert column(spark, ["CEO", "VP of Sales", "Head of Sales", "Engineer", None], A.seniority) == [1, 2, 3, 9, 9]


def test_confidence_grid(spark):
    rows = spark.createDataFrame(
        [("scraped", "J", "valid"), ("scraped", None, "valid"), ("scraped", None, "not_checked"), ("scraped", "J", "catch_all"),
         ("scraped", None, "unverified"), ("guessed", None, "valid"), ("scraped", "J", "invalid")], "s string, n string, v string")
    got = [r[0] for r in rows.select(A.confidence(F.col("s"), F.col("n"), F.col("v"))).collect()]
    assert got == ["high", "medium", "medium", "medium", "low", "low", "reject"]


def naive_syllables(word):
    word = "".join(c for c in word.lower() if "a" <= c <= "z")
    if not word:
        return 0
    runs, before = 0, False
    for c in word:
        runs += (c in "aeiouy") and not before
        before = c in "aeiouy"
    return max(runs - (word[-1] == "e" and runs > 1), 1)


def test_syllables_and_grade(spark):
    import random
    import re

    rng = random.Random(5)
    made = ["".join(rng.choice("aeiouybcdrst'e") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    assert column(spark, made, Q.syllables) == [naive_syllables(w) for w in made]
    texts = [" ".join(made[i:i + 8]) + ". Ä b! c" for i in range(0, 392, 8)] + ["", "...", "One two. Three"]

    def grade(text):
        sentences = [s for s in re.split(r"[.!?]+", text.strip()) if s.strip()]
        found = re.findall(r"[A-Za-z']+", text)
        if not sentences or not found:
            return 0.0
        return max(0.39 * len(found) / len(sentences) + 11.8 * sum(map(naive_syllables, found)) / len(found) - 15.59, 0.0)

    for got, text in zip(column(spark, texts, Q.reading_grade), texts):
        assert got == pytest.approx(grade(text), abs=0.0501)


def test_white_space_of_every_kind(spark):
    made = ["a b c d\x1ce\n", " 　x ", "éß üᙿ", ""]
    assert column(spark, made, words) == [m.split() for m in made]
    assert column(spark, made, strip) == [m.strip() for m in made]


def test_rule_checks(spark):
    assert column(spark, ["see www.x.io", "see x"], Q.has_no_links) == [False, True]
    assert column(spark, ["![a](b)", "<IMG src=x>", "!x"], Q.has_no_images) == [False, False, True]
    assert column(spark, ["Hi {{x}} NAME null", "Dear name"], Q.leaks) == [
        ["double_curly: '{{x}}'", "literal_null: 'null'", "literal_name_token: 'NAME'"], []]
    assert column(spark, ["Great SYNERGY, just following up"], Q.banned_phrases) == [["just following up", "synergy"]]
    assert column(spark, ["x " * 91, "x " * 90], Q.length_violation) == ["body over 90 words (91 words)", None]


def test_message_classes(spark):
    rows = spark.createDataFrame(
        [("mailer-daemon@x.io", "hi", ""), ("j@x.io", "Undelivered Mail", ""), ("j@x.io", "Re", "Please unsubscribe me"),
         ("j@x.io", "Automatic reply", "x"), ("j@x.io", "Re", "Interested")], "f string, s string, b string")
    assert [r[0] for r in rows.select(M.message_class("f", "s", "b")).collect()] == ["bounce", "bounce", "unsubscribe", "ooo", "reply"]
    texts = ["Status: 5.1.1", "Status: 4.2.2 user unknown", "mailbox full", "mailbox full, user unknown", "odd"]
    assert column(spark, texts, M.bounce_severity) == ["hard", "soft", "soft", "hard", "hard"]


def test_return_dates(spark):
    as_of = F.lit("2026-03-01 00:00:00").cast("timestamp")
    cases = {
        "back on 12/25/2026": (2026, 12, 25), "Returning Dec 25": (2026, 12, 25), "back on 3/4/27": (2027, 3, 4),
        "available on 12-25-2026": (2026, 12, 25), "return january 5": (2026, 1, 5), "back Sept 5": None, "back 02/29": None,
        "away indefinitely": None, "back 13/45": None, "back 01-02-26": None,
    }
    want = [dt.datetime(*v) if v else None for v in cases.values()]
    assert column(spark, cases, lambda c: M.ooo_return_date(c, as_of)) == want


def test_warm_up_and_variants(spark):
    today = F.lit("2026-03-31").cast("date")
    starts = ["2026-03-31", "2026-03-24", "2026-03-17", "2026-03-10", "2026-04-09"]
    assert column(spark, starts, lambda c: S.ramp_cap(c.cast("date"), today)) == [10, 20, 30, 40, 10]
    assert column(spark, ["Re: RE:  Quick Q ", "quick q", "regarding x", None], S.variant_key) == ["quick q", "quick q", "regarding x", ""]


def test_model_answers(spark):
    raw = ['```json\n{"company_name": "A", "hooks": [{"hook": "h", "specificity": 8}]}\n```', '"geo": "EU"}', "{broken", '{"services": "x"}']
    rows = column(spark, raw, R.read_extraction)
    assert [r.parse_error for r in rows] == [False, False, True, False]
    assert rows[0].company_name == "A" and rows[0].hooks[0].specificity == 8 and rows[1].geo == "EU" and rows[3].services == []
    drafts = column(spark, ['[{"step": 1, "subject": "s", "body": "b"}]', '{"step": 2, "body": "b"}]', "no"], R.read_draft)
    assert [[i.step for i in d] for d in drafts] == [[1], [2], []]
    assert column(spark, ["  It’s   OK\n now "], R.normalize_quote) == ["it's ok now"]


def test_word_sets(spark):
    assert sorted(column(spark, [["a", "b", "c"]], C.word_sets, "array<string>")[0]) == ["a", "a b", "a b c", "a c", "b", "b c", "c"]


@pytest.mark.parametrize("answer, passes", [('{"grounding": 8.5, "overall": 9.0}', True), ('{"grounding": 7.9, "overall": 9}', False), ('{"overall": 9}', False)])
def test_judges_may_grade_with_fractions(spark, answer, passes):
    read = spark.createDataFrame([(answer, None)], "raw_text string, error string").select(R.read_judge("raw_text", "error").alias("s"))
    assert read.select(Q.judge_passes(F.col("s.grounding"), F.col("s.overall"), F.col("s.error")).alias("p")).first()["p"] is passes


# -------------------------------------------------- suffixes and references
RULES = """// a comment
com
ua
com.ua
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
бг
us
k12.ma.us
pvt.k12.ma.us
// ===BEGIN PRIVATE DOMAINS===
blog.com
"""


def rules(tmp_path, private=False):
    path = tmp_path / "list.dat"
    path.write_text(RULES, encoding="utf-8")
    return suffixes.read_rules(str(path), private)


HOSTS = [
    ("acme.com", "acme.com"), ("a.b.acme.com.ua", "acme.com.ua"), ("com.ua", ""), ("com", ""), ("acme.co.ck", "acme.co.ck"), ("co.ck", ""), ("a.www.ck", "www.ck"),
    ("www.ck", "www.ck"), ("ck", ""), ("x.city.kawasaki.jp", "city.kawasaki.jp"), ("city.kawasaki.jp", "city.kawasaki.jp"), ("a.b.foo.kawasaki.jp", "b.foo.kawasaki.jp"),
    ("foo.kawasaki.jp", ""), ("kawasaki.jp", "kawasaki.jp"), ("acme.бг", "acme.бг"), ("acme.xn--90ae", "acme.xn--90ae"), ("x.pvt.k12.ma.us", "x.pvt.k12.ma.us"),
    ("k12.ma.us", ""), ("ma.us", "ma.us"), ("acme.unlisted", ""), ("me.blog.com", "blog.com"), ("localhost", ""), ("10.0.0.1", ""), ("", ""), ("..com", ""), ("acme.com.", "acme.com"),
]


def test_suffix_rules(spark, tmp_path):
    known = rules(tmp_path)
    assert column(spark, [h for h, _ in HOSTS], lambda h: urls.registrable_domain(h, known)) == [d for _, d in HOSTS]


def test_private_suffixes_on_demand(spark, tmp_path):
    df = spark.createDataFrame([("me.blog.com",)], "h string")
    assert df.select(urls.registrable_domain(F.col("h"), rules(tmp_path, True))).first()[0] == "me.blog.com"


def test_a_large_dictionary(spark):
    entries = {f"w{i}é": f"v{i}" for i in range(5000)}
    table = Dictionary(entries)
    df = spark.createDataFrame([(w,) for w in [*list(entries)[::97], "w1", "", "w5000é", "v1"]], "w string")
    found = {r.w: r.v for r in df.select("w", table.value(F.col("w")).alias("v")).collect()}
    assert found == {w: entries.get(w) for w in found}


REFERENCES = ["&#38;lt;b", "&amp;lt;", "&eacute;&euro;", "&NotEqualTilde;", "&notit;", "&not;", "&copy2024", "&#x80;&#150;", "&#0;&#1114112;&#xD800;&#99999999999;", "&bogus; AT&T &; & &&amp;",
              "&ampamp;", "&#65&#x42;&#x;", "&lt;&gt;&quot;&apos;&nbsp;", "a&b=c&amp=d", "&Aacute&aacute;x", "", "plain", "&sup1;&sup;", "&frac12x"]


def test_references_in_one_pass(spark):
    assert column(spark, REFERENCES, H.decode_entities) == [unescape(text) for text in REFERENCES]


def test_every_named_reference(spark):
    names = [f"&{name}" for name in html5]
    df = spark.createDataFrame([("|".join(names),)], "t string")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == unescape("|".join(names))


ODD_TEXTS = [
    "", " ", "...", "one", "a b　c d e", "​x y\u0085z", "It's 'the' end. e! Able? table rhythm", "no. .yes . \x1f.", "é’😀 ıs\x00 so",
    "'", "a''e", "queue\nE eye", "x" * 5000 + " e." * 3000,
]


def brute_counts(text):
    spaces = {*map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}
    words = "".join(" " if c in spaces else "x" for c in text).split()
    stretches = [s for s in re.split("[.!?]", text) if set(s) - spaces]
    syllables = 0
    for word in re.findall("[a-zA-Z]+", text.replace("'", "")):
        runs = len(re.findall("[aeiouy]+", word.lower()))
        syllables += max(1, runs - (word[-1] in "eE" and runs > 1))
    return len(words), len(re.findall("[A-Za-z']+", text)), len(stretches), syllables


def test_text_counts_match_a_plain_count(spark):
    got = column(spark, [*ODD_TEXTS, None], text_counts)
    assert [tuple(g) for g in got[:-1]] == [brute_counts(t) for t in ODD_TEXTS] and got[-1] is None


def test_rule_checks_list_no_words_and_try_patterns_on_likely_texts_only(spark):
    rows = spark.createDataFrame([("s", "a word", 1)], "subject string, body string, step int")
    plan = rows.select(Q.rule_violations("subject", "body", "step"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("text_counts(body#") == 1
    leaky = ["undefİned", "undefıned", "Aſ an AI", "i don’t have acceſs", "AS AN Aİ", "{{", "name NAME"]
    assert column(spark, leaky, lambda c: F.array_join(Q.leaks(c), "|")) == [
        "literal_undefined: 'undefİned'", "literal_undefined: 'undefıned'", "ai_self_disclosure: 'Aſ an AI'", "ai_no_access: 'i don’t have acceſs'",
        "ai_self_disclosure: 'AS AN Aİ'", "", "literal_name_token: 'NAME'"]
    assert column(spark, ["HTTP://x", "WWW.x", "www", None], Q.has_no_links) == [False, False, True, True]
