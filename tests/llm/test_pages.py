from __future__ import annotations

import fnmatch
import random
import re
import time

import pytest

from symweave.llm import html_text as h
from symweave.llm import urls

PAGES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<p>b <b>c</p> d", "a\nb c\nd"),
    ("<article><h1>T</h1><p>One\n  two<br>three</p><p>x</p></article><footer>f</footer>", "T\nOne two three\nx"),
    ("<nav><a href=/>Home</a></nav><main><p>Text</p><div class='ad'>Buy</div><p>More</p></main>", "Text\nMore"),
    ("<article><p>A</p><section class=\"reader-comments\"><article><p>Nice!</p></article></section><p>B</p></article>", "A\nB"),
    ("<article><script>if (a<b) { x('</p>') }</script><style>p{}</style><p>Only</p><form><input><p>Mail</p></form></article>", "Only"),
    ("<article><!-- <p>gone</p> --><p title='a>b'>kept</p></article>", "kept"),
    ("<article><header><h1>Head</h1></header><p>Body</p><aside><p>Side</p></aside></article>", "Head\nBody"),
    ("<div id='cookie-notice'><p>We use cookies on this site</p></div><article><p>&eacute;&#233;&#xe9; &lt;p&gt;</p></article>", "ééé <p>"),
    ("<article><p>cut &am and <b>open", "cut &am and open"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><ul><li>one<li><a href=x>two</a></ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
    ("<body class='has-sidebar'><article class='no-comments'><p>in</p></article></body>", "in"),
    ("<article><p>" + "word " * 30_000 + "</p></article>", ("word " * 30_000).strip()),
    ("<ul><li><a href=1>Menu</a><li><a href=2>Other</a></ul><div><p>A page without any article tag has its text in plain paragraphs.</p></div>", "A page without any article tag has its text in plain paragraphs."),
    ("<article><p>cut off in a tag</p><p cla", "cut off in a tag"),
    ("<article><p>cut off in a tag</arti", "cut off in a tag"),
    ("<article><p>a < b</p><p>end <", "a < b\nend <"),
    ("<article><p title=\"odd>one</p><p>two</p>", "one\ntwo"),
    ("<p>text</p></article></p></div>after", "text\nafter"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_main_text(source, text):
    assert h.main_text(source) == text


def test_any_markup_is_read():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<", ">", "&", "&amp;", "<a href='", "\"", "<!--", "-->", "<script>", "</script>", "text ", "<div class=ad>", "</div>", "<![CDATA[", "]]>", "<br/>", "</", "<td>", "é"]
    for _ in range(3000):
        text = h.main_text("".join(rng.choices(parts, k=rng.randint(0, 25))))
        assert text == "\n".join(line.strip() for line in text.split("\n"))


def test_tree_agrees_with_its_table_and_splits_on_words_and_links_of_neighbours():
    x, y = h.labelled_rows()
    assert len(x) > 400 and [h.is_content(tuple(r)) for r in x] == [bool(v) for v in y]
    used, todo = set(), [h.tree()]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            used.add(h.FEATURES[node.feature])
            todo += [node.below, node.above]
    assert {"words", "density", "words_before", "density_before", "words_after"} <= used
    # and names are one of many: without them the tree still tells most blocks
    names = [h.FEATURES.index(f) for f in ("named", "share")]
    plain = x.copy()
    plain[:, names] = 0
    node = h.grow(plain, y)
    right = 0
    for row, label in zip(plain, y, strict=True):
        at = node
        while at.feature >= 0:
            at = at.below if row[at.feature] <= at.at else at.above
        right += at.content == bool(label)
    assert right > 0.9 * len(y)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div><h1>Title</h1><p>{L}</p><p>{L}</p></div><div>2024 Example Ltd. All rights reserved.</div>", "Title {L} {L}"),
        ("<h1>Title</h1><p>{L}</p><p>{L}</p><p>2024 Example Ltd. All rights reserved.</p>", "Title {L} {L}"),
        ("<div><h1>Title</h1><p>{L}</p><p>{L}</p></div><div><p>Anna: great article, thanks for writing.</p></div>", "Title {L} {L}"),
        ("<article><h1>T</h1><p>{L}</p><ul class=mostread><li><a href=1>One link here</a></li><li><a href=2>Two link</a></li><li><a href=3>Three</a></li></ul><p>{L}</p></article>", "T {L} {L}"),
        ("<div class='text social-history'><h1>T</h1><p>{L}</p><section id='legal'><p>{L}</p><p>Short.</p></section></div>", "T {L} {L} Short."),
        ("<div class=social><h1>T</h1><p>{L}</p><p>{L}</p></div>", "T {L} {L}"),
        ("<div><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>T</h1><p>{L}</p><p>Hi.</p><p>{L}</p></div><div><div>Anna</div><div>Nice one!</div></div></div>", "T {L} Hi. {L}"),
        ("<article><h1>T</h1><p>{L}</p><p>{L}</p><section><article><p>Me too.</p></article><article><p>Not I.</p></article></section></article>", "T {L} {L}"),
        ("<main><article><p>{L}</p></article><article><p>Hi.</p></article></main>", "{L} Hi."),
    ],
)
def test_pages_without_telling_names(source, text):
    long = "word " * 39 + "end"
    assert h.main_text(source.replace("{L}", long)) == text.replace(" ", "\n").replace("{L}", long)


@pytest.mark.parametrize("part", ["<div></b>", "<b><div></b>", "<span><p>", '<a "', "<li><ul>", "<a><p></a>", "<div class=ad>x", "<p><span>", "<td><b>x"])
def test_time_grows_with_the_length_however_deep_a_page_nests(part):
    began = time.perf_counter()
    h.main_text(part * 20_000)
    assert time.perf_counter() - began < 20


def test_pages_of_a_table(spark):
    rows = [(i, f"u{i}", s, "old", 5) for i, (s, _) in enumerate(PAGES)] + [(0, "u0", None, "old", 5), (None, None, "<p>x", None, None)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["page_id"]: r["text"] for r in found} == {i: t for i, (_, t) in enumerate(PAGES)} | {None: "x"}
    assert h.extract(spark.createDataFrame([], "html string")).count() == 0


def test_automaton_matches_like_plain_globs():
    rng = random.Random(9)
    globs = ["*", "a", "a*", "*a", "*ab*", "a?b", "??", "*a*b*", "abab", "b*a", "", "a**b", "*?", "ba*ab*a"] + ["".join(rng.choices("ab*?", k=rng.randint(1, 12))) for _ in range(60)]
    automaton = urls.Automaton(globs)
    assert automaton.words > 1
    texts = ["", "a", "b"] + ["".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(400)] + ["ü" * 3, "🙂a"]
    found = automaton.match(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == bool(re.fullmatch(fnmatch.translate(g).replace("(?s:", "(?s:"), t)), (t, g)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme.com/en/", "", "", None, "allow"),
        ("http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
        ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com?x=/en/", "example.com", "", None, "allow"),
        ("ftp://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("http://net/fr/z", "net", "/fr/z", "net/fr/", "block"),
        ("http://a.net/de/", "a.net", "/de/", None, "allow"),
        ("http://spam-farm.example.org/a.com/en/", "spam-farm.example.org", "/a.com/en/", None, "block"),
        ("http://cheap-pills.example.com/fr/", "cheap-pills.example.com", "/fr/", "com/", "allow"),
        ("http://x.org/http://example.com/en/", "x.org", "/http://example.com/en/", None, "allow"),
        ("http://É.com/", "É.com", "/", "com/", "allow"),
        ("http://a.com\x1f/en/", "a.com\x1f", "/en/", None, "allow"),
        ("http://" + "a" * 20_000 + ".net/es/" + "b" * 20_000, "a" * 20_000 + ".net", "/es/" + "b" * 20_000, "net/es/", "block"),
    ],
)
def test_judgements(url, host, path, rule, verdict):
    parts = urls.split_url(url)
    assert parts == (host, path)
    assert urls.Judge(urls.CONTRACT_RULES, urls.DEFAULT_RULES, "allow").judge([parts]) == [(rule, verdict)]


def test_urls_of_a_table(spark):
    rows = [(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (2, None, None), (None, "http://b.net/fr/", "y")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in out.collect()) == [(0, "b.net", "net/fr/", "block"), (1, "a.com", "com/", "allow"), (1, "a.com", "com/", "allow"), (2, "", None, "allow")]
    assert urls.filter_urls(spark.createDataFrame([], "url string")).count() == 0


@pytest.mark.parametrize("clash", ["Host", "PATH", "Rule", "verdict"])
def test_columns_called_like_results_are_replaced(spark, clash):
    rows = spark.createDataFrame([("http://a.net/es/x", 1, "y")], f"`{clash}` string, n int, __read string")
    (got,) = urls.filter_urls(rows, url=clash).collect()
    assert got.asDict() == {"n": 1, "__read": "y", "host": "a.net", "path": "/es/x", "rule": "net/es/", "verdict": "block"}


def test_a_thousand_rules_of_a_table(spark, monkeypatch):
    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(200)]
    rules = {(rng.choice(hosts), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 5))), rng.choice(["allow", "block"])) for _ in range(1100)}
    ddl = "host string, path string, verdict string"
    known = urls.rules_of(spark.createDataFrame([*rules, (None, "/", "allow")], ddl))
    assert len(known) == len(rules) > 1000
    pages = [(f"https://{rng.choice(['', 'www.', 'x'])}{rng.choice(hosts)}/{''.join(rng.choices('ab/', k=8))}?q",) for _ in range(300)]
    got = urls.filter_urls(spark.createDataFrame(pages, "url string"), rules=known, defaults=(), verdict="none").collect()
    for r in got:
        fits = [x for x in sorted(rules) if (r["host"] == x[0] or r["host"].endswith("." + x[0])) and r["path"].startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=(None, None, "none"))
        assert (r["rule"], r["verdict"]) == (best[0] and best[0] + best[1], best[2])
    monkeypatch.setattr(urls, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        urls.rules_of(spark.createDataFrame(list(rules), ddl))


LONG = "word " * 39 + "end"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        (f'<section id="related-work"><h2>Related work</h2><p>{LONG}</p></section>', f"Related work\n{LONG}"),
        ('<section id="privacy"><h2 id="privacy">Privacy</h2><p>Short.</p></section>', "Privacy\nShort."),
        ('<h2 id="Legal_issues">Legal issues</h2><p>Few words.</p><h2 id="discussion">Discussion</h2>', "Legal issues\nFew words.\nDiscussion"),
        ('<div class="section" id="discussion"><p>It is so.</p></div>', "It is so."),
        ('<div class="social-policy"><p>It is so.</p></div>', "It is so."),
        (f'<div class="notice"><p>{LONG}</p></div>', LONG),
        ('<div class="share"><a href="/">Share this</a></div>', ""),
        (f'<div class="related-posts"><p><a href="/">{LONG}</a></p></div>', ""),
        (f'<div class="reader-comments"><p>{LONG}</p></div>', ""),
        (f'<div class="comment-list"><p>{LONG}</p></div><div class="ad">{LONG}</div><div id="ad_slot_2">Buy</div>', ""),
    ],
)
def test_sections_of_an_article_are_not_lost_for_their_names(inside, text):
    source = f"<nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{LONG}</p>{inside}<p>{LONG} too</p></article>"
    assert h.main_text(source) == "\n".join(x for x in ("Title", LONG, text, f"{LONG} too") if x)
