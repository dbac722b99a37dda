"""URLs, quality tests, bodies, Markdown and HTML on single values."""

import re

import pytest
from pyspark.sql import functions as F

from pressmill.functions import bodies, quality, urls
from pressmill.functions.html import decode_entities, html_to_markdown
from pressmill.functions.markdown import (
    clean_markdown,
    is_navigation,
    is_noise_line,
    parse_header,
    render_article,
)


DOMAINS = [  # rule of P1: the last two labels, the last at least two signs and opening with a letter
    ("ftp://files.harbour.net/x", "unknown"),
    ("https://harbour.n2/x", "harbour.n2"),
    ("https://harbour.2n/x", "unknown"),
    ("https://harbour.n/x", "unknown"),
    ("http://harbour.net?q=1", "harbour.net?q=1"),
    ("see https://harbour.net/x", "harbour.net"),
    ("https://tide.harbour.net:90/", "harbour.net"),
    ("https://a.b.c.d.harbour.travel/", "harbour.travel"),
    ("https://HARBOUR.Net", "HARBOUR.Net"),
    ("https:///x", "unknown"),
]


def test_registered_domain(each):
    values, wanted = zip(*DOMAINS)
    assert each(urls.registered_domain, values) == list(wanted)


def test_domain_lists(one):
    assert one(urls.is_skipped_domain, "x.com") and not one(urls.is_skipped_domain, "netflix.com")
    assert one(urls.is_scripted_domain, "notmedium.com")
    assert not one(urls.is_scripted_domain, "paper.org")


@pytest.mark.parametrize(
    "link, url",
    [
        ("/i/7", "https://paper.org/i/7"),
        ("i/7", "https://paper.org/i/7"),
        ("http://o.net/7", "http://o.net/7"),
    ],
)
def test_absolute_url(one, link, url):
    assert one(lambda c: urls.absolute_url(c, F.lit("https://paper.org/list/x")), link) == url


def test_trailing_number(one):
    assert one(urls.trailing_number, "/issues/613") == 613
    assert one(urls.trailing_number, "/issues/last") is None


LONG = "<html><body><article>" + "word " * 300 + "</article></body></html>"


SCRIPTED = [
    ("<p>please enable your javascript</p>", True),
    ("<p>enable\njavascript</p>", False),
    ("<p>enablejavascript</p>", False),
    ("<p>enablejavascript then javascript</p>", True),
    ("<p>javascript must really be now enabled</p>", True),
    ("<p>javascript must enabled be</p>", False),
    ("<p><div id='root'></p>", True),
    ("<p>loadingapp</p>", True),
    ("<p>window.__x__</p>", True),
    ("<p>window.__</p>", False),
    ("<p>windowx__y__</p>", False),
    ("<p>bundle.min.js</p>", True),
    ("<p><noscript></p>", True),
    ("short and plain", True),
    ("short <p>but a paragraph", False),
    (LONG, False),
]


def test_needs_script(each):
    values, wanted = zip(*SCRIPTED)
    assert each(quality.needs_script, values) == list(wanted)
    # and the same by the patterns as they stand
    runs = [
        (".+" if gap else ".*").join(map(re.escape, words))
        for gap, words in quality.SCRIPT_WORD_RUNS
    ]
    for text, needed in SCRIPTED:
        plain = any(re.search(p, text) for p in runs + quality.SCRIPT_PATTERNS + ["<noscript"])
        bare = len(text) < 1000 and not any(m in text for m in quality.SHORT_PAGE_MARKERS)
        assert needed is (plain or bare)


def test_meaningful_content(one):
    assert one(quality.has_meaningful_content, LONG)
    assert not one(quality.has_meaningful_content, LONG[:150])
    two = "<body>" + " " * 200 + "<p>a</p><pre>b</p>"
    assert one(quality.has_meaningful_content, two)
    assert not one(quality.has_meaningful_content, "<body>" + " " * 200 + "<p>a</p>")
    assert not one(quality.has_meaningful_content, two.replace("<body>", ""))


def test_loaded_content(one):
    assert one(quality.has_loaded_content, "<div class='x story-content'>")
    assert one(quality.has_loaded_content, "<div data-testid='storyContent'>")
    assert one(quality.has_loaded_content, "<p>" * 4)
    assert not one(quality.has_loaded_content, "<p>" * 3 + "<pre><h4>")
    assert one(quality.has_loaded_content, "<h3>x</h3>")


def test_score_of_a_flawless_page(spark):
    row = spark.range(1).select(
        quality.quality_score(F.lit(2000), F.lit(True), F.lit(True), F.lit(False), F.lit(False))
    )
    assert row.first()[0] == 0.9999999999999999


@pytest.mark.parametrize(
    "body, charset, text",
    [
        (b"a\xffb", None, "a�b"),
        ("é".encode(), "iso-8859-1", "é"),
        (b"\xe9\x80", "windows-1252", "é€"),
        (b"\xa4", "iso-8859-15", "€"),
        (b"a\xe9", "us-ascii", "a�"),
        (b"\xe9", "latin1", "é"),
        ("né".encode("utf-16-le"), "utf-16le", "né"),
        ("n\U0001f600".encode("utf-16-be"), "utf-16be", "n\U0001f600"),
        (b"\x00a\x00b\x00", "utf-16be", "ab\ufffd"),
        (b"\xd8\x00\x00a", "utf-16be", "\ufffda"),
        ("n\u00e9".encode("utf-16"), "utf-16", "n\u00e9"),
        ("Привет".encode("cp1251"), "windows-1251", "Привет"),
        ("Привет".encode("koi8-r"), "koi8-r", "Привет"),
        ("zażółć".encode("iso-8859-2"), "iso-8859-2", "zażółć"),
        ("ğış".encode("iso-8859-9"), "iso-8859-9", "ğış"),
        ("日本".encode("shift_jis") + b"\xff", "shift_jis", "日本\ufffd"),
        ("日本".encode("euc-jp"), "euc-jp", "日本"),
        ("한글".encode("euc-kr"), "euc-kr", "한글"),
        ("汉字".encode("gb18030"), "gb18030", "汉字"),
        ("漢字".encode("big5"), "big5", "漢字"),
        (b"a\xc3", "base64", "a\ufffd"),
        (b"a\xffb", "klingon", "a�b"),
    ],
)
def test_decode_body(one, body, charset, text):
    decoded = one(lambda c: bodies.decode_body(c, F.lit(charset).cast("string")), body, "binary")
    assert decoded == text


def test_compression(one):
    assert one(bodies.compression, b"\x1f\x8b..", "binary") == "gzip"
    assert one(bodies.compression, b"BZh9", "binary") == "bzip2"
    assert one(bodies.compression, b"\x78\xda", "binary") == "zlib"
    assert one(bodies.compression, b"", "binary") is None


@pytest.mark.parametrize(
    "headers, body, kind",
    [
        ({"Content-Type": "Text/HTML; charset=x"}, b"{", "text/html"),
        (None, b"<!DOCTYPE html><p>", "text/html"),
        ({}, b"[1]", "application/json"),
        ({"x": "y"}, b"<?xml version='1.0'?>", "application/xml"),
        ({}, b"hello", "text/plain"),
        ({}, None, "unknown"),
    ],
)
def test_content_type(spark, headers, body, kind):
    df = spark.createDataFrame([(headers, body)], "h map<string,string>, b binary")
    assert df.select(bodies.content_type(F.col("h"), F.col("b"))).first()[0] == kind


PAGES = [
    ("<h4>Low tide</h4>text<h6>deep</h6>", "#### Low tide\n\ntext\n\n###### deep"),
    ("<section><p>boats<i>and</i>nets</p></section>", "boats*and*nets"),
    ("<ul><li><em>hull</em></li></ul><p>keel</p>", "- *hull*\n\nkeel"),
    ("<p>a*b_c</p>", "a\\*b\\_c"),
    ("<p>x &amp;lt; &eacute;&#8217;&#x41;</p>", "x &lt; é’A"),
    ("<p><a href='http://a.b/c' title='T'> go <b>on</b></a>!</p>", "[go **on**](http://a.b/c \"T\")!"),
    ("<p>at <a href='http://a_b'>http://a_b</a></p>", "at <http://a_b>"),
    ("<p>at <a>nowhere</a></p>", "at nowhere"),
    ("<img alt='x' src='y.png'>", "![x](y.png)"),
    ("<ol start='3'><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<blockquote><p>one</p><p>two</p></blockquote>", "> one\n>\n> two"),
    ("<pre>a *b*\n  c</pre>", "```\na *b*\n  c\n```"),
    ("<p>say <code>x_y</code></p>", "say `x_y`"),
    (
        "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>",
        "| A | B |\n| --- | --- |\n| 1 | 2 |",
    ),
    ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |"),
    ("one<br>two<hr><span>three</span>", "onetwothree"),
    ("<div class='big sidebar'>no</div><div class='ad'>yes</div>", "yes"),
    ("<div role='navigation'>no</div>yes", "yes"),
    ("<nav>n</nav><header>h</header><main><h1>M</h1><p>t</p></main><footer>f", "# M\n\nt"),
    # what is dropped may nest, close itself, stay open, and be any element
    ("<p>bow</p><iframe src='x'/><p>stern</p><svg a='b'/><script src='y'/><p>keel</p>", "bow\n\nstern\n\nkeel"),
    ("<ul><li class='nav'>n<li>rope</ul><p>tail</p>", "- rope\n\ntail"),
    ("<div class='sidebar'><div>inner</div><p>leak</p></div><p>body</p>", "body"),
    ("<nav>a<nav>b</nav>c</nav><p>d</p>", "d"),
    ("<h2 class='ads'>Ad</h2><h2>Log</h2>", "## Log"),
    ("<div class=sidebar>no</div><div role=navigation>no</div><p>yes</p>", "yes"),
    ("<section><aside>never closed</section><p>yes</p>", "yes"),
    ("<p>yes</p><footer>open to the end", "yes"),
    ("<input class='nav'><p>yes</p><br class='ads'/>so", "yes\n\nso"),
    ("<table><tr><td class='ads'>x</td><td>y</td></tr></table>", "|  |\n| --- |\n| y |"),
    ("<script>x='</p><nav>'</script><p>t</p><!-- <p>no</p> -->", "t"),
    ("<article><p><b>one<br><p>two</p></article>after", "**one\n\ntwo**\n\nafter"),
    ("<div><p><b>one</p><p>two</p></div>", "**one**\n\ntwo"),
    ("<p><b></b>x<i> y </i>z</p>", "x *y* z"),
    ("<p>a < b</p>", "a < b"),
    ("<p>x</p><ul><li>A<ul><li>B</li><li>C<ul><li>D</li></ul></li></ul></li><li>E</li></ul><p>y</p>",
     "x\n\n- A\n  - B\n  - C\n    - D\n- E\n\ny"),
    ("<ul><li>A</li></ul>mid<ul><li><p>B</p><p>b</p></li></ul>end", "- A\n\nmid\n\n- B\n\n  b\n\nend"),
    ("<ul><li></li><li>A</li></ul>", "- A"),
    ("", ""),
]


def test_html_to_markdown(each):
    values, wanted = zip(*PAGES)
    assert each(html_to_markdown, values) == list(wanted)


def test_entities_are_decoded_once(one):
    assert one(decode_entities, "&amp;lt; &nope; &#0; & &copy;") == "&lt; &nope; � & ©"
    assert one(decode_entities, "&#0000000065; &#x00000000041; &#99999999999; &lsqb; &NotEqualTilde;") == "A A � [ ≂̸"
    assert one(decode_entities, "&copy 2024 &lt&copy=1 &section") == "© 2024 <&copy=1 &section"


TEXTS = [  # a hit and a near miss for every alternative of the line rules
    *[(f"{verb} our boat\nKeel", "Keel") for verb in ("Register", "Log in", "SIGN UP", "subscribe", "Tweet", "Like", "share", " Follow", "Sign in")],
    *[(f"Do {verb}\nKeel", f"Do {verb}\nKeel") for verb in ("register", "follow", "share")],
    *[(f"[{name} page](https://h.net/{name})\nKeel", "Keel") for name in ("Pinterest", "GitHub", "YouTube", "Instagram", "LinkedIn", "Twitter")],
    ("[Mastodon](https://h.net/m)\nKeel", "[Mastodon](https://h.net/m)\nKeel"),
    ("[GitHub](ftp://h.net)\nKeel", "[GitHub](ftp://h.net)\nKeel"),
    ("- [Quay](/quay) and more\nKeel", "Keel"),
    ("- Quay\nKeel", "- Quay\nKeel"),
    *[(f"{label} the crew\nKeel", "Keel") for label in ("Author", "written BY", "Published on", "by")],
    ("Published at sea\nKeel", "Published at sea\nKeel"),
    ("12min read\n7 mins read\n1 minute  read\nKeel", "Keel"),
    ("12 hours read\nKeel", "12 hours read\nKeel"),
    ("___\nKeel\n——————\n-_-", "Keel"),
    ("--\nKeel", "--\nKeel"),
    ("###\nKeel\n\n\n\n\n\nMast", "Keel\n\nMast"),
    ("# H\ntext", "# H\n\ntext"),
    ("# A\n# B\ntext", "# A\n\n# B\n\ntext"),
    ("see [this]( ) now", "see this now"),
    ("https://www.netflix.com/x\nWords", "Words"),
    ("[in](/x)\nWords \t\nMore", "Words\nMore"),
    ("One\n \n\t\nTwo", "One\n\nTwo"),
    (" Share it\nWords", "Words"),
    ("Words By me", "Words By me"),
]


def test_clean_markdown(each):
    values, wanted = zip(*TEXTS)
    assert each(clean_markdown, values) == list(wanted)


def test_clean_keeps_an_article(one):
    text = "# Top\n\n## Part\n\nSome **bold** words.\n\n- One\n- Two\n\n> Said"
    assert one(clean_markdown, text) == text


def test_second_cleaning_sees_what_the_first_left(one):
    assert one(clean_markdown, "[Share]( )") == "Share"
    assert one(lambda c: clean_markdown(clean_markdown(c)), "[Share]( )") == ""


OPENINGS = [  # a hit and a near miss for every opening
    ("go to the quay", True),
    ("going to the quay", False),
    ("About", True),
    ("About boats", False),
    ("MENU of the day", True),
    ("menus", False),
    ("skip to", True),
    ("skip too", False),
    ("contact: crew", True),
    ("contacts", False),
    ("search", True),
    ("research", False),
    ("home\n", True),
    ("home\n\n", False),
    ("navigation", True),
    ("main menus", False),
    ("Main menu.", True),
]


def test_navigation(each):
    values, wanted = zip(*OPENINGS)
    assert each(is_navigation, values) == list(wanted)
    assert each(is_noise_line, ["By the way", "Nearby"]) == [True, False]


def test_render_and_parse(spark):
    df = spark.createDataFrame(
        [("A # title", "http://a.b/c(d)", 3, "Line one\nline two", None)],
        "t string, u string, r int, s string, m string",
    )
    text = df.select(render_article(*[F.col(c) for c in "turs"], F.col("m")).alias("x"))
    assert text.first()["x"] == (
        "# A # title\n\nSource: [http://a.b/c(d)](http://a.b/c(d))\nReading time: 3 minutes\n\n"
        "Line one\nline two\n\n---\n\n"
    )
    header = text.select(parse_header(F.col("x")).alias("h")).first()["h"]
    assert (header["title"], header["source_url"]) == ("A # title", "d")
    assert (header["reading_time"], header["summary"]) == ("3 minutes", "Line one\nline two")


def test_parse_without_header(one):
    header = one(parse_header, "Only a line")
    assert tuple(header) == ("Only a line", "", "", "")


def test_last_label_counts(one):
    header = one(parse_header, "# T\nSource: [a](a)\nSource: [b](b)\nReading time: x: 4 \n---\nbody")
    assert (header["source_url"], header["reading_time"]) == ("b", "4")


NESTED = {
    "a \ue000 x \ue001 b \ue004 c \ue00a b \ue00b d \ue00f1\ue010": "a \ue000 x \ue001 b \ue004 c \ue00a b \ue00b d \ue00f1\ue010",
    "<ol><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ol>": "1. a\n  1. x\n  2. y\n2. b",
    "<ul><li>a<ol start=3><li>x</li><li>y</li></ol></li><li>b</li></ul><p>end</p>": "- a\n  3. x\n  4. y\n- b\n\nend",
    "<ol><li>a<ul><li>x</li></ul></li><li>b</li></ol><ol><li>c</li></ol>": "1. a\n  - x\n2. b\n\n1. c",
    "<blockquote>a<blockquote>b</blockquote>c</blockquote>z": "> a\n>\n> > b\n>\n> c\n\nz",
    "<p>t</p><blockquote><p>one</p><p>two</p></blockquote><p>u</p><blockquote>three": "t\n\n> one\n>\n> two\n\nu\n\n> three",
    "x</blockquote>y": "xy",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>x<table><tr><td>in1</td><td>in2</td></tr></table></td><td>y</td></tr></table>":
        "| A | B |\n| --- | --- |\n| x in1 in2 | y |",
    "<p><b>x<b>y</b>z</b> and <i>k<em>l</em></i></p>": "**xyz** and *kl*",
    "<p><b>x <i>y</i></b></p>": "**x *y***",
    "a &#57344; b <a href='http://x'>http://x</a>": "a \ue000 b <http://x>",
    "<ol><li>p</li><li>q</li></ol>": "1. p\n2. q",
}


def test_nested_elements_and_private_characters(each):
    assert dict(zip(NESTED, each(html_to_markdown, list(NESTED)), strict=True)) == NESTED
