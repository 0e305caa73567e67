import html
import random
import re
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries, wrappers

KIND = "page_id long, url string, html string"


class Plain(HTMLParser):
    """A plain second way for well-formed pages: text of the article but for what is left out, block by block."""

    def __init__(self, out):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.blocks, self.said = out, [], [], []

    def close_block(self):
        if text := " ".join("".join(self.said).split()):
            self.blocks.append(text)
        self.said = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.said.append(" ")
            return
        if tag not in wrappers.INLINE:
            self.close_block()
        self.stack.append((tag, tag in self.out or dict(attrs).get("class") in self.out))

    def handle_endtag(self, tag):
        if tag not in wrappers.INLINE:
            self.close_block()
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(o for _, o in self.stack):
            self.said.append(data)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta &amp; gamma", "d&eacute;j&agrave;", "x&nbsp;&nbsp;y", "&lt;tag&gt;", "é😀", "a\tb\n c", "&#x41;&#66;"]) for _ in range(n))


def page(rng, kind):
    nav = "<ul>" + "".join(f'<li><a href="/{i}">Item {i} {rng.random()}</a></li>' for i in range(rng.randint(2, 6))) + "</ul>"
    body = f"<h1>Title {words(rng, 3)}</h1>"
    for _ in range(rng.randint(1, 6)):
        body += rng.choice([f"<p>{words(rng, 12)}</p>", f"<h2>{words(rng, 2)}</h2><p>{words(rng, 9)} <b>bold</b>ly, <a href='x'>linked</a>.</p>", f"<ul><li>{words(rng, 3)}</li><li>{words(rng, 2)}</li></ul>", f"<blockquote>one<br>two</blockquote>", f'<div class="ad">Buy {words(rng, 2)}</div>', "<aside>Aside</aside>", "<form>Name <input> <button>Send</button></form>", "<script>var x='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->"])
    if rng.random() < 0.5:
        body += '<section class="comments"><h2>Comments</h2><article class="comment"><p>I disagree.</p></article></section>'
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title></head><body><header><h2>Site {kind}</h2></header><nav>{nav}</nav><div class="cookie-notice">We use cookies</div><main><article>{body}</article></main><div id="sidebar"><p>{words(rng, 5)}</p></div><footer>&copy; 2024</footer></body></html>'


def test_matches_a_plain_parser(spark):
    rng = random.Random(1)
    rows = [(i, f"https://host{i % 3}.example/{i}", page(rng, i % 3)) for i in range(150)]
    rows += [(7, rows[5][1], rows[5][2])] * 3
    df = spark.createDataFrame(rows, KIND).repartition(6).withColumn("text", F.lit(1)).withColumn("host", F.lit("h")).withColumn("wrapper", F.lit("w"))
    out = sorted(wrappers.extract(df).collect())
    assert len(out) == len(rows)
    want = []
    for i, url, text in rows:
        p = Plain({"ad", "aside", "form", "comments", "script", "style"})
        p.feed(text)
        p.close()
        want.append((i, url, "\n".join(p.blocks), len("\n".join(p.blocks))))
    assert [tuple(r) for r in out] == sorted(want)


def test_joined_wrappers_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, f"https://host{i % 5}.example/{i}", page(rng, i % 5)) for i in range(60)], KIND)
    want = sorted(wrappers.extract(df).collect())
    monkeypatch.setattr(wrappers, "AT_HAND", 0)
    assert sorted(wrappers.extract(df).collect()) == want


def test_odd_pages(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "not an address", "plain text &amp;  more"),
        (4, "https://a.b/1", "<article>unfinished <p>one<p>two</article><p>after"),
        (5, "https://a.b/2", "<article>x <a href='"),
        (6, "https://a.b/3", "<p>no article <script>never closed"),
        (7, "https://a.b/4", "<article>" + "<div>" * 400 + "deep" + "</div>" * 400 + "<p>after</p></article><footer>no</footer>"),
        (8, "https://a.b/5", "<ARTICLE><P>Upper</P><!-- gone --><TABLE><TR><TD>a<TD>b<TR><TD>c</TABLE></ARTICLE>"),
        (9, "https://a.b/6", "<article>" + "<p>long words here</p>" * 20_000 + "</article>"),
        (None, "https://a.b/7", "<article><p>1 < 2 & 3 > 2</p></article>"),
        (10, "https://a.b/8", '<article><p title="a > b">x</p><p title="open>y</p></article>'),
    ]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, KIND)).collect()}
    text = {k: r.text for k, r in got.items()}
    assert (text[1], text[2], text[3]) == ("", "", "plain text & more")
    assert (text[4], text[5], text[6]) == ("unfinished\none\ntwo", "x", "no article")
    assert (text[7], text[8]) == ("deep\nafter", "Upper\na\nb\nc")
    assert text[9] == "\n".join(["long words here"] * 20_000) and text[None] == "1 < 2 & 3 > 2" and text[10] == "x\ny"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].url is None
    assert wrappers.extract(spark.createDataFrame([], KIND)).count() == 0


CASES = {
    "main": ("<header>Site</header><main><h1>T</h1><p>Body text.</p></main><footer>f</footer>", "T\nBody text."),
    "content class": ('<div id="header">Site</div><div class="post-content"><h1>T</h1><p>A body text of some length.</p></div><div class="widget">w</div>', "T\nA body text of some length."),
    "article's own head": ("<article><header><h1>T</h1></header><p>B</p><footer>by me</footer></article>", "T\nB"),
    "words of a whole page": ('<body class="has-sidebar header-fixed"><article class="post comments-open"><h1 class="entry-header">T</h1><p>B</p></article></body>', "T\nB"),
    "article in a form": ('<form id="search-all"><article><p>B</p></article></form>', "B"),
    "teasers": ('<article><p>B</p></article><div class="related"><article><p>Other</p></article></div>', "B"),
    "comments": ('<article><p>B</p><div id="userComments"><p>no</p></div></article>', "B"),
    "articles one after the other": ("<article><p>A</p></article><article><p>B</p></article>", "A\nB"),
}


@pytest.mark.parametrize("name", CASES)
def test_parts_of_pages(spark, name):
    text, want = CASES[name]
    assert [r.text for r in wrappers.extract(spark.createDataFrame([(1, "https://x.y/", text)], KIND)).collect()] == [want]


def test_template_without_elements_that_say_so(spark):
    """Nothing but plain elements: what is the same on all pages and lists of links are left out."""
    rng = random.Random(3)
    rows, want = [], []
    for i in range(20):
        paragraphs = [f"Paragraph {i} {j} of the text with number {rng.random()}." for j in range(rng.randint(3, 6))]
        rows.append((i, f"https://plain.example/{i}", f"<body><div><div>Welcome to the site</div><div><a href='1'>one {i}</a> <a href='2'>two</a></div><table><tr><td><h1>Head {i}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</td></tr></table></div><div>All rights reserved by the people of the site</div></body>"))
        want.append("\n".join([f"Head {i}", *paragraphs]))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i in range(20)] == want


def as_regex(items):
    said = ""
    for x in items:
        body = "#?" if len(x) == 1 else (f"<{re.escape(x[0])}>{as_regex(x[2])}</>" if x[0] else as_regex(x[2]))
        said += body if len(x) == 1 else f"(?:{body}){x[1]}"
    return said


def stream(node):
    said = ""
    for k in node.kids:
        if isinstance(k, str):
            if not k.isspace() and not said.endswith("#"):
                said += "#"
        else:
            said += f"<{k.label}>{stream(k)}</>"
    return said


def test_wrappers_accept_their_pages():
    """A wrapper, as a regular expression, matches the token stream of each page it was made from, in any order of pages."""
    rng = random.Random(4)
    for trial in range(25):
        pages = [wrappers.parse(page(rng, trial)) for _ in range(6)]
        state = None
        for p in pages:
            e = wrappers.expression(p)
            assert re.fullmatch(as_regex(e), stream(p)), (as_regex(e), stream(p))
            state = e if state is None else wrappers.align(state, e)
        for p in pages:
            assert re.fullmatch(as_regex(state), stream(p))


def test_alignment_finds_groups_and_optional_parts():
    e = lambda text: wrappers.expression(wrappers.parse(text))
    assert wrappers.pattern(wrappers.align(e("<ul><li>a<li>b</ul><p>x"), e("<ul><li>a</ul><hr><p>y"))) == "<ul>(<li>#</li>)+</ul>(<hr></hr>)?<p>#</p>"
    assert wrappers.pattern(e("<h2>a</h2><p>b</p>" * 3)) == "(<h2>#</h2><p>#</p>)+"


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, queries.op11_main_text(spark, d).collect())) == sorted(con.sql(queries.ORACLE_SQL["op11_main_text"]).fetchall())


def test_character_references():
    for text in ("&amp;lt;", "&lt", "&notit;", "&#0;", "&#xD800;", "&unknown;", "&"):
        assert wrappers.article(wrappers.parse(f"<article>a{text}b</article>"), wrappers.NONE) == " ".join(html.unescape(f"a{text}b").split())
