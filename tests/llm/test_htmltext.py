import random
import time
from html.parser import HTMLParser

from brindle.llm import htmltext


class Plain(HTMLParser):
    """The tree of a well-formed page, and the same scores by recursion over it."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "#root", "hint": "", "kids": [], "up": None}
        self.at, self.skip = self.root, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.VOID:
            return
        node = {"tag": tag, "hint": " ".join(v for k, v in attrs if k in ("class", "id") and v), "kids": [], "up": self.at}
        self.at["kids"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        if tag == self.at["tag"]:
            self.at = self.at["up"]

    def handle_data(self, data):
        at = self.at
        while at and at["tag"] not in ("script", "style", "head", "noscript", "select", "textarea", "svg", "iframe", "template"):
            at = at["up"]
        if not at:
            self.at["kids"].append(data)


def walk(n):
    yield n
    for k in n["kids"]:
        if isinstance(k, dict):
            yield from walk(k)


def size(n, linked=False, inside=False):
    inside = inside or n["tag"] == "a"
    return sum((0 if linked and not inside else len(" ".join(k.split()))) if isinstance(k, str) else size(k, linked, inside) for k in n["kids"])


def commas(n):
    return sum(k.count(",") if isinstance(k, str) else commas(k) for k in n["kids"])


def best(page, parser=Plain):
    tree = parser(page)
    density = lambda n: size(n, True) / size(n) if size(n) else 0.0
    scores = {}
    for n in walk(tree.root):
        holds = any(m is not n and m["tag"] in htmltext.BLOCK for m in walk(n))
        if not (n["tag"] in htmltext.PARAGRAPH or n["tag"] in ("div", "section", "article") and not holds) or size(n) < htmltext.LEAST:
            continue
        points = (1 + commas(n) + min(size(n) / 100, 3)) * (1 - density(n))
        e, level = (n["up"] if n["tag"] in htmltext.PARAGRAPH and n["up"]["tag"] != "#root" else n), 0
        while e["tag"] != "#root" and level < htmltext.REACH:
            if id(e) not in scores:
                s = htmltext.TAG_SCORE.get(e["tag"], 0) + 25 * (bool(htmltext._GOOD.search(e["hint"])) - bool(htmltext._BAD.search(e["hint"])))
                scores[id(e)] = [s, e]
            scores[id(e)][0] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e, level = e["up"], level + 1
    return max((s * (1 - density(e)) for s, e in scores.values()), default=0.0)


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style></head><body>
<div id="nav" class="menu"><ul><li><a href="/">Home, sweet home of many links</a></li><li><a href="/x">Other pages that we have</a></li></ul></div>
<div class="content"><h1>Head</h1><p>First paragraph, with some commas, and enough words to count as one.</p>
<p>Second paragraph: it, too, is long enough to be scored, <a href="#">with a link</a>.</p><script>var x = "<p>no</p>";</script></div>
<p>A sibling that reads like prose, long enough to be kept because it has no links and says more than eighty characters do.</p>
<div id="footer"><p>Copyright, all rights, imprint, <a href="#">contact and more and more links</a></p></div></body></html>"""


def test_the_article_is_kept_and_the_rest_is_not():
    title, text, score = htmltext.extract(PAGE)
    assert title == "A & B"
    assert text.split("\n")[:3] == ["Head", "First paragraph, with some commas, and enough words to count as one.", "Second paragraph: it, too, is long enough to be scored, with a link."]
    assert "A sibling that reads like prose" in text and "Home" not in text and "Copyright" not in text and "var x" not in text
    assert abs(score - best(PAGE)) < 1e-9


def random_page(rng) -> str:
    """A well-formed page, whose tree a plain parser sees as well."""
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum,", "dolor", "sit", "amet,", "x", "consectetur"]) for _ in range(n))

    def block(depth):
        kind = rng.choice(["div", "section", "article", "ul", "p", "p", "p", "h2", "nav", "aside", "blockquote"])
        attr = rng.choice(["", "", ' class="content main"', ' id="sidebar"', ' class="comment"', " class=post"])
        if kind in ("p", "h2") or depth > 4:
            inner = words(rng.randint(1, 60)) + rng.choice(["", f' <a href="#">{words(rng.randint(1, 20))}</a> ', f"<b>{words(3)}</b>"])
            return f"<{kind if kind != 'ul' else 'div'}{attr}>{inner}</{kind if kind != 'ul' else 'div'}>"
        inner = "".join(block(depth + 1) for _ in range(rng.randint(0, 5)))
        return f"<ul{attr}><li>{inner}</li></ul>" if kind == "ul" else f"<{kind}{attr}>{inner}</{kind}>"

    return "<html><head><title>t</title></head><body>" + "".join(block(0) for _ in range(4)) + "</body></html>"


def test_scores_equal_a_plain_recursion():
    rng = random.Random(5)
    scored = 0
    for _ in range(300):
        page = random_page(rng)
        score = htmltext.extract(page)[2]
        assert abs(score - best(page)) < 1e-6, page
        scored += score != 0
    assert scored > 200


def test_time_grows_with_the_page_only():
    began = time.time()
    for page in ("<" * 20_000 + "a='" * 20_000, "<a b='" * 30_000, "<script " * 30_000, "</b " * 50_000, "<b>" * 50_000, "<p>x" * 50_000, "<a b=\"c" * 30_000, "<!--" * 30_000):
        htmltext.extract(page)
    assert time.time() - began < 30


def test_odd_rows(spark):
    broken = "<p>one <b>two<p>three</div></i> four <!-- open"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (3, "u", broken), (3, "u", broken), (4, "u", "<div>" * 3000 + "deep " * 40 + "</div>" * 3000), (5, "u", "<p>" + "long, " * 200_000), (6, "u", "<" * 2000 + "a='" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("e", "title", "text", "score"):
        pages = pages.withColumn(name, pages.page_id)
    got = htmltext.main_text(pages).collect()
    assert (got[0].text, got[0].score) == (None, None)
    assert (got[1].text, got[1].score, got[2].text, got[2].score) == ("", 0.0, "plain text", 0.0)
    assert got[3].text.split() == ["one", "two", "three", "four"] and got[4].text == got[3].text
    assert got[5].text.split() == ["deep"] * 40 and got[6].text.count(",") == 200_000
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_quoted_attributes_may_hold_any_markup():
    for attr in ('title="x<y"', "title='x<y'", 'content="<p class=ad>no</p>"', 'data-a = "a > b < c"', 'title="it\'s <b>"', "data-a='<i id=\"nav\">' data-b"):
        page = PAGE.replace('<div class="content">', f'<div {attr} class="content">').replace("<p>First", f"<p {attr}>First").replace('<a href="/">', f'<a {attr} href="/">')
        page = page.replace("<script>", f"<script {attr}>").replace("<style>", f"<style {attr}>")
        assert page != PAGE and htmltext.extract(page) == htmltext.extract(PAGE), attr
        assert abs(htmltext.extract(page)[2] - best(page)) < 1e-9
    assert htmltext.extract('<p>one <a href="never closed>two</a> three</p>')[1] == "one two three"
    assert htmltext.extract("<p class=it's>one <b>two</b> isn't</p>")[1] == "one two isn't"


class Lenient(Plain):
    """Reads elements that are left open, too: all given pages have some."""

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.BLOCK and tag != "br":
            e = self.at
            while e["up"] and e["tag"] not in htmltext.BLOCK:
                e = e["up"]
            if e["tag"] == "p":
                self.at = e["up"]
        while self.at["tag"] in htmltext.CLOSES.get(tag, ()):
            self.at = self.at["up"]
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        e = self.at
        while e and e["tag"] != tag:
            e = e["up"]
        if e and e["up"]:
            self.at = e["up"]


def test_scores_of_all_given_pages_equal_a_plain_recursion(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.main_text(pages).collect():
        assert abs(r.score - best(html[r.page_id], Lenient)) < 1e-6, r.page_id


def test_time_of_quotes_grows_with_the_page_only():
    began = time.time()
    for unit in ("<a b=\"", "<a b=' c=\"", "=\"<a ='\" '\" =\"<b ", "<a x='\" y=\"' z=", "<a b=\"<i c='>\"", "<a =\"<\" ", "<a ==\"'<", "<a \"<", "<a = "):
        htmltext.extract("<a b=" + unit * 30_000)
    assert time.time() - began < 30
