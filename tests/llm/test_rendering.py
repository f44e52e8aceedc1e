"""HTML extraction: layout, visibility, mended markup, odd pages, whole tables."""

from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

import pytest

from skimmer.llm.rendering import extract_text, marker, op1_html_text, render


@pytest.mark.parametrize("page, wanted", [
    (None, None), ("", ""), ("  \n ", ""), ("text", "text"), ("a  b\n c", "a b c"), ("<p>One<p>Two <b>bold</b>", "One\n\nTwo bold"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>t</title><h1>H</h1>x", "H\n\nx"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>a<p>b</p><li value=20>c</ol>", "9. a\n\n   b\n20. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol type=a><li>x<li>y</ol>", "a. x\nb. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>fig<td>12</table>", "Name  Qty\nfig   12"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"), ("<table><td>a</td>lost<td>b</table>end", "lost\n\na  b\n\nend"), ("<table><tfoot><tr><td>f<tbody><tr><td>b</table>", "b\nf"), ("<table><tr><td>out<td><table><tr><td>in<td>ner</table></table>", "out  in  ner"),
    ("<pre>\n a\n  b</pre>", " a\n  b"), ("<blockquote>q</blockquote>", "  q"), ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("a &amp; b &lt;c&gt; &eacute;&#233;", "a & b <c> éé"), ("<a title='x > y'>z</a>", "z"), ("</p>x</div>", "x"),
    ("x<script>var t = '</p>';</script>y<style>p{}</style>", "xy"), ("a<!-- <p>no</p> -->b", "ab"), ("a<!-- open", "a"), ("a<!-->b", "ab"), ("<div hidden>no</div>yes", "yes"), ("<p style='display : none'>no</p>yes", "yes"), ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<style>.x, #y {display:none} p.z{visibility:hidden}</style><p class='a x'>1<p id=y>2<p class=z>3<p>4", "4"), ("<details><summary>s</summary>no</details>", "s"), ("<details open><summary>s</summary>yes</details>", "s\nyes"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<textarea>a <b>c</textarea>", "a <b>c"), ("<input type=submit value=Go><input type=hidden value=no>", "Go"), ("a<b", "a"), ("1 < 2 > 0", "1 < 2 > 0"), ("<body>a</body>b</html>c", "abc"), ("<ruby>漢<rp>(</rp><rt>kan</rt></ruby>", "漢kan"), ("<td>a<td>b", "ab"), ("<template>no</template><noscript>no</noscript>y", "y"),
])
def test_render(page, wanted):
    assert render(page) == wanted


@pytest.mark.parametrize("css, body, wanted", [
    ("@media print{p{display:none}}", "<p>visible on screen</p>", "visible on screen"), ("@media screen{p{display:none}}", "<p>no<div>yes", "yes"), ("@media all and (max-width:600px){p{display:none}} @media (min-width:40em){.w{display:none}}", "<p>1<p class=w>2", "1"),
    ("@media not print{.a{display:none}} @media print, screen{.b{display:none}}", "<p class=a>1<p class=b>2<p>3", "3"), ("@media print{@media screen{p{display:none}}}", "<p>1", "1"), ("@supports (display:grid){p{display:none}}", "<p>1<div>2", "2"),
    ("p.x{display:none} p.x{display:block}", "<p class=x>1", "1"), ("p.x{display:none} p{display:block}", "<p class=x>1</p>2", "2"), ("p{display:none!important} #a{display:block}", "<p id=a>1</p>2", "2"), ("#a{display:block} p{display:none}", "<p id=a>1</p>2", "1\n\n2"),
    (".a .b{display:none}", "<div class=a><i><b class=b>no</b></i>yes</div><b class=b>also</b>", "yes\nalso"), (".x.y{display:none}", "<p class='x y'>no<p class=x>yes", "yes"), ("div>p{display:none}", "<div><p>1</p><span><p>2</p></span></div>", "2"),
    ("h1+p{display:none} h1~div{display:none}", "<h1>h</h1><p>1</p><p>2</p><div>3</div>", "h\n\n2"), ("p:first-child{display:none} p:not(.k):last-child{display:none}", "<div><p>1<p>2<p>3</div>", "2"), ("li:nth-child(2n+1){display:none}", "<ul><li>1<li>2<li>3<li>4</ul>", "- 2\n- 4"),
    ("[data-x=y]{display:none} [lang|=de]{display:none} a[href^=http]{display:none}", "<p data-x=y>1<p lang=de-AT>2<p><a href=http://a>3</a><a href=b>4</a>", "4"), ("p:hover, p::before{display:none}", "<p>1", "1"), ("/* p{display:none} */ p{color:red}", "<p>1", "1"),
    ("p{display:none} [hidden]{display:block}", "<p>1<div hidden>2</div>", "2"), (".v{visibility:hidden} .v b{visibility:visible}", "<p class=v>no <b>yes</b> no", "yes"), ("p{display:nonsense;display:none;display:what}", "<p>1</p>2", "2"), ("@font-face{x:y} @keyframes k{from{display:none}} p{display:none", "<p>1</p>2", "2"),
    ("span{display:block} div{display:inline}", "<span>1</span><span>2</span><div>3</div><div>4</div>", "1\n2\n34"), ("pre{white-space:normal} .k{white-space:pre}", "<pre>a\n b</pre><p class=k>c\n d", "a b\n\nc\n d"), ("p{content:'}p{display:none}'}", "<p>1", "1"),
])
def test_style_sheets(css, body, wanted):
    assert render(f"<style>{css}</style>{body}") == wanted
    assert render(f"<style media=print>p,div,b,i,span,a,h1,pre,li{{display:none}}</style><style>{css}</style>{body}") == wanted


def test_own_styles_stand_above_rules():
    assert render("<style>p{display:none}</style><p style='display:block'>1<p>2") == "1"
    assert render("<style>p{display:none!important}</style><p style='display:block'>1</p>2") == "2"
    assert render("<style>p{display:none!important}</style><p style='display:block ! important'>1</p>2") == "1\n\n2"


@pytest.mark.parametrize("css, wanted", [
    (".a{.b{display:none}}", "1 3 4 5"), (".a{& .b{display:none}}", "1 3 4 5"), (".a{&.b{display:none}}", "1 2 3 4 5"), (".a,i{> .b{display:none}}", "1 3 4 5"), (".b{.a &{display:none}}", "1 3 4 5"), (".a{@media print{display:none}}", "1 2 3 4 5"), (".a{@media screen{display:none}}", "4 5"),
    (".a{display:none;&{display:block}}", "1 2 3 4 5"), (".a{&{display:block} display:none}", "4 5"), ("div{.a,&.a{.b{&.b{display:none}}}} i{display:none}", "1 3 4"), ("div{div,.a &{.b,.c{&.b{display:none}}}}", "1 2 3 4 5"), (".a{.b{color:red;.c{display:none}}} i{display:none}", "1 2 3 4"), (".a{@font-face{.b{x:y}} .b{display:none}}", "1 3 4 5"),
])
def test_rules_within_rules(css, wanted):
    assert render(f"<style>{css}</style><div class=a>1 <p class=b>2</p> 3</div><p class=b>4 <i>5</i>").split() == wanted.split()


class Slow(HTMLParser):
    """The words that show of a page whose tags are all closed: every rule is tried on every element, in order of the cascade."""

    def __init__(self, rules):
        super().__init__()
        self.rules, self.stack, self.words = rules, [], []

    @staticmethod
    def one(simple, tag, attrs):
        classes = (attrs.get("class") or "").split()
        parts = re.findall(r"[.#]?\w+", simple)
        return all(p[1:] in classes if p[0] == "." else attrs.get("id") == p[1:] if p[0] == "#" else p == tag for p in parts)

    def chain(self, sel, path):
        if not sel:
            return True
        if not self.one(sel[-1], *path[-1]):
            return False
        rest = sel[:-1]
        if not rest:
            return True
        if rest[-1] == ">":
            return len(path) > 1 and self.chain(rest[:-1], path[:-1])
        return any(self.chain(rest, path[:k]) for k in range(1, len(path)))

    def handle_starttag(self, tag, attrs):
        path = [(t, a) for t, a, _, _ in self.stack] + [(tag, dict(attrs))]
        found = {"display": ((-1,), "none" if "hidden" in dict(attrs) else ""), "visibility": ((-1,), "")}
        for n, (sel, prop, value, important) in enumerate(self.rules):
            weight = (important, sel.count("#"), sel.count("."), len(re.findall(r"(?<![.#\w])[a-z]\w*", sel)), n)
            if self.chain(sel.split(), path) and weight > found[prop][0]:
                found[prop] = (weight, value)
        _, _, none, seen = self.stack[-1] if self.stack else ("", {}, False, True)
        v = found["visibility"][1]
        self.stack.append((tag, dict(attrs), none or found["display"][1] == "none", v == "visible" or seen and v != "hidden"))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if not self.stack or not self.stack[-1][2] and self.stack[-1][3]:
            self.words += data.split()


def test_what_shows_against_a_slow_renderer():
    r = random.Random(12)
    for _ in range(400):
        simple = lambda: r.choice(["div", "span", "b", "i", ".a", ".b", ".c", "#u", "#v", "div.a", "span.b", "b.c", ".a.b", "div#u"])
        rules = []
        for _ in range(r.randint(0, 8)):
            sel = simple()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                sel = f"{simple()} {r.choice(['', '> '])}{sel}"
            prop = r.choice(["display", "visibility"])
            rules.append((sel, prop, r.choice(["none", "inline", "none"] if prop == "display" else ["hidden", "visible"]), r.random() < 0.2))
        n = 0

        def part(depth):
            nonlocal n
            out = ""
            for _ in range(r.randint(1, 3)):
                n += 1
                out += f" w{n} "
                if depth < 5:
                    out += "<div>" * (deep := r.choice([0, 0, 0, 0, 300]))
                    t = r.choice(["div", "span", "b", "i"])
                    attrs = r.choice(["", "", " class=a", " class='b c'", " class='a b'", " id=u", " id=v class=c", " hidden"])
                    out += f"<{t}{attrs}>{part(depth + r.choice([1, 2, 5]))}</{t}>" + "</div>" * deep
            return out

        page = f"<div>{part(0)}</div>"
        css = " ".join(f"{s}{{{p}:{v}{'!important' * i}}}" for s, p, v, i in rules)
        slow = Slow(rules)
        slow.feed(page)
        assert render(f"<style>{css}</style>{page}").split() == slow.words, (css, page)


def test_hostile_styles_end_soon():
    start = time.time()
    deep = "<div class=a>" * 180
    assert render(f"<style>{'.a ' * 40}.z{{display:none}} {'.a > ' * 30}.a .z{{display:none}}</style>{deep}<p class=z>x") == ""
    assert render("<style>" + "@media screen{" * 5000 + "p{display:none}</style><p>x").strip() in ("", "x")
    assert "x" in render(f"<style>li + li b{{display:none}} li:last-child{{display:none}} {'p{display:block}' * 3000}</style>" + "<li>x" * 20_000)
    assert render("<style>" + "{" * 50_000 + "</style>x") == "x"
    assert time.time() - start < 30


def test_cells_line_up():
    rows = [("name", "n"), ("漢字", "1"), ("ab", "22"), ("", "333")]
    lines = render("<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in rows) + "</table>").split("\n")
    assert lines == ["name  n", "漢字  1", "ab    22", "      333"]
    assert marker("i", 1994) == "mcmxciv." and marker("A", 28) == "AB." and marker("1", -3) == "-3."


def test_columns_line_up_against_their_widest_cells():
    r = random.Random(8)
    for _ in range(200):
        cells = [["x" * r.choice([1, 5, 59, 61, 70, 300]) if r.random() < 0.9 else "" for _ in range(3)] for _ in range(r.randint(1, 5))]
        around = "<div>" * r.choice([0, 250])
        found = render(around + "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>")
        wide = [max(len(row[k]) for row in cells) for k in range(3)]
        slow = ["".join(c.ljust(w + 2) if w else "" for c, w in zip(row, wide)).rstrip() for row in cells]
        slow = [x for k, x in enumerate(slow) if any(slow[: k + 1]) and any(slow[k:])]
        assert [x for x in found.split("\n") if x] == [x for x in slow if x], cells


def test_what_is_nested_deep_is_laid_out_alike():
    deep = "<div>" * 250
    assert render(f"{deep}<p style='display:none'>hid</p>seen") == "seen"
    assert render(f"{deep}<table><tr><td>ab<td>se<tr><td>abcd<td>x</table>en") == "ab    se\nabcd  x\n\nen"
    assert render("<ul><li>a" * 2000).split("\n")[-1] == "  " * 1999 + "- a"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<a x='" * 20_000, "<!--" * 20_000, "<" * 50_000 + "x", "<table>" * 5_000 + "x", "<li>" * 20_000 + "x", "<b>" * 20_000 + "x", '<a b="' * 20_000 + ">", "<p><table><td>" * 500 + "x", "<td colspan=9999999999 rowspan=99999999999>" * 200 + "x", "<p>" + "<div>" * 200_000 + "</p>x", "<style>" + "a,b{& &{" * 300 + "display:none</style>x"])
def test_hostile_pages_end_soon(page):
    start = time.time()
    assert isinstance(render(page), str)
    assert time.time() - start < 20


def test_no_text_is_lost_however_markup_is_broken():
    r = random.Random(4)
    tags = "p div b i ul ol li table tr td th tbody h1 span a blockquote pre dl dt dd section".split()
    for _ in range(300):
        words, page = [], []
        for k in range(30):
            t = r.choice(tags)
            page.append(r.choice([f"<{t}>", f"</{t}>", f"<{t} class=x>"]))
            if r.random() < 0.6:
                words.append(f"w{k}x")
                page.append(f" w{k}x ")
        assert sorted(render("".join(page)).split()) == sorted(words + [x for x in render("".join(page)).split() if x not in words]), page
        assert set(words) <= set(render("".join(page)).split())


def test_table_of_pages(spark):
    rows = [(1, "<p>a", "keep"), (1, "<p>a", "keep"), (None, None, None), (3, "", "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got if r["text"] is not None) == [(1, "a"), (1, "a"), (3, "")]
    assert len(got) == 4 and got[0].__fields__ == ["page_id", "html", "text"]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_query_renders_every_page(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in op1_html_text(spark, sf_dir).collect()}
    assert got == {k: render(v) for k, v in pages.items()}
    assert all("track(" not in t and "margin:0" not in t for t in got.values())
