"""The one-pass reader of paper pages: equal to the older patterns on flat pages, right on nested and broken ones."""

from __future__ import annotations

import random
import time

import pytest

from skimmer.functions import paper_html as H
from skimmer.functions.tag_scanner import Paper

HEAD = '<h1 class="ltx_title ltx_title_document">On {t}</h1><div class="ltx_authors"><span>Ann Lee</span>, Bo Roe and c@d.org</div><div class="ltx_abstract"><p>Short &amp; sweet.</p></div>'


WORDS = [
    "a", "b&lt;c", "d&amp;lt;", "é f", "<b>g</b>", "<br/>", "<!-- h -->", '<a href="#bib.1">[1]</a>', "\n",
    '<math alttext="x"><semantics><mi>x</mi><annotation encoding="application/x-tex"> x^2 </annotation></semantics></math>',
]
EXTRA = ["", "<script>var a = '<p>no</p>';</script>", "<style>p {}</style>", '<nav class="ltx_page_navbar"><p>menu</p></nav>', "<footer><p>foot</p></footer>", '<div class="ltx_pagination">1</div>']


def page(r):
    """A page without anything in which the older patterns lose their way: no section in a section, every end tag there, every formula with its TeX."""
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))
    sections = ""
    for _ in range(r.randint(0, 4)):
        h = r.randint(2, 6)
        sections += f"<section class='s'><h{h}>{text()}</h{h}><div><p class=x>{text()}</p><p>{text()}</p></div></section>"
    head = HEAD.format(t=r.randint(1, 9)) if r.random() < 0.8 else ""
    return f'<html><body>{r.choice(EXTRA)}{head}{sections}<section class="ltx_bibliography"><h2>References</h2><p>Old.</p></section></body></html>'


@pytest.mark.parametrize("no_references", [False, True])
def test_flat_pages_equal_the_older_patterns(spark, no_references):
    r = random.Random(3)
    df = spark.createDataFrame([(page(r),) for _ in range(300)] + [(None,), ("",)], "html string")
    c = H.F.col("html")
    for row in df.select("html", H.paper_text(c, no_references).alias("now"), H.paper_text(c, no_references, compat=True).alias("older")).collect():
        assert row["now"] == row["older"], row["html"]


def body(html, **more):
    return Paper(html, **more).sections.blocks()


def test_sections_in_sections():
    html = "<section><h2>A</h2><p>1</p><section><h3>B</h3><p>2</p><section><p>3</p></section></section><p>4</p></section><section><p>5</p><h2>C</h2><h3>D</h3></section>"
    assert body(html) == ["A", "1", "B", "2", "3", "4", "C", "5"]


@pytest.mark.parametrize("html, wanted", [
    ("<section><p>a<p>b<h2>H</h2>c</section>", ["H", "a", "b"]), ("<section><p>a<i>b<b>c</p><p>d</section>", ["a b c", "d"]), ("</p></section><section><p>a</b></p>", ["a"]), ("<section><p>a < b & c > d</p></section>", ["a < b & c > d"]),
    ("<section><p>a<script>x</p></section>", ["a x"]), ("<section><p>a<SCRIPT>x</p></script >b</P></Section>", ["ab"]), ("<section><p>a<!-- b</p></section>", ["a<!-- b"]), ("<section><p>a<!-- </p> -->b</p></section>", ["ab"]),
    ("<section><pre>no</pre><p>a</p></section>", ["a"]), ("<section><p>x <math><mi>y</mi></math> <math><annotation encoding='application/x-tex'>z</annotation></math></p></section>", ["x y $z$"]),
    ("<section><p>a<br>b<img src=x>c</p></section>", ["a b c"]), ("<p>out</p>", []), ("<section><p>1 &amp;lt; 2&nbsp;3</p></section>", ["1 < 2 3"]), ("<section><ul><li>x<p>y</p></ul></section>", ["y"]),
    ("<section><p>a <math><mi>b</mi><annotation encoding='application/x-tex'>c</p></section>", ["a $c$"]),
])
def test_nested_and_broken_pages(html, wanted):
    assert body(html) == wanted


def test_titles_hold_markup_and_references_go():
    html = '<h1 class="ltx_title_document">On <em>many</em> things</h1><div class="ltx_abstract"><div>Deep</div> end</div><section><p>See <a href="#bib.1">[1]</a>.</p><ul><li class="ltx_bibitem"><p>r</p></li></ul></section><section class="ltx_bibliography"><section><p>x</p></section><p>y</p></section>'
    paper = Paper(html, no_references=True)
    assert (paper.title, paper.abstract, paper.sections.blocks()) == ("On many things", "Deep end", ["See ."])
    assert body(html) == ["See [1] .", "r", "x", "y"]


@pytest.mark.parametrize("html", ["<p>" * 100_000, "<section>" * 100_000 + "x", "<div><span>" * 100_000, "<section><p>" * 100_000, "</p>" * 100_000, "<!-- " * 100_000, "<script>" * 100_000, "<" * 200_000, "<math>" * 100_000, '<nav class="ltx_TOC">' * 100_000, "<a " * 100_000, "<section>" + "<b><p>" * 100_000 + "</b>" * 100_000])
def test_time_is_in_proportion(html):
    begin = time.perf_counter()
    Paper(html).text()
    assert time.perf_counter() - begin < 10
