"""Papers published as HTML, to plain text.

Title, authors, abstract and the sections' headings and paragraphs are picked and joined by blank lines: in one pass over a page's tags, or, with
``compat=True``, by the older patterns, which end an element at the first end tag. Single steps are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skimmer.functions.steady import text_udf
from skimmer.functions.tag_scanner import CLASSES, ENTITIES, Paper
from skimmer.functions.text import collapse, replaced_in_order, substituted_in_order

# What the page format's elements look like; they say what is picked.
MATH = r'(?s)<math[^>]*>.*?<annotation[^>]*encoding="application/x-tex"[^>]*>\s*(.*?)\s*</annotation>.*?</math>'
TITLE = rf'(?is)<[^>]*class="[^"]*{CLASSES["title"]}[^"]*"[^>]*>(.*?)</[^>]+>'
AUTHORS = rf'(?is)<div[^>]*class="[^"]*{CLASSES["authors"]}[^"]*"[^>]*>(.*?)</div>'
ABSTRACT = rf'(?is)<div[^>]*class="[^"]*{CLASSES["abstract"]}[^"]*"[^>]*>(.*?)</div>'
SECTION, PARAGRAPH, HEADING = r"(?is)<section[^>]*>(.*?)</section>", r"(?is)<p[^>]*>(.*?)</p>", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
REFERENCE = r'(?is)<a[^>]*href="#bib[^"]*"[^>]*>.*?</a>'


def _element(tag: str, css: str = "") -> str:
    """A pattern for an element of a tag, with a class, up to its first end tag."""
    return rf'(?is)<{tag}[^>]*class="[^"]*{css}[^"]*"[^>]*>.*?</{tag}>' if css else rf"(?is)<{tag}[^>]*>.*?</{tag}>"


def math_to_latex(page: Column) -> Column:
    """Formulas become the TeX that their annotation holds, between dollars."""
    return F.regexp_replace(page, MATH, r"\$$1\$")


def without_unwanted(page: Column) -> Column:
    """Scripts, styles, footers and navigation go."""
    rules = [*(_element(t) for t in ("script", "style", "noscript", "footer")), _element("nav", CLASSES["navbar"]), _element("nav", CLASSES["toc"]), _element("div", CLASSES["pages"])]
    return substituted_in_order(page, [(r, "") for r in rules])


def without_references(page: Column) -> Column:
    rules = [_element("section", CLASSES["bibliography"]), _element("div", CLASSES["entry"]), REFERENCE]
    return substituted_in_order(page, [(r, "") for r in rules])


def decoded(c: Column) -> Column:
    """Seven entities, the ampersand first: '&amp;lt;' becomes '<'."""
    return replaced_in_order(c, ENTITIES)


def without_tags(c: Column) -> Column:
    return collapse(decoded(F.regexp_replace(c, r"(?s)<[^>]+>", " ")))


def title(page: Column) -> Column:
    """Text of the first element with the title's class, up to its first end tag of any kind; null if there is none."""
    return F.when(F.regexp_like(page, F.lit(TITLE)), without_tags(F.regexp_extract(page, TITLE, 1)))


def authors(page: Column) -> Column:
    """Names, joined by ', '; pieces of 80 bytes or more or with an address go. Null if none is left."""
    text = without_tags(F.regexp_extract(page, AUTHORS, 1))
    names = F.transform(F.split(text, ", | and "), lambda x: F.trim(x))
    return F.nullif(F.array_join(F.filter(names, lambda x: (x != "") & (F.octet_length(x) < 80) & ~F.contains(x, F.lit("@"))), ", "), F.lit(""))


def abstract(page: Column) -> Column:
    return F.nullif(without_tags(F.regexp_extract(page, ABSTRACT, 1)), F.lit(""))


def paragraphs(page: Column) -> Column:
    """Texts of all p elements that are not empty."""
    return F.filter(F.transform(F.regexp_extract_all(page, F.lit(PARAGRAPH), F.lit(1)), without_tags), lambda x: x != "")


def first_heading(page: Column) -> Column:
    return without_tags(F.regexp_extract(page, HEADING, 1))


def sections(page: Column) -> Column:
    """Of each section its first heading, then its paragraphs; a section ends at the first end tag."""
    bodies = F.regexp_extract_all(page, F.lit(SECTION), F.lit(1))
    return F.flatten(F.transform(bodies, lambda b: F.filter(F.concat(F.array(first_heading(b)), paragraphs(b)), lambda x: x != "")))


def paper_text(page: Column, no_references: bool = False, compat: bool = False) -> Column:
    """The paper as plain text; null for null. Sections in sections and elements without an end are read; ``compat`` ends each at its first end tag."""
    if not compat:
        return text_udf(lambda p: Paper(p, no_references).text())(page)
    clean = without_unwanted(math_to_latex(page))
    if no_references:
        clean = without_references(clean)
    names, summary = authors(clean), abstract(clean)
    head = F.array(F.nullif(title(clean), F.lit("")), F.concat(F.lit("Authors: "), names), F.concat(F.lit("Abstract\n"), summary))
    return F.when(page.isNotNull(), F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), sections(clean)), "\n\n"))
