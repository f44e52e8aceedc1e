"""Scalar text functions of ingestion and display, as column expressions.

Where a rule says characters, code points are counted; where it says bytes, UTF-8 bytes. ``compat=True`` keeps
a known oddity of older data; the default does what was meant.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode at either end, as other languages trim it.
_ENDS = r"(?U)^\s+|\s+$"
ABSTRACT_LENGTH, EMBED_LENGTH = 2000, 8000


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def collapse(c: Column) -> Column:
    """Runs of white space, of any kind, become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_tag(c: Column, tag: str) -> Column:
    """Content of the first exact ``<tag>``; '' if there is none. Entities stay."""
    return F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def tag_or_null(c: Column, tag: str) -> Column:
    return F.when(F.regexp_like(c, F.lit(rf"(?s)<{tag}>.*?</{tag}>")), first_tag(c, tag))


def nested_tag(c: Column, outer: str, inner: str) -> Column:
    """Trimmed content of the first ``inner`` within the first ``outer``; null if there is none."""
    found = trim_all(first_tag(first_tag(c, outer), inner))
    return F.nullif(found, F.lit(""))


def all_tags(c: Column, tag: str) -> Column:
    """Trimmed, non-empty contents of every ``<tag>``, joined by ', '; null if there are none."""
    each = F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), trim_all)
    return F.nullif(F.array_join(F.filter(each, lambda x: x != ""), ", "), F.lit(""))


def announced(kind: Column, absent_counts: bool = True) -> Column:
    """Whether an item is new or cross-listed; an absent type counts as new, or not."""
    return F.coalesce(kind, F.lit("new" if absent_counts else "")).isin("new", "cross")


def id_from_link(link: Column, compat: bool = False) -> Column:
    """What follows the first '/abs/' without its version; ``compat`` cuts at the first letter v. Without '/abs/': the link's md5."""
    rest = F.regexp_extract(link, r"(?s)/abs/(.*)", 1)
    own = F.split(rest, "v", 2)[0] if compat else F.regexp_replace(rest, r"v[0-9]+$", "")
    return F.when(F.contains(link, F.lit("/abs/")), own).otherwise(F.md5(link))


def versioned_id_from_link(link: Column) -> Column:
    """What follows the last '/abs/', version and all; else the link's md5."""
    return F.when(F.contains(link, F.lit("/abs/")), F.element_at(F.split(link, "/abs/"), -1)).otherwise(F.md5(link))


def without_version(paper_id: Column) -> Column:
    return F.regexp_replace(paper_id, r"v[0-9]+$", "")


def abstract_of(description: Column, length: int = ABSTRACT_LENGTH) -> Column:
    """Between the first and second 'Abstract:', trimmed and cut; without the mark the description, cut only."""
    marked = F.substring(trim_all(F.split(description, "Abstract:", -1)[1]), 1, length)
    return F.when(F.contains(description, F.lit("Abstract:")), marked).otherwise(F.substring(description, 1, length))


def abstract_after(description: Column, length: int = ABSTRACT_LENGTH) -> Column:
    """All that follows the first 'Abstract:', or the whole, cut; '' for null."""
    d = F.coalesce(description, F.lit(""))
    return F.substring(F.when(F.contains(d, F.lit("Abstract:")), F.split(d, "Abstract:", 2)[1]).otherwise(d), 1, length)


def ids_in(c: Column) -> Column:
    """Different paper ids in a text, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+/[0-9]{7})"), F.lit(1)))


def id_from_url(url: Column, compat: bool = False) -> Column:
    """The id in a link to a paper's page or file; null if there is none. ``compat`` stops at a hyphen, as in old archive names."""
    name = r"[\w./]+" if compat else r"[\w./-]+"
    page = F.regexp_extract(url, rf"arxiv\.org/(?:abs|pdf|format)/({name})", 1)
    other = F.regexp_extract(url, r"ar5iv\.org/html/([\w.]+)", 1)
    return F.when(page != "", F.replace(page, F.lit(".pdf"), F.lit(""))).when(other != "", other)


def ids_of_line(line: Column, compat: bool = False) -> Column:
    """Ids that a line of favourites names: itself if short and plain, one from a link, or all that the text holds."""
    t = trim_all(line)
    plain = (F.octet_length(t) < 20) & ~F.contains(t, F.lit("/")) & ~F.contains(t, F.lit(":"))
    url = id_from_url(t, compat)
    return F.when(t == "", F.array().cast("array<string>")).when(plain, F.array(t)).when(url.isNotNull(), F.array(url)).otherwise(ids_in(t))


def normal_id(c: Column) -> Column:
    """An id as given on a command line: prefix, link, '.pdf' and a last '/' go, the version stays; what is unknown stays as it is."""
    t = trim_all(c)
    t = F.regexp_replace(t, r"^(?:arxiv:|ARXIV:)", "")
    linked = F.regexp_extract(t, r"arxiv\.org/(?:abs|pdf|html)/(.+)$", 1)
    bare = F.when(linked != "", linked).otherwise(t)
    return F.regexp_replace(F.regexp_replace(trim_all(bare), r"\.pdf$", ""), r"/$", "")


def valid_ids(c: Column) -> Column:
    """Whether every line that is not blank is an id of the new or the old form."""
    lines = F.filter(F.transform(F.split(c, "\n"), trim_all), lambda x: x != "")
    return F.forall(lines, lambda x: F.regexp_like(x, F.lit(r"^(?:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)$")))


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters; where some are cut, dots follow."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def short_authors(c: Column) -> Column:
    """Up to five authors as they are; of more the first three and the last two. '' for null."""
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    short = F.concat_ws(", ", F.slice(names, 1, 3), F.lit("et. al."), F.slice(names, -2, 2))
    return F.when(F.size(names) > 5, short).otherwise(F.coalesce(c, F.lit("")))


def embed_input(title: Column, abstract: Column, length: int = EMBED_LENGTH) -> Column:
    return F.substring(F.concat_ws(" ", title, abstract), 1, length)


def upper_entries(c: Column) -> Column:
    """Entries of a comma list, trimmed and in upper case, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def number_entry(c: Column) -> Column:
    """The first two digits of an entry as a number from 1 to 99; 0 if there are none."""
    return F.coalesce(F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 2).try_cast("int"), F.lit(0))


#: A formula in a text: two dollars, one dollar on a line, brackets, parentheses.
_MATH = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)"


def math_tokens(c: Column) -> Column:
    """Text and formulas in turn: array of (math, display, content). Empty texts between formulas are left out; null gives null."""
    mark = "\x01"  # no text of a page holds this sign
    parts = F.split(F.regexp_replace(c, rf"({_MATH})", f"{mark}$1{mark}"), mark, -1)

    def token(x: Column, k: Column) -> Column:
        math = k % 2 == 1
        wide = F.startswith(x, F.lit("$$")) | F.startswith(x, F.lit("\\["))
        size = F.when(F.startswith(x, F.lit("$")) & ~F.startswith(x, F.lit("$$")), 1).otherwise(2)
        inner = F.substring(x, size + 1, F.char_length(x) - 2 * size)
        return F.struct(math.alias("math"), (math & wide).alias("display"), F.when(math, inner).otherwise(x).alias("content"))

    return F.filter(F.transform(parts, token), lambda t: t["math"] | (t["content"] != ""))


def vector_of_bytes(c: Column) -> Column:
    """A vector of little-endian 32-bit floats from its bytes; null for null, or where bytes are left over."""

    @F.pandas_udf("array<float>")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return read(c)


def bytes_of_vector(c: Column) -> Column:
    """The little-endian bytes of a vector's 32-bit floats; null for null."""

    @F.pandas_udf("binary")
    def write(vector: pd.Series) -> pd.Series:
        return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(c)


def replaced_in_order(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, c)


def substituted_in_order(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda s, r: F.regexp_replace(s, r[0], r[1]), rules, c)
