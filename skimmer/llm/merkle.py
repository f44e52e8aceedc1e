"""Document fingerprints (operator 3): a Merkle tree over spans, paragraphs and sections, in column expressions only.

Leaves are spans of up to four words, whose digests make up a paragraph's (a line of the text), paragraphs make up
sections, and sections the root. A section ends after a paragraph whose digest begins with 0 or 1, so an edit
moves no other border. The fingerprint writes the tree out, root first:

    root;section{paragraph=leaf.leaf paragraph=leaf};section{...}

Equal roots mean equal texts; where roots differ, sections, paragraphs and leaves tell where.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = r"\s*+(?:\S++\s*+){1,4}+|\s++"
_SECTION_END = r"(?<![0-9a-f=.])([01][0-9a-f]{15}=[0-9a-f.]*) "
#: Buckets of ids, at most, and rows of a bucket, about, where that allows it. Bounds are quantiles, exact to a tenth of the smallest bucket.
BUCKETS, BUCKET_ROWS = 10_000, 2048


def fingerprint(text: Column) -> Column:
    """The tree of ``text`` as a string; a null text counts as empty."""
    short = lambda x, n: F.substring(F.sha2(x, 256), 1, n)

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(SPAN), F.lit(0)), lambda x: F.sha2(x, 256))
        return F.transform(F.array(leaves), lambda own: F.concat(short(F.array_join(own, ""), 16), F.lit("="), F.array_join(F.transform(own, lambda d: F.substring(d, 1, 8)), ".")))[0]

    lines = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph), " ")
    sections = F.transform(F.split(F.regexp_replace(lines, _SECTION_END, "$1;"), ";", -1), lambda s: F.concat(short(s, 16), F.lit("{"), s, F.lit("}")))
    body = F.array_join(sections, ";")
    return F.transform(F.array(body), lambda b: F.concat(F.sha2(b, 256), F.lit(";"), b))[0]


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def sections(print_: Column) -> Column:
    """Digests of the sections, in order."""
    return F.regexp_extract_all(print_, F.lit(r"([0-9a-f]{16})\{"), F.lit(1))


def paragraphs(print_: Column) -> Column:
    """Digests of the paragraphs, in order."""
    return F.regexp_extract_all(print_, F.lit(r"([0-9a-f]{16})="), F.lit(1))


def leaves(print_: Column) -> Column:
    """Digests of the leaves, in order."""
    return F.regexp_extract_all(print_, F.lit(r"(?<=[=.])[0-9a-f]{8}"), F.lit(0))


def changed_paragraphs(before: Column, after: Column) -> Column:
    """Places (from 0) of the paragraphs of ``after`` that ``before`` has nowhere; empty if the roots are equal. See ``edits`` for what moved or went."""
    old = paragraphs(before)
    numbered = F.transform(paragraphs(after), lambda p, k: F.struct(k.alias("at"), p.alias("digest")))
    new = F.array_except(paragraphs(after), old)
    places = F.transform(F.filter(numbered, lambda x: F.array_contains(new, x["digest"])), lambda x: x["at"])
    return F.when(root(before) == root(after), F.array().cast("array<int>")).otherwise(places)


def _in_common(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    n = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(other > 0, other - 1).otherwise(n).cast("int")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def edits(before: Column, after: Column) -> Column:
    """Where two trees differ, from the root down: a struct of

    first (place, from 0, of the first paragraph that differs), before and after (how many paragraphs from there on are not alike at
    the end either), deleted and inserted (digests of paragraphs of that stretch which only one tree has in it), moved (those
    which both have). Null if the roots are equal. Branches of equal digest are not entered.
    """
    own = lambda p: F.regexp_extract_all(p, F.lit(r"[0-9a-f]{16}\{([^}]*)\}"), F.lit(1))

    def walked(s: Column) -> Column:
        lead = _in_common(s["sa"], s["sb"])
        rest = lambda x: F.flatten(F.transform(F.slice(x, lead + 1, F.greatest(F.size(x) - lead, F.lit(0))), paragraphs_of))
        inside = F.struct(F.size(F.flatten(F.transform(F.slice(s["ba"], F.lit(1), lead), paragraphs_of))).alias("at"), rest(s["ba"]).alias("a"), rest(s["bb"]).alias("b"))
        return _with(inside, stretch)

    def stretch(s: Column) -> Column:
        front = _in_common(s["a"], s["b"])
        cut = lambda x: F.slice(x, front + 1, F.greatest(F.size(x) - front, F.lit(0)))
        return _with(F.struct((s["at"] + front).alias("at"), cut(s["a"]).alias("a"), cut(s["b"]).alias("b")), ended)

    def ended(s: Column) -> Column:
        back = _in_common(F.reverse(s["a"]), F.reverse(s["b"]))
        cut = lambda x: F.slice(x, F.lit(1), F.size(x) - back)
        told = lambda t: F.struct(t["at"].alias("first"), F.size(t["a"]).alias("before"), F.size(t["b"]).alias("after"), F.array_except(t["a"], t["b"]).alias("deleted"), F.array_except(t["b"], t["a"]).alias("inserted"), F.array_intersect(t["a"], t["b"]).alias("moved"))
        return _with(F.struct(s["at"].alias("at"), cut(s["a"]).alias("a"), cut(s["b"]).alias("b")), told)

    paragraphs_of = lambda body: F.regexp_extract_all(body, F.lit(r"([0-9a-f]{16})="), F.lit(1))
    trees = F.struct(sections(before).alias("sa"), sections(after).alias("sb"), own(before).alias("ba"), own(after).alias("bb"))
    return F.when(root(before) != root(after), _with(trees, walked))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of different leaves that two trees have in common (Dice); null if either is null."""
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        F.transform(
            F.array(F.struct(F.array_distinct(leaves(a)).alias("x"), F.array_distinct(leaves(b)).alias("y"))),
            lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.lit(1), F.size(s["x"]) + F.size(s["y"])),
        )[0]
    )


def _quantiles(docs: DataFrame, id_column: str, k: int) -> list[int]:
    """Bounds that deal the ids into about ``k`` buckets of about as many rows: at most k - 1 different ones, in order."""
    if k < 2:
        return []
    shares = F.split(F.lit(",".join(str(i / k) for i in range(1, k))), ",").cast("array<double>")  # a constant
    found = docs.agg(F.percentile_approx(F.col(id_column).cast("long"), shares, max(10_000, 10 * k))).first()[0]
    return sorted(set(found or []))


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most ``id_``: the bounds stand in rows of an array, so that few of them are looked at."""
    if not bounds:
        return F.when(id_.isNotNull(), F.lit(0))
    wide = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    numbers = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")  # noqa: E731  constants, worked out once
    table = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";"), lambda r: F.split(r, ",").cast("array<bigint>"))
    row = F.size(F.filter(numbers([r[0] for r in rows]), lambda x: x <= id_))
    return F.when(id_.isNull(), F.lit(None)).when(row == 0, F.lit(0)).otherwise((row - 1) * wide + F.size(F.filter(F.element_at(table, F.greatest(row, F.lit(1))), lambda x: x <= id_))).cast("int")


def with_next(docs: DataFrame, id_column: str, columns: list[str], bucket_rows: int = BUCKET_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (``id_column`` and ``columns``) with next_<column> of the row with the next id; after the last comes the first.

    Null ids come first, and rows with the same id follow each other in order of their columns. Ids are dealt into buckets
    by their quantiles, so that single ids far from the others make no bucket large; the first rows of a bucket are lent to the bucket before it.
    There are at most ``buckets`` of them, which bounds the broadcast table of their first ids.
    """
    k = max(1, min(buckets, -(-docs.count() // bucket_rows)))
    bucket = F.coalesce(_bucket(F.col(id_column), _quantiles(docs, id_column, k)), F.lit(-1))
    firsts = docs.select(F.col(id_column).alias("_id"), bucket.alias("_bucket")).groupBy("_bucket").agg(F.min("_id").alias("_id"))
    in_order = Window.orderBy("_bucket")  # at most `buckets` + 1 rows
    lent = firsts.select("_id", F.coalesce(F.lag("_bucket").over(in_order), F.max("_bucket").over(Window.partitionBy())).alias("_lend"))
    here = docs.select(id_column, *columns).withColumn("_bucket", bucket).join(F.broadcast(lent), F.col(id_column).eqNullSafe(F.col("_id")), "left").drop("_id")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("lent"))
    guest = F.struct(F.col("_lend").alias("b"), F.lit(1).alias("lent"))
    here = here.withColumn("_at", F.explode(F.when(F.col("_lend").isNull(), F.array(own)).otherwise(F.array(own, guest)))).drop("_bucket", "_lend")
    following = Window.partitionBy("_at.b").orderBy("_at.lent", F.col(id_column).asc_nulls_first(), *columns)
    return here.select(id_column, *columns, *[F.lead(c).over(following).alias(f"next_{c}") for c in columns], F.col("_at.lent").alias("_lent")).where("_lent = 0").drop("_lent")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points, rounded down, replaced by the first as many of ``following``."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def op3_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", ["text", "fingerprint"])
    changed = near.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("_edited"), "fingerprint", "next_fingerprint")
    marked = changed.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    marked = marked.withColumn("_where", edits(F.col("fingerprint"), F.col("edited_fingerprint")))
    return marked.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("_where.first").alias("first_changed"), F.col("_where.before").alias("n_before"), F.col("_where.after").alias("n_after"), *(F.size(f"_where.{c}").alias(f"n_{c}") for c in ("deleted", "inserted", "moved")),
    )
