"""Feeds and lists that were fetched to files: RSS items, Atom entries, favourites, vote pages, and archives of sources."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import text as T
from skimmer.functions.steady import give_back
from skimmer.operators.store import first_by

FEED_URL = "https://rss.arxiv.org/rss/"


def feed_urls(categories: list[str]) -> list[str]:
    return [FEED_URL + c for c in categories]


def feed_urls_of(rows: DataFrame, category: str) -> DataFrame:
    """(url): the feed of each different category."""
    return rows.where(F.col(category).isNotNull()).select(F.concat(F.lit(FEED_URL), F.col(category)).alias("url")).distinct()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_items(spark: SparkSession, path: str, mark: str = "<item>") -> DataFrame:
    """(path, block, item_no, item): what follows each mark in each file, up to the next, as ``items`` of the whole file gives; but a file is read item by item,
    in as many tasks as it has blocks. ``item_no`` counts within a block; blocks are known by where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = n = None
        for batch in batches:
            files = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            begins = [k for k, own in enumerate(files) if own != (files[k - 1] if k else file)]
            for a, b in zip([0, *begins], [*begins, len(files)]):
                if a == b:
                    continue
                if files[a] != file:
                    file, n = files[a], 0
                    a += file[1] == 0  # what stands before a file's first mark is no item
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(range(n, n + b - a), pa.int64()), part.column(2)], ["path", "block", "item_no", "item"])
                n += b - a
            give_back()

    rows = spark.read.text(path, lineSep=mark).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("item"))
    return rows.mapInArrow(run, "path string, block long, item_no long, item string")


def items(content: Column, mark: str = "<item>") -> Column:
    """What follows each mark, up to the next."""
    parts = F.split(content, mark, -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def parsed_items(feeds: DataFrame, content: str = "content", compat: bool = False) -> DataFrame:
    """Rows of articles from RSS texts; items without title or link, and replacements, are left out. Other columns of ``feeds`` are kept."""
    rows = feeds.select(*[c for c in feeds.columns if c != content], F.posexplode(items(F.col(content))).alias("item_no", "_item"))
    return articles_of_items(rows, "_item", compat)


def articles_of_items(rows: DataFrame, item: str = "item", compat: bool = False) -> DataFrame:
    """Rows of articles from single items of RSS texts; those without title or link, and replacements, are left out. Other columns of ``rows`` are kept."""
    kept, item = [c for c in rows.columns if c != item], F.col(item)
    title, link = T.trim_all(T.first_tag(item, "title")), T.trim_all(T.first_tag(item, "link"))
    rows = rows.where((title != "") & (link != "") & T.announced(T.tag_or_null(item, "arxiv:announce_type")))
    description = T.first_tag(item, "description")
    return rows.select(
        *kept, T.id_from_link(link, compat).alias("id"), title.alias("title"), link.alias("link"),
        T.abstract_of(description).alias("abstract"), F.lit("arxiv").alias("source"), F.nullif(T.trim_all(T.first_tag(item, "dc:creator")), F.lit("")).alias("author"), T.all_tags(item, "category").alias("category"),
    )


def parsed_entries(feeds: DataFrame, content: str = "content") -> DataFrame:
    """Rows of articles from Atom texts. An entry counts if its first link leads to an abstract page."""
    rows = feeds.select("*", F.posexplode(items(F.col(content), "<entry>")).alias("item_no", "_item"))
    item = F.col("_item")
    link = F.regexp_extract(item, r'href="([^"]*)"', 1)
    primary = F.regexp_extract(item, r'<arxiv:primary_category[^>]*term="([^"]*)"', 1)
    other = F.regexp_extract(item, r'<category[^>]*term="([^"]*)"', 1)
    rows = rows.where(F.contains(link, F.lit("/abs/")) & ~F.contains(link, F.lit("pdf")))
    return rows.select(
        *[c for c in feeds.columns if c != content], "item_no", T.id_from_link(link).alias("id"), F.translate(T.trim_all(T.first_tag(item, "title")), "\n", " ").alias("title"), link.alias("link"),
        F.substring(T.trim_all(T.first_tag(item, "summary")), 1, T.ABSTRACT_LENGTH).alias("abstract"), F.lit("arxiv").alias("source"), T.nested_tag(item, "author", "name").alias("author"), F.coalesce(F.nullif(primary, F.lit("")), other).alias("category"),
    )


def first_of_each(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each id, the first in the order in which feeds and items came."""
    return first_by(rows, ["id"], *[F.col(c) for c in order])


def read_xml_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items by Spark's XML reader: real parsing, with an explicit schema. Spaces at the ends of a text stay."""
    schema = "title string, link string, description string, category array<string>, `arxiv:announce_type` string, `dc:creator` string"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "item").option("ignoreSurroundingSpaces", False).load(path)
    fit = rows.where(F.col("title").isNotNull() & F.col("link").isNotNull() & T.announced(F.col("`arxiv:announce_type`"), absent_counts=False))
    return fit.select(T.versioned_id_from_link(F.col("link")).alias("id"), "title", "link", T.abstract_after(F.col("description")).alias("abstract"), F.lit("arxiv").alias("source"), F.array_join("category", ", ").alias("category"))


def favourites(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id) of a list of links, one on a line, with '/abs/' in them."""
    own = T.trim_all(F.col(column))
    return lines.where((own != "") & F.contains(own, F.lit("/abs/"))).select(F.element_at(F.split(own, "/abs/"), -1).alias("id"))


def votes(pages: DataFrame, page: str = "page") -> DataFrame:
    """Counters that a vote page's data names; null where it names none."""
    number = lambda key: F.regexp_extract(F.col(page), rf'"{key}"\s*:\s*([0-9]+)', 1).try_cast("int")
    return pages.withColumns({"hf_upvotes": number("upvotes"), "ax_upvotes": number("upvote_count"), "ax_downvotes": number("downvote_count")})


def with_pages(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """``ids`` with has_page: whether a page of the paper is there."""
    return ids.join(pages.select("id", F.lit(True).alias("_there")).distinct(), "id", "left").withColumn("has_page", F.coalesce("_there", F.lit(False))).drop("_there")


def safe_path(path: str) -> bool:
    return not path.startswith("/") and ".." not in path


def unpacked(raw: bytes) -> list[tuple[str, str]]:
    """(path, content) of an archive: a packed or plain tar, else one file, packed or not. One unsafe path rejects the whole."""
    try:
        data = gzip.decompress(raw) or raw
    except (OSError, EOFError, zlib.error):
        data = raw
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
            members = [m for m in tar.getmembers() if m.isfile()]
            if not all(safe_path(m.name) for m in members):
                raise ValueError("unsafe path in archive")
            return [(m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in members]
    except tarfile.ReadError:
        return [("main.tex", data.decode("utf-8", "replace"))]


def archive_files(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(paper, path, content, problem) of each file of each archive; a rejected archive has one row with its problem. ``archives`` as the binaryFile source gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for paper, raw in zip(df["paper"], df["raw"]):
                try:
                    files, problem = unpacked(bytes(raw or b"")), None
                except ValueError as e:
                    files, problem = [(None, None)], str(e)
                yield pd.DataFrame({"paper": paper, "path": [f[0] for f in files], "content": [f[1] for f in files], "problem": problem}, dtype=object)

    narrow = archives.select(F.col(key).cast("string").alias("paper"), F.col(content).alias("raw"))
    return narrow.mapInPandas(run, "paper string, path string, content string, problem string")
