"""Papers from source trees: the main file, its includes, and the choice between page and source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions.latex import latex_text
from skimmer.functions.paper_html import paper_text
from skimmer.functions.steady import SLICE_BYTES, give_back
from skimmer.sources.paper_files import register

MAIN_NAMES = ("main.tex", "paper.tex", "index.tex")
_INCLUDE = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}")


def _lines(content: Column) -> Column:
    """Lines as an editor counts them: a line end at the end begins none."""
    return F.size(F.split(F.regexp_replace(content, r"\n$", ""), "\n", -1))


def main_files(files: DataFrame) -> DataFrame:
    """(paper, path): of each paper's TeX files with a document class the one with a main name, else the longest, else none. Ties go by path."""
    name = F.element_at(F.split("path", "/"), -1)
    fit = files.where(F.endswith("path", F.lit(".tex")) & F.regexp_like("content", F.lit(r"\\document(?:class|style)")))
    rank = F.coalesce(*[F.when(name == n, k) for k, n in enumerate(MAIN_NAMES)], F.lit(len(MAIN_NAMES)))
    return fit.groupBy("paper").agg(F.min_by("path", F.struct(rank.alias("r"), (-_lines(F.col("content"))).alias("n"), F.col("path").alias("p"))).alias("path"))


def commented(line: str) -> bool:
    """Whether a percent sign that an even number of backslashes precedes stands in what comes before."""
    return any((len(m[1]) % 2) == 0 for m in re.finditer(r"(\\*)%", line))


def flattened(files: dict[str, str], main: str) -> str:
    """The main file with its includes in place, however deep: each file once, missing ones as their directive, commented directives as they are."""
    used, out = {main}, []
    open_ = [(files[main], 0, _INCLUDE.finditer(files[main]))]
    while open_:
        content, at, found = open_.pop()
        m = next(found, None)
        if m is None:
            out.append(content[at:])
            continue
        out.append(content[at : m.start()])
        open_.append((content, m.end(), found))
        line = content[content.rfind("\n", 0, m.start()) + 1 : m.start()]
        name = m[1].strip()
        path = next((p for p in (f"{name}.tex", name) if p in files), None)
        if commented(line) or path is None:
            out.append(m[0])
        elif path not in used:
            used.add(path)
            open_.append((files[path], 0, _INCLUDE.finditer(files[path])))
    return "".join(out)


def flat_sources(files: DataFrame) -> DataFrame:
    """(paper, latex): each paper's main file with its includes. A group is one paper's source tree; papers without a main file are left out."""
    trees = files.where(F.col("path").isNotNull() & F.col("content").isNotNull()).groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("path", "content"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for k in range(len(batch)):  # one tree at a time: a batch of them may be large
                own = {f["path"]: f["content"] for f in batch["files"][k].as_py()}
                made.append((batch["paper"][k].as_py(), flattened(own, batch["path"][k].as_py())))
                size += len(made[-1][1])
                if size > SLICE_BYTES or k == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], ["paper", "latex"])
                    made, size = [], 0
            give_back()

    return trees.join(main_files(files), "paper").select(F.col("paper").cast("string"), "files", "path").mapInArrow(run, "paper string, latex string")


def write_texts(texts: DataFrame, path: str, text: str = "text") -> None:
    """Texts as text files below ``path``, a form feed after each; rows without text are left out."""
    texts.where(F.col(text).isNotNull()).select(F.col(text).alias("value")).write.option("lineSep", "\f").text(path)


def write_paper_files(texts: DataFrame, path: str, extension: str = "txt") -> None:
    """A file for each (paper, text); what was at ``path`` goes when all are written."""
    register(texts.sparkSession)
    texts.select("paper", "text").write.format("paper_files").mode("overwrite").option("path", path).option("extension", extension).save()


def write_profile(profile: DataFrame, path: str, text: str = "text", name: str = "preferences") -> None:
    """A reader's profile, one row with its text, as a Markdown file."""
    write_paper_files(profile.limit(1).select(F.lit(name).alias("paper"), F.col(text).alias("text")), path, "md")


def paper_files(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    """(paper, text) of the files that ``write_paper_files`` wrote."""
    register(spark)
    return spark.read.format("paper_files").option("path", path).option("extension", extension).load()


def paper_texts(pages: DataFrame, sources: DataFrame, force_tex: bool = False, no_references: bool = True, compat: bool = False) -> DataFrame:
    """(paper, text) from (paper, html) and (paper, latex): the page if there is one, else the source; or the source first."""
    html = pages.select("paper", paper_text(F.col("html"), no_references).alias("_html"))
    tex = sources.select("paper", latex_text(F.col("latex"), no_references, compat).alias("_tex"))
    order = ("_tex", "_html") if force_tex else ("_html", "_tex")
    return html.join(tex, "paper", "full").select("paper", F.coalesce(*order).alias("text"))
