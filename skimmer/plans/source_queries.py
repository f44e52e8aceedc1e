"""Queries of sources and smaller steps: Atom entries, favourites, votes, archives, settings, entries of forms, rescoring."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import paper_html as H
from skimmer.functions import providers as P
from skimmer.functions import text as T
from skimmer.operators import clusters as C
from skimmer.operators import papers
from skimmer.operators import ranking as R
from skimmer.operators import store as S
from skimmer.plans.ranking_queries import CENTROIDS_SQL, with_vectors
from skimmer.plans.registry import query
from skimmer.sources import feeds
from skimmer.sources.tables import ARTICLES_SQL, articles, conform, dealt_articles, table, vectors
from skimmer.streaming import feedback as W

A = f"WITH {ARTICLES_SQL}"


def _pick(values: tuple, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query("""SELECT '2401.' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') AS id, 'Title ' || doc_id || ' here' AS title, 'A. One' AS author,
  CASE WHEN doc_id % 2 = 0 THEN 'cs.LG' ELSE 'stat.ML' END AS category, 'Sum ' || doc_id AS abstract FROM documents WHERE doc_id % 3 <> 2""")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every third entry leads to a file first, and is left out."""
    n = F.col("doc_id")
    number = F.concat(F.lit("2401."), F.lpad((n % 99999).cast("string"), 5, "0"))
    link = F.concat(F.lit("http://arxiv.org/"), F.when(n % 3 == 2, "pdf").otherwise("abs"), F.lit("/"), number, F.lit("v1"))
    primary = F.when(n % 2 == 0, '<arxiv:primary_category term="cs.LG"/>').otherwise("")
    entry = F.concat(F.lit('<feed><entry><link href="'), link, F.lit('"/><title>Title '), n.cast("string"), F.lit("\nhere</title><summary> Sum "), n.cast("string"), F.lit(" </summary><author><name> A. One </name></author><author><name>B</name></author>"), primary, F.lit('<category term="stat.ML"/></entry></feed>'))
    return feeds.parsed_entries(table(spark, d, "documents").select(entry.alias("content"))).select("id", "title", "author", "category", "abstract")


@query("SELECT CAST(doc_id AS VARCHAR) || 'v1' AS id FROM documents WHERE doc_id % 3 = 0")
def favourites_list(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    lines = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" https://arxiv.org/abs/"), n, F.lit("v1 "))).when(F.col("doc_id") % 3 == 1, "  ").otherwise(F.concat(F.lit("https://arxiv.org/pdf/"), n)).alias("value"))
    return feeds.favourites(lines)


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 END AS INTEGER) AS hf_upvotes, CAST(doc_id % 9 AS INTEGER) AS ax_upvotes, CAST(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 END AS INTEGER) AS ax_downvotes FROM documents""")
def votes_scrape(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    part = lambda key, value: F.concat(F.lit(f'"{key}": '), value.cast("string"), F.lit(", "))
    page = F.concat(F.lit("<script>{"), F.when(n % 2 == 0, part("upvotes", n % 50)).otherwise(""), part("upvote_count", n % 9), F.when(n % 5 != 0, part("downvote_count", n % 4)).otherwise(""), F.lit("}</script>"))
    return feeds.votes(table(spark, d, "documents").select("doc_id", page.alias("page"))).select("doc_id", "hf_upvotes", "ax_upvotes", "ax_downvotes")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, doc_id IN (SELECT page_id FROM pages) AS has_page FROM documents")
def page_available(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return feeds.with_pages(ids, table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id")))


@query("SELECT DISTINCT 'https://rss.arxiv.org/rss/' || lang AS url FROM documents WHERE lang IS NOT NULL")
def feed_urls(spark: SparkSession, d: str) -> DataFrame:
    return feeds.feed_urls_of(table(spark, d, "documents"), "lang")


def _archive(kind: int) -> bytes:
    """An archive of two files, packed or not; a single packed or plain file; an archive with an unsafe path."""
    if kind >= 2 and kind < 4:
        text = b"\\documentclass{a} alone"
        return gzip.compress(text) if kind == 2 else text
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, text in ((("../main.tex" if kind == 4 else "main.tex"), b"\\documentclass{a} \\input{part}"), ("part.tex", b"part")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    return gzip.compress(out.getvalue()) if kind == 0 else out.getvalue()


@query("""SELECT CAST(page_id AS VARCHAR) AS paper, CASE WHEN page_id % 5 < 2 THEN 2 WHEN page_id % 5 < 4 THEN 1 ELSE 0 END AS files,
  CASE WHEN page_id % 5 < 2 THEN '\\documentclass{a} part' WHEN page_id % 5 < 4 THEN '\\documentclass{a} alone' END AS latex FROM pages""")
def archive_unpack(spark: SparkSession, d: str) -> DataFrame:
    """Archives of five kinds, unpacked, and their main file with its includes."""
    raw = F.element_at(F.array(*[F.lit(_archive(k)) for k in range(5)]), (F.col("page_id") % 5 + 1).cast("int"))
    files = feeds.archive_files(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), raw.alias("content")))
    counts = files.groupBy("paper").agg(F.count("path").cast("int").alias("files"))
    return counts.join(papers.flat_sources(files), "paper", "left")


@query("SELECT CAST(page_id AS VARCHAR) AS paper, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE 'Source ' || page_id END AS text FROM pages WHERE page_id % 6 <> 5")
def paper_choice(spark: SparkSession, d: str) -> DataFrame:
    """A page for even papers, a source for those that 3 leaves no rest of two for; the page counts if there are both."""
    n = F.col("page_id")
    rows = table(spark, d, "pages").select(n.cast("string").alias("paper"), n)
    html = rows.where(n % 2 == 0).select("paper", F.concat(F.lit('<h1 class="ltx_title_document">Page '), "paper", F.lit("</h1>")).alias("html"))
    tex = rows.where(n % 3 != 2).select("paper", F.concat(F.lit("% c\nSource "), "paper").alias("latex"))
    return papers.paper_texts(html, tex)


@query("SELECT CAST(doc_id AS VARCHAR) AS paper, CASE doc_id % 3 WHEN 0 THEN 'x/paper.tex' WHEN 1 THEN 'long.tex' ELSE 'main.tex' END AS path FROM documents")
def main_file(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    doc = "\\documentclass{a}"
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    own = F.array(
        file("x/paper.tex", F.when(n % 3 == 1, "none").otherwise(doc)), file("main.tex", F.when(n % 3 == 2, doc).otherwise("none")), file("a.tex", F.lit(doc + "\n1\n")), file("long.tex", F.lit(doc + "\n1\n2\n")), file("z.tex", F.lit(doc + "\n1\n2\n")), file("notes.txt", F.lit(doc + "\n" * 9)),
    )
    rows = table(spark, d, "documents").select(n.cast("string").alias("paper"), F.explode(own).alias("f"))
    return papers.main_files(rows.select("paper", "f.path", "f.content"))


@query("SELECT string_agg(key || '=' || value, ';' ORDER BY key) AS settings FROM (SELECT event_type AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1)")
def settings_all(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    entries = F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return S.settings_map(stored).select(F.array_join(F.array_sort(entries), ";").alias("settings"))


@query("""SELECT doc_id, doc_id % 3 <> 2 AS valid, 'cs/9901001' AS bare, 'CS.AI|X' || doc_id AS entries, CAST(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 40 + doc_id % 4 END AS INTEGER) AS papers FROM documents""")
def form_entries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    typed = F.when(n % 4 == 3, "none").otherwise(F.concat(F.lit("a4"), (n % 4).cast("string"), F.lit("7")))
    return table(spark, d, "documents").select(
        "doc_id", T.valid_ids(_pick(("2401.00001\n\n cs/9901001 ", "2401.12345v2", "2401.00001\nnot an id"), n)).alias("valid"), T.without_version(F.lit("cs/9901001v12")).alias("bare"),
        F.array_join(T.upper_entries(F.concat(F.lit(" cs.ai,CS.AI ,, x"), n.cast("string"))), "|").alias("entries"), T.number_entry(typed).alias("papers"),
    )


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS BOOLEAN) AS due FROM events""")
def schedule_due(spark: SparkSession, d: str) -> DataFrame:
    """Whether the day's work is still to be done: never done, done today, done on another day."""
    last = F.when(F.col("event_id") % 3 == 1, "2024-02-15").when(F.col("event_id") % 3 == 2, "2024-02-14").cast("date")
    return table(spark, d, "events").select("event_id", W.due(last, F.lit("2024-02-15").cast("date")).alias("due"))


@query(CENTROIDS_SQL + """, top AS (SELECT * FROM articles WHERE status = 0 ORDER BY score DESC, id LIMIT 1000)
SELECT a.id, round(CASE WHEN t.id IS NOT NULL THEN s.score ELSE a.score END, 6) AS score FROM articles a LEFT JOIN top t ON a.id = t.id LEFT JOIN scored s ON a.id = s.id""")
def rescore_unread(spark: SparkSession, d: str) -> DataFrame:
    """New scores for the best unread rows by old score; the others keep theirs."""
    rows = articles(spark, d)
    centroids = C.weighted_means(dealt_articles(spark, d), vectors(spark, d))
    top = R.best(with_vectors(spark, d).where("status = 0")).select("id", "vector", "score")
    new = R.score_all(top, centroids).select("id", "score")
    return S.merge(rows, new, ["score"]).select("id", F.round("score", 6).alias("score"))


@query(CENTROIDS_SQL + """SELECT type, CAST(label AS INTEGER) AS cluster_id, round(centroid[1], 6) AS first FROM centroids WHERE type = 'negative'
UNION ALL SELECT 'positive', CAST(label AS INTEGER), round(centroid[1], 6) FROM centroids WHERE type = 'negative'""")
def replace_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Stored: the means of either type; new positive ones, which have the negative ones' places; no new negative ones."""
    stored = C.weighted_means(dealt_articles(spark, d), vectors(spark, d)).select("type", F.col("label").cast("int").alias("cluster_id"), F.col("centroid").cast("array<float>").alias("centroid"))
    new = stored.where("type = 'negative'").withColumn("type", F.lit("positive"))
    kept = C.replace_centroids(C.replace_centroids(stored, "positive", new), "negative", None)
    return kept.select("type", "cluster_id", F.round(F.col("centroid")[0].cast("double"), 6).alias("first"))


@query(A + "SELECT id, category, 0 AS status_, CAST(0 AS DOUBLE) AS score, comment IS NULL AS empty FROM (SELECT *, NULL AS comment FROM articles)")
def conform_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older form take the full schema: what is missing is null, status and score start at 0."""
    older = articles(spark, d).select("id", "title", "link", "source", "category")
    return conform(older).select("id", "category", F.col("status").alias("status_"), "score", F.col("comment").isNull().alias("empty"))


@query("SELECT page_id, 'x $a^2$ y' AS text, 'One|p ' || page_id || '|two' AS parts FROM pages")
def html_math_sections(spark: SparkSession, d: str) -> DataFrame:
    math = F.lit('x <math id="1"><mi>a</mi><annotation encoding="application/x-tex"> a^2 </annotation></math> y')
    page = F.concat(F.lit("<section class='s'><h2>One</h2><p>p "), F.col("page_id").cast("string"), F.lit("</p><p> </p><section><p>two</p></section>lost</section>"))
    return table(spark, d, "pages").select("page_id", H.math_to_latex(math).alias("text"), F.array_join(H.sections(page), "|").alias("parts"))


@query()
def embed_with_provider(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each text, cut as embeddings are asked for, from the stand-in for a model; texts without words have none."""
    rows = table(spark, d, "documents").select("doc_id", T.embed_input(F.lit(None).cast("string"), F.col("text")).alias("text"))
    return P.embedded(rows, P.hashed_embedding(), "doc_id")


@query(A + "SELECT 'articles' AS name, (SELECT count(*) FROM articles) AS before, CAST(0 AS BIGINT) AS after UNION ALL SELECT 'settings', (SELECT count(DISTINCT event_type) FROM events), 0")
def clear_all(spark: SparkSession, d: str) -> DataFrame:
    """Counts of articles and settings before and after all rows go."""
    rows, settings = articles(spark, d), table(spark, d, "events").select("event_type").where("event_type IS NOT NULL").distinct()
    tagged = lambda name, df, when: df.select(F.lit(name).alias("name"), F.lit(when).alias("at"))
    every = [tagged(n, df, k) for k, pair in enumerate(((rows, settings), S.cleared(rows, settings))) for n, df in zip(("articles", "settings"), pair)]
    both = every[0].union(every[1]).union(every[2]).union(every[3])
    return both.groupBy("name").agg(F.count_if(F.col("at") == 0).alias("before"), F.count_if(F.col("at") == 1).alias("after"))
