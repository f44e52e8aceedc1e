"""Filter interaction audit (operator 13): what each filter removes in each order of application, by long-form windows.

Each document has a mask, one bit for each filter that it fails. Documents with the same part, mask and labels are one cell,
however many they are; only cells are unpivoted against the steps of all orders. A running bit-or over the steps before tells what
had already removed a cell, conditional sums over cells give the metrics of a step, and totals over a filter's steps its Shapley sum.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a stretch of other letters than blank, tab, line feed, vertical tab, form feed and return.
_SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails: A under 200 words, B under half of its words distinct, C over 2 % capitals, D any of #$%&*|."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part fail the same filters and carry the same labels.

    ``filters`` are columns of ``_text`` (null texts count as empty); bit k of the mask is the k-th of their letters and ``copies`` together, in order. ``copies``
    names the filter that fails documents whose text a smaller id has too, in whatever part. A null part is the empty string. A null id is no smaller than
    any and has no smaller one; repeated rows don't fail each other. Labels of one id count together: good if any has quality 1, toxic if any has toxic 1.
    """
    letters = sorted([*filters, copies])
    bit = {x: 1 << k for k, x in enumerate(letters)}
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    mask = sum((F.when(c, bit[x]).otherwise(0) for x, c in filters.items()), F.lit(0))
    keyed = narrow.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("sha"), mask.alias("mask"))
    # one row of each id, part and text before anything is joined: copies under a null id are one row
    rows = keyed.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # ids become strings, so that null ids, which have no label, are dealt by their texts
    own = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("sha")))
    met = rows.withColumn("own", own).join(marked.withColumn("own", F.col("of").cast("string")), "own", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    # a text's rows shrink to one for each part and labels: the smallest id, how many have it, how many have others
    parts = met.groupBy("sha", "mask", "part", *flags).agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least_row"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    smallest = F.min("least").over(Window.partitionBy("sha"))
    first = F.col("n_null") + F.when(F.col("least") == F.col("smallest"), F.col("n_least_row")).otherwise(0)
    split = parts.withColumn("smallest", smallest).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + bit[copies]).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    return split.select("part", "x.mask", "good", "toxic", "x.n").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, filter, and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for all orders of ``letters``.

    ``cells`` as ``failure_cells`` gives them, bit k of the mask being the k-th of ``letters`` as sorted. Each part has a row for each order and step, zeros included.
    """
    letters = "".join(sorted(letters))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    long = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))])
    long = long.withColumn("fails", F.col("mask").bitwiseAND(bits[F.col("filter")]))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = (F.col("fails") > 0) & (F.col("earlier") == 0), F.col("earlier") > 0
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    told = long.groupBy("part", "filter_order", "step", "filter").agg(
        counted(~gone & ~here).alias("kept"),
        counted(here).alias("removed"),
        counted((F.col("fails") > 0) & gone).alias("redundant"),
        counted((F.col("fails") > 0) & (F.col("mask") == F.col("fails"))).alias("unique_fails"),
        counted(here & F.col("good")).alias("good_lost"),
        counted(here & F.col("toxic")).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the filters of ``text_filters`` and of E, copies of a smaller id's text, over whole texts, by source.

    Null texts count as empty, null sources as the empty string; null ids, repeated rows and labels as in ``failure_cells``. Further columns are
    ignored, whatever their names. An empty table gives no row.
    """
    return audit(failure_cells(docs, labels, text_filters(F.col("_text")), "E", **columns), "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter interaction audit of all documents, by source."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Prefixes of orders as sets of letters; nothing of it is a window over steps.
OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
fails AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * len(d.t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > f.least THEN 'E' ELSE '' END) AS f
  FROM docs d JOIN firsts f ON f.t = d.t LEFT JOIN marks m ON m.doc_id = d.doc_id),
cells AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step:step] AS x, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)),
met AS (
  SELECT part, filter_order, step, x, n, good, toxic, f, contains(f, x) AS fails, len(list_intersect(string_split(before, ''), string_split(f, ''))) > 0 AND before <> '' AND f <> '' AS gone
  FROM cells, steps),
told AS (
  SELECT part, filter_order, step, x AS filter,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, x),
shares AS (SELECT part, filter, sum(removed) AS shapley FROM told GROUP BY part, filter)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM told JOIN shares USING (part, filter)
"""
