"""A training corpus in four stages: toxic documents go, one of each group of near copies stays, sources are mixed to
target weights, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimmer.llm.jaccard import jaccard_classes
from skimmer.llm.mixing import mix, word_count
from skimmer.llm.packing import best_fit_packing
from skimmer.llm.shared import done_with, written
from skimmer.llm.toxicity import score_toxicity


#: In every stage the caller's row is one value, so that no column of it meets the stage's own, whatever their names.
ROW = "_doc"


def _held(docs: DataFrame, **own: Column) -> DataFrame:
    """Each row of ``docs`` as one value, and the columns ``own`` made of it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW), *[c.alias(name) for name, c in own.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text scores below one half; the model learns from the labelled rows that are not held out.

    Null and empty texts score as texts without any mark, and so stay unless nearly all labelled rows are toxic; repeated rows share their fate. An
    empty table gives an empty one; further columns are kept as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(_held(docs, doc_id=F.col("doc_id"), text=F.col("text")), labels).where("predicted = 0").select(f"{ROW}.*")


def _met(rows: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``settled`` on ``keys``, nulls equal, dealt by _place, a hash of the keys: what follows by _place needs no other shuffle of the texts."""
    small = settled.select(F.xxhash64(*keys).alias("_place"), F.struct(*keys).alias("_settled"), *[c for c in settled.columns if c not in keys])
    return rows.withColumn("_place", F.xxhash64(*keys)).join(small, "_place").where(F.array_contains(F.array("_settled"), F.struct(*keys)))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id (a null id is the smallest); of repeated rows, which agree in id and text, one.

    Documents without words, null texts among them, are no copies of each other: all of them with different ids stay. An empty table gives an empty one. Further
    columns are kept as they are, whatever their names.
    """
    own = {"_id": F.col("doc_id"), "_sha": F.sha2("text", 256)}
    classes = written(jaccard_classes(docs.select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"), own["_sha"].alias("_sha"))), "classes")
    first = classes.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("_row", "_sha")).alias("x")).select("x._row", "x._sha")
    kept = first.union(classes.where("class_key IS NULL").select("_row", "_sha")).distinct().withColumnRenamed("_row", "_id")
    both = _met(_held(docs, **own), kept, [*own])
    turn = F.row_number().over(Window.partitionBy("_place", "_settled").orderBy(f"{ROW}.lang", f"{ROW}.source"))
    return both.withColumn("_turn", turn).where("_turn = 1").select(f"{ROW}.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go.

    The mix is settled over ids, sources and sizes alone; the texts move once, to meet what was settled for them. Rows
    that agree in all three share their copies as evenly as can be. Null sources are a source of their own; texts without words, null ones
    among them, have size 0, are never taken, and go. An empty table gives an empty one. Further columns are kept as they are, whatever their names.
    """
    own = {"_id": F.col("doc_id"), "_source": F.col("source"), "_size": word_count()}
    narrow = written(docs.select(*[c.alias(n) for n, c in own.items()]), "sized")
    settled = mix(narrow).groupBy(*own).agg(F.sum("_copies").alias("_total"), F.count("*").alias("_rows")).where("_total > 0")
    both = _met(_held(docs, **own), settled, [*own])
    turn = F.row_number().over(Window.partitionBy("_place", "_settled").orderBy(f"{ROW}.text")) - 1
    copies = F.floor(F.col("_total") / F.col("_rows")) + F.when(turn < F.col("_total") % F.col("_rows"), 1).otherwise(0)
    taken = both.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(f"{ROW}.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences. A null or empty text is one piece, its end id; repeated rows are packed each; an empty table gives no piece. Further columns are left out."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: A model, MinHash classes and a packing plan are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        done_with(*made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
