"""Answers of an outside service, kept by what was asked, so that the same is not asked again within an hour."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions.providers import Answer, attempted

SCHEMA = "signature string, answer string, asked_at timestamp"


class AnswerCache:
    """A table of answers at ``path``, by the md5 of the text that was asked; an answer counts for ``minutes`` minutes."""

    def __init__(self, spark: SparkSession, path: str, minutes: int = 60):
        self.spark, self.path, self.minutes = spark, path.rstrip("/"), minutes

    def known(self, as_of: str) -> DataFrame:
        """(signature, answer) that count at ``as_of``: of several the newest. Failures are not kept as answers."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return self.spark.createDataFrame([], "signature string, answer string")
        now = F.lit(as_of).cast("timestamp")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/*").where(F.col("answer").isNotNull() & (F.col("asked_at") <= now) & (F.col("asked_at") > now - F.make_interval(mins=F.lit(self.minutes))))
        return rows.groupBy("signature").agg(F.max_by("answer", "asked_at").alias("answer"))

    def answered(self, rows: DataFrame, provider: Answer, as_of: str, key: str = "id", text: str = "text", cut: int = 6000, size: int = 20) -> DataFrame:
        """(key, signature, answer, cached) for each (key, text): the first ``cut`` letters are asked; equal ones once, known ones not at all. Null where the call fails.

        Only misses reach ``provider``, ``size`` at a time, in tasks; what it says is written as a run of its own before anything is given out, so reading the result asks nobody.
        A null text is asked as an empty one.
        """
        asked = F.substring(F.coalesce(F.col(text), F.lit("")), 1, cut)
        signed = rows.select(key, F.md5(asked).alias("signature"), asked.alias("asked"))
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        known = self.known(as_of)
        misses = signed.groupBy("signature").agg(F.any_value("asked").alias("asked")).join(known, "signature", "left_anti")
        attempted(misses, provider, "signature", "asked", size).select("signature", "answer", F.lit(as_of).cast("timestamp").alias("asked_at")).write.parquet(run)
        new = self.spark.read.schema(SCHEMA).parquet(run).select("signature", "answer", F.lit(False).alias("cached"))
        told = new.unionByName(known.join(new, "signature", "left_anti").withColumn("cached", F.lit(True)))
        return signed.select(key, "signature").join(told, "signature", "left").select(key, "signature", "answer", "cached")
