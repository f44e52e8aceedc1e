"""Profile updates from a feedback stream: each over the feedback of 30 days, none lost when a service fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.operators.store import last_by
from skimmer.sources.tables import CLICKED, DISLIKED, LIKED

Update = Callable[[DataFrame, DataFrame, int], None]


class ProfileLedger:
    """Keeps the feedback of a stream below ``path`` and which of its batches are still to be told to ``update``.

    ``update(window, batch, k)`` gets the latest rated status of each article within ``days`` days before the newest row of batch k, and that batch's rows;
    what it writes goes under k, for it is asked again if it raises, or if its success could not be noted. Both frames depend on batch k and those before it alone,
    so an update that comes late sees what it would have seen. Feedback is kept by day, of which a window reads the days it needs; the ledger
    is one empty file for each batch that is open, so it is as long as what has failed.
    """

    def __init__(self, spark: SparkSession, path: str, update: Update, days: int = 30, key: str = "article"):
        self.spark, self.path, self.update, self.days, self.key = spark, path.rstrip("/"), update, days, key

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def sink(self, batch: DataFrame, k: int) -> None:
        """For ``foreachBatch``: notes the batch's feedback (rows with a status other than 0) and tries all that is open. A batch that comes again writes over itself."""
        feedback = batch.where("status <> 0").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        if feedback.isEmpty():
            return
        feedback.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/feedback/batch={k}")
        fs, marker = self._file(f"open/{k}")
        fs.create(marker, True).close()
        self.settle()

    def open(self) -> list[int]:
        """The batches whose update has not succeeded yet, oldest first."""
        fs, folder = self._file("open")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def batch(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/feedback/batch={k}").drop("day")

    def window(self, k: int) -> DataFrame:
        newest = self.batch(k).agg(F.max("ts")).first()[0]
        since = F.lit(newest) - F.make_interval(days=F.lit(self.days))
        rows = self.spark.read.option("basePath", f"{self.path}/feedback").parquet(f"{self.path}/feedback").where(F.col("batch") <= k)
        rows = rows.where((F.col("day").cast("string") >= F.date_format(since, "yyyy-MM-dd")) & (F.col("ts") > since) & (F.col("ts") <= F.lit(newest)))
        latest = last_by(rows.select(self.key, "status", "ts", "event_id"), [self.key], F.col("ts"), F.col("event_id"))
        return latest.where(F.col("status").isin(CLICKED, LIKED, DISLIKED))

    def settle(self) -> list[int]:
        """Asks for every open batch, oldest first; gives those that stay open. What a scheduler calls between batches."""
        for k in self.open():
            try:
                self.update(self.window(k), self.batch(k), k)
            except Exception as e:  # stays in the ledger and is asked again
                print(f"profile update of batch {k} failed: {e}")
                continue
            fs, marker = self._file(f"open/{k}")
            fs.delete(marker, False)
        return self.open()
