"""The article store on disk, laid out by buckets of the id, so that a batch of changes rewrites the buckets that it touches and no others.

A bucket is a partition folder of a Parquet table. A change by key reads the buckets of its keys, and a change by condition the buckets that hold such
rows; what they become replaces them by dynamic partition overwrite, at the end of the job and bucket by bucket. So a failed job leaves every bucket as
it was or as it should be, and running the same change again ends the same. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimmer.operators.store import last_by, merge, new_rows
from skimmer.sources.tables import ARTICLE, SKIPPED, UNREAD

BUCKET = "bucket"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _dealt_by_less(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned within take rows as they are dealt, if that is by some of the join's keys."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


class BucketedStore:
    """A table at ``path`` with the columns of ``schema``, one row for each ``key``, in ``buckets`` folders.

    Take so many buckets that one fits a task: rewriting one is a task's work. All methods that change the table return the numbers of the buckets
    that they wrote, at most ``buckets`` integers. A null key is a key like others and has a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, schema: T.StructType = ARTICLE, key: str = "id"):
        self.spark, self.path, self.buckets, self.schema, self.key = spark, path, buckets, schema, key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _all(self) -> DataFrame:
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema])
        return self.spark.read.schema(plain.add(BUCKET, T.IntegerType())).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def _put(self, rows: DataFrame, mode: str, together: bool = False) -> None:
        """Writes rows to their buckets; rows of a bucket come together, so that each is one file. ``together``: they do already, in ``rows`` with their bucket."""
        out = rows.select(*self.schema.fieldNames(), BUCKET) if together else rows.select(*self.schema.fieldNames(), self._bucket()).repartition(BUCKET)
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes the table anew; it must not be there yet."""
        self._put(rows, "error")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def _holding(self, condition: Column) -> list[int]:
        return sorted(r[0] for r in self._all().where(condition).select(BUCKET).distinct().collect())

    def rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets ``touched`` by what ``change`` makes of their rows, of which it must keep some in each bucket, and their keys."""
        if touched:
            self._put(change(self._all().where(F.col(BUCKET).isin(touched)).drop(BUCKET)), "overwrite")
        return touched

    def _drop(self, bucket: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def insert(self, incoming: DataFrame, order: str) -> list[int]:
        """Adds the rows whose keys are not there, the first of each key in ``order``: new files in their buckets, the others stay. Of the table only keys are read."""
        stored = self._all().where(F.col(BUCKET).isin(self._touched(incoming))).select(self.key)
        fresh = new_rows(incoming, stored, order, self.key)
        touched = self._touched(fresh)
        if touched:
            self._put(fresh, "append")
        return touched

    def update(self, changes: DataFrame, columns: list[str], order: str | None = None) -> list[int]:
        """Sets ``columns`` by key, nulls included; of several changes of a key the last in ``order`` counts. Unknown keys change nothing."""
        if order is not None:
            changes = last_by(changes.select(self.key, *columns, order), [self.key], F.col(order))
        touched = self._touched(changes)
        if touched:
            # both sides are dealt by the bucket, which the key decides: what is merged lies as it is written, and the rows move once
            rows = self._all().where(F.col(BUCKET).isin(touched)).repartition(BUCKET)
            new = changes.select(self.key, *columns, self._bucket()).repartition(BUCKET)
            with _dealt_by_less(self.spark):
                self._put(merge(rows, new, columns, self.key, BUCKET), "overwrite", together=True)
        return touched

    def update_where(self, condition: Column, values: dict[str, Column]) -> list[int]:
        """Sets columns of the rows for which ``condition`` holds; buckets without any stay as they are."""
        return self._rewrite_in_place(self._holding(condition), lambda rows: rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))

    def _rewrite_in_place(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """As ``rewrite`` for a change of single rows that leaves keys alone: rows stay in the tasks that read them. A bucket in several pieces may be as many files again."""
        if touched:
            self._put(change(self._all().where(F.col(BUCKET).isin(touched))), "overwrite", together=True)
        return touched

    def delete_where(self, condition: Column) -> list[int]:
        """Removes the rows for which ``condition`` holds; where it is null they stay. A bucket from which all rows go loses its folder."""
        touched, stay = self._holding(condition), ~F.coalesce(condition, F.lit(False))
        left = [r[0] for r in self._all().where(F.col(BUCKET).isin(touched) & stay).select(BUCKET).distinct().collect()]
        self.rewrite(sorted(left), lambda rows: rows.where(stay))
        for k in set(touched) - set(left):
            self._drop(k)
        return touched

    def mark_all_read(self) -> list[int]:
        return self.update_where(F.col("status") == UNREAD, {"status": F.lit(SKIPPED)})

    def retain(self, as_of: str, days: int = 30, column: str = "timestamp") -> list[int]:
        """Removes rows older than ``days`` days at ``as_of``."""
        return self.delete_where(F.col(column) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
