"""What several operators need: the shared scratch folder, and steady memory in Python workers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker looks at together, about; a longer text is looked at alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session does not say: texts of a few thousand letters make a few megabytes.
BATCH_ROWS, _DEFAULT_ROWS = 1000, "10000"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine without that setting, a temporary one.

    A cluster that names none raises: its executors would not see a folder of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="skimmer-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/skimmer-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later stages read it, also after executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` from which nothing more will be read: what is made of them has itself been written."""
    for table in tables:
        _delete(table.sparkSession, table.scratch)
        _made.remove(table.scratch)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session sets their size itself: both sides of a Python worker hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == _DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch | pa.Array, texts: pa.Array | None = None, size: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Array]:
    """``batch`` in parts of about ``size`` bytes of ``texts`` (its own, if it is an array) and at most ``rows`` rows; then what they held is given back."""
    n = len(batch)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch if texts is None else texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero((np.diff(ends // size) > 0) | (np.diff(np.arange(n) // rows) > 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n]):
        yield batch.slice(a, b - a)
    give_back()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library keeps its own house
        return lambda _: 0


def give_back() -> None:
    """Hands memory that is free back to the system, so that an idle worker weighs what it holds."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


class Kept(dict):
    """A worker's memory of what it has worked out, of ``budget`` bytes: longer keys than ``longest`` are not kept, and beyond the budget it starts afresh."""

    def __init__(self, budget: int, longest: int = 256):
        super().__init__()
        self.budget, self.longest, self.weight = budget, longest, 0

    def keep(self, key, value, weight: int) -> None:
        """``weight``: the bytes of the value; a key and its place weigh some 200 besides."""
        if len(key) > self.longest:
            return
        self.weight += weight + len(key) + 200
        if self.weight > self.budget:
            self.clear()
            self.weight = weight + len(key) + 200
        self[key] = value

    def keep_all(self, found: dict) -> None:
        """Keeps values that are bytes together, as far as the budget holds them all."""
        short = found if max(map(len, found), default=0) <= self.longest else {k: v for k, v in found.items() if len(k) <= self.longest}
        weight = sum(map(len, short)) + sum(map(len, short.values())) + 200 * len(short)
        if self.weight + weight > self.budget:
            self.clear()
            self.weight = 0
        if weight <= self.budget:
            self.update(short)
            self.weight += weight


_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _clear() -> None:
    """Removes this application's scratch tables while its JVM still lives."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        for path in _made:
            _delete(spark, path)
    except Exception:  # the gateway is already gone
        return
