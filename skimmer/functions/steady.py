"""Python workers of steady memory: a batch as Arrow hands it over is looked at about a megabyte at a time, and what comes of that goes on at once.

A batch holds up to 10,000 rows or 64 MB, whichever comes first; as Python strings a text may weigh four times its bytes, and what is made of it as much again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a worker looks at together, about; a longer text is looked at alone.
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library keeps its own house
        return lambda _: 0


def give_back() -> None:
    """Hands memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch | pa.Array, texts: pa.Array | None = None, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """``batch`` in parts of about ``size`` bytes of ``texts`` (its own, if it is an array)."""
    n = len(batch)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch if texts is None else texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(ends // size) > 0) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n]):
        yield batch.slice(a, b - a)
    give_back()


def text_udf(work: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function of text columns that applies ``work`` to each text; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.string())
            for part in slices(batch):
                yield pa.array([None if t is None else work(t) for t in part.to_pylist()], pa.string())

    return run
