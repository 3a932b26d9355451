"""Arrow batches that are bounded in bytes, and Python workers that give freed memory back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession


def settle(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, so that very long rows don't meet in one batch."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


_LIBC: list = []


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive tasks and share the executor's memory with the JVM."""
    if not _LIBC:
        import ctypes

        try:
            _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library has no such call
            _LIBC.append(lambda pad: 0)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)


def lean(run, pieces: bool = False):
    """A function for ``mapInArrow`` that trims the worker's memory after every batch that it returns.

    ``pieces``: it returns many small ones of each batch that it reads, and memory is trimmed once a batch read. What a piece frees serves the next piece;
    given back to the system, its pages would have to be made anew for every piece.
    """

    def read(batches):
        for batch in batches:
            yield batch
            del batch
            trim()

    def trimmed(batches):
        for out in run(read(batches) if pieces else batches):
            yield out
            del out  # else it lives until the next one is made
            if not pieces:
                trim()
        trim()

    return trimmed
