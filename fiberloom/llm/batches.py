"""How many rows go to a Python worker at once, and what it keeps afterwards."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts: some megabytes of text at the usual lengths, where Spark's own limit would gather tens of them.
TEXT_ROWS = 1000
#: Bytes of one: where rows are long, a batch ends before it has TEXT_ROWS of them.
TEXT_BYTES = 8 << 20
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's limits to TEXT_ROWS and TEXT_BYTES if they are higher or unset."""
    conf = df.sparkSession.conf
    for name, most in ((ROWS, TEXT_ROWS), (BYTES, TEXT_BYTES)):
        now = int(conf.get(name, str(most + 1)).rstrip("b"))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def give_back() -> None:
    """Return what a worker has freed to the system: workers are used again, and what one operator leaves adds to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` over Arrow batches, giving memory back when it ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
