"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python stage takes at once. Spark bounds its own batches by bytes; these parts of them are what becomes Python objects.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Bytes of a row group of stored tables. A task holds one whole while it writes or reads, and texts hardly shrink; Parquet's own 128 MB are too much for each core.
GROUP_BYTES = 16 << 20

_made: list[str] = []


def parts(batch, values: pa.Array, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator:
    """``batch`` (a record batch or an array as long as ``values``) in slices: as many rows as hold ``size`` bytes of ``values``, one at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(values):
        stop = max(at + 1, min(at + rows, len(values), int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what one stage freed is not there for the JVM's next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_parts(fn: Callable[..., pa.Array], rows: int = PART_ROWS) -> Callable[..., pa.Array]:
    """An Arrow function of columns, the first of them texts or bytes, run on slices of them."""

    @wraps(fn)
    def run(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return fn(*columns)
        table = pa.record_batch(list(columns), names=[str(k) for k in range(len(columns))])
        return pa.concat_arrays([fn(*part.columns) for part in parts(table, columns[0], rows)])

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hushgrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; ``drop_scratch`` removes them all."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what it took to make is not done twice, nor lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Remove the tables that operators of this process have stored; call it when their results have been used. Returns how many."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
