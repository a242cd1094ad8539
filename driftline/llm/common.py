"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_BATCH = 4 << 20  # characters handled together inside a task


ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of about 8 MB instead of 64: memory per task, results unchanged."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns, whatever their names, stay out of the way."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def tidy() -> None:
    """Give freed memory back to the system: a worker process lives on, and would hold it beside what the next step needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_batches(batches: Iterator[pa.RecordBatch], *columns: str, most: int = TEXT_BATCH) -> Iterator[list[list]]:
    """Columns as Python lists (the text last), cut so that one step never holds much more than ``most`` characters
    beyond a single long text."""
    try:
        for batch in batches:
            size, begin = 0, 0
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(columns[-1])), 0).to_pylist()
            for i, n in enumerate(lengths):
                size += n
                if size >= most or i + 1 == len(lengths):
                    cut = batch.slice(begin, i + 1 - begin)
                    yield [cut.column(c).to_pylist() for c in columns]
                    size, begin = 0, i + 1
    finally:
        tidy()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)],
                                      schema=schema)
