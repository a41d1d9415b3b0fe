"""What the corpus operators share: column access, shared storage, Arrow batches.

Rules that hold for every operator of this subpackage:

* Only the named columns of an input are used; other columns may have any
  name, also the name of one of the operator's own results (the result wins).
* A null text is the empty text.
* A row whose id is null cannot be addressed and takes no part.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir``,
  which driver and executors share, so a lost executor costs a reread only.
  They are deleted when nothing reads them any more, at the latest when the
  application ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.operators import storage
from strandsift.operators.storage import forget, new_path  # noqa: F401
from strandsift.shipping import ship

#: Rows of an Arrow batch handed to Python; texts of a few kB make batches of a few MB.
BATCH_ROWS = 1000


def field(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def tuned(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, so that very long texts fit a Python worker, and sends the code to the executors."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of the rows that have an id; null texts are empty."""
    return docs.select(
        field(id_col).cast("long").alias("doc_id"),
        F.coalesce(field(text_col).cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: Python operators take any table, whatever its columns are called."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def materialised(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; the enclosing scratch block deletes it, if there is one."""
    back = storage.materialised(df, name, codec)
    if _made:
        _made[-1].append(back)
    return back


#: The tables of the scratch blocks that are open, innermost last.
_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised in the block go at its end, but for those passed to the function that it yields."""
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._strandsift_path)
        if len(_made) > 1:
            _made[-2].append(df)
        return df

    _made.append(made)
    try:
        yield keep
    finally:
        _made.pop()
        for df in made:
            if df._strandsift_path not in kept:
                forget(df)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: allocators keep it for the process, and a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, so that freed memory does not stay with the worker: over a pipeline's stages it would add up."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the task before held to its very end
        yield from run(it)
        give_back()

    return whole


def sliced(batches: Iterator[pa.RecordBatch], text_col: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column takes about ``max_bytes`` at most (one row at least)."""
    for b in batches:
        n, at = b.num_rows, 0
        if not n:
            continue
        size = b.column(b.schema.get_field_index(text_col)).nbytes
        step = max(1, int(n * max_bytes / max(size, 1)))
        while at < n:
            yield b.slice(at, step)
            at += step
