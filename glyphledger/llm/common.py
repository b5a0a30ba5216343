"""What the corpus operators share: scratch tables, raw text buffers, row identity.

Scratch.  Tables that cut lineage lie in the shared folder.  Inside a
``scratch`` block they go at its end; outside of one they stay, as the lazy
result that a caller holds reads them.

Row identity.  A row of a document table is known by its id and the XXH64 of
its text.  Rows equal in both are repeats of one document; operators that keep
or drop rows keep at most one of them.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Characters deleted or split at as white space: blank and \t \n \v \f \r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_ROOT = str(Path(__file__).resolve().parents[2])
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scope: ContextVar[list[str] | None] = ContextVar("scratch tables of the innermost block", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers; bounds Arrow batches where the user has set no bound."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    if spark.conf.get(_ROWS, None) in (None, "10000"):  # the default
        spark.conf.set(_ROWS, "2000")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes with the innermost scratch block."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _scope.get()
    if own is not None:
        own.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Scratch tables made inside the block are deleted at its end; what is derived from them must be written by then."""
    own: list[str] = []
    outer = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in own:
            delete(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds row_key, the XXH64 of the text (null as empty)."""
    return df.withColumn("row_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def shielded(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with its text named "text" and all other columns c0, c1, ..., which no operator uses, and these names in order."""
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (id, row_key) is in kept, repeats of a row once, columns as in docs.

    Repeats of a row (null ids count as one id) become one row per task before
    anything moves, so a row that is a third of all is no hot key; then both
    sides meet by id and key, and the texts are shuffled one time.
    """
    known = lambda c: F.coalesce(c.cast("string"), F.lit("no id"))
    mark = kept.select(known(F.col(id_col)).alias("__id"), F.col("row_key").alias("__key")).distinct()
    plain, names = shielded(docs, text_col)
    keyed = plain.select(known(F.col(names[docs.columns.index(id_col)])).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"), *names)
    once = keyed.dropDuplicates(["__id", "__key"])
    return once.join(mark, ["__id", "__key"], "left_semi").select(*names).toDF(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int):
    """Ranges (first, last) of rows of about limit bytes each; a longer row is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
