"""Shared helpers of the text operators: tables, folds, flat text buffers, row maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.sources.tables import OWNER, materialize, new_path

# Bytes of text that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 2 << 20
# Rows of whole texts that Spark hands to Python at once: its 10,000 would be held by both sides of every task.
TEXT_ROWS = 1000
# Tables of up to so many rows of two numbers may be broadcast (some 10 MB).
BROADCAST_ROWS = 200_000
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns of these names, upper and lower case alike.

    Operators that append columns call this first: a column of the input that has the
    name of an output column is replaced by it.
    """
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one buffer, and each text's start (one more at the end).

    A null text counts as an empty one.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, so that memory stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def store(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """A stage table whose shuffle files are deleted as soon as it is written.

    Nothing reads them again: the table is in the shared folder, packed by zstd. ``rows``
    go to a Python function at once (None: as the session has it). The settings are changed
    for the write alone.
    """
    conf = df.sparkSession.conf
    settings = _WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {name: conf.get(name) for name in settings}
    # A run's table stays with the run, which may read it again.
    path = new_path(df.sparkSession, label) if OWNER.get() is None else None
    for name, value in settings.items():
        conf.set(name, value)
    try:
        out = materialize(df, label, path)
    finally:
        for name, value in before.items():
            conf.set(name, value)
    out._stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that no later step and no result reads.

    Tables of a ``StageRun`` and those that ``store`` did not make stay.
    """
    for df in tables:
        path = vars(df).get("_stage_path")
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame) -> DataFrame:
    """A stored table of two or three numbers a row; broadcast if its row count is bounded."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def append_columns(
    df: DataFrame,
    column: str,
    fields: Sequence[T.StructField],
    compute: Callable[[pa.Array], Sequence[pa.Array]],
) -> DataFrame:
    """All columns of ``df`` and those that ``compute`` makes from slices of one text column.

    ``compute`` gets a string array and returns an array for each field.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            for part in steps(batch, column):
                added = compute(part.column(column))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *added], [*part.schema.names, *[f.name for f in fields]]
                )

    return kept.mapInArrow(run, schema)
