"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one numpy pass handles at a time; keeps a worker's arrays near 100 MB.
SLICE_BYTES = 1 << 19
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder of the cluster (`spark.checkpoint.dir`). A temporary one is set only where none is and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back; `discard` deletes it again.

    What the write has shuffled goes at its end, as nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(conf).delete(path, True)


def whole_text(col: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_hash(col: str = "text") -> Column:
    """With doc_id it names a row, so that rows that repeat a doc_id stay apart; equal rows are interchangeable."""
    return F.xxhash64(whole_text(col))


def packed(docs: DataFrame) -> DataFrame:
    """(row, id, th): whole rows as one column, so that no column of theirs can clash in a join; select("row.*") gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_hash().alias("th"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without a copy; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, at, data = column.buffers()
    n, first = len(column), column.offset
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, kind)[first : first + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes together; a longer document stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every (start, length), one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts.astype(np.int64), lengths)


_ARGMIN_ROWS = 1 << 22


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of values[i : i + width] for every full window; values are below 2**40."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n > _ARGMIN_ROWS + width - 1:  # positions inside a part fit the low 24 bits
        return np.concatenate([sliding_argmin(values[a : a + _ARGMIN_ROWS + width - 1], width) + a for a in range(0, n - width + 1, _ARGMIN_ROWS)])
    packed = (values.astype(np.uint64) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = packed
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)
