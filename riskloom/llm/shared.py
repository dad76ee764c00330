"""Work folder, materialised tables and small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed, delete, scratch_tables, shared_folder
from ..shipping import ship


def work_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; on a local master that has none, a temporary one, set once."""
    ship(spark)
    return shared_folder(spark)


#: Writes a frame as Parquet in the shared folder and reads it back: its lineage ends there, on storage that outlives an executor.
materialise = checkpointed
#: Tables that are materialised inside are deleted at its end, but for the one whose frame is given to keep().
scratch = scratch_tables


def in_few_files(df: DataFrame) -> DataFrame:
    """df with the partitions that one task after another would take put together, so that a table of many small ones is few files.

    At least sixteen tasks stay for each core, and no task gets much more than eight partitions.
    """
    spark = df.sparkSession
    return df.coalesce(max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def materialise_few(df: DataFrame, label: str = "table", codec: str | None = None) -> DataFrame:
    """materialise, in_few_files."""
    return materialise(in_few_files(df), label, codec)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: Bytes of keys that may be sent to every executor; beyond it the same join is a shuffle.
MOST_SENT = 64 << 20


def having(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows joined with a written table of keys, which is broadcast if its rows and texts, counted, are within MOST_SENT."""
    wide = F.lit(16)
    for f in keys.schema:
        wide = wide + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if f.dataType.simpleString() in ("string", "binary") else F.lit(16))
    size = keys.agg(F.sum(wide.cast("bigint"))).first()[0] or 0
    return rows.join(F.broadcast(keys) if size <= MOST_SENT else keys, on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a contiguous matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    if not len(matrix):
        return pa.array([], pa.binary())
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)]).cast(pa.binary())


def binary_slices(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values[offsets[i]:offsets[i+1]] as binary, for each i."""
    values = np.ascontiguousarray(values)
    at = np.asarray(offsets, dtype=np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)]).cast(pa.binary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: What the tokenizing operators keep in a worker: module and name.
_KEPT = (("tokenpieces", "_loaded"), ("token_counts", "_workers"), ("chunk_bpe", "_tools"))


def leave_tokenizers() -> None:
    """Gives back the memory of the tokenizers, and the pieces they know, that tasks of other operators left in this worker; they load them again."""
    kept = [d for module, name in _KEPT if (d := getattr(sys.modules.get(f"{__package__}.{module}"), name, None))]
    for d in kept:
        d.clear()
    if kept:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000):
    """Cuts a batch into runs of rows with about most_bytes of text, or one row that is longer."""
    text = batch.column(column)
    sizes = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        end = int(np.searchsorted(sizes, sizes[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), len(text))
        yield batch.slice(at, end - at)
        at = end


def runs_of(batches, columns: list[str]):
    """Tables of following rows that are equal in these columns; rows of a sorted partition give one table for each group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        own = [batch.column(c) for c in columns]
        new = np.zeros(len(batch), bool)
        for c in own:
            if c.null_count:
                values = c.to_pylist()
                new[1:] |= np.array([a != b for a, b in zip(values[1:], values, strict=False)], bool)
            else:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[0] = [c[0].as_py() for c in own] != last
        at = 0
        for k in np.flatnonzero(new).tolist():
            if k > at:
                held.append(batch.slice(at, k - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], k
        last = [c[len(batch) - 1].as_py() for c in own]
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def as_text(text: pa.Array) -> pa.Array:
    """Nulls become empty strings."""
    return text.fill_null("") if text.null_count else text


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text array without nulls, offsets from 0."""
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def texts_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts raw[starts[i]:ends[i]]."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[ragged(starts, sizes)])))


def checked(schema: str):
    """An Arrow schema from a Spark DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
