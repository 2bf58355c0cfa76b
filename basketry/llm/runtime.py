"""What the operators of this subpackage share: reading tables, written intermediate tables, Arrow blocks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker holds at once, about; one text may be longer than this.
BLOCK_BYTES = 4 << 20
#: Rows of an Arrow batch: long texts make large batches, so fewer than Spark's own 10,000.
BATCH_ROWS = 1_000

_written: dict[int, list[str]] = {}
_path_of: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the size of Arrow batches by rows; long texts are common here. Spark bounds their bytes itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='basketry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(id(spark), []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[id(out)] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the table that materialise() returned as df, once nothing that is still to run reads it."""
    path = _path_of.pop(id(df))
    _written[id(df.sparkSession)].remove(path)
    _delete(df.sparkSession, path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by number, and the new name of each: no name of the caller's clashes with an operator's."""
    names = {c: f"_{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    The cleaner follows the driver's garbage collector, which may not run for half an hour; an operator with several
    written steps calls this between them, so that only one step's shuffle files stand on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_materialised(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Deletes the tables that materialise() has written, but for the one it returned as keep; for callers whose other
    results are all stored or gone."""
    kept = _path_of.get(id(keep))
    paths = [p for p in _written.pop(id(spark), []) if p != kept]
    for path in paths:
        _delete(spark, path)
    if kept:
        _written[id(spark)] = [kept]
    return len(paths)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroups batches so that each block has about limit bytes in its text column (a single longer text stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1]) - before
            at = upto
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def utf8(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each text's start (one more for the end). Null: empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # without chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
