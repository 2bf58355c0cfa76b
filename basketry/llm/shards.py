"""Sharding by sampled splitters: near-equal bytes in each shard, whatever the skew of sizes and keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise, prepare

#: Bytes of text that a range should have at scale (its rows have a few dozen bytes each), and the most ranges the
#: driver keeps bounds of.
RANGE_BYTES, MAX_RANGES = 64 << 20, 100_000


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="right").astype("int32"))

    return place


def _draw(rows: DataFrame, rate: float, salt: int) -> np.ndarray:
    """Keys of rows drawn with a chance in proportion to their size, by a hash, so that a task run again draws the same."""
    u = F.expr(f"(xxhash64(key, doc_id, {salt}) & 1073741823) / 1073741824.0D")
    drawn = rows.filter(u < F.col("size") * F.lit(rate)).select("key").toArrow().column("key")  # 8 bytes each
    return np.sort(drawn.to_numpy())


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    if parts < 2 or not len(sample):
        return sample[:0]
    return np.unique(sample[(np.arange(1, parts) * len(sample)) // parts])


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, per_range: int = 32, rounds: int = 4) -> DataFrame:
    """Assigns each row of docs to one of n_shards shards of near-equal bytes.

    Rows are ordered by a key whose upper 40 bits come from the text's hash, the next 12 from the id's and the last 12
    from the row's number as it was written: equal texts stand together, and yet a text, or a row, that makes up a
    third of all rows can be cut. A size-weighted sample of keys (per_range
    for each range, a bound that doesn't grow with the rows) gives quantiles as splitters; ranges are measured over
    all rows, and overfull ones are sampled and split again. Running sums within ranges, on top of the sums of the
    ranges before, then cut the order into shards: no shard differs from the mean by more than about one text.

    Null texts count as empty; null ids and repeated rows are placed like any other; an empty table gives no rows.
    Returns doc_id, size, text_crc32, shard, slot. Columns of docs other than id and text are not read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "size", "text_crc32", F.expr("(h & -16777216L) | (xxhash64(doc_id) & 16773120L) | (xxhash64(row) & 4095L)").alias("key"))
    rows = materialise(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = int(min(MAX_RANGES, max(8 * n_shards, total // RANGE_BYTES)))
    splitters = _quantiles(_draw(rows, parts * per_range / max(total, 1), 0), parts)
    measured: list = []
    for k in range(1, rounds + 1):
        ranged = rows.withColumn("range", _range_of(splitters)("key"))
        measured = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()
        over = [r for r in measured if r["bytes"] > 2 * total / parts and r["lo"] < r["hi"]]
        if not over or k == rounds:
            break
        rate = 4 * parts * per_range / total  # finer than at first, only over what is overfull
        sample = _draw(ranged.filter(F.col("range").isin([r["range"] for r in over])), rate, k)
        more = [_quantiles(sample[np.searchsorted(sample, r["lo"]) : np.searchsorted(sample, r["hi"], "right")], int(r["bytes"] * parts // total) + 1) for r in over]
        grown = np.unique(np.concatenate([splitters, *more]))
        if len(grown) == len(splitters):
            break
        splitters = grown
    bytes_before, rows_before, before = 0, 0, []
    for r in measured:
        before.append((r["range"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["bytes"], rows_before + r["n"]
    offsets = docs.sparkSession.createDataFrame(before, "range int, bytes_before long, rows_before long")
    w = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("range", _range_of(splitters)("key")).withColumns({"upto": F.sum("size").over(w), "nth": F.count("*").over(w)})
    placed = placed.join(F.broadcast(offsets), "range")  # at most MAX_RANGES and the ranges split once more
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(total, 1)))).cast("int"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("rank")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def query(spark, sf_dir):
    from .runtime import table

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
