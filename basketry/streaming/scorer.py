"""Scoring a stream of baskets: stateless, so the batch operators serve each row."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names that share a bucket of the model's literal, on average.
BUCKET = 4


def label_scores(baskets: DataFrame, coefficients: dict[str, dict[str, float]], intercepts: dict[str, float], temperature: float = 1.0, parents: dict[str, str] | None = None, parent_weight: float = 0.0) -> DataFrame:
    """baskets(id, items) with a map of label shares, from literals alone; works on streams and batches alike. Parents
    that aren't there themselves count with parent_weight.

    The model is the size of its lexicon and travels in the plan; each row is scored without a shuffle. An item is looked
    up once for all labels, in a bucket of a few names, and every step of a row is worked out once."""
    names = sorted(intercepts)
    known = sorted({i for label in names for i in coefficients.get(label, {})})
    table = _Table({i: F.array(*(F.lit(float(coefficients.get(label, {}).get(i, 0.0))) for label in names)) for i in known}, F.array(F.lit(0.0)))
    start = F.array(*(F.lit(float(intercepts[label])) for label in names))
    up = _Table({i: F.lit(parent) for i, parent in (parents or {}).items()}, F.lit(""))

    def scored(own):
        total = _folded(own, table, start, 1.0)
        if parents and parent_weight > 0:
            above = F.array_sort(F.array_except(F.array_compact(F.array_distinct(F.transform(own, up.find))), own))
            total = _folded(above, table, total, parent_weight)
        return _once(F.transform(total, lambda x: x / temperature), softmax)

    def softmax(z):
        return _once(F.array_max(z), lambda top: _once(F.transform(z, lambda x: F.exp(x - top)), shared))

    def shared(e):
        whole = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return _once(whole, lambda w: F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(e, lambda x: x / w)))

    return baskets.select("id", _once(F.array_sort(F.array_distinct("items")), scored).alias("shares"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class _Table:
    """A dict of names as a literal of buckets by checksum, because a map is searched from its front."""

    def __init__(self, values: dict[str, Column], kind: Column):
        size = max(1, len(values) // BUCKET)
        buckets: list[list[Column]] = [[] for _ in range(size)]
        for name in sorted(values):
            buckets[zlib.crc32(name.encode()) % size] += [F.lit(name), values[name]]
        nothing = F.map_from_arrays(F.slice(F.array(F.lit("")), 1, 0), F.slice(F.array(kind), 1, 0))
        self.buckets, self.size = F.array(*(F.create_map(*b) if b else nothing for b in buckets)), size

    def find(self, name: Column) -> Column:
        return F.try_element_at(F.get(self.buckets, (F.crc32(name.cast("binary")) % self.size).cast("int")), name)


def _folded(items, table: _Table, start, value: float):
    return F.aggregate(items, start, lambda acc, i: _once(table.find(i), lambda w: F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda a, x: a + value * x))))


def score_stream(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, score: Callable[[DataFrame], DataFrame]):
    """Starts a query that hands each scored micro-batch to sink(frame, batch number)."""
    return score(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Item counts by event-time window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
