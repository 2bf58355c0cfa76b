"""Connected components: each task replaces its links by a forest, few links are finished by one task, many by
alternating large and small stars; links stay distributed, each round is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Links that one task finishes, and that a task holds at once (about 100 bytes each while they are joined).
TASK_LINKS = 1_000_000
#: Rounds of stars; their number grows with the logarithm of the longest path, so this is never met but for a fault.
ROUNDS = 100


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of these links, and for each the least id that links reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        if not apart.any():
            return ids, ids[label]
        a, b = a[apart], b[apart]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from each id to a smaller one, that join what the task's links join: none twice, none in a cycle.

    At most TASK_LINKS are held beside those of a batch; what is still more after joining goes out as it is."""
    held, n = [np.zeros((2, 0), np.int64)], 0

    def joined() -> np.ndarray:
        both = np.concatenate(held, axis=1)
        ids, least = least_reached(both[0], both[1])
        own = ids != least
        return np.stack([ids[own], least[own]])

    def rows(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"u": links[0], "v": links[1]})

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]))
        n += batch.num_rows
        if n >= TASK_LINKS:
            links = joined()
            if links.shape[1] > TASK_LINKS // 2:
                yield rows(links)
                links = links[:, :0]
            held, n = [links], links.shape[1]
    if n:
        yield rows(joined())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, task_links: int = TASK_LINKS, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) to (id, component): every id that has a link to another, and the least id of its component.

    Each task first replaces its links by a forest with the same components. As long as there are more than task_links
    links, rounds of large and small stars replace them by links to smaller ids: their number never grows, the least
    neighbour is joined to the links, which lets a node with very many be split over tasks, and the rounds end when
    nothing changes (they raise if that takes more than rounds). As soon as there are no more than task_links, one task
    of bounded memory joins them. Either way gives the same components. No links give no rows.
    """
    pairs = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u != v")
    edges = materialise(pairs.mapInArrow(_forest, "u long, v long"), "links")
    before = _state(edges)
    for _ in range(rounds):
        if before[0] <= task_links:
            edges = materialise(edges.coalesce(1).mapInArrow(_forest, "u long, v long"), "links")
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u != v").distinct()
        joined = large.join(_least(large), "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("id"), "component").distinct())
