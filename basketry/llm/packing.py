"""Packing token pieces into sequences: best fit first, then swaps that raise the squared fill until bins are empty."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise, prepare, table

Bin = tuple[int, ...]  # lengths, longest first
_encoders: dict[str, object] = {}
#: Distinct chunks of text whose ids a worker remembers (a cache: what it forgets is encoded again).
CACHE_CHUNKS = 400_000


def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE over a vocabulary file of ranks; ids as the tokenizers library gives for the same vocabulary with
    encode_special_tokens on, so that a special token's name in a text is text."""
    import tiktoken

    if ranks_path not in _encoders:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


class ChunkedEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The pattern lets a piece begin with one space but has none inside, so a text without two spaces in a row can be
    cut before each space: the chunks' ids, one after another, are the text's ids. Words come again and again, so
    most chunks are found in a dictionary. Texts with two spaces in a row are encoded as one.
    """

    def __init__(self, ranks_path: str, pattern: str):
        self.encode = encoder(ranks_path, pattern).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _bytes(self, chunk: str) -> bytes:
        return np.array(self.encode(chunk), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "  " in text:
            return self._bytes(text)
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        head, *rest = text.split(" ")
        for word in set(rest).difference(known):
            known[word] = self._bytes(" " + word)
        return self._bytes(head) + b"".join(map(known.__getitem__, rest))


def _pieces(ranks_path: str, pattern: str, capacity: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkedEncoder(ranks_path, pattern)
        block, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            docs, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + tail
                n = len(ids) // 4
                at, upto = 0, (n - 1) % capacity + 1  # the first piece takes the remainder
                k = 0
                while at < n:
                    docs.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * upto]))
                    nth.append(seen[upto - at])
                    seen[upto - at] += 1
                    k, at, upto = k + 1, upto, upto + capacity
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([block] * len(docs), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    return run


def _fill(free: int, left: dict[int, int], lengths: list[int]) -> list[int]:
    """Best fit: again and again the longest length that is left and fits."""
    out: list[int] = []
    for length in lengths:
        while length <= free and left.get(length, 0) > out.count(length):
            out.append(length)
            free -= length
    return out


def best_fit(counts: dict[int, int], capacity: int) -> dict[Bin, int]:
    """Bins as lengths and how often each is used, filled from the longest length on."""
    left = {k: v for k, v in counts.items() if v}
    bins: dict[Bin, int] = {}
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        found = tuple([first, *_fill(capacity - first, left, lengths)])
        left[first] += 1
        times = min(left[k] // found.count(k) for k in set(found))
        for k in set(found):
            left[k] -= times * found.count(k)
            if not left[k]:
                del left[k]
        bins[found] = bins.get(found, 0) + times
    return bins


def _without(b: Bin, *out: int) -> list[int]:
    rest = list(b)
    for x in out:
        rest.remove(x)
    return rest


def _trade(a: Bin, b: Bin, capacity: int) -> tuple[Bin, Bin] | None:
    """The move, one-for-one or two-for-one exchange between two bins that raises their squared fill most, if one does."""
    fa, fb = sum(a), sum(b)
    best, found = fa * fa + fb * fb, None

    def offer(give: tuple[int, ...], take: tuple[int, ...]) -> None:
        nonlocal best, found
        d = sum(give) - sum(take)
        x, y = fa - d, fb + d
        if 0 <= x <= capacity and 0 <= y <= capacity and x * x + y * y > best:
            best, found = x * x + y * y, (give, take)

    sa, sb = sorted(set(a)), sorted(set(b))
    for x in sa:
        offer((x,), ())
        for y in sb:
            offer((x,), (y,))
    for y in sb:
        offer((), (y,))
    for one, two, flip in ((sa, b, False), (sb, a, True)):
        pairs = {(two[i], two[j]) for i in range(len(two)) for j in range(i + 1, len(two))}
        for x in one:
            for pair in pairs:
                offer(*((pair, (x,)) if flip else ((x,), pair)))
    if found is None:
        return None
    give, take = found
    return tuple(sorted([*_without(a, *give), *take], reverse=True)), tuple(sorted([*_without(b, *take), *give], reverse=True))


def local_search(bins: dict[Bin, int], capacity: int) -> dict[Bin, int]:
    """Trades between underfull bins until none raises the squared fill; equal bins trade all at once.

    The sum of squares is bounded and rises by at least one with each trade, so it ends. After the first sweep only
    pairs with a bin that has come up since are tried.
    """
    bins = dict(bins)
    fresh = set(bins)
    while fresh:
        under = sorted((b for b in bins if sum(b) < capacity), key=lambda b: (sum(b), b))
        new = [b in fresh for b in under]
        places = [i for i, x in enumerate(new) if x]
        fresh = set()
        for i, a in enumerate(under):
            for j in range(i, len(under)) if new[i] else places[bisect_left(places, i) :]:
                b = under[j]
                if bins.get(a, 0) < 1 + (a == b) or not bins.get(b, 0):
                    continue
                traded = _trade(a, b, capacity)
                if traded is None:
                    continue
                times = bins[a] // 2 if a == b else min(bins[a], bins[b])
                for old in (a, b):
                    bins[old] -= times
                for made in traded:
                    if made:
                        bins[made] = bins.get(made, 0) + times
                        fresh.add(made)
                for old in (a, b):
                    if not bins.get(old, 1):
                        del bins[old]
    return bins


def _slots(bins: dict[Bin, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length, the sequences and offsets that its pieces take in order: keys (length and first rank), and for each key the first sequence and the offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for b, times in sorted(bins.items(), reverse=True):
        offset = 0
        for length in b:
            first = used.get(length, 0)
            rows.append(((length << 48) + first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each document's ids (and end_id) into pieces of at most capacity and packs all pieces into few sequences.

    Only documents longer than capacity are cut; their first piece takes the remainder. Pieces of one length are
    alike, so the driver packs their counts (at most capacity numbers, however many rows): best fit, then swaps. Which
    piece takes which slot follows from its rank among its length: rank in its block of rows, written with the piece,
    plus the count of the blocks before. A length that a third of all rows share is no hot group that way.

    A null text is empty and has the end id alone; null ids and repeated rows are packed like others; an empty table
    gives no rows; other columns are not read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(ranks_path, pattern, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long")
    pieces = materialise(pieces, "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    keys, sequences, offsets = _slots(local_search(best_fit(totals, capacity), capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("before")), ["length", "block"])

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        want = (length.to_numpy() << 48) + rank.to_numpy()
        at = np.searchsorted(keys, want, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + want - keys[at], "offset": offsets[at]})

    placed = ranked.withColumn("slot", slot("length", F.col("nth") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def query(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
