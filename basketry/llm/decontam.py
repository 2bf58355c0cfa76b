"""Benchmark decontamination over a positional inverted index of the training tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, materialise, prepare, table, utf8
from .textscan import LOWER, NOT_ALNUM, mix, powers, span_hashes, word_bounds

#: Bytes of item texts that one pass over the index looks for; more items take more passes.
PASS_BYTES = 16 << 20
#: Other words between two words of a window that the query's proximity matches allow.
NEAR = 2
INDEX = "block long, docs binary, words binary, terms binary, posting_bounds binary, postings binary"


def _hashes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets, NOT_ALNUM)
    return span_hashes(data, starts, ends), bounds


def _index_block(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches):
            number += 1
            words, bounds = _hashes(block.column("text"))
            order = np.argsort(words, kind="stable").astype(np.uint32)
            terms, first = np.unique(words[order], return_index=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", kind)])) as out:
                out.write_table(pa.table({"id": block.column("doc_id").cast(kind)}))
            yield pa.RecordBatch.from_pydict({"block": [number], "docs": [sink.getvalue().to_pybytes()], "words": [bounds.astype(np.int64).tobytes()], "terms": [terms.tobytes()], "posting_bounds": [np.append(first, len(order)).astype(np.uint32).tobytes()], "postings": [order.tobytes()]})

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written index of all tokens of docs: for each block of texts its sorted terms (64-bit hashes of the lower-cased
    words) and, for each term, the positions at which it stands in the block, ascending."""
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(docs.sparkSession)
    kind = to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_index_block(kind), INDEX), "postings")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Phrases:
    """The distinct windows of item words, each with the items that have it, as arrays.

    place numbers the term of every item word; a window is a stretch (start, length) of it. Once counts of the terms in
    the index are known, by_rarest() lists the windows under their rarest term, from which a search starts."""

    def __init__(self, ids: list, texts: list, window: int, gap: int, near: int = 0):
        words, bounds = _hashes(pa.chunked_array([pa.array(texts, pa.string())]))
        self.gap, self.near, self.window, self.ids = gap, near, window, ids
        n = np.diff(bounds)
        each = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        start, item = _ranges(bounds[:-1], each), np.repeat(np.arange(len(n)), each)
        length = np.minimum(n, window)[item]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(max(len(words), 1))[: len(words)], dtype=np.uint64)))
        key = mix((total[start + length] - total[start]) * powers(max(len(words), 1), "down")[start] + length.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = start[first].astype(np.int32), length[first].astype(np.int32)
        pairs = np.unique(np.stack([which, item], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
        self.items, self.item_bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.terms, place = np.unique(words, return_inverse=True)
        self.place = place.astype(np.int32)

    def places(self, w: int) -> np.ndarray:
        return self.place[self.start[w] : self.start[w] + self.length[w]]

    def by_rarest(self, counts: np.ndarray) -> None:
        """counts: how often each of terms stands in the index; windows with a term that doesn't are left out."""
        rarest = np.zeros(len(self.start), np.int32)
        occurs = np.zeros(len(self.start), bool)
        for n in np.unique(self.length):
            own = np.flatnonzero(self.length == n)
            for part in np.array_split(own, len(own) // 100_000 + 1):
                terms = self.place[self.start[part][:, None] + np.arange(n)]
                had = counts[terms]
                at = had.argmin(axis=1)
                rarest[part], occurs[part] = terms[np.arange(len(part)), at], had.min(axis=1) > 0
        there = np.flatnonzero(occurs)
        self.windows = there[np.argsort(rarest[there], kind="stable")].astype(np.int32)
        self.window_bounds = np.searchsorted(rarest[self.windows], np.arange(len(self.terms) + 1))

    def candidates(self, size: np.ndarray) -> np.ndarray:
        """Windows all of whose terms occur, by the terms' numbers of postings in a block."""
        rare = np.flatnonzero((size > 0) & (np.diff(self.window_bounds) > 0))
        found = self.windows[_ranges(self.window_bounds[rare], np.diff(self.window_bounds)[rare])]
        whole = found[self.length[found] == self.window]
        short = [w for w in found[self.length[found] != self.window] if size[self.places(w)].all()]
        terms = self.place[self.start[whole][:, None] + np.arange(self.window)]
        return np.concatenate([whole[(size[terms] > 0).all(axis=1)], np.array(short, np.int32)])


def _term_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, bounds in zip(batch.column("terms"), batch.column("posting_bounds"), strict=True):
                own, bounds = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(bounds.as_buffer(), np.uint32).astype(np.int64)
                n += _sizes(terms, own, bounds)[1]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": at.astype(np.int64), "n": n[at]})

    return run


def _sizes(wanted: np.ndarray, terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted term its place among a block's terms, and its number of postings there."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    return at, np.where(terms[at] == wanted, bounds[at + 1] - bounds[at], 0)


def _place(own: np.ndarray, wanted: np.ndarray, side: str = "left") -> np.ndarray:
    """Where wanted positions stand in a list of postings, which is searched as it is, without a wider copy."""
    return np.searchsorted(own, np.clip(wanted, 0, 0xFFFFFFFF).astype(np.uint32), side=side)


def _near(lists: list[np.ndarray], gap: int, word_bounds_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of the first term from which the others follow in order, at most gap words between two, in the same
    document, and the furthest place of the last term. From the last term on, places from which the rest can be reached
    are kept; a later one of them never ends earlier, so the last within reach counts."""
    begin = finish = lists[-1]
    for own in reversed(lists[:-1]):
        if not len(begin):
            break
        upto = np.minimum(own + 1 + gap, word_bounds_[np.searchsorted(word_bounds_, own, side="right")] - 1)
        at = np.searchsorted(begin, upto, side="right") - 1
        ok = (at >= 0) & (begin[at] > own)
        begin, finish = own[ok], finish[at[ok]]
    return begin, finish


def _around_rarest(lists: list[np.ndarray], gap: int) -> list[np.ndarray]:
    """Of each term's places those that a proximity match can use: beginning with the shortest list, a place stays while
    every other term stands as far from it as the phrase and the gaps allow, and of the others what lies near one that stays."""
    order = sorted(range(len(lists)), key=lambda o: len(lists[o]))
    o, r = order[0], lists[order[0]].astype(np.int64)
    for other in order[1:]:
        d, own = other - o, lists[other]
        low, high = (d, d * (1 + gap)) if d > 0 else (d * (1 + gap), d)
        at = _place(own, r + low)
        r = r[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= r + high) & (r + high >= 0)]
        if not len(r):
            return [r] * len(lists)
    reach = len(lists) * (1 + gap)
    out = []
    for own in lists:
        begin = _place(own, r - reach)
        out.append(own[np.unique(_ranges(begin, _place(own, r + reach, "right") - begin))].astype(np.int64))
    return out


#: Places of rarest terms that are followed at once.
FOLLOWED = 1 << 20


def _followed(p: Phrases, windows: np.ndarray, at: np.ndarray, size: np.ndarray, bounds: np.ndarray, postings: np.ndarray, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of windows of one length: (window, begin) for each place of the window's rarest term that every other term, the
    rarer first, stands as far from as the phrase and the gaps allow; begin is where the window would begin without gaps.

    The block's postings as one sorted array of (term, place) let all places of all windows be looked up together."""
    n = int(p.length[windows[0]])
    terms = p.place[p.start[windows][:, None] + np.arange(n)]
    order = np.argsort(size[terms], axis=1, kind="stable")
    keys = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds)) << np.uint64(32) | postings
    first = order[:, 0]
    rare = terms[np.arange(len(windows)), first]
    cut = np.cumsum(size[rare]) // FOLLOWED
    for part in np.unique(cut):
        own = np.flatnonzero(cut == part)
        w = np.repeat(own, size[rare[own]])
        r = postings[_ranges(bounds[at[rare[own]]], size[rare[own]])].astype(np.int64)
        for j in range(1, n):
            other = order[w, j]
            d = other - first[w]
            low, high = r + np.where(d > 0, d, d * (1 + gap)), r + np.where(d > 0, d * (1 + gap), d)
            term = at[terms[w, other]].astype(np.uint64) << np.uint64(32)
            found = np.searchsorted(keys, term | np.maximum(low, 0).astype(np.uint64))
            ok = (high >= 0) & (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= (term | np.maximum(high, 0).astype(np.uint64)))
            w, r = w[ok], r[ok]
            if not len(w):
                break
        if len(w):
            yield windows[w], r - first[w]


def _search_block(terms: np.ndarray, bounds: np.ndarray, postings: np.ndarray, word_bounds_: np.ndarray, p: Phrases, gap: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each window that occurs: its number, and where its occurrences begin and end.

    Only windows whose rarest term stands in the block are taken up, and of them those all of whose terms do; their
    lists are intersected from the rarest on, each shifted by its term's place in the window. With a gap, a word may
    stand up to gap words later than in the phrase, in order: what is left then is followed through all its places, but
    for places that known (window and begin as one number) has already."""
    at, size = _sizes(p.terms, terms, bounds)
    candidates = p.candidates(size)
    for n in np.unique(p.length[candidates]):
        for windows, begins in _followed(p, candidates[p.length[candidates] == n], at, size, bounds, postings, gap):
            if known is not None and len(known):
                key = windows.astype(np.int64) << 32 | np.maximum(begins, 0)
                fresh = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key
                windows, begins = windows[fresh], begins[fresh]
            if not len(windows):
                continue
            cut = np.append(np.flatnonzero(np.append(True, windows[1:] != windows[:-1])), len(windows))
            for i, j in zip(cut, cut[1:], strict=False):
                k, begin = int(windows[i]), begins[i:j]
                finish = begin + n - 1
                if gap:
                    lists = [postings[bounds[at[t]] : bounds[at[t] + 1]] for t in p.places(k)]
                    begin, finish = _near(_around_rarest(lists, gap), gap, word_bounds_)
                same = (begin >= 0) & (np.searchsorted(word_bounds_, begin, side="right") == np.searchsorted(word_bounds_, finish, side="right"))
                if same.any():
                    yield k, begin[same], finish[same]


def _search(p: Phrases, kind: pa.DataType, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {k: batch.column(i)[row].as_buffer() for i, k in enumerate(batch.schema.names) if k != "block"}
                ids = pa.ipc.open_stream(get["docs"]).read_all().column("id")
                words = np.frombuffer(get["words"], np.int64)
                n = len(words) - 1
                index = np.frombuffer(get["terms"], np.uint64), np.frombuffer(get["posting_bounds"], np.uint32).astype(np.int64), np.frombuffer(get["postings"], np.uint32), words
                begins, ends, keys = [], [], []
                items: dict[int, set[int]] = {}
                nearby: dict[int, set[int]] = {}

                def add(to: dict[int, set[int]], k: int, begin: np.ndarray) -> None:
                    own = p.items[p.item_bounds[k] : p.item_bounds[k + 1]].tolist()
                    for d in np.unique(np.searchsorted(words, begin, side="right") - 1).tolist():  # noqa: B023
                        to.setdefault(d, set()).update(own)

                for k, begin, finish in _search_block(*index, p, p.gap):
                    begins.append(begin)
                    ends.append(finish + 1)
                    add(items, k, begin)
                    if p.near and not p.gap:
                        keys.append(np.int64(k) << 32 | begin)
                if p.near:  # what matches exactly is near
                    nearby.update({} if p.gap else {d: set(x) for d, x in items.items()})
                    for k, begin, _ in _search_block(*index, p, p.near, np.sort(np.concatenate(keys)) if keys else None):
                        add(nearby, k, begin)
                count = lambda x: np.bincount(np.concatenate(x), minlength=int(words[-1]) + 1) if x else np.zeros(int(words[-1]) + 1, np.int64)  # noqa: B023, E731
                hit = np.flatnonzero(np.cumsum(count(begins) - count(ends))[:-1] > 0)
                per_doc = np.searchsorted(hit, words)
                spans = [[] for _ in range(n)]
                for d in items:
                    own = hit[per_doc[d] : per_doc[d + 1]] - words[d]
                    breaks = np.flatnonzero(np.diff(own) > 1)
                    spans[d] = list(zip(own[np.append(0, breaks + 1)].tolist(), (own[np.append(breaks, len(own) - 1)] + 1).tolist(), strict=True))
                found, close = ([[p.ids[i] for i in sorted(x.get(d, ()))] for d in range(n)] for x in (items, nearby))
                yield pa.RecordBatch.from_arrays(
                    [ids.combine_chunks() if ids.num_chunks != 1 else ids.chunk(0), pa.array(np.diff(words)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(id_kind)), pa.array(close, pa.list_(id_kind)), pa.array([batch.column(0)[row].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32())],
                    names=["doc_id", "n_words", "hit_spans", "item_ids", "near_ids", "block", "nth"],
                )

    return run


def search(index: DataFrame, items: DataFrame, doc_kind, window: int = 13, gap: int = 0, item_id: str = "item_id", text_col: str = "text", pass_bytes: int = PASS_BYTES, near: int = 0) -> DataFrame:
    """Documents of the index with the spans of words (start, end) inside occurrences of the items' windows, and the items.

    A window is window consecutive words of an item, or all its words if it has fewer; gap > 0 allows up to so many
    other words between two words of a window (proximity). With near > 0, near_ids are the items that match with such a
    gap, whatever gap is; else it is empty. Items come to the tasks in passes of at most pass_bytes of
    text (their words and windows are arrays of a few times that), by the size that is summed first, so that a large benchmark takes more passes over the index and no more
    memory; a pass joins the results of those before by union.
    Null and empty texts have no words; null item ids are kept; repeated items count once in each document.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_kind, kind = to_arrow_type(items.schema[item_id].dataType), to_arrow_type(doc_kind)
    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    rows = rows.withColumn("pass", F.pmod(F.xxhash64("id", "text"), F.lit(passes)))
    out = None
    listed = f"array<{items.schema[item_id].dataType.simpleString()}>"
    schema = f"doc_id {doc_kind.simpleString()}, n_words long, hit_spans array<struct<start:long,end:long>>, item_ids {listed}, near_ids {listed}, block long, nth int"
    for k in range(passes):
        own = rows.filter(F.col("pass") == k).select("id", "text").orderBy("id", "text").collect()  # about pass_bytes
        phrases = Phrases([r[0] for r in own], [r[1] for r in own], window, gap, near)
        counted = index.select("terms", "posting_bounds").mapInArrow(_term_counts(phrases.terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(phrases.terms), np.int64)
        for r in counted.collect():  # no more than the terms of a pass
            counts[r["term"]] = r["n"]
        phrases.by_rarest(counts)
        found = index.mapInArrow(_search(phrases, kind, id_kind), schema)
        out = found if out is None else out.unionByName(found)
    if passes > 1:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "item_ids", "near_ids")]  # one row of each pass
        out = out.groupBy("block", "nth", "doc_id", "n_words").agg(*joined)
        out = out.withColumns({"hit_spans": merge_spans(F.col("hit_spans")), **{c: F.array_distinct(c) for c in ("item_ids", "near_ids")}})
    return out.drop("block", "nth")


def merge_spans(spans: F.Column) -> F.Column:
    """Overlapping or touching spans made one."""
    empty = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", near: int = 0) -> DataFrame:
    """For each document its words, how many lie inside an item's window, the items, and whether a twentieth or more of the words are hit.

    With near > 0, n_near_items counts the items that have a window whose words stand in order with up to near other
    words between two; what matches exactly is among them. The verdict is that of exact matches.

    Defined for nulls (no words), empty tables (no rows, or nothing hit), repeated rows (each on its own) and long
    texts (a block of their own); other columns are not read.
    """
    found = search(build_index(docs, id_col, text_col), items, docs.schema[id_col].dataType, window, near=near)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "hit_spans", *([F.size("near_ids").cast("long").alias("n_near_items")] if near else []))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=NEAR).drop("hit_spans")
