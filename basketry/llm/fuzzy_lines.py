"""Fuzzy line dedup: minhash bands over character shingles, exact confirmation, distributed union of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import connect, sketch
from .runtime import blocks, discard, materialise, numbered, partitions, prepare, release, table, utf8
from .textscan import _BASE, LOWER, mix, per_text_unique, span_hashes

_U = np.uint64
#: Characters of a shingle, and the similarity of linked lines in percent.
SHINGLE, PERCENT = 7, 80
#: Bands and minwise tokens of each. Lines at the threshold share a band with a chance of 0.995, at 0.9 of 0.99997.
BANDS, TOKENS_OF_BAND = 10, 4
_MASKS = (mix(np.arange(1001, 1001 + BANDS * TOKENS_OF_BAND, dtype=_U)) >> _U(32)).astype(np.uint32)
#: Lines with one key in a block beyond which only the least is sent to meet other blocks' and the rest go around.
LOCAL_KEYS = 64
#: Bytes of text that are scanned at once: arrays that stay in a core's cache and needn't be mapped anew.
SCAN_BYTES = 1 << 20
_LAST_ID = (1 << 63) - 1
#: Bytes with A-Z in lower case and the white space within a line as a space.
_NORMAL = LOWER.copy()
_NORMAL[[9, 11, 12, 13]] = 32


def normal(line: str) -> str:
    """A-Z lower-cased, white space made one space, none at the ends."""
    return normal_bytes(line).decode("utf-8")


def normal_bytes(line: str) -> bytes:
    """normal() in UTF-8; bytes know ASCII white space and letters alone."""
    return b" ".join(line.encode("utf-8").split()).lower()


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)


class Lines:
    """The lines with a word of a block of texts, normalised: code points, bounds, text and line numbers, hashes."""

    def __init__(self, texts: pa.ChunkedArray):
        data, offsets = utf8(texts)
        data, offsets = self._single_spaces(_NORMAL[data], offsets)
        newlines = np.flatnonzero(data == 10)
        starts, ends = np.sort(np.concatenate([offsets[:-1], newlines + 1])), np.sort(np.concatenate([newlines, offsets[1:]]))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.number = np.searchsorted(newlines, starts) - np.searchsorted(newlines, offsets[self.text])
        self.hash = span_hashes(data, starts, ends)
        self.points = _points(data.tobytes())
        if len(self.points) < len(data):  # bytes to characters
            inner = np.flatnonzero((data & 0xC0) == 0x80)
            starts, ends = starts - np.searchsorted(inner, starts), ends - np.searchsorted(inner, ends)
        self.starts, self.ends = starts, ends

    @staticmethod
    def _single_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the spaces at a line's ends, and with one of each run within."""
        at = np.flatnonzero(data == 32)
        if not len(at):
            return data, offsets
        edge = np.zeros(len(data) + 1, bool)  # where a line begins; the byte before one is its predecessor's end
        edge[offsets] = True
        edge[1:] |= data == 10
        first = np.append(True, (at[1:] != at[:-1] + 1) | edge[at[1:]])
        begin = np.flatnonzero(first)
        finish = np.append(begin[1:], len(at)) - 1
        after = at[finish] + 1
        outer = edge[at[begin]] | edge[after] | (data[np.minimum(after, len(data) - 1)] == 10)
        drop = at[~first | np.repeat(outer, finish - begin + 1)]
        return np.delete(data, drop), offsets - np.searchsorted(drop, offsets)

    def shingles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the chosen lines and their bounds; a line shorter than a shingle has one, of the whole."""
        return shingle_hashes(self.points, self.starts[chosen], self.ends[chosen])


def shingle_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the characters' runs of SHINGLE that begin in each line, or of the whole line if it is shorter."""
    sizes = ends - starts
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    padded = np.zeros(len(points) + SHINGLE, _U)
    padded[: len(points)] = points
    padded += _U(1)
    acc = padded[: len(points)].copy()
    for j in range(1, SHINGLE):
        acc *= _U(_BASE)
        acc += padded[j : j + len(points)]
    out = mix(acc[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], counts)])
    for k in np.flatnonzero(sizes < SHINGLE):
        value = 0
        for c in points[starts[k] : ends[k]].tolist():
            value = (value * _BASE + c + 1) % (1 << 64)
        out[bounds[k]] = mix(np.array([value ^ int(sizes[k])], _U))[0]
    return out, bounds


def _all_shingles(members: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of normalised lines (UTF-8) and their bounds, all at once."""
    texts = [m.decode("utf-8") for m in members]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return shingle_hashes(points, np.concatenate(([0], ends[:-1])).astype(np.int64), ends)


def line_sets(members: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of normalised lines (UTF-8)."""
    if not members:
        return []
    values, bounds = per_text_unique(*_all_shingles(members))
    return [values[bounds[i] : bounds[i + 1]] for i in range(len(members))]


def _scan(n: int):
    """Of each block where its lines stand (bucket -1), and for each bucket the band keys of its distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("around", pa.bool_()), *((c, pa.binary()) for c in ("keys", "reps", "ids", "ties", "nth"))])
        for block in blocks(batches, limit=SCAN_BYTES):
            lines = Lines(block.column("text"))
            if not len(lines.hash):
                continue
            reps, chosen = np.unique(lines.hash, return_index=True)
            ids, ties = (block.column(c).to_numpy() for c in ("id", "tie"))
            yield pa.RecordBatch.from_pylist([{"bucket": -1, "reps": lines.hash.tobytes(), "ids": ids[lines.text].astype(np.int64).tobytes(), "ties": ties[lines.text].tobytes(), "nth": lines.number.astype(np.int32).tobytes()}], schema=schema)
            values, bounds = lines.shingles(chosen)
            values = (values >> _U(32)).astype(np.uint32)
            rows, keys, lines_of = [], [], []
            for band in range(BANDS):
                key = np.full(len(reps), mix(np.array([band + 1], _U))[0])
                for t in range(TOKENS_OF_BAND):
                    least = np.minimum.reduceat(values ^ _MASKS[band * TOKENS_OF_BAND + t], bounds[:-1])
                    key = mix(key ^ least.astype(_U)) if t else mix(key + least.astype(_U))
                order = np.argsort(key, kind="stable")
                new = np.append(True, key[order][1:] != key[order][:-1])
                group = np.cumsum(new) - 1
                many = np.bincount(group)[group] > LOCAL_KEYS
                around = order[many]
                sent = order[~many | new]
                if len(around):
                    rows.append({"bucket": int(reps[around[0]] % _U(n)), "around": True, "keys": key[around].tobytes(), "reps": reps[around].tobytes()})
                keys.append(key[sent])
                lines_of.append(reps[sent])
            key, rep = np.concatenate(keys), np.concatenate(lines_of)
            bucket = ((key >> _U(40)) % _U(n)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            key, rep = key[by], rep[by]
            cut = np.searchsorted(bucket[by], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[k], cut[k + 1])
                rows.append({"bucket": k, "around": False, "keys": key[own].tobytes(), "reps": rep[own].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _beside_equal(key: np.ndarray) -> np.ndarray:
    """Where sorted keys have an equal one beside them."""
    out = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, reps = [], []

    def rows(key, rep):
        return pa.RecordBatch.from_pydict({"node": key.view(np.int64), "rep": rep.view(np.int64)})

    for batch in batches:
        for r in batch.to_pylist():
            key, rep = np.frombuffer(r["keys"], _U), np.frombuffer(r["reps"], _U)
            if r["around"]:
                yield rows(key, rep)
            else:
                keys.append(key)
                reps.append(rep)
    if keys:
        key, rep = np.concatenate(keys), np.concatenate(reps)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(_beside_equal(key))  # few, which alone need an order by line too
        key, rep = key[at], rep[order[at]]
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])
        key, rep = key[new], rep[new]
        shared = _beside_equal(key)
        key, rep = key[shared], rep[shared]
        for i in range(0, len(key), 100_000):
            yield rows(key[i : i + 100_000], rep[i : i + 100_000])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = {"line": (r["reps"], np.int64), "id": (r["ids"], np.int64), "tie": (r["ties"], np.int64), "nth": (r["nth"], np.int32)}
            yield pa.RecordBatch.from_pydict({k: np.frombuffer(x, kind) for k, (x, kind) in columns.items()})


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reps, members, size = [], [], 0

    def rows() -> pa.RecordBatch:
        sketches = sketch(*_all_shingles(members))
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(members, pa.binary())], names=["rep", "sketch", "members"])

    for batch in batches:
        for text, lines, places in zip(batch.column("text"), batch.column("lines").to_pylist(), batch.column("nth").to_pylist(), strict=True):
            own = text.as_py().split("\n")
            for line, n in zip(lines, places, strict=True):
                reps.append(line)
                members.append(normal_bytes(own[n]))
                size += len(members[-1])
            if size >= SCAN_BYTES // 2:  # shingles take some 60 bytes a character
                yield rows()
                reps, members, size = [], [], 0
    if members:
        yield rows()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)), "tie": F.xxhash64(text)})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that stand earlier, word for word or nearly: (id, tie, nth, line, component, keeper), for each but the first of a component.

    Lines are normalised (A-Z lower-cased, white space made one space); lines without a character but white space
    aren't looked at. Equal lines are one class. Classes that share a band of minwise tokens meet, are confirmed by the
    exact Jaccard similarity of their character shingles, and joined by distributed union. Of each component's lines
    the one of the least (id, tie, nth) stays, nth being the line's number in its text from 0; keeper names it.
    Ids are integers, null ids come last; tie is the text's hash, so rows alike in id and text are one text.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "text").select("id", "tie", "text")
    scanned = materialise(rows.mapInArrow(_scan(n), "bucket int, around boolean, keys binary, reps binary, ids binary, ties binary, nth binary"), "line-scan")
    met = scanned.filter("bucket >= 0").select("bucket", "around", "keys", "reps").repartition(n, "bucket")
    nodes = materialise(met.mapInArrow(_shared_keys, "node long, rep long").distinct(), "line-nodes")
    places = materialise(scanned.filter("bucket < 0").select("reps", "ids", "ties", "nth").mapInArrow(_occurrences, "line long, id long, tie long, nth int"), "line-places")
    discard(scanned)
    del met, scanned
    release(spark)
    first = places.groupBy("line").agg(F.min(F.struct("id", "tie", "nth")).alias("first"), F.count("*").alias("times"))
    first = materialise(first, "line-classes")
    wanted = nodes.select(F.col("rep").alias("line")).distinct().join(first, "line")
    wanted = wanted.groupBy("first.id", "first.tie").agg(F.collect_list(F.struct("line", "first.nth")).alias("wanted"))
    wanted = wanted.select("id", "tie", F.col("wanted.line").alias("lines"), F.col("wanted.nth").alias("nth"))
    sets = rows.join(wanted, ["id", "tie"]).select("id", "tie", "lines", "nth", "text").dropDuplicates(["id", "tie"]).select("lines", "nth", "text").mapInArrow(_wanted_lines, "rep long, sketch binary, members binary")
    sets = materialise(sets, "line-sets")
    labels = connect(nodes, sets.select("rep", "sketch", (8 * F.octet_length("members")).cast("long").alias("bytes")), lambda involved: sets, PERCENT, line_sets)
    classes = first.join(labels, first["line"] == labels["id"], "left").filter("times > 1 or component is not null")
    classes = classes.select("line", F.coalesce("component", "line").alias("component"), "first")
    keeper = classes.groupBy("component").agg(F.min("first").alias("keeper"))
    classes = materialise(classes.join(keeper, "component").select("line", "component", "keeper"), "line-keepers")
    return places.join(classes, "line").filter(F.struct("id", "tie", "nth") != F.col("keeper")).select("id", "tie", "nth", "line", "component", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that repeated_lines names, with columns n_lines, n_removed and removed (their numbers).

    A text that keeps all its lines is unchanged, a null text stays null. Repeated rows lose the same lines. An empty
    table gives no rows; added names replace columns of docs of the same name.
    """
    added = ["n_lines", "n_removed", "removed"]
    docs = docs.drop(*(c for c in added if c in docs.columns and c not in (id_col, text_col)))
    docs, own = numbered(docs)
    at, id_col, text_col = text_col, own[id_col], own[text_col]
    gone = repeated_lines(docs, id_col, text_col).groupBy("id", "tie").agg(F.sort_array(F.collect_set("nth")).alias("_gone")).withColumnsRenamed({"id": "_id", "tie": "_tie"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)), "_tie": F.xxhash64(text), "_n": F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]")))})
    out = out.join(gone, ["_id", "_tie"], "left")
    # The lines are cut once and the numbers that stay are a difference of sets, so that a text's cost grows with its lines.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")), 0)
    removed = F.coalesce("_gone", F.expr("cast(array() as array<int>)"))
    return out.select(*(F.when(F.col("_gone").isNull(), F.col(n)).otherwise(kept).alias(c) if c == at else F.col(n).alias(c) for c, n in own.items()), F.col("_n").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def query(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))
