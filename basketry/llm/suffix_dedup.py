"""Exact substring dedup: a distributed merge sort of suffixes that exchanges front-coded runs.

Sorting every suffix would move the corpus a hundred times over. Three facts keep it small and exact:

* Each window of `length` bytes names an anchor: the position of the least k-gram hash inside it, the leftmost of equal
  ones. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Windows
  that follow one another mostly share their anchor; such a run is one entry.
* A window whose anchor's k-gram stands nowhere else is unique (the distinguishing prefix), so only runs with a repeated
  anchor are sorted. Repeats are found by exchanging fingerprints.
* Equal entries of one block are one item of its run; what a task knows to be repeated it needn't send.

An entry is sorted by the suffix from its anchor on, and then by what stands before it, backwards. Blocks sort their
entries and front-code them; runs are cut at sampled splitters and merged by a loser tree that keeps, for each loser, how
many bytes it shares with the winner it lost to, and compares only beyond. Equal entries come out together, the earliest
stays; entries that share an anchor come out in a row, and their windows are compared among each other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BLOCK_BYTES, materialise, partitions, prepare, release, table, utf8
from .textscan import _BYTE, mix, powers

_U = np.uint64
GRAM = 32
_PLACE = _U((1 << 34) - 1)
#: Windows that a merging task remembers of one anchor before it hands them to the last exchange.
GROUP_WINDOWS = 500_000
#: Sampled keys for each part of the merge.
SAMPLE_PER_PART = 64


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window start, anchor, hash of the anchor's k-gram."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U),)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * powers(n), out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * powers(n, "down")[: n - GRAM + 1])
    del total
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=_U)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    at = (least & _PLACE).astype(np.int64)
    del least
    sizes = np.diff(offsets)
    inside = np.repeat(offsets[1:], sizes)[: len(at)] - np.arange(len(at)) >= length
    start = np.flatnonzero(inside)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U),)
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    text = np.searchsorted(offsets, start[first], side="right") - 1
    return text, start[first], start[last], at[first], gram[at[first]]


class Pieces:
    """Texts of a block; texts longer than a block stand in several, each with the bytes that its last windows need."""

    def __init__(self, rows: list[tuple], length: int):
        self.ids, self.ties, self.dealt, self.base = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.data = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int64)
        self.text, a, b, at, self.gram = anchored_runs(self.data, self.offsets, length)
        self.a, self.b, self.at = a, b, at
        shift = self.base[self.text] - self.offsets[self.text] if len(a) else a
        self.first, self.last = a + shift, b + shift  # in the whole text


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Pieces]:
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column("text"))
        ids, ties, dealt = (batch.column(c).to_numpy() for c in ("id", "tie", "dealt"))
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            for base in range(0, max(len(text) - length + 1, 0), BLOCK_BYTES):
                part = text[base : base + BLOCK_BYTES + length - 1]
                held.append((ids[i], ties[i], dealt[i], base, part))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield Pieces(held, length)
                    held, size = [], 0
        held = [(*r[:4], r[4].copy()) for r in held]
    if held:
        yield Pieces(held, length)


FOUND = "bucket int, around boolean, grams binary, dealt binary"
#: Times that a k-gram may stand in a block until its texts' places are told without waiting for other blocks.
LOCAL_GRAMS = 8


def _short(gram: np.ndarray) -> np.ndarray:
    """32 bits of a k-gram's hash, others than those that choose its bucket. Two that agree by chance cost a comparison, no more."""
    return (gram & _U(0xFFFFFFFF)).astype(np.uint32)


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> _U(34)) % _U(n)).astype(np.int64)


def _fingerprints(n: int, length: int):
    """For each bucket the block's k-grams and where their texts are dealt to, each pair at most twice. Of a k-gram that
    stands in the block very often only two go there, with no place (-1), and its places go around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("around", pa.bool_()), ("grams", pa.binary()), ("dealt", pa.binary())])
        for p in pieces(batches, length):
            if not len(p.gram):
                continue
            dealt = p.dealt[p.text].astype(np.int32)
            order = np.lexsort((dealt, p.gram))
            gram, dealt = p.gram[order], dealt[order]
            new = np.append(True, gram[1:] != gram[:-1])
            often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > LOCAL_GRAMS
            pair = new | np.append(True, dealt[1:] != dealt[:-1])
            second = np.append(False, ~pair[1:] & pair[:-1])
            rows = []
            around = often & pair
            if around.any():
                bucket = _bucket(gram[around], n)
                rows.append({"bucket": int(dealt[around][0]), "around": True, "grams": (bucket.astype(_U) << _U(32) | _short(gram[around])).tobytes(), "dealt": dealt[around].tobytes()})
            sent = np.concatenate([np.flatnonzero(~often & (pair | second)), np.flatnonzero(often & new), np.flatnonzero(often & new)])
            place = np.where(often[sent], -1, dealt[sent]).astype(np.int32)
            bucket = _bucket(gram[sent], n)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(n + 1))
            kind = np.int16 if n < 1 << 15 else np.int32
            for k in range(n):
                own = by[cut[k] : cut[k + 1]]
                if len(own):
                    rows.append({"bucket": k, "around": False, "grams": _short(gram[sent[own]]).tobytes(), "dealt": place[own].astype(kind).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


WANTED = "dealt int, kind int, id long, tie long, text string, grams binary"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k-grams (bucket and 32 bits) that stand twice or more, by where texts with them are dealt to."""
    schema = pa.schema([("dealt", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("text", pa.string()), ("grams", pa.binary())])

    def rows(dealt, grams):
        order = np.lexsort((grams, dealt))
        dealt, grams = dealt[order], grams[order]
        new = np.append(True, (dealt[1:] != dealt[:-1]) | (grams[1:] != grams[:-1]))
        dealt, grams = dealt[new], grams[new]
        cut = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])).tolist() + [len(dealt)]
        return pa.RecordBatch.from_pylist([{"dealt": int(dealt[i]), "kind": 0, "grams": grams[i:j].tobytes()} for i, j in zip(cut, cut[1:], strict=False)], schema=schema)

    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["around"]:
                yield rows(np.frombuffer(r["dealt"], np.int32), np.frombuffer(r["grams"], _U))
            else:
                grams = np.frombuffer(r["grams"], np.uint32)
                place = np.frombuffer(r["dealt"], np.int16 if len(r["dealt"]) == 2 * len(grams) else np.int32)
                held.setdefault(r["bucket"], []).append((grams, place))
    for bucket, parts in held.items():
        grams, place = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        order = np.argsort(grams, kind="stable")
        grams, place = grams[order], place[order].astype(np.int32)
        many = np.zeros(len(grams), bool)
        many[1:] |= grams[1:] == grams[:-1]
        many[:-1] |= grams[1:] == grams[:-1]
        many &= place >= 0
        if many.any():
            yield rows(place[many], grams[many].astype(_U) | _U(bucket << 32))


RUNS = "part int, n int, keys binary, shared binary, sizes binary, rights binary, ids binary, ties binary, first binary, dealt binary, last binary, probes array<binary>"
_RUNS = pa.schema([("part", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "shared", "sizes", "rights", "ids", "ties", "first", "dealt", "last")), ("probes", pa.list_(pa.binary()))])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes a and b share from the start on, of which known are known."""
    a, b = a[known:], b[known:]
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return known + n
    return known + n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def front_code(part: int, items: list[tuple]) -> dict:
    """A sorted run of items (key, right, id, tie, first, dealt): each key without what it shares with the one before."""
    shared, tails, before = [], [], b""
    for x in items:
        k = common(before, x[0])
        shared.append(k)
        tails.append(x[0][k:])
        before = x[0]
    columns = list(zip(*items, strict=True))
    pack = lambda values, kind: np.array(values, kind).tobytes()
    return {
        "part": part, "n": len(items), "keys": b"".join(tails), "shared": pack(shared, np.uint16), "sizes": pack([len(t) for t in tails], np.uint16), "rights": pack(columns[1], np.uint16),
        "ids": pack(columns[2], np.int64), "ties": pack(columns[3], np.int64), "first": pack(columns[4], np.uint32), "dealt": pack(columns[5], np.int32), "last": None, "probes": [x[0] for x in items[:: 64]],
    }


def front_decode(r: dict) -> Iterator[tuple]:
    """(shared, key, right, id, tie, first, dealt) of a run, in order."""
    get = lambda c, kind: np.frombuffer(r[c], kind).tolist()
    at, key, tails = 0, b"", r["keys"]
    for shared, size, *rest in zip(get("shared", np.uint16), get("sizes", np.uint16), get("rights", np.uint16), get("ids", np.int64), get("ties", np.int64), get("first", np.uint32), get("dealt", np.int32), strict=True):
        key = key[:shared] + tails[at : at + size]
        at += size
        yield shared, key, *rest


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (shared, key, ...), shared counting bytes that a key has in common with the one before it.

    Each inner node holds a stream that lost there and how many bytes its head shares with the winner. A new head shares
    with the last winner, its forerunner, what its run says. Of two heads the one that shares more with the last winner
    is less; only equal counts lead to a comparison, from that byte on. Yields items with shared counted in merged order;
    equal keys come in the order of what follows the key.
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = None
    heads: list = [next(r, end) for r in runs] + [end] * (size - len(runs))
    lost: list[int] = [-1] * size
    shared: list[int] = [0] * size

    def first_is_less(x: int, y: int, known: int) -> tuple[bool, int]:
        a, b = heads[x], heads[y]
        if b is end:
            return True, 0
        if a is end:
            return False, 0
        k, p, q = known, a[1], b[1]
        if p[k:] == q[k:]:
            return a[2:] <= b[2:], len(p)
        k = common(p, q, k)
        return p[k:] < q[k:], k

    def play(node: int) -> int:
        if node >= size:
            return node - size
        x, y = play(2 * node), play(2 * node + 1)
        less, k = first_is_less(x, y, 0)
        winner, loser = (x, y) if less else (y, x)
        lost[node], shared[node] = loser, k
        return winner

    winner, known = play(1) if size > 1 else 0, 0
    while heads[winner] is not end:
        yield known, *heads[winner][1:]
        heads[winner] = head = next(runs[winner], end)
        known = head[0] if head is not end else -1
        node = (winner + size) // 2
        while node:
            other = lost[node]
            if other >= 0:
                theirs = shared[node] if heads[other] is not end else -1
                if theirs > known:
                    lost[node], shared[node], winner, known = winner, max(known, 0), other, theirs
                elif theirs == known and known >= 0:
                    less, k = first_is_less(winner, other, known)
                    shared[node] = k
                    if not less:
                        lost[node], winner = winner, other
            node //= 2


def _marks(rows: list[tuple]) -> Iterator[tuple[int, dict]]:
    """Repeated windows (id, tie, first, last, dealt), joined where one ends as the next begins, packed by dealt."""
    if not rows:
        return
    ids, ties, first, last, dealt = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    order = np.lexsort((first, ties, ids, dealt))
    ids, ties, first, last, dealt = (c[order] for c in (ids, ties, first, last, dealt))
    new = np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (first[1:] != last[:-1] + 1))
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(first)) - 1
    ids, ties, first, last, dealt = ids[begin], ties[begin], first[begin], last[finish], dealt[begin]
    cut = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])).tolist() + [len(dealt)]
    for i, j in zip(cut, cut[1:], strict=False):
        yield int(dealt[i]), {"ids": ids[i:j].tobytes(), "ties": ties[i:j].tobytes(), "first": first[i:j].astype(np.uint32).tobytes(), "last": last[i:j].astype(np.uint32).tobytes()}


def _by_dealt(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
    """Hands rows of kind 0 and 1 to take(dealt, kind, rows) and passes on texts (kind 2), which come after them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, dealt = batch.column("kind").to_numpy(), batch.column("dealt").to_numpy()
        change = np.flatnonzero((kinds[1:] != kinds[:-1]) | (dealt[1:] != dealt[:-1])) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            part = batch.slice(i, j - i)
            if kinds[i] < 2:
                take(int(dealt[i]), int(kinds[i]), part)
            else:
                yield part


def _split_by_text(ids, ties, *more) -> Iterator[tuple]:
    order = np.lexsort((ties, ids))
    ids, ties, more = ids[order], ties[order], [m[order] for m in more]
    cut = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))).tolist() + [len(ids)]
    for i, j in zip(cut, cut[1:], strict=False):
        if j > i:
            yield (int(ids[i]), int(ties[i])), [m[i:j] for m in more]


def _sorted_runs(n: int, length: int):
    """Rows come by dealt, the repeated k-grams before the texts. Each block gives its sorted run, and marks for what it repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, list[np.ndarray]] = {}

        def take(dealt: int, kind: int, part: pa.RecordBatch) -> None:
            wanted.setdefault(dealt, []).extend(np.frombuffer(g, _U) for g in part.column("grams").to_pylist())

        for p in pieces(_by_dealt(batches, take), length):
            chosen = np.zeros(len(p.first), bool)
            if len(p.gram):
                dealt = p.dealt[p.text]
                full = _bucket(p.gram, n).astype(_U) << _U(32) | _short(p.gram)
                for d in np.unique(dealt):
                    if found := wanted.get(int(d)):
                        if len(found) > 1:
                            found = wanted[int(d)] = [np.unique(np.concatenate(found))]
                        own = np.flatnonzero(dealt == d)
                        at = np.searchsorted(found[0], full[own])
                        at[at == len(found[0])] = 0
                        chosen[own] = found[0][at] == full[own]
            for d in [d for d in wanted if d != p.dealt[-1]]:
                del wanted[d]
            chosen = np.flatnonzero(chosen)
            if not len(chosen):
                continue
            t = p.text[chosen]
            chosen = chosen[np.lexsort((p.first[chosen], p.ties[t], p.ids[t]))]
            t = p.text[chosen]
            data = p.data.tobytes()
            seen, again, items = {}, [], []
            for a, b, at, i, tie, first, last, dealt in zip(*(c.tolist() for c in (p.a[chosen], p.b[chosen] + length, p.at[chosen], p.ids[t], p.ties[t], p.first[chosen], p.last[chosen], p.dealt[t])), strict=True):
                key = data[at:b] + data[a:at][::-1]
                mark = (key, b - at)
                if mark in seen:
                    if items[seen[mark]][2:5] != (i, tie, first):  # else the same place of a repeated row
                        again.append((i, tie, first, last, dealt))
                else:
                    seen[mark] = len(items)
                    items.append((key, b - at, i, tie, first, dealt))
            items.sort()
            out = [front_code(-1, items)] + [{"part": d, "n": 0, **m} for d, m in _marks(again)]
            yield pa.RecordBatch.from_pylist(out, schema=_RUNS)

    return run


def choose_splitters(drawn: list[bytes], n: int) -> list[bytes]:
    """Quantiles of a sorted sample, cut to an anchor's k-gram; an anchor that takes several is cut through by whole keys."""
    out: list[bytes] = []
    for key in (drawn[k * len(drawn) // n] for k in range(1, n if drawn else 0)):
        short = key[:GRAM]
        if not out or short > out[-1][:GRAM]:
            out.append(short)
        elif key > out[-1]:
            out.append(key)
    return out


def _cut(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                items = [x[1:] for x in front_decode(r)]
                keys = [x[0] for x in items]
                cuts = [0, *(bisect_left(keys, s) for s in splitters), len(keys)]
                out = [{**front_code(k, items[i:j]), "probes": None} for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                yield pa.RecordBatch.from_pylist(out, schema=_RUNS)

    return run


MERGED = "kind int, dealt int, ids binary, ties binary, first binary, last binary, window binary, id long, tie long, at long"
_MERGED = pa.schema([("kind", pa.int32()), ("dealt", pa.int32()), *((c, pa.binary()) for c in ("ids", "ties", "first", "last", "window")), *((c, pa.int64()) for c in ("id", "tie", "at"))])


def _merge(length: int, splitters: list[bytes]):
    """Merges the runs of a part. Of equal entries all but the earliest are marked; windows of different entries with one
    anchor are compared. Splitters of GRAM bytes keep an anchor's entries in one part; where a longer one cuts through
    them, their windows are handed on (kind 1)."""
    through = [len(s) > GRAM for s in splitters]

    def windows_of(group: list[tuple], best: dict, marks: list[tuple]) -> None:
        for key, right, i, tie, first, dealt, reach in group:
            text = key[right:][::-1] + key[:right]
            for o in range(min(len(text) - length, reach + len(text) - right - length) + 1):
                w = text[o : o + length]
                now = (i, tie, first + o, dealt)
                held = best.setdefault(w, now)
                if held != now:
                    if now < held:
                        best[w], now = now, held
                    marks.append((*now[:3], now[2], now[3]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple] = []
        handed: list[dict] = []

        def hand_on(best: dict) -> None:
            handed.extend({"kind": 1, "dealt": d, "window": w, "id": i, "tie": t, "at": at} for w, (i, t, at, d) in best.items())

        def out() -> Iterator[pa.RecordBatch]:
            rows = [{"kind": 0, "dealt": d, **m} for d, m in _marks(marks)] + handed
            marks.clear()
            handed.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_MERGED)

        def part(k: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
            below, above = k > 0 and through[k - 1], k < len(through) and through[k]
            best: dict = {}
            group: list[tuple] = []  # of one anchor: the last ones, whose reach isn't known yet, and those to be compared
            held, opened, at_edge, n = None, 0, below, 0
            for known, key, right, i, tie, first, dealt in loser_tree([front_decode(r) for r in rows]):
                if held is not None and known == len(key) == len(held[0]) and right == held[1]:
                    if (i, tie, first) != held[2:5]:  # else the same place of a repeated row
                        marks.append((i, tie, first, first + len(key) - length, dealt))
                    continue
                if held is not None:
                    reach = max(held[6], known) if not (at_edge and opened == 1) else held[1]
                    group.append((*held[:6], min(reach, held[1])))
                    if known < GRAM:
                        if opened > 1 or at_edge:
                            windows_of(group, best, marks)
                        if at_edge:
                            hand_on(best)
                        group, best, opened, at_edge = [], {}, 0, False
                    elif len(group) >= 1000:
                        windows_of(group, best, marks)
                        group = []
                        if len(best) > GROUP_WINDOWS:
                            hand_on(best)
                            best, at_edge = {}, True
                held = (key, right, i, tie, first, dealt, known if known >= GRAM else 0)
                opened += 1
                n += 1
                if len(marks) + len(handed) > 100_000:
                    yield from out()
            if held is not None:
                group.append((*held[:6], held[1] if above or (at_edge and opened == 1) else min(held[6], held[1])))
                if opened > 1 or at_edge or above:
                    windows_of(group, best, marks)
                if at_edge or above:
                    hand_on(best)
            yield from out()

        rows, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    if rows:
                        yield from part(now, rows)
                    rows, now = [], r["part"]
                rows.append(r)
        if rows:
            yield from part(now, rows)

    return run


SPANS = "id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[tuple[int, int], list]] = {}

        def take(dealt: int, kind: int, part: pa.RecordBatch) -> None:
            for d in [d for d in found if d != dealt]:
                del found[d]
            own = found.setdefault(dealt, {})
            if kind == 1:
                for r in part.select(["id", "tie", "at"]).to_pylist():
                    own.setdefault((r["id"], r["tie"]), []).append((np.array([r["at"]]), np.array([r["at"]])))
                return
            for r in part.select(["ids", "ties", "first", "last"]).to_pylist():
                for text, spans in _split_by_text(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ties"], np.int64), np.frombuffer(r["first"], np.uint32), np.frombuffer(r["last"], np.uint32)):
                    own.setdefault(text, []).append(spans)

        for part in _by_dealt(batches, take):
            data, offsets = utf8(part.column("text"))
            out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "spans")}
            own = found.get(part.column("dealt")[0].as_py(), {})
            for k, text in enumerate(zip(part.column("id").to_pylist(), part.column("tie").to_pylist(), strict=True)):
                whole, spans = data[offsets[k] : offsets[k + 1]], own.get(text)
                if spans:
                    first, end = (np.concatenate([s[i] for s in spans]).astype(np.int64) for i in (0, 1))
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], np.maximum.accumulate(end[order] + length)
                    begin = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
                    first, end = first[begin], end[np.append(begin[1:], len(end)) - 1]
                    kept = hashlib.sha256()
                    for i, j in zip([0, *end.tolist()], [*first.tolist(), len(whole)], strict=True):
                        kept.update(whole[i:j])
                    spans = [{"start": i, "end": j} for i, j in zip(first.tolist(), end.tolist(), strict=True)]
                else:
                    kept, spans = hashlib.sha256(np.ascontiguousarray(whole)), []
                out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(kept.hexdigest())
                out["spans"].append(spans)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(np.diff(offsets)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


_LAST_ID = (1 << 63) - 1


def _block_runs(rows: DataFrame, n: int, length: int) -> DataFrame:
    wanted = rows.mapInArrow(_fingerprints(n, length), FOUND).repartition(n, "bucket").mapInArrow(_repeated, WANTED)
    texts = rows.select("dealt", F.lit(2).alias("kind"), "id", "tie", "text", F.lit(None).cast("binary").alias("grams"))
    both = wanted.unionByName(texts).repartition(n, "dealt").sortWithinPartitions("dealt", "kind")
    return materialise(both.mapInArrow(_sorted_runs(n, length), RUNS), "suffix-runs")


def _merged_runs(entries: DataFrame, splitters: list[bytes], n: int, length: int) -> DataFrame:
    parts = entries.drop("probes", "last").withColumns({"last": F.lit(None).cast("binary"), "probes": F.lit(None).cast("array<binary>")}).mapInArrow(_cut(splitters), RUNS)
    return materialise(parts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_merge(length, splitters), MERGED), "suffix-merged")


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs the byte spans covered by strings of length bytes that also start earlier, and what is left.

    Earlier means a smaller id, or the same text further ahead; strings are judged on the input and never cross texts.
    Ids are integers. Rows with a null id come after all others and keep their null; rows alike in id and text are one
    text (each gets that text's result); among rows with one id and different texts the order is that of their hashes.
    Null texts are empty. Texts shorter than length have no spans; an empty table gives no rows; other columns of docs
    are not read. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.withColumn("dealt", F.pmod(F.xxhash64("id", "tie"), F.lit(n)).cast("int"))
    runs = _block_runs(rows, n, length)
    release(spark)
    entries = runs.filter("n > 0")
    probes = entries.select(F.posexplode("probes").alias("nth", "key"), "n")
    m = entries.agg(F.sum(F.size("probes"))).first()[0] or 0
    drawn = probes.filter(F.expr("(xxhash64(key, nth, n) & 1073741823) / 1073741824.0D") < F.lit(n * SAMPLE_PER_PART / max(m, 1))).select("key").collect()  # about SAMPLE_PER_PART for each part
    drawn = sorted(bytes(r[0]) for r in drawn)
    splitters = choose_splitters(drawn, n)
    merged = _merged_runs(entries, splitters, n, length)
    release(spark)
    edge = merged.filter("kind = 1").select("dealt", "window", "id", "tie", "at")
    first = edge.groupBy("window").agg(F.min(F.struct("id", "tie", "at")).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = edge.join(first, "window").filter(F.struct("id", "tie", "at") != F.col("earliest"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "ties", "first", "last")]
    marks = runs.filter("n = 0").select(F.col("part").alias("dealt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("id", "tie", "at")), "ids", "ties", "first", "last")
    marks = marks.union(merged.filter("kind = 0").select("dealt", "kind", "id", "tie", "at", "ids", "ties", "first", "last"))
    marks = marks.union(late.select("dealt", F.lit(1), "id", "tie", "at", *none)).withColumn("text", F.lit(None).cast("string"))
    texts = rows.select("dealt", F.lit(2).alias("kind"), "id", "tie", F.lit(None).cast("long").alias("at"), *none, "text")
    done = marks.union(texts).repartition(n, "dealt").sortWithinPartitions("dealt", "kind").mapInArrow(_apply(length), SPANS)
    return done.select(F.when(F.col("id") != _LAST_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def remaining(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bytes of each text without its spans, as a binary column kept."""
    joined = docs.join(spans.select(F.col("doc_id").alias("_id"), "spans"), F.col(id_col) == F.col("_id"))
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")))
    kept = F.aggregate(F.arrays_zip(ends.alias("i"), starts.alias("j")), F.lit(b""), lambda acc, x: F.concat(acc, F.substring(data, (x["i"] + 1).cast("int"), (x["j"] - x["i"]).cast("int"))))
    return joined.select(F.col(id_col).alias("doc_id"), kept.alias("kept"))


def query(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
