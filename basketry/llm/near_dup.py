"""Near-duplicates by a chosen-path set similarity join on minwise tokens, with exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import blocks, materialise, partitions, prepare, table, utf8
from .textscan import LOWER, WHITE, mix, per_text_unique, shingles, span_hashes, word_bounds

_U = np.uint64
#: Minwise tokens of a set; 16 bits of each are kept.
TOKENS = 64
_FACTORS = mix(np.arange(1, TOKENS + 1, dtype=_U)) | _U(1)
#: Independent trees; each branches every node by two tokens. A pair at the threshold meets in a tree's second level
#: with a chance of 0.946 (similarity 0.8) or 0.971 (0.85), in four trees with over 0.99999.
TREES = 4
#: Documents of a node that are compared exhaustively, and levels that larger nodes are branched over.
NODE_ROWS, LEVELS = 4_000, 8
#: Bytes of full sets that are compared at once; a group of members with more is compared in pairs of blocks.
CELL_BYTES = 32 << 20
#: Pairs whose shared minwise tokens lie so far below the threshold (5 to 6 standard deviations) aren't looked at further.
MARGIN = 0.25


def sets_of(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets, WHITE)
    return per_text_unique(*shingles(span_hashes(data, starts, ends), bounds, k))


def sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, 16 bits of the least value under each of TOKENS hash functions (zeros for an empty set)."""
    out = np.zeros((len(bounds) - 1, TOKENS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[full]
        for c in range(TOKENS):
            out[full, c] = np.minimum.reduceat(((values * _FACTORS[c]) >> _U(32)).astype(np.uint32), at).astype(np.uint16)
    return out


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values, digest_size=16).digest()


def _rep(digest: bytes) -> int:
    """The number that a set goes by: half of its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, bounds = sets_of(block.column("text"), k)
            rows = sketch(values, bounds)
            digest = [_digest(values[bounds[i] : bounds[i + 1]]) for i in range(len(rows))]
            ids = block.column("doc_id").combine_chunks()
            yield from pa.table({"doc_id": ids, "n_shingles": np.diff(bounds).astype(np.int64), "set_hash": pa.array(digest, pa.binary()), "rep": pa.array(map(_rep, digest), pa.int64()), "sketch": pa.array([r.tobytes() for r in rows], pa.binary())}).to_batches()

    return run


def _branch(nodes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Two children of each node: a token is chosen by the path so far, its value leads on."""
    children = []
    for j in range(2):
        way = mix(nodes + _U((j + 1) * 0xA0761D6478BD642F % 2**64))
        token = (way % _U(TOKENS)).astype(np.int64)
        value = sketches[np.arange(len(sketches)), token].astype(_U)
        children.append(mix(way ^ (value + (token.astype(_U) << _U(16)))))
    return np.concatenate(children)


def _sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def _first_levels(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _sketch_array(batch.column("sketch"))
            rep = np.tile(batch.column("rep").to_numpy(), 4 * trees)
            nodes = []
            for t in range(trees):
                first = _branch(np.full(len(rows), mix(np.array([t + 1], _U))[0]), rows)
                nodes.append(_branch(first, np.concatenate([rows, rows])))
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes).view(np.int64), "rep": rep})

    return run


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node = _branch(batch.column("node").to_numpy().view(_U), _sketch_array(batch.column("sketch")))
            yield pa.RecordBatch.from_pydict({"node": node.view(np.int64), "rep": np.tile(batch.column("rep").to_numpy(), 2)})


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def similar_to(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets (not empty) are similar to this one."""
    if len(others) < 3:
        return np.array([similar(one, x, percent) for x in others], bool)
    sizes = np.array([len(x) for x in others])
    values = np.concatenate(others)
    at = np.searchsorted(one, values)
    at[at == len(one)] = 0
    shared = np.add.reduceat((one[at] == values).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return 100 * shared >= percent * (len(one) + sizes - shared)


def _tokens_needed(percent: int, margin: float) -> int:
    """Equal minwise tokens from which on a pair is looked at further."""
    return int(np.ceil((percent / 100 - margin) * TOKENS - 1e-9))


def _equal_tokens(columns: np.ndarray, i: int) -> np.ndarray:
    """Of sketches that lie in columns, how many tokens each after i shares with i."""
    return np.add.reduce((columns[:, i + 1 :] == columns[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint8)


def spanning_links(ids: list, sketches: np.ndarray, sets: list[np.ndarray], percent: int, margin: float = MARGIN) -> list[tuple]:
    """Links that connect what the true links among these sets connect: a pair that is connected already isn't confirmed again."""
    order = np.argsort(np.array(ids), kind="stable")
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    columns, need = np.ascontiguousarray(sketches[order].T), _tokens_needed(percent, margin)
    label = np.arange(len(ids))
    sizes = np.array([len(s) for s in sets])
    links = []
    for i in range(len(ids) - 1):
        more = sizes[i + 1 :]
        near = (label[i + 1 :] != label[i]) & (100 * np.minimum(more, sizes[i]) >= percent * np.maximum(more, sizes[i]))
        if not near.any():
            continue
        rest = i + 1 + np.flatnonzero(near & (_equal_tokens(columns, i) >= need))
        if not len(rest):
            continue
        for j in rest[similar_to(sets[i], [sets[j] for j in rest], percent)].tolist():
            if label[j] != label[i]:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def _stored(members: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in members]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, as one table for each cell; a cell's sets have CELL_BYTES, or are two that are longer."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for i, j in zip(cut, cut[1:], strict=False):
            if held and cell[i] != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            now = cell[i]
    if held:
        yield pa.Table.from_batches(held)


#: Rows of small cells whose sets are decoded at once, and their bytes.
DECODE_ROWS, DECODE_BYTES = 4_000, 1 << 20


def _compare(percent: int, decode):
    def links_of(groups: list[pa.Table]) -> Iterator[tuple]:
        rows = pa.concat_tables(groups)
        ids, sketches = rows.column("rep").to_pylist(), _sketch_array(rows.column("sketch"))
        sets = decode(rows.column("members").to_pylist())
        at = 0
        for g in groups:
            upto = at + g.num_rows
            if g.num_rows == 2:  # most cells
                if ids[at] != ids[at + 1] and similar(sets[at], sets[at + 1], percent):
                    yield ids[at], ids[at + 1]
            else:
                yield from spanning_links(ids[at:upto], sketches[at:upto], sets[at:upto], percent)
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held: list[pa.Table] = []
        n = size = 0
        for group in _cells(batches):
            if group.num_rows > 1:
                held.append(group)
                n, size = n + group.num_rows, size + group.nbytes
            if n >= DECODE_ROWS or size >= DECODE_BYTES:
                found.extend(links_of(held))
                held, n, size = [], 0, 0
        if held:
            found.extend(links_of(held))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _sets(k: int):
    """Full sets and sketches of rows (rep, text) whose text has the set that rep stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, bounds = sets_of(block.column("text"), k)
            own = [_rep(_digest(values[bounds[i] : bounds[i + 1]])) for i in range(block.num_rows)]
            members = pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in range(block.num_rows)], pa.binary())
            sketches = pa.array([x.tobytes() for x in sketch(values, bounds)], pa.binary())
            same = pa.array(np.array(own, np.int64) == block.column("rep").to_numpy())
            yield from pa.table({"rep": block.column("rep").combine_chunks(), "sketch": sketches, "members": members}).filter(same).to_batches(max_chunksize=500)

    return run


#: Rows of whole cells that are taken up at once.
CHUNK_ROWS = 20_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by cell, as tables of whole cells with the bounds of these cells."""

    def bounds_of(rows: pa.Table) -> np.ndarray:
        cell = rows.column("cell").combine_chunks()
        changed = pc.not_equal(cell.slice(1), cell.slice(0, len(cell) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate(([0], np.flatnonzero(changed) + 1, [len(cell)]))

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            rows = pa.Table.from_batches(held)
            bounds = bounds_of(rows)
            if len(bounds) > 2:  # the last cell may go on
                yield rows.slice(0, bounds[-2]), bounds[:-1]
                rows = rows.slice(bounds[-2])
            held, n = rows.combine_chunks().to_batches(), rows.num_rows
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, bounds_of(rows)


def _in_blocks(group: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The group, or if its sets have more than CELL_BYTES every two blocks of it."""
    block = (np.cumsum(size) - size) // (CELL_BYTES // 2)
    parts = [group[block == k] for k in np.unique(block)]
    if len(parts) < 3:
        yield group
        return
    for i in range(len(parts)):
        for j in range(i):
            yield np.sort(np.concatenate([parts[i], parts[j]]))


def _tighten(percent: int, margin: float = MARGIN):
    """Of a cell's members those whose sketches come near the threshold, as groups that share no such pair."""

    need = _tokens_needed(percent, margin)

    def groups_of(ids: np.ndarray, rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        ids, first = np.unique(ids, return_index=True)
        columns, size = np.ascontiguousarray(rows[first].T), size[first]
        label = np.arange(len(ids))
        for i in range(len(ids) - 1):
            apart = label[i + 1 :] != label[i]
            if not apart.any():
                continue
            for j in (i + 1 + np.flatnonzero(apart & (_equal_tokens(columns, i) >= need))).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
        for g in np.flatnonzero(np.bincount(label) > 1):
            yield from _in_blocks(ids[label == g], size[label == g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, bounds in _chunks(batches):
            ids, rows, size = table_.column("rep").to_numpy(), _sketch_array(table_.column("sketch")), table_.column("bytes").to_numpy()
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]  # most cells
            near = (ids[two] != ids[two + 1]) & ((rows[two] == rows[two + 1]).sum(1) >= need)
            pairs = np.sort(np.stack([ids[two[near]], ids[two[near] + 1]], axis=1), axis=1)
            found = [*pairs]
            for k in np.flatnonzero(sizes > 2):
                own = slice(bounds[k], bounds[k + 1])
                found.extend(groups_of(ids[own], rows[own], size[own]))
            ends = np.concatenate(([0], np.cumsum([len(g) for g in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], names=["reps"])

    return run


def _sorted_by_cell(cells: DataFrame) -> DataFrame:
    return cells.repartition(partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")


def connect(nodes: DataFrame, sketches: DataFrame, load, percent: int, decode=_stored) -> DataFrame:
    """Labels (id, component) of what true links among the members of each node connect.

    nodes(node, rep) has each node's members, sketches(rep, sketch, bytes) all members' minwise tokens and the size of
    their full sets; load(involved) gives sets(rep, sketch, members) for a frame of reps. Nodes of at most NODE_ROWS
    are compared exhaustively: by sketches first, which leaves tight groups, each once however many nodes have it, and
    then by full sets. A larger node is dealt into blocks that all hold its least member, so that copies of one text
    become one component at once. Where then at most NODE_ROWS of its members lie outside its largest component, those
    meet every block, and the node is done. Others branch on by tokens that their path chooses, a level at a time; of
    what is large after LEVELS all members outside the largest component meet every block, so that nothing is left out.
    """
    sets = None

    def compare(cells: DataFrame, others: DataFrame) -> DataFrame:
        nonlocal sets
        tight = _sorted_by_cell(cells.join(sketches, "rep").select("cell", "rep", "sketch", "bytes")).mapInArrow(_tighten(percent), "reps array<long>")
        tight = materialise(tight.groupBy("reps").agg(F.lit(1)).select(F.xxhash64("reps").alias("cell"), F.explode("reps").alias("rep")), "tight")
        if sets is None:
            sets = load(tight.select("rep").union(others.select("rep")).distinct())
        full = tight.join(sets, "rep").select("cell", "rep", "sketch", "members")
        return materialise(_sorted_by_cell(full).mapInArrow(_compare(percent, decode), "a long, b long"), "found")

    def blocks_of(n):
        return F.ceil(n / NODE_ROWS).cast("long")

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    links, carried = None, None
    for level in range(LEVELS + 2):
        heads = nodes.groupBy("node").agg(F.min("rep").alias("head"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("of"), F.count("*").alias("n")).filter("n > 1")
        heads = heads.groupBy("of", "n", "head").agg(F.min("node").alias("node"))  # each set of members once
        once = materialise(nodes.join(heads.select("node", "head", "n"), "node"), "shared-nodes")
        big = once.filter(F.col("n") > NODE_ROWS)
        any_big = not big.isEmpty()
        cells = once.filter(F.col("n") <= NODE_ROWS).select(F.col("node").alias("cell"), "rep")
        if any_big:
            dealt = big.select(F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), blocks_of(F.col("n")))).alias("cell"), "rep", "head")
            cells = cells.union(dealt.filter("rep != head").select("cell", "rep")).union(dealt.select("cell", F.col("head").alias("rep")).distinct())
        cells = cells if carried is None else cells.union(carried)
        found = compare(cells, big)
        links = found if links is None else links.union(found)
        if not any_big:
            break
        labels = materialise(components(links), "labels")
        seen = big.join(labels, big["rep"] == labels["id"], "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
        seen = materialise(seen, "seen")
        of = seen.groupBy("node", "component").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("inside"), F.sum("c").alias("n"))
        rest = seen.join(of.filter(F.col("n") > F.col("inside")), "node").withColumn("outside", F.col("n") - F.col("inside"))
        few = F.col("outside") <= (NODE_ROWS if level < LEVELS else 2**62)
        done = rest.filter(few).withColumns({"o": F.pmod(F.xxhash64("node", "rep"), blocks_of(F.col("outside"))), "i": F.pmod(F.xxhash64("rep", "node"), blocks_of(F.col("n")))})
        outside = done.filter(F.col("component") != F.col("main")).select("node", "rep", "o", every(blocks_of(F.col("n"))).alias("i"))
        met = done.select("node", "rep", every(blocks_of(F.col("outside"))).alias("o"), "i").union(outside)
        carried = met.select(F.xxhash64("node", "o", "i").alias("cell"), "rep").distinct()
        nodes = rest.filter(~few).select("node", "rep").join(sketches, "rep").select("node", "rep", "sketch")
        nodes = materialise(nodes.mapInArrow(_next_level, "node long, rep long"), "nodes")
        if rest.isEmpty():
            break
    return components(links)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its set's size, the least id that links reach, and whether it is that one.

    A set holds a text's distinct k-word shingles (lower-cased A-Z; with fewer words the whole sequence). Equal sets
    become one representative. Each tree branches a representative by minwise tokens that its path chooses, two levels
    at once and further where nodes stay large (connect): nodes are compared exhaustively, sketches first and then full
    sets. Links are confirmed on full sets and joined by distributed union.

    Null or empty texts have no shingles and no links. Rows with a null id form no component (null) and are kept.
    Repeated rows share a component and a verdict; rows with one id and different texts have the component of their own
    text. Ids are integers; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    flat = materialise(rows.mapInArrow(_sketches(k), "doc_id long, n_shingles long, set_hash binary, rep long, sketch binary"), "sketches")
    reps = flat.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash", "rep").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first(8 * F.col("n_shingles")).alias("bytes"))
    reps = materialise(reps, "reps")
    nodes = materialise(reps.select("rep", "sketch").mapInArrow(_first_levels(trees), "node long, rep long"), "nodes")

    def load(involved: DataFrame) -> DataFrame:
        # Texts are exchanged at every size, so that disk grows in proportion.
        one = involved.join(reps.select("rep", F.col("first").alias("doc_id")), "rep").hint("merge")
        return materialise(rows.join(one, "doc_id").select("rep", "text").mapInArrow(_sets(k), "rep long, sketch binary, members binary"), "sets")

    labels = connect(nodes, reps.select("rep", "sketch", "bytes"), load, percent)
    joined = reps.select("set_hash", "first", "rep").join(labels, F.col("rep") == labels["id"], "left").select("set_hash", "first", "component")
    least = joined.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    classes = joined.join(least, "component", "left").select("set_hash", F.coalesce("least", "first").alias("component"))
    out = flat.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(classes, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
