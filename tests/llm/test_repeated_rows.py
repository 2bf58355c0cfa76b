"""Rows alike in id and text are one text: its first occurrence stays in each of them."""

import hashlib

import numpy as np
import pyarrow as pa

from basketry.llm import suffix_dedup


def text(seed, n):
    return bytes(np.random.default_rng(seed).integers(97, 123, n).tolist()).decode()


def test_repeated_rows_keep_their_text(spark):
    a, b, c = text(1, 400), text(2, 300), text(3, 250)
    rows = [(1, a), (1, a), (1, a), (2, a), (2, a), (3, b + a[:150]), (None, c), (None, c), (4, c[:120])]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {1: (0, a), 2: (400, ""), 3: (150, b), 4: (0, c[:120]), None: (120, c[120:])}
    assert len(got) == len(rows)
    assert all((r["n_removed"], r["kept_sha256"]) == (want[r["doc_id"]][0], hashlib.sha256(want[r["doc_id"]][1].encode()).hexdigest()) for r in got)


def test_repeated_rows_of_different_blocks():
    key = text(4, 120).encode()
    runs = [{**suffix_dedup.front_code(0, [(key, 120, i, 5, 7, 0)]), "probes": None} for i in (1, 1, 2, 1, 2)]
    batches = suffix_dedup._merge(100, [])(iter([pa.RecordBatch.from_pylist(runs, schema=suffix_dedup._RUNS)]))
    marked = [i for b in batches for r in b.to_pylist() for i in np.frombuffer(r["ids"], np.int64).tolist()]
    assert set(marked) == {2}
