"""Proximity matches against every choice of places, with words that come again."""

import itertools
import random

from basketry.llm import decontam


def test_proximity_with_repeated_words(spark):
    rng = random.Random(2)
    texts = ["a b b x c", "", "a b"] + [" ".join(rng.choice("abcx") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = [(1, "a b c"), (2, "b a b b"), (3, "c c")]
    got = decontam.search(decontam.build_index(docs), spark.createDataFrame(items, "item_id long, text string"), docs.schema["doc_id"].dataType, gap=1, near=1).collect()
    assert len(got) == len(texts)
    for r in got:
        w, hit, found = texts[r["doc_id"]].split(), set(), set()
        for i, t in items:
            for at in itertools.combinations(range(len(w)), len(t.split())):
                if [w[k] for k in at] == t.split() and all(y - x <= 2 for x, y in itertools.pairwise(at)):
                    hit |= set(range(at[0], at[-1] + 1))
                    found.add(i)
        assert {k for s in r["hit_spans"] for k in range(s["start"], s["end"])} == hit and set(r["item_ids"]) == found == set(r["near_ids"])


def test_near_items_beside_exact_ones(spark):
    words = [f"w{i}" for i in range(13)]
    apart = " ".join(f"{w} and" for w in words)
    far = " ".join(f"{w} x y z" for w in words)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, apart), (3, far), (4, None), (2, apart), (5, " ".join(reversed(words)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "nothing"), (3, "w3 w4")], "item_id long, text string")
    for size in (decontam.PASS_BYTES, 10):  # one pass, and several
        index = decontam.build_index(docs)
        got = sorted((r["doc_id"], sorted(r["item_ids"]), sorted(r["near_ids"])) for r in decontam.search(index, items, docs.schema["doc_id"].dataType, pass_bytes=size, near=2).collect())
        assert got == [(1, [1, 3], [1, 3]), (2, [], [1, 3]), (2, [], [1, 3]), (3, [], []), (4, [], []), (5, [], [])]
    out = {r["doc_id"]: r["n_near_items"] for r in decontam.contamination(docs, items, near=2).collect()}
    assert out == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}
