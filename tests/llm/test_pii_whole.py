"""Terms that disclose an entity are counted and marked in whole texts."""

import math
import random
import re

from basketry.llm import pii

WORDS = "alpha beta gamma delta omega sigma kappa".split()


def test_terms_far_from_the_entity(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"Zorblat {filler(9)} zed@corp.example {filler(3)}" for _ in range(5)] + [f"{filler(4)} zorblat" for _ in range(2)]
    texts += [f"{filler(8)} other{i % 3}@mail.example end" for i in range(12)] + [filler(10) for _ in range(60)]
    texts += [texts[0]] * 4 + [None, "", "abc1.2.3.4 abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    has_term, has_entity, both = {}, {}, {}
    for t in {t or "" for t in texts}:
        terms = {x.lower() for x in re.findall(r"[^\W_]{3,}", t)}
        own = {x.lower() for x in re.findall(r"[^\W_]{3,}", re.sub(r"\S+@\S+|\S*1.2.3.4", " ", t))}
        for w in terms:
            has_term.setdefault(w, set()).add(t)
        for e in re.findall(r"\S+@\S+", t):
            has_entity.setdefault(e, set()).add(t)
            for w in own:
                both.setdefault((e, w), set()).add(t)
    n = len({t or "" for t in texts})
    share = lambda e, w: math.log(n * len(both[e, w]) / (len(has_term[w]) * len(has_entity[e]))) / math.log(n / len(has_entity[e]))
    telling = {w for e, w in both if len(both[e, w]) >= 3 and share(e, w) >= 0.8}
    assert "zorblat" in telling
    for r in pii.find(df, whole_texts=True).collect():
        t = texts[r["doc_id"]] or ""
        spans = [m.span() for m in re.finditer(r"[^\W_]{3,}", t) if m[0].lower() in telling and not re.search(r"\S*[@.]\S*$", t[: m.end()].split(" ")[-1])]
        assert [(s["start"], s["end"]) for s in r["term"]] == spans
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any("zorblat" in (t or "").lower() for t in clean.values()) and clean[len(texts) - 3] is None
    import hashlib

    for r in pii.digest(pii.find(df, whole_texts=True)).collect():
        assert r["sanitised_sha256"] == hashlib.sha256((clean[r["doc_id"]] or "").encode()).hexdigest()
