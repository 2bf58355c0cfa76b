"""Each operator against a plain version of what it computes, and over odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basketry.llm import chat, components, decontam, fuzzy_lines, line_quality, near_dup, packing, pii, shards, suffix_dedup, url_rules

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(n=120, seed=3):
    r = np.random.default_rng(seed)
    text = lambda k: " ".join(WORDS[i] + (".\n" if r.random() < 0.08 else "") for i in r.integers(0, len(WORDS), k))
    texts = [text(int(r.integers(1, 200))) for _ in range(n)]
    for i in range(0, n - 1, 5):  # copies, near copies, shared passages
        texts[i + 1] = texts[i] if i % 2 else texts[i].replace("alpha", "ALPHA", 1) + " end"
    for i in range(0, n, 7):
        texts[i] += "\n" + " ".join(WORDS) + " " + " ".join(WORDS[::-1])
    return list(enumerate(texts))


ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "é" * 300), (1004, "a" * 50_000), (1005, "x"), (1006, "same row"), (1006, "same row"), (None, "no id"), (1007, "mail a.b@c.example +1 (234) 567-8900 1.2.3.4")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i is None else f"s{i % 3}", "en", 7) for i, t in corpus() + ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_suffix_dedup(docs, rows):
    seen, want = {}, {}
    for d, t in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover[i : i + 100] = True
            seen.setdefault(b[i : i + 100], d)
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()) if len(b) else 0
        want[d] = len(b), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()
    got = suffix_dedup.repeated_spans(docs).collect()
    assert len(got) == len(rows) and all(tuple(r[1:5]) == want[r["doc_id"]] for r in got)


def test_loser_tree():
    r = np.random.default_rng(1)
    runs = [sorted(bytes(r.integers(97, 99, int(r.integers(1, 9))).tolist()) for _ in range(40)) for _ in range(7)]
    coded = []
    for k, run in enumerate(runs):
        row = suffix_dedup.front_code(0, [(x, 0, k, 0, i, 0) for i, x in enumerate(run)])
        coded.append(suffix_dedup.front_decode(row))
    out = list(suffix_dedup.loser_tree(coded))
    assert [x[1] for x in out] == sorted(x for run in runs for x in run)
    for a, b in zip(out, out[1:], strict=False):
        assert b[0] == suffix_dedup.common(a[1], b[1])


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, docs):
    odd = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111", "4111111111111111", "5 4111111111111111", "+1 (234) 567-8900 +12", "é𝒳 a@c-d.e ++1234567890", "4" * 9000, "%a@b.c%d@e.f-@g.h", "a" * 9000 + "@x.y", "1." * 3000]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in pii.digest(pii.find(df)).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r["spans"].split(",")[: len(want)] == (want or [""])[: len(want)]


def test_pii_shares_against_plain_counts(spark):
    rng = random.Random(5)
    people = [f"user{i}@mail.org" for i in range(6)]
    texts = []
    for _ in range(120):
        p = rng.randrange(len(people))
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "Über", "omega"]) for _ in range(12)]
        words[rng.randrange(12)] = people[p]
        words.insert(0, rng.choice([f"nick{p}", "common"]))
        texts.append(" ".join(words))
    texts += [texts[0]] * 40 + [texts[1]] * 3 + ["nick0 alone", "", None]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), disclosure=0.5, min_texts=2).collect()
    distinct = {t or "" for t in texts}
    has_term, has_entity, near = {}, {}, {}
    for t in distinct:
        for w in {x.lower() for x in re.findall(r"[^\W_]{3,}", t)}:
            has_term.setdefault(w, set()).add(t)
        for m in re.finditer(r"user\d@mail\.org", t):
            has_entity.setdefault(m[0], set()).add(t)
            before, after = t[: m.start()].split(), t[m.end() :].split()
            for w in before[-3:] + after[:3]:
                near.setdefault((m[0], w.lower()), set()).add(t)
    share = {}
    for (e, w), at in near.items():
        n_e = len(has_entity[e])
        if len(at) >= 2:
            share[e, w] = math.log(len(distinct) * len(at) / (len(has_term[w]) * n_e)) / math.log(len(distinct) / n_e)
    assert any(x >= 0.5 for x in share.values())
    for r in found:
        t = texts[r["doc_id"]] or ""
        got = {t[s["start"] : s["end"]].lower() for s in r["term"]}
        want = set()
        for m in re.finditer(r"user\d@mail\.org", t):
            want |= {w.lower() for w in t[: m.start()].split()[-3:] + t[m.end() :].split()[:3] if share.get((m[0], w.lower()), 0) >= 0.5}
        assert got == want


def test_pii_terms(spark):
    rows = [(i, f"note {i} about zorblat contact zed@corp.example the {WORDS[i]} thing") for i in range(4)] + [(10 + i, f"plain the note about {WORDS[i]} contact thing {i}") for i in range(12)]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all("term:13:20" in found[i] and found[i].count("term") == 1 for i in range(4)) and not any(found[10 + i] for i in range(12))
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 0").first()["text"]
    assert clean == "note 0 about  contact [EMAIL] the alpha thing"


def test_chat(spark):
    rows = [(1, 0, "u", "Hello there my good friend.\nHow are you today then?"), (1, 1, "a", "> Hello there my good friend.\n> How are you today then?\nFine, and you?"), (1, 2, "u", ">> Hello there my good friend.\n>> How are you today then?\n> Fine, and you?\nGood."), (1, 3, "a", "> how ARE you   today then?\n>\nSure"), (1, 4, "u", None), (2, 0, "u", ""), (2, 0, "u", ""), (None, None, None, "> x"), (3, 0, "u", ">" * 500 + " deep")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert [(got[1, t]["parent_turn"], got[1, t]["root_turn"], got[1, t]["depth"]) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (0, 0, 1), (None, 4, 0)]
    assert got[1, 2]["clean_text"] == "Good." and got[1, 2]["level"] == 2 and got[1, 4]["clean_text"] is None and got[None, None]["clean_text"] == ""
    assert chat.link_quotes(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://net/", "https://net", "http://x.org/fr/", "http://example.com/de/1#a", "ftp://badnet/", "nothing", None, "", "http://u://v", "http://example.net/en/\n", "://.net/", "http://a.net/"] + ["http://hot.example.net/en/1"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([(h, p, v) for v, h, p in url_rules.RULES], "host string, path string, verdict string")
    got = url_rules.apply_rules(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r["page_id"] is None:
            continue
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best)
    assert url_rules.apply_rules(pages.limit(0), rules).count() == 0


def test_quality(docs, rows):
    texts = dict(rows)
    for r in line_quality.judge(docs).collect():
        t = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(cover) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_quality_boilerplate(spark):
    r = np.random.default_rng(5)
    own = lambda n: " ".join(WORDS[i] + str(int(r.integers(1000))) for i in r.integers(0, 20, n))
    menu = " ".join(f"Menu{i}" for i in range(60))
    rows = [(i, f"{own(30)}\n{menu}\n{own(60)}", "h") for i in range(30)] + [(100, menu, "h"), (101, menu, "other"), (102, own(80), "h")]
    got = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and menu not in got[0]["clean_text"] and not got[100]["kept"] and got[101]["kept"] and got[102]["kept"]


def test_quality_removes_blocks_of_lines_and_leaves_near_copies(spark):
    r = np.random.default_rng(6)
    own = lambda n: " ".join(WORDS[i] + str(int(r.integers(10**6))) for i in r.integers(0, 20, n))
    footer = [" ".join(f"{part}{i}" for i in range(15)) for part in ("Imprint", "Cookies", "Licence", "Contact")]
    block = "\n".join(footer)
    rows = [(i, f"{own(60)}\n{block}", "h") for i in range(40)] + [(100 + i, f"{own(5)}\n{block}", "h") for i in range(5)]
    base = [own(8) for _ in range(20)]
    rows += [(200 + i, "\n".join([*base[: i % 20], own(8), *base[i % 20 + 1 :]]), "copies") for i in range(60)]
    got = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] and not any(x in got[i]["clean_text"] for x in footer) for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(5))
    assert all(got[i]["kept"] and got[i]["clean_text"] == t for i, t, host in rows if host == "copies")


def test_near_duplicates(docs, rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[d] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else ({tuple(w)} if w else set())
    ids = sorted(d for d in sets if d is not None)
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])) and r["kept"] == (r["doc_id"] == r["component_id"])


def test_large_nodes_are_finished(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_ROWS", 5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)] + [(100 + i, " ".join([*base[:100], *(f"y{i}_{j}" for j in range(60))])) for i in range(12)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 60} == {0} and all(r["kept"] for r in got if r["doc_id"] >= 100)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 200), (205, 203)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[205] == got[203] == 200 and got[200] == 200


def test_fuzzy_lines(docs, rows):
    occ, classes = [], {}
    for d, t in sorted({r for r in rows if r[0] is not None}):
        for i, line in enumerate(t.split("\n")):
            if m := fuzzy_lines.normal(line):
                occ.append((d, i, classes.setdefault(m, len(classes))))
    sets = [{m[i : i + 7] for i in range(max(len(m) - 6, 1))} for m in classes]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    seen, want = set(), {}
    for d, i, k in occ:
        if top(k) in seen:
            want.setdefault(d, []).append(i)
        seen.add(top(k))
    got = fuzzy_lines.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["removed"] == want.get(r["doc_id"], [])
    assert next(r for r in got if r["doc_id"] == 1000)["text"] is None


def test_decontamination(spark, docs, rows):
    item = " ".join(WORDS)
    items = spark.createDataFrame([(1, item), (2, "Short, item"), (3, None), (4, ""), (10, "nothing like this " * 6), (1, item)], "item_id long, text string")
    extra = spark.createDataFrame([(3000, "say SHORT item now"), (3001, "short"), (3002, item[: len(item) // 2])], "doc_id long, text string")
    texts = dict(rows) | {r[0]: r[1] for r in extra.collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = {}
    for i, t in ((1, item), (2, "Short, item"), (10, "nothing like this " * 6)):
        w = cut(t)
        for k in range(max(len(w) - 12, 1)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for r in decontam.contamination(docs.select("doc_id", "text").union(extra), items).collect():
        w = cut(texts[r["doc_id"]])
        hit, found = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_in_passes_and_near(spark, docs):
    items = spark.createDataFrame([(i, " ".join(WORDS[i:] + WORDS[:i])) for i in range(6)], "item_id long, text string")
    index = decontam.build_index(docs)
    kind = docs.schema["doc_id"].dataType
    key = lambda df: sorted((str(r["doc_id"]), r["n_words"], sorted(r["item_ids"]), [tuple(s) for s in r["hit_spans"]]) for r in df.filter("doc_id < 1000").collect())
    assert key(decontam.search(index, items, kind)) == key(decontam.search(index, items, kind, pass_bytes=200))
    gappy = spark.createDataFrame([(1, "alpha inserted beta gamma")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert decontam.search(decontam.build_index(gappy), one, kind, gap=1).first()["item_ids"] == [1]
    assert decontam.search(decontam.build_index(gappy), one, kind).first()["item_ids"] == []


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    import zlib

    pieces = Counter()
    for _, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())] += 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 1024) + 1


def test_local_search_empties_bins():
    bins = {(6, 1): 2, (5,): 1, (3, 2): 2, (4, 4): 1}
    out = packing.local_search(bins, 10)
    count = lambda b: Counter(x for k, n in b.items() for x in k for _ in range(n))
    assert count(out) == count(bins) and sum(out.values()) < sum(bins.values()) and all(sum(k) <= 10 for k in out)


@pytest.mark.parametrize("text", ["a  b   c", " lead", "trail ", "x\n y", "it's 12 o'clock\t\tnow \n\n z", "<|endoftext|> é𝒳", "a \nb", ""])
def test_chunked_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    chunked = packing.ChunkedEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert np.frombuffer(chunked(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_shards(docs, rows):
    got = shards.shard(docs, 6).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    for k in size:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    rest = sorted(r["size"] for r in got)[-1]
    assert max(size.values()) - min(size.values()) <= 2 * rest
    assert shards.shard(docs.limit(0), 6).count() == 0


@pytest.mark.parametrize("f", [lambda d: suffix_dedup.repeated_spans(d), lambda d: pii.digest(pii.find(d)), lambda d: line_quality.judge(d), lambda d: near_dup.near_duplicates(d), lambda d: fuzzy_lines.dedup_lines(d)])
def test_empty_tables(docs, f):
    assert f(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(9)
    own = lambda n: "\n".join(" ".join(f"{WORDS[i]}{int(r.integers(5000))}" for i in r.integers(0, 20, 12)) for _ in range(n // 12))
    bench = " ".join(f"bench{i}" for i in range(20))
    texts = [own(120) for _ in range(12)]
    texts += [texts[0], "short text", own(72) + "\n" + bench]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == set(range(12))


def test_components_by_rounds_of_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 200), (205, 203)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(frame, task_links=0).collect()}
    assert got == {r["id"]: r["component"] for r in components.components(frame).collect()} and len(got) == 46
    with pytest.raises(RuntimeError):
        components.components(frame, task_links=0, rounds=1)
    assert components.components(frame.limit(0), task_links=0).count() == 0


def test_least_reached():
    r = np.random.default_rng(4)
    for n in (1, 5, 200):
        a, b = r.integers(0, n, n), r.integers(0, n, n)
        ids, least = components.least_reached(a, b)
        up = {int(x): int(x) for x in ids}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[x] = up[y] = min(up[x], up[y])
        assert dict(zip(ids.tolist(), least.tolist(), strict=True)) == up


def test_groups_of_many_bytes_are_compared_in_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "CELL_BYTES", 2000)
    rows = pa.RecordBatch.from_pydict({"cell": [7] * 10, "rep": list(range(10)), "sketch": [b"\1" * 128] * 10, "bytes": [400] * 10})
    groups = [set(g) for out in near_dup._tighten(85)(iter([rows])) for g in out.column("reps").to_pylist()]
    assert all(any({a, b} <= g for g in groups) for a in range(10) for b in range(a)) and all(len(g) <= 6 for g in groups)


@pytest.mark.parametrize("levels", [0, 1])
def test_what_stays_large_is_compared_in_full(docs, rows, monkeypatch, levels):
    want = sorted(map(str, near_dup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dup, "NODE_ROWS", 2)
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    assert sorted(map(str, near_dup.near_duplicates(docs).collect())) == want


def test_lines_of_a_block_are_the_normal_ones():
    import pyarrow as pa

    r = random.Random(8)
    texts = ["".join(r.choice(["a", "B", "é", "𝒳", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", "z"]) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", " ", "\n", None, " a", "a ", "  \n a"]
    lines = fuzzy_lines.Lines(pa.chunked_array([pa.array(texts, pa.string())]))
    want = [(i, k, m) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if (m := fuzzy_lines.normal(x))]
    got = ["".join(map(chr, lines.points[i:j])) for i, j in zip(lines.starts, lines.ends, strict=True)]
    assert list(zip(lines.text.tolist(), lines.number.tolist(), got, strict=True)) == want
    assert all((m == n) == (h == g) for (_, _, m), h in zip(want, lines.hash, strict=True) for (_, _, n), g in zip(want[:50], lines.hash, strict=False))


def test_pipeline_of_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(10)
    own = lambda n: "\n".join(" ".join(f"{WORDS[i]}{int(r.integers(5000))}" for i in r.integers(0, 20, 12)) for _ in range(n // 12))
    texts = [own(120) for _ in range(4)]
    rows = [(0, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (None, texts[1], "en", "s", 1), (None, texts[2], "en", "s", 1), (4, texts[3] + "\n" + "long " * 60_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kept in (("odd", rows), ("none", [])):
        spark.createDataFrame(kept, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "no such passage " * 9), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {x["doc_id"] for x in out} == {0, None} and sum(x["piece"] == 0 for x in out) == 4
    assert pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/odd").columns == docs.columns, name


def test_one_id_with_two_texts(spark):
    r = np.random.default_rng(12)
    own = lambda n: [WORDS[i] + str(int(r.integers(999))) for i in r.integers(0, 20, n)]
    a, b, c = own(60), own(60), own(60)
    near = lambda w: " ".join([*w[:30], "other", *w[31:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (3, " ".join(c)), (4, near(c)), (4, near(c))]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_ids_of_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    chunked = packing.ChunkedEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "'s", "'LL", "a", "Word", "12", "345", "é", "ß", "𝒳", "中文", ".", "--", '"', "<|endoftext|>", "<", "|", "\x00", "e\u0301"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(chunked(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
