"""All ten operators: empty tables, extra columns with clashing names, texts longer than a block, ties."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import chat, decontam, fuzzy_lines, line_quality, near_dup, packing, pii, runtime, shards, suffix_dedup, url_rules

DOCS, PAGES, TALK = "doc_id long, text string, source string", "page_id long, url string", "conv_id long, turn int, role string, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def items(spark):
    return spark.createDataFrame([(1, " ".join(WORDS)), (2, "beta gamma")], "item_id long, text string")


def rules(spark):
    return spark.createDataFrame([(h, p, v) for v, h, p in url_rules.RULES], "host string, path string, verdict string")


OPERATORS = {
    "suffix": (DOCS, lambda s, d: suffix_dedup.repeated_spans(d)),
    "pii": (DOCS, lambda s, d: pii.digest(pii.find(d, whole_texts=True))),
    "chat": (TALK, lambda s, d: chat.link_quotes(d).select("conv_id", "turn", *chat.ADDED)),
    "url": (PAGES, lambda s, d: url_rules.apply_rules(d, rules(s))),
    "quality": (DOCS, lambda s, d: line_quality.judge(d).select(line_quality.COLUMNS)),
    "near": (DOCS, lambda s, d: near_dup.near_duplicates(d)),
    "lines": (DOCS, lambda s, d: fuzzy_lines.dedup_lines(d).select("doc_id", "text", "n_lines", "n_removed", "removed")),
    "leaks": (DOCS, lambda s, d: decontam.contamination(d, items(s)).drop("hit_spans")),
    "packing": (DOCS, lambda s, d: packing.pack(d, *tokenizer()).drop("sequence_id", "offset")),
    "shards": (DOCS, lambda s, d: shards.shard(d, 3).drop("slot", "shard")),
}
#: Names that the operators use inside or return.
CLASHES = ("kept", "n_words", "id", "tie", "key", "size", "shard", "slot", "range", "h", "row", "piece", "start", "length", "block", "nth", "rep", "node", "component", "spans", "email", "term", "host", "path", "rule", "verdict", "part", "salt", "level", "depth", "root_turn", "parent_turn", "source_", "_id", "_tie", "_host", "_k1", "drop", "removed", "bytes", "label")


def rows_of(schema):
    if schema == PAGES:
        return [(1, "http://a.net/x"), (2, None), (3, ""), (None, "https://example.net/en/1"), (3, "")]
    if schema == TALK:
        return [(1, 0, "u", "said before by me"), (1, 1, "a", "> said before by me\nyes"), (None, 2, "u", None), (2, None, "u", "")]
    return [(1, " ".join(WORDS * 8), "s"), (2, None, "s"), (3, "", None), (None, "beta gamma a@b.example", "t"), (4, " ".join(WORDS * 8), "t"), (4, " ".join(WORDS * 8), "t")]


def plain(df):
    return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    schema, f = OPERATORS[name]
    assert f(spark, spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(spark, name):
    schema, f = OPERATORS[name]
    docs = spark.createDataFrame(rows_of(schema), schema)
    more = docs.withColumns({c: F.lit("x") for c in CLASHES if c not in docs.columns})
    assert plain(f(spark, more)) == plain(f(spark, docs)) and len(plain(f(spark, docs))) >= len(rows_of(schema))


@pytest.mark.parametrize("f", [line_quality.judge, fuzzy_lines.dedup_lines, pii.sanitise])
def test_other_columns_come_through(spark, f):
    names = [c for c in CLASHES if c not in ("kept", "n_words", "removed")]
    docs = spark.createDataFrame(rows_of(DOCS), DOCS).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for c in names})
    out = f(docs).collect()
    assert len(out) == len(rows_of(DOCS)) and all(r[c] == f"{c}{r['doc_id'] or 0}" for r in out for c in names)


@pytest.mark.parametrize("name", OPERATORS)
def test_text_longer_than_a_block(spark, name):
    schema, f = OPERATORS[name]
    digests = (hashlib.md5(str(i).encode()).hexdigest() for i in range(runtime.BLOCK_BYTES // 32 + 1))
    long = "\n".join(f"{x[:9]} {x[9:20]} {x[20:]}" for x in digests)
    assert len(long) > runtime.BLOCK_BYTES
    if schema == PAGES:
        out = f(spark, spark.createDataFrame([(1, f"http://a.net/{long}"), (2, "http://a.net/")], schema)).collect()
        assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "block"}
        return
    if schema == TALK:
        quoted = "\n".join(f"> {x}" for x in long.split("\n"))
        out = {r["turn"]: r for r in f(spark, spark.createDataFrame([(1, 0, "u", long), (1, 1, "a", f"{quoted}\nall of it")], schema)).collect()}
        assert out[1]["parent_turn"] == 0 and out[1]["clean_text"] == "all of it" and out[1]["n_passages"] == 1
        return
    out = f(spark, spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, "beta gamma", "s")], schema)).collect()
    by = {r["doc_id"]: r for r in out}
    want = {"suffix": ("n_removed", 0, len(long)), "near": ("component_id", 1, 1), "lines": ("n_removed", 0, long.count("\n") + 1), "leaks": ("n_items", 0, 0), "quality": ("kept", True, True), "pii": ("n_email", 0, 0)}
    if name in want:
        column, first, second = want[name]
        assert (by[1][column], by[2][column]) == (first, second)
    elif name == "shards":
        assert by[1]["size"] == len(long) + 8 and by[1]["text_crc32"] == zlib.crc32(long.encode())
    else:
        assert Counter(r["doc_id"] for r in out)[1] == Counter(r["doc_id"] for r in out)[2] > 1000


def test_equal_rules_block(spark):
    twice = spark.createDataFrame([("a.net", "/x", "allow"), ("a.net", "/x", "block"), ("a.net", "/x", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, "http://b.a.net/x/1") for i in range(50)], PAGES)
    assert {r["verdict"] for r in url_rules.apply_rules(pages, twice).collect()} == {"block"}


def test_shards_against_plain_sums(spark):
    """Each shard holds the rows whose middle lies in its part of the running sum, within one text of the mean."""
    rows = [(i, "x" * (i * 37 % 200), "s") for i in range(400)] + [(None, None, "s")] * 5 + [(7, "same row " * 9, "s")] * 300
    docs = spark.createDataFrame(rows, DOCS)
    got = shards.shard(docs, 6, per_range=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    total, most = sum(size(t) for _, t, _ in rows), max(size(t) for _, t, _ in rows)
    for k in range(6):
        own = [r for r in got if r["shard"] == k]
        assert abs(sum(r["size"] for r in own) - total / 6) <= most and sorted(r["slot"] for r in own) == list(range(len(own)))


def test_local_folder_only_in_local_sessions(monkeypatch):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert runtime.shared_dir(Session()).startswith("file:")
