"""The verdict of the quality rules under a filter, and its SQL on boilerplate blocks and near-copies."""

import time

import duckdb
import numpy as np

from basketry.llm import line_quality

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, source string"


def test_a_filter_costs_no_more_than_the_verdict(spark):
    r = np.random.default_rng(2)
    text = "\n".join(" ".join(WORDS[i] for i in r.integers(0, 20, 20)) for _ in range(100))
    docs = spark.createDataFrame([(i, f"{text} w{i}", "s") for i in range(20)], SCHEMA)
    want = {x["doc_id"]: (x["n_repeat_words"], x["kept"]) for x in line_quality.judge(docs).collect()}
    began = time.time()
    assert {x["doc_id"] for x in line_quality.judge(docs).filter("kept").select("doc_id", "clean_text").collect()} == {i for i, x in want.items() if x[1]}
    assert {x["doc_id"] for x in line_quality.judge(docs).filter("n_repeat_words > 100").select("doc_id").collect()} == {i for i, x in want.items() if x[0] > 100}
    assert time.time() - began < 60


def test_sql_of_blocks_and_near_copies(spark, tmp_path):
    r = np.random.default_rng(6)
    own = lambda n: " ".join(WORDS[i] + str(int(r.integers(10**6))) for i in r.integers(0, 20, n))
    block = "\n".join(" ".join(f"{part}{i}" for i in range(15)) for part in ("Imprint", "Cookies", "Licence", "Contact"))
    rows = [(i, f"{own(60)}\n{block}", "h") for i in range(40)] + [(100 + i, f"{own(5)}\n{block}", "h") for i in range(5)]
    base = [own(8) for _ in range(20)]
    rows += [(200 + i, "\n".join([*base[: i % 20], own(8), *base[i % 20 + 1 :]]), "copies") for i in range(60)]
    rows += [(300, None, "h"), (301, "", None), (302, " \n\t", "h"), (200, rows[50][1], "h"), (None, "no id", "h")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted((tuple(x) for x in con.execute(f"SELECT {', '.join(line_quality.COLUMNS)} FROM ({line_quality.SQL})").fetchall()), key=key)
    got = sorted((tuple(x) for x in line_quality.query(spark, str(tmp_path)).collect()), key=key)
    assert got == want and len(got) == len(rows)
