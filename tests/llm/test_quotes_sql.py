"""Quotation linking against its SQL on planted quotes: all depths, repeated passages, odd rows."""

import duckdb
import pytest

from basketry.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string"


def run(spark, tmp_path, rows):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = chat.query(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.SQL})").fetchall()
    key = lambda r: str(tuple(r))
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)


@pytest.mark.parametrize("level", [1, 2, 99, 100, 101, 205, 3000])
def test_any_depth_links(spark, level):
    rows = [(1, 0, "u", "First words of the thread"), (1, 1, "a", ">" * level + " First words of the thread\nand an answer to it")]
    got = {r["turn"]: r for r in chat.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["level"], got[1]["n_passages"], got[1]["n_linked"], got[1]["parent_turn"], got[1]["clean_text"]) == (level, 1, 1, 0, "and an answer to it")


def test_sql_of_planted_quotes(spark, tmp_path):
    say = ["Alpha beta gamma delta epsilon", "zeta eta theta iota", "kappa lambda mu nu xi omicron"]
    rows = [(c, 0, "user", "\n".join(say)) for c in range(4)]
    rows += [(0, 1, "assistant", f"> {say[0]}\n> {say[1]}\n> {say[2]}\nAn answer with words of its own"), (0, 2, "user", f">> {say[0]}\n>> {say[1]}\n>> {say[2]}\n> An answer with words of its own\nThanks")]
    rows += [(1, 1, "assistant", f"> {say[1].upper()}\nfirst\n> {say[1]}\nsecond"), (1, 2, "user", f" > > {say[2]}\n\t> nothing that was said\n{say[0]}")]
    rows += [(2, 1, "assistant", ">\n> \n"), (2, 2, "user", None), (2, 3, "user", ""), (2, 4, "user", ">" * 205 + say[0] + "\n" + ">" * 200 + say[1])]
    rows += [(3, t, "user", f"> {say[0]}\nturn {t} says something new here\n" + "".join(f"> turn {k} says something new here\n" for k in range(1, t))) for t in range(1, 9)]
    rows += [(5, 0, "user", "x\r\n> y"), (5, 1, "user", "> x\r\n>> y")]
    got, want = run(spark, tmp_path, rows)
    assert got == want and any(r[5] for r in got)
