import math

from pyspark.sql import functions as F

import __spark_entry__ as entry

from basketry.operators import divergence, reports
from basketry.streaming import scorer


def test_stream_scores_like_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b", "b"]), (2, [])], "id long, items array<string>")
    rows.write.parquet(f"{tmp_path}/in")
    weights, base = {"x": {"a": 1.0}, "y": {"b": 2.0}}, {"x": 0.0, "y": 0.0}
    score = lambda df: scorer.label_scores(df, weights, base)
    got = []
    q = scorer.score_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda df, n: got.extend(df.collect()), f"{tmp_path}/cp", score)
    q.awaitTermination(60)
    shares = {r["id"]: r["shares"] for r in got}
    assert abs(shares[1]["y"] - 1 / (1 + math.exp(-1))) < 1e-12 and shares[2] == {"x": 0.5, "y": 0.5}
    assert {r["id"]: r["shares"] for r in score(rows).collect()} == shares


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_scores_with_parents(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "id long, items array<string>")
    got = {r["id"]: r["shares"] for r in scorer.label_scores(rows, {"x": {"b": 2.0}}, {"x": 0.0, "y": 0.0}, 1.0, {"a": "b"}, 0.5).collect()}
    assert abs(got[1]["x"] - 1 / (1 + math.exp(-1))) < 1e-12 and abs(got[2]["x"] - 1 / (1 + math.exp(-2))) < 1e-12


def test_reports(spark):
    balance = spark.createDataFrame([("a", 1, 2)], "label string, fold_0 long, fold_1 long")
    assert "| a | 1 | 2 |" in reports.fold_balance_report(balance)
    stats = spark.createDataFrame([("exact_alias", 3, 0.75), ("unresolved", 1, 0.25)], "method string, mentions long, share double")
    summary = spark.createDataFrame([(4, 0.75, 0.75)], "mentions_total long, alias_tier_coverage double, full_chain_coverage double")
    sizes = spark.createDataFrame([(2, 3, 1)], "ingredient_count long, alias_count long, preserved_variant_count long")
    payload = reports.coverage_payload({"train": stats}, {"train": summary}, sizes, spark.createDataFrame([("manual_alias", 3)], "source string, aliases long"), spark.createDataFrame([("1", 2)], "bucket string, groups long"), spark.createDataFrame([("odd", 1)], "item string, mentions long"), {"seed": 42})
    text = reports.coverage_report(payload)
    assert "| exact_alias | 3 | 75.00% |" in text and "- odd (1)" in text and "- Preserved variants: 1" in text and "| manual_alias | 3 |" in text
    folds = spark.createDataFrame([(0, 0.5, 0.4, 1.1)], "fold long, accuracy double, macro_f1 double, log_loss double")
    frames = {"folds": folds, "mean": folds.drop("fold"), "per_label": spark.createDataFrame([("a", 3, 0.5)], "label string, basket_count long, recall double"), "confusion_pairs": spark.createDataFrame([("a", "b", 3, None)], "truth string, predicted string, n long, similarity double")}
    text = reports.evaluation_report(frames, {"c": 1.0, "parent_weight": 0.3}, {"temperature": 1.0, "ece_before": 0.1, "ece_after": 0.05}, {"pooled_oof_log_loss": 2.0, "mean_accuracy": 0.1, "mean_macro_f1": 0.1}, [(1.5, 1.0, 0.3)])
    assert "| a | b | 3 | — |" in text and "| logistic regression | 1.5 | 0.5 | 0.4 |" in text and "| mean | 0.5 | 0.4 | 1.1 |" in text


def test_shown_top(spark):
    top = spark.createDataFrame([([("thai", 0.525, 4.04)],), ([],)], "top array<struct<label:string,share:double,lift:double>>")
    assert [r[0] for r in top.select(divergence.shown_top(F.col("top"))).collect()] == ["thai 52.5% (4.0x)", "(none)"]


def test_scores_work_out_each_step_once(spark):
    import time

    names, labels = [f"item {i:03d}" for i in range(300)], list("vwxyz")
    weights = {l: {n: ((i * 7 + k) % 13 - 6) / 10 for i, n in enumerate(names[:250])} for k, l in enumerate(labels)}
    base, parents = {l: k / 10 for k, l in enumerate(labels)}, dict(zip(names[:200], names[50:250], strict=True))
    baskets = {b: sorted({names[(b * 17 + j * 29) % 300] for j in range(6)}) for b in range(60_000)}

    def plain(items):
        up = sorted({parents[i] for i in items if i in parents} - set(items))
        z = [(base[l] + sum(weights[l].get(i, 0) for i in items) + 0.3 * sum(weights[l].get(i, 0) for i in up)) / 2 for l in labels]
        return [math.exp(x) / sum(map(math.exp, z)) for x in z]

    rows = spark.createDataFrame(list(baskets.items()), "id long, items array<string>").union(spark.createDataFrame([(-1, ["item 000", None, "nothing"]), (-2, None)], "id long, items array<string>"))
    began = time.time()
    got = {r["id"]: r["shares"] for r in scorer.label_scores(rows, weights, base, 2.0, parents, 0.3).collect()}
    assert time.time() - began < 20
    for b in range(0, 60_000, 1501):
        assert all(abs(got[b][l] - x) < 1e-12 for l, x in zip(labels, plain(baskets[b]), strict=True))
    assert all(abs(got[-1][l] - x) < 1e-12 for l, x in zip(labels, plain(["item 000"]), strict=True))
