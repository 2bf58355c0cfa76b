import math

import pytest
from pyspark.sql import functions as F

from basketry.functions.lexicon import Brands, Gate, Modifiers
from basketry.operators import divergence, features, gates, model, resolver, search, taxonomy, vocabulary
from basketry.sources import readers, sinks


def baskets(spark, rows):
    m = spark.createDataFrame([(i, x, k) for i, _, items in rows for k, x in enumerate(items)] or [], "basket_id long, item string, pos int")
    return m, spark.createDataFrame([(i, l) for i, l, _ in rows], "basket_id long, label string")


def test_divergence_is_zero_bounded_and_symmetric(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.6, 0.4])], "p array<double>, q array<double>")
    rows = df.select(divergence.jsd_bits(F.col("p"), F.col("q")).alias("a"), divergence.jsd_bits(F.col("q"), F.col("p")).alias("b")).collect()
    assert rows[0].a == pytest.approx(1.0) and rows[1].a == 0.0
    assert all(r.a == pytest.approx(r.b) for r in rows)


def test_null_level_shrinks_and_repeats():
    base = [0.5, 0.3, 0.2]
    assert divergence.null95(base, 10) == divergence.null95(base, 10) > divergence.null95(base, 200) > 0
    assert divergence.null95(base, 0) == 0


def test_gate_layers(spark):
    g = Gate(always_merge=(r"\blite\b",), forced=frozenset({"dark sugar"}), varieties=frozenset({"thai basil"}), never_merge=frozenset({"black rice"}))
    rows = [("black rice", 50, 0.0, 0.0, 0.1), ("lite milk", 50, 0.5, 0.01, 0.1), ("dark sugar", 50, 0.5, 0.01, 0.1), ("a", 20, 0.07, 0.001, 0.1), ("a", 20, 0.3, 0.2, 0.1), ("a", 20, 0.2, 0.1, 0.1), ("a", 20, 0.01, 0.005, 0.1), ("a", 50, 0.3, 0.0, 0.1), ("thai basil", 5, 0.0, 0.0, 0.9), ("a", 5, 0.0, 0.0, 0.8), ("a", 4, 0.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "v string, n long, j double, z double, t double")
    got = [(x.g.action, x.g.layer) for x in df.select(divergence.decide(F.col("v"), F.col("n"), F.col("j"), F.col("z"), F.col("t"), g).alias("g")).collect()]
    tested = [(x, "statistical_gate") for x in ("review", "review", "preserve", "merge", "preserve")]
    assert got == [("preserve", "do_not_merge_exception"), ("merge", "always_merge_lexicon"), ("merge", "forced_merge_override"), *tested, ("preserve", "named_variety_lexicon"), ("review", "small_sample_review"), ("merge", "small_sample_default")]


def test_vocabulary_passes(spark):
    rows = [(i, "thai" if i < 24 else ("chinese" if i % 2 else "italian"), ["dark soy sauce"] if i < 24 else ["soy sauce"]) for i in range(74)]
    rows += [(100 + i, "chinese", ["fresh soy sauce"]) for i in range(4)] + [(200 + i, "thai", ["fish sauce", "sauce"]) for i in range(5)]
    m, l = baskets(spark, rows)
    members = vocabulary.group_mechanically(m)
    members, frozen = vocabulary.reduce_groups(m, members, Modifiers(tokens=frozenset({"fresh"})), Brands())
    groups = {r["item"]: (r["group"], r["source"]) for r in members.collect()}
    assert groups["fresh soy sauce"] == ("soy sauce", "modifier_strip")
    pairs = vocabulary.candidate_pairs(vocabulary.group_counts(m, members), {"dark"})
    assert [tuple(r) for r in pairs.collect()] == [("dark soy sauce", "soy sauce")]
    members, kept, queue = vocabulary.apply_outcomes(pairs, m, l, members, Gate())
    assert [(r["variant"], r["layer"]) for r in kept.collect()] == [("dark soy sauce", "statistical_gate")] and queue.count() == 0
    out = {r["id"]: r for r in vocabulary.compile_vocabulary(m, members, vocabulary.representatives(m, members, frozen), kept).collect()}
    assert out["dark_soy_sauce"]["parent_id"] == "soy_sauce" and out["soy_sauce"]["train_mention_count"] == 54
    assert [a["alias"] for a in out["soy_sauce"]["aliases"]] == ["fresh soy sauce", "soy sauce"]


def test_three_outcomes_of_the_gate(spark):
    groups = [("dark soy sauce", "thai", 24), ("soy sauce", "chinese", 25), ("soy sauce", "italian", 25), ("sweet soy sauce", "chinese", 12), ("sweet soy sauce", "italian", 8), ("dark hot sauce", "thai", 10), ("hot sauce", "mexican", 12)]
    rows, at = [], 0
    for item, label, n in groups:
        rows += [(at + i, label, [item]) for i in range(n)]
        at += n
    m, l = baskets(spark, rows)
    members = vocabulary.group_mechanically(m)
    pairs = vocabulary.candidate_pairs(vocabulary.group_counts(m, members), {"dark", "sweet"})
    members, kept, queue = vocabulary.apply_outcomes(pairs, m, l, members, Gate())
    assert [(r["variant"], r["base"]) for r in kept.collect()] == [("dark soy sauce", "soy sauce")]
    assert {r["item"]: (r["group"], r["source"]) for r in members.collect()}["sweet soy sauce"] == ("soy sauce", "statistical_gate")
    entry = vocabulary.review_entries(queue, m, members).first()
    assert (entry["decision_id"], entry["gate_route"], entry["variant_count"], entry["base_count"], entry["suggested"]) == ("dark_hot_sauce__vs__hot_sauce", "small_sample_review", 10, 12, "merge")
    assert entry["example_ids"] == [94, 95, 96, 97, 98] and entry["variant_top"][0]["label"] == "thai"
    decisions = spark.createDataFrame([(entry["decision_id"], "merge_into:soy sauce", "x", "note")], "decision_id string, decision string, decided_by string, note string")
    done, _ = vocabulary.apply_decisions(members, kept, queue, decisions)
    assert {r["item"]: (r["group"], r["source"]) for r in done.collect()}["dark hot sauce"] == ("soy sauce", "manual_review")
    nowhere = decisions.withColumn("decision", F.lit("merge_into:no such group"))
    with pytest.raises(vocabulary.DecisionError):
        vocabulary.apply_decisions(members, kept, queue, nowhere)


def test_moves_are_replayed_in_order():
    gone, frozen = vocabulary.replay_moves([("a", "b", None, "s"), ("b", "c", None, "s"), ("d", "a", None, "s"), ("e", "x", "gen x", "brand")], {"a": "A", "b": "B", "c": "C", "d": "D", "e": "E"})
    assert gone == {"a": ("b", "s"), "b": ("c", "s"), "e": ("x", "brand")}
    assert frozen == {"b": "B", "c": "C", "x": "gen x"}


def test_decisions_need_a_match(spark):
    members = spark.createDataFrame([("a", "a", "s", "", "dark a"), ("b", "b", "s", "", "a")], "item string, cleaned string, source string, rule string, group string")
    kept = spark.createDataFrame([], "variant string, base string, layer string, jsd_bits double, null95_bits double, variant_count long")
    queue = spark.createDataFrame([("dark_a__vs__a", "dark a", "a", 0.07, 0.01, 20, "merge")], "decision_id string, variant string, base string, jsd_bits double, null95_bits double, variant_count long, suggested string")
    with pytest.raises(vocabulary.DecisionError):
        vocabulary.apply_decisions(members, kept, queue, spark.createDataFrame([], "decision_id string, decision string, decided_by string, note string"))
    done, _ = vocabulary.apply_decisions(members, kept, queue, spark.createDataFrame([("dark_a__vs__a", "merge", "x", "why")], "decision_id string, decision string, decided_by string, note string"))
    assert {(r["item"], r["group"], r["source"]) for r in done.collect()} == {("a", "a", "manual_review"), ("b", "a", "s")}


def test_resolver_and_staging(spark):
    v = spark.createDataFrame([("red_pepper", "red pepper", 459, [("red pepper", "s", "", 1)]), ("sauce", "sauce", 50, [("Sauce", "s", "", 1)])], "id string, name string, train_mention_count long, aliases array<struct<alias:string,source:string,rule:string,train_frequency:long>>")
    m, l = baskets(spark, [(1, "x", ["Red Peppers", "zz hot red pepper", "red pepper", "???", "zzz qqq", "hot pepper"]), (2, "y", [])])
    r = resolver.Resolver(v, Modifiers(tokens=frozenset({"fresh"}), never=frozenset({"hot"}))).resolve(m)
    got = {x["item"]: (x["id"], x["method"], x["dropped"]) for x in r.collect()}
    lost = (None, "unresolved", None)
    assert got == {"Red Peppers": ("red_pepper", "cleaned_match", None), "zz hot red pepper": ("red_pepper", "token_drop_match", "zz hot"), "red pepper": ("red_pepper", "exact_alias", None), "???": lost, "zzz qqq": lost, "hot pepper": lost}
    rows = {x["basket_id"]: x for x in resolver.stage(m, l, r).collect()}
    assert rows[1]["item_ids"] == ["red_pepper"] and rows[1]["unresolved"] == ["???", "zzz qqq", "hot pepper"] and rows[1]["raw_count"] == 6
    assert rows[2]["item_ids"] == [] and rows[2]["raw_count"] == 0


def test_drops_come_from_the_stripped_key_and_generics_of_both_forms(spark):
    entry = "id string, name string, train_mention_count long, aliases array<struct<alias:string,source:string,rule:string,train_frequency:long>>"
    v = spark.createDataFrame([("blue_gear", "blue gear", 9, [("blue gear", "s", "", 1)]), ("widget", "widget", 5, [("widget", "s", "", 1)])], entry)
    brands = Brands(patterns=((r"\bshiny acme\b", "no such thing"), (r"\bacme\b", "widget")))
    r = resolver.Resolver(v, Modifiers(tokens=frozenset({"shiny"})), brands).resolve(spark.createDataFrame([("zz shiny blue gears",), ("shiny acme",), ("shiny zz",)], "item string"))
    got = {x["item"]: (x["id"], x["method"], x["dropped"]) for x in r.collect()}
    assert got == {"zz shiny blue gears": ("blue_gear", "token_drop_match", "zz"), "shiny acme": ("widget", "brand_resolved_match", None), "shiny zz": (None, "unresolved", None)}


def test_features_and_folds(spark):
    v = spark.createDataFrame([("basil", None), ("thai_basil", "basil")], "id string, parent_id string")
    m, l = baskets(spark, [(1, "x", ["thai_basil"]), (2, "x", ["thai_basil", "basil"]), (3, "y", [])])
    rows = features.feature_rows(m, l, features.feature_space(v))
    assert {r["basket_id"]: (r["indices"], r["parents"]) for r in rows.collect()} == {1: ([1], [0]), 2: ([0, 1], [0]), 3: ([], [])}
    assert {(r["basket_id"], r["index"], r["value"]) for r in features.design_matrix(rows, 0.3).collect()} == {(1, 1, 1.0), (1, 0, 0.3), (2, 0, 1.0), (2, 1, 1.0)}
    many = spark.range(103).selectExpr("id as basket_id", "if(id % 3 = 0, 'a', 'b') as label")
    for folded in (features.folds(many), features.seeded_folds(many)):
        assert folded.count() == 103 and gates.fold_spread(features.fold_balance(folded)).count() == 0


def test_scores_and_metrics(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "basket_id long, label string")
    matrix = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "basket_id long, index int, value double")
    coef = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 0.0), ("b", 0, 0.0), ("b", 1, 2.0)], "label string, index int, coefficient double")
    shares = model.softmax(model.logits(matrix, labels, coef, spark.createDataFrame([("a", 0.0), ("b", 0.0)], "label string, intercept double")))
    tops = model.top_label(shares)
    assert {r["basket_id"]: r["top"] for r in tops.collect()} == {1: "a", 2: "b", 3: "a"}
    p = math.exp(2) / (1 + math.exp(2))
    assert model.log_loss(shares, labels).first()[0] == pytest.approx((-2 * math.log(p) - math.log(0.5)) / 3)
    assert model.accuracy_macro_f1(model.per_label(tops, labels)).first() == (1.0, 1.0)
    bins = model.reliability(tops, labels)
    assert bins.count() == 10 and model.calibration_error(bins).first()[0] == pytest.approx((2 * (1 - p) + 0.5) / 3)
    assert gates.share_sum(shares).count() == 0


def test_search_and_taxonomy(spark):
    corpus = spark.createDataFrame([("soy_sauce", "soy sauce", 9, ["shoyu"]), ("soybean_paste", "soybean paste", 5, []), ("dark_soy_sauce", "dark soy sauce", 7, []), ("miso", "miso", 1, ["Soy paste"])], "id string, name string, mentions long, aliases array<string>")
    assert [r["id"] for r in search.search(corpus, " SOY ").collect()] == ["soy_sauce", "soybean_paste", "miso", "dark_soy_sauce"]
    assert search.search(corpus, "  ").count() == 0
    m, l = baskets(spark, [(1, "a", ["x", "x", "y"]), (2, "b", ["x"]), (3, "b", ["z"])])
    w = {(r["label"], r["item"]): r["weight"] for r in taxonomy.tfidf(m, l).collect()}
    assert w["a", "x"] == pytest.approx(math.log(1.5)) and w["b", "z"] == pytest.approx(0.5 * math.log(3))


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('[{"id": 1, "cuisine": "a", "ingredients": ["x"]}, {"id": 1, "cuisine": "a", "ingredients": ["y"]}]')
    with pytest.raises(readers.SourceError):
        readers.read_baskets(spark, str(p))
    p.write_text('[{"id": 1, "cuisine": "a", "ingredients": ["x", "x"]}]')
    assert readers.mentions_of(readers.read_baskets(spark, str(p), rows=1, labels=1)).count() == 2
    out = tmp_path / "deep" / "x.json"
    sinks.write_text_atomically(out, sinks.canonical_json({"b": 1, "a": "é"}))
    assert out.read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    a, b = spark.range(3).toDF("x"), spark.range(1, 4).toDF("x")
    assert sinks.mismatches(a, b).count() == 2 and sinks.table_fingerprint(a) == sinks.table_fingerprint(a.orderBy(F.desc("x")))


def test_gate_runner(spark):
    empty = spark.range(0)
    assert gates.run([gates.Gate("ok", empty)]) == ["ok"]
    with pytest.raises(gates.GateError):
        gates.run([gates.Gate("bad", spark.range(2))])


def test_the_samples_of_a_base_share_one_stream():
    import numpy as np

    def plain(p, n):
        upto = np.cumsum(p)
        u = np.random.RandomState([divergence.SEED]).random_sample(divergence.TRIALS * n) * upto[-1]
        found = np.minimum(np.searchsorted(upto, u, side="right"), len(p) - 1).reshape(-1, n)
        q = np.stack([np.bincount(x, minlength=len(p)) for x in found]) / n
        return float(np.sort(divergence._bits(np.asarray(p), q))[math.ceil(divergence.QUANTILE * divergence.TRIALS) - 1])

    for p in ([1.0], [0.5, 0.0, 0.5], [0.2, 0.19, 0.21, 0.2, 0.2]):
        assert divergence.null95s(p, [1, 40, 999, 0]) == {n: plain(p, n) if n else 0.0 for n in (1, 40, 999, 0)}


def test_eight_large_samples_cost_little_more_than_one():
    import time

    began = time.process_time()
    found = divergence.null95s([0.2, 0.19, 0.21, 0.2, 0.2], range(100_000, 100_800, 100))
    assert len(found) == 8 and time.process_time() - began < 6  # one by one, each took as long


def test_mentions_are_counted_before_any_cleaning_or_join(spark):
    v = spark.createDataFrame([("gear", "gear", 9, [("gear", "s", "", 1)])], "id string, name string, train_mention_count long, aliases array<struct<alias:string,source:string,rule:string,train_frequency:long>>")
    m = spark.range(1000).select(F.col("id").alias("basket_id"), F.when(F.col("id") % 3 == 0, "Red Gears").when(F.col("id") % 3 == 1, "nothing").alias("item"), F.lit(1).alias("pos"))
    found = resolver.Resolver(v, Modifiers(tokens=frozenset({"red"})), Brands(patterns=((r"\bacme\b", "gear"),)), python=False).resolve(m)

    def below(node):
        kids = node.children()
        for i in range(kids.size()):
            yield kids.apply(i)
            yield from below(kids.apply(i))

    def groupings(df):
        top = df._jdf.queryExecution().optimizedPlan()
        return [[(n.nodeName(), n.toString().split("\n")[0]) for n in below(x)] for x in [top, *below(top)] if x.nodeName() == "Aggregate"]

    over_mentions = lambda x: all(name != "Aggregate" for name, _ in x) and any(name == "Range" for name, _ in x)
    lowest = [x for x in groupings(found) if over_mentions(x)]
    assert lowest and not any("replace" in text or "translate" in text for x in lowest for _, text in x)
    for df in (resolver.resolution_statistics(m, found), resolver.top_unresolved(m, found)):
        lowest = [x for x in groupings(df) if over_mentions(x)]
        assert lowest and not any(name == "Join" for x in lowest for name, _ in x)
    got = {r["method"]: (r["mentions"], r["share"]) for r in resolver.resolution_statistics(m, found).collect()}
    assert got["modifier_stripped_match"] == (334, 0.334) and got["unresolved"] == (333, 0.333)  # and 333 without an item
    assert [tuple(r) for r in resolver.top_unresolved(m, found).collect()] == [("nothing", 333)]
    empty = m.filter("basket_id < 0")
    assert {tuple(r)[1:] for r in resolver.resolution_statistics(empty, found).collect()} == {(0, 0.0)}


def test_features_of_a_basket_come_from_its_own_row(spark):
    rows = spark.createDataFrame([(1, [0, 2], [2, 5]), (2, [], []), (3, [4], [])], "basket_id long, indices array<int>, parents array<int>")
    got = lambda w: {tuple(r) for r in features.design_matrix(rows, w).collect()}
    assert got(0.3) == {(1, 0, 1.0), (1, 2, 1.0), (1, 5, 0.3), (3, 4, 1.0)} and got(0.0) == {(1, 0, 1.0), (1, 2, 1.0), (3, 4, 1.0)}
    assert got(2.0) == {(1, 0, 1.0), (1, 2, 2.0), (1, 5, 2.0), (3, 4, 1.0)}
    assert "Exchange" not in features.design_matrix(rows, 0.3)._jdf.queryExecution().executedPlan().toString()


def test_large_inputs_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from basketry import session

    spark.range(20_000).selectExpr("id", "id % 7 AS basket_id").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    assert session.spread(df, "basket_id") is df
    assert session.spread(spark.createDataFrame([(1,)], "basket_id long"), "basket_id").rdd.getNumPartitions() < 100  # of no known size
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    more = session.spread(df, "basket_id")
    assert more.rdd.getNumPartitions() > 50 and more.count() == 20_000


def test_gates_on_rows_are_counted_in_one_pass(spark):
    rows = spark.range(10)
    checks = [gates.of_rows("odd", rows, F.col("id") % 2 == 1, "id"), gates.Gate("none", rows.filter("id > 99")), gates.of_rows("high", rows, F.col("id") > 6, "id")]
    out = gates.report(checks)
    assert {tuple(r) for r in out.collect()} == {("odd", 5), ("none", 0), ("high", 3)}
    assert out._jdf.queryExecution().analyzed().toString().count("Range (0, 10") == 2
    assert sorted(r[0] for r in checks[2].violations.collect()) == [7, 8, 9]
