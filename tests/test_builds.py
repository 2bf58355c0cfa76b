"""The four builds one after another on a small corpus, their gates on spoiled tables, and what is read back."""

import math
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.lexicon import Brands, Gate, Lexicons, LexiconError, Modifiers
from basketry.operators import exports, features, gates, model, predict, resolver, validators
from basketry.plans import builds
from basketry.sources import artifacts

LABELS = {"thai": "asian", "italian": "european", "mexican": "american"}
OWN = {"thai": ["fish sauce", "thai basil", "dark soy sauce", "lime"], "italian": ["olive oil", "basil", "tomatoes"], "mexican": ["lime", "tortillas", "tomatoes", "soy sauce"]}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = random.Random(4)
    names = sorted(LABELS)
    items = lambda label: r.sample(OWN[label], r.randint(2, len(OWN[label]))) + ["salt"] * (r.random() < 0.5) + (["fresh Basil"] if r.random() < 0.2 else []) + (["ACME® lime!"] if r.random() < 0.1 else [])
    train = [(i, names[i % 3], items(names[i % 3])) for i in range(150)]
    test = [(1000 + i, None, items(names[i % 3]) + ["a thing unheard of"] * (i == 0)) for i in range(20)]
    schema = "id long, label string, items array<string>"
    lexicons = Lexicons(modifiers=Modifiers(tokens=frozenset({"fresh"})), brands=Brands(patterns=((r"\bacme\b", "lime"),)), gate=Gate(varieties=frozenset({"thai basil"})), variant_tokens=frozenset({"dark", "thai"}), families=LABELS)
    at = str(tmp_path_factory.mktemp("tiers"))
    floors = {"train": 0.9, "test": 0.9}
    build = builds.silver(spark, spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), lexicons, f"{at}/silver", floors=floors, alias_floor=0.9)
    builds.gold(spark, f"{at}/silver", f"{at}/gold")
    constants = builds.train(spark, f"{at}/gold", f"{at}/silver", f"{at}/model", weights=(0.0, 0.3), cs=(1.0,), max_iterations=20)
    recipes = [("nothing", True, ()), ("thai one", True, ("fish_sauce", "lime", "not_a_real_item"))]
    builds.app(spark, f"{at}/model", f"{at}/gold", f"{at}/silver", f"{at}/app", recipes)
    return at, build, constants, lexicons


def test_silver(spark, built):
    at, build, _, lexicons = built
    inputs = artifacts.load_silver_inputs(spark, f"{at}/silver")
    v = {r["id"]: r for r in inputs.vocabulary.collect()}
    assert "basil" in v and "fresh_basil" not in v and [a["alias"] for a in v["basil"]["aliases"] if a["source"] == "canonical_surface_form"] == ["basil"]
    assert {a["source"] for a in v["lime"]["aliases"]} == {"canonical_surface_form", "brand_pattern"}
    assert inputs.baskets_train.count() == 150 and inputs.baskets_test.filter("size(unresolved) > 0").count() == 1
    assert artifacts.read_document(spark, f"{at}/silver/build.json") == build
    spoiled = inputs.baskets_train.withColumn("item_ids", F.when(F.col("basket_id") == 3, F.array(F.lit("nowhere"), F.lit("nowhere"))).otherwise(F.col("item_ids")))
    with pytest.raises(gates.GateError, match="ids are in the vocabulary.*ids stand once"):
        gates.run(validators.staged_gates(spoiled, inputs.vocabulary, 150, LABELS))
    with pytest.raises(gates.GateError, match="have a family"):
        gates.run(validators.family_gates(inputs.baskets_train.select("label"), LABELS | {"greek": "european"}))
    stats = spark.read.parquet(f"{at}/silver/statistics")
    totals = stats.groupBy("split").agg(F.sum("mentions").alias("mentions_total"))
    lost = spark.read.parquet(f"{at}/silver/unresolved")
    with pytest.raises(gates.GateError, match="every method"):
        gates.run(validators.statistics_gates(stats.filter("method <> 'unresolved'"), totals, lost, {}, 0.0))
    with pytest.raises(gates.GateError, match="the sum"):
        gates.run(validators.statistics_gates(stats, totals.withColumn("mentions_total", F.col("mentions_total") + 1), lost, {}, 0.0))
    with pytest.raises(gates.GateError, match="alike"):
        gates.run(validators.build_gates(spark, {"a": {"x": 1}, "b": {"x": 2}}, ["x"]))
    with pytest.raises(gates.GateError, match="fresh"):
        gates.run(validators.build_gates(spark, {"a": {"x": 1}}, ["x"], {"x": 2}))


def test_gold(spark, built):
    at = built[0]
    staged = artifacts.load_silver_inputs(spark, f"{at}/silver").baskets_train
    gold = artifacts.load_gold_model_inputs(spark, f"{at}/gold", f"{at}/silver")
    assert gold.rows_train.count() == 150 and gates.run(validators.fold_gates(gold.folds, staged))
    with pytest.raises(gates.GateError, match="follow from"):
        gates.run(validators.rows_gates(gold.rows_train.withColumn("label", F.lit("thai")), gold.space, staged))
    with pytest.raises(gates.GateError, match="balance"):
        gates.run(validators.balance_gates(features.fold_balance(gold.folds).withColumn("fold_0", F.lit(0).cast("long")), gold.folds))


def test_model(spark, built):
    at, _, constants, _ = built
    blends = artifacts.read_table(spark, f"{at}/model", "blends")
    assert blends.count() == 20 and constants["calibration"]["temperature"] > 0
    assert [x for x in constants["grid"]] == sorted(constants["grid"]) and constants["baseline"]["mean_accuracy"] > 0.5
    rows = spark.read.option("header", True).csv(f"{at}/model/submission")
    with pytest.raises(gates.GateError, match="top labels"):
        gates.run(validators.submission_gates(rows.withColumn("cuisine", F.lit("thai")), blends))
    with pytest.raises(gates.GateError, match="header"):
        gates.run(validators.submission_gates(rows.toDF("id", "label"), blends))
    with pytest.raises(gates.GateError, match="temperature.*loses"):
        gates.run(validators.calibration_gates(spark, {"temperature": 1e3, "log_loss_before": 1.0, "log_loss_after": 1.1}))
    frames = {"folds": artifacts.read_table(spark, f"{at}/model", "folds_evaluated"), **{k: artifacts.read_table(spark, f"{at}/model", k) for k in ("mean", "per_label", "confusion_pairs")}}
    nothing = spark.createDataFrame([], "truth string, predicted string, similarity double")
    with pytest.raises(gates.GateError, match="means.*recall.*best"):
        frames |= {"mean": frames["mean"].withColumn("accuracy", F.col("accuracy") + 1), "per_label": frames["per_label"].filter("label <> 'thai'"), "confusion_pairs": frames["confusion_pairs"].limit(0)}
        gates.run(validators.evaluation_gates(frames, {"c": 3.0, "parent_weight": 0.0}, LABELS, [(0.1, 1.0, 0.0), (0.2, 3.0, 0.0)], nothing))


def test_app(spark, built):
    at = built[0]
    get = lambda name: artifacts.read_table(spark, f"{at}/app", name)
    items = {r["id"]: r for r in get("ingredients").collect()}
    assert items["soy_sauce"]["children"] == ["dark_soy_sauce"] or items["basil"]["children"] == ["thai_basil"]
    assert all(a["alias"] != r["name"] for r in items.values() for a in r["aliases"])
    vectors = {r["name"]: r for r in get("contract_vectors").collect()}
    assert vectors["thai one"]["top"] == "thai" and vectors["nothing"]["contributions"] is None
    assert abs(sum(vectors["nothing"]["blend"]) - 1) < 0.002
    assert {r["label"] for r in get("cuisines").collect()} == set(LABELS) and get("card_reliability_after").count() == 10
    card = artifacts.fetch_asset(spark, f"{at}/app/model_card.json")
    assert card is artifacts.fetch_asset(spark, f"{at}/app/model_card.json") and card["parent_weight"] in (0.0, 0.3)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.fetch_asset(spark, f"{at}/app/nothing.json")
    with pytest.raises(gates.GateError, match="parents and children"):
        gates.run(validators.ingredients_asset_gates(get("ingredients").withColumn("parent_id", F.lit("nobody")), get("asset_features")))
    with pytest.raises(gates.GateError, match="on the circle.*recall"):
        gates.run(validators.cuisines_asset_gates(get("cuisines").withColumns({"x": F.lit(2.0), "recall": F.lit(None).cast("double")}), get("edges"), get("ingredients"), 3))
    with pytest.raises(gates.GateError, match="bins before"):
        gates.run(validators.card_gates({"per_label": get("card_per_label"), "reliability_before": get("card_reliability_before").limit(3), "reliability_after": get("card_reliability_after")}, 3))
    with pytest.raises(gates.GateError, match="largest"):
        gates.run(validators.vector_gates(get("contract_vectors").withColumn("top", F.lit("none")), sorted(LABELS)))
    asset = {"coefficients": get("asset_coefficients"), "intercepts": get("asset_intercepts"), "features": get("asset_features"), "temperature": 0.0, "parent_weight": 0.3}
    with pytest.raises(gates.GateError, match="labels are as many.*constants"):
        gates.run(validators.model_asset_gates(asset, 4, get("asset_features").count()))
    with pytest.raises(gates.GateError, match="known ids"):
        exports.contract_vectors(exports.recipes_of(spark, [("odd", True, ("no_such",))]), asset)


def test_prediction(spark, built):
    at, _, constants, lexicons = built
    inputs = artifacts.load_app_export_inputs(spark, f"{at}/model", f"{at}/gold", f"{at}/silver")
    asset = exports.scoring_model(inputs.coefficients, inputs.intercepts, inputs.space, constants["calibration"]["temperature"], 0.3)
    found = predict.predict(spark, predict.split_items("Fish Sauce, thai basil,, wonder stuff"), resolver.Resolver(inputs.vocabulary, lexicons.modifiers, lexicons.brands), asset)
    lines = {r["pos"]: r["line"] for r in predict.resolution_lines(found.resolution).collect()}
    assert lines[0] == "  'Fish Sauce' -> fish_sauce [cleaned_match]" and lines[2] == "  'wonder stuff' -> UNRESOLVED [unresolved]"
    assert predict.blend_lines(found.blend).first()["line"].endswith("%  thai") and {r["id"] for r in found.contributions.collect()} == {"fish_sauce", "thai_basil", "basil"}


def test_waves_wait_for_what_may_change_them():
    from basketry.operators import vocabulary

    pairs = [("a b c", "b c"), ("d b c", "b c"), ("e f g", "f g"), ("x c", "c")]
    wave, rest = vocabulary.next_wave(pairs, {})
    assert wave == [("a b c", "b c"), ("e f g", "f g")] and rest == [("d b c", "b c"), ("x c", "c")]
    assert vocabulary.next_wave(rest, {"b c": "c"})[0] == [("d b c", "c")]


def test_chunked_draws_are_the_same(monkeypatch):
    from basketry.operators import divergence

    base = [0.5, 0.3, 0.2]
    want = divergence.null95(base, 37)
    for size in (5, 37, 100, 1000):
        monkeypatch.setattr(divergence, "DRAWN_AT_ONCE", size)
        assert divergence.null95(base, 37) == want


def test_lexicon_folder(tmp_path):
    with pytest.raises((LexiconError, OSError)):
        Lexicons.load(tmp_path)
    files = {
        "singularize_exceptions": '{"irregular": {}, "no_singularize": []}',
        "modifier_strip": '{"strip_phrases": [], "strip_tokens": ["fresh"], "conditional_tokens": {}, "never_strip_tokens": [], "protected_strings": []}',
        "brand_patterns": '{"keep_as_ingredient": [], "patterns": []}',
        "always_merge_patterns": '{"patterns": []}',
        "forced_merge_overrides": '{"overrides": []}',
        "named_varieties": '{"varieties": []}',
        "do_not_merge": '{"exceptions": []}',
        "manual_aliases": '{"_note": "x", "dri basil": "dried basil"}',
        "variant_modifier_tokens": '{"tokens": ["dark"]}',
        "cuisine_families": '{"families": {"_note": "x", "thai": "asian"}}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = Lexicons.load(tmp_path)
    assert found.families == {"thai": "asian"} and found.aliases == {"dri basil": "dried basil"} and found.variant_tokens == {"dark"}


def test_the_temperature_is_that_of_the_golden_section(spark):
    r = random.Random(3)
    z = {i: [r.gauss(0, 3) for _ in range(4)] for i in range(40)}
    own = {i: max(range(4), key=lambda k: z[i][k] + r.gauss(0, 4)) for i in z}
    scores = spark.createDataFrame([(i, "abcd"[k], x) for i, row in z.items() for k, x in enumerate(row)], "basket_id long, label string, logit double")
    labels = spark.createDataFrame([(i, "abcd"[k]) for i, k in own.items()], "basket_id long, label string")
    loss = lambda x: sum(math.log(sum(math.exp(v / 10**x) for v in z[i])) - z[i][own[i]] / 10**x for i in z)
    low, high, ratio = -2.0, 2.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    assert model.fit_temperature(scores, labels) == pytest.approx(10 ** ((low + high) / 2), abs=5e-6)
    sure = spark.createDataFrame([(i, "abcd"[max(range(4), key=lambda k: z[i][k])]) for i in z], "basket_id long, label string")
    assert model.fit_temperature(scores, sure) == 0.01


def test_the_temperature_works_the_scores_out_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    rows = [(i, "abc"[k], float((i * 7 + k * 5) % 11)) for i in range(30) for k in range(3)]
    scores = spark.createDataFrame(rows, "basket_id long, label string, logit double").withColumn("logit", told("logit"))
    labels = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(30)], "basket_id long, label string")  # d has no score
    t = model.fit_temperature(scores, labels)
    assert seen.value == len(rows)
    own = {(i, l): z for i, l, z in rows}
    kept = [([own[i, l] for l in "abc"], own[i, "abc"[i % 4]]) for i in range(30) if i % 4 < 3]
    loss = lambda t: sum(math.log(sum(math.exp(v / t) for v in z)) - x / t for z, x in kept)
    assert 0.01 < t < 100 and loss(t) <= min(loss(t * 1.001), loss(t / 1.001))
    assert model.fit_temperature(scores.filter("basket_id < 0"), labels) == 0.01


def test_vocabulary_reads_its_baskets_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(items):
        read.add(1)
        return items

    rows = [(i, names[i % 3], OWN[names[i % 3]] + ["fresh basil"] * (i % 5 == 0)) for names in [sorted(LABELS)] for i in range(60)]
    train = spark.createDataFrame(rows, "id long, label string, items array<string>").withColumn("items", F.udf(seen, "array<string>")("items"))
    lexicons = Lexicons(modifiers=Modifiers(tokens=frozenset({"fresh"})), variant_tokens=frozenset({"dark", "thai"}))
    v = {r["id"]: r for r in builds.vocabulary_build(train, lexicons)[0].collect()}
    assert read.value == 60
    assert v["basil"]["train_mention_count"] == len([r for r in rows if {"basil", "fresh basil"} & set(r[2])]) and v["lime"]["train_mention_count"] == 40


def test_sets_of_baskets_count_what_mentions_count(spark):
    from basketry.operators import vocabulary
    from basketry.sources import readers

    rows = [(1, "x", ["a", "a", "b"]), (1, "y", ["c", None]), (2, "x", ["b", "d"]), (3, None, ["a", "d"]), (4, "y", []), (None, "x", ["a"]), (None, "y", ["c"]), (5, "x", None), (6, "y", ["e", "c", "b"])]
    train = spark.createDataFrame(rows, "id long, label string, items array<string>")
    members = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C"), ("d", "new C"), ("e", "E")], "item string, group string")
    mentions, baskets = readers.mentions_of(train), vocabulary.baskets_of(train)
    seen, kin = vocabulary.item_counts_of(baskets), vocabulary.kin_of(members, vocabulary.families_of([("new C", "C")]))
    sets = vocabulary.basket_sets(baskets, kin)
    asdict = lambda df: {r[0]: r[1] for r in df.collect()}
    assert asdict(seen) == {k: n for k, n in asdict(vocabulary.item_counts(mentions)).items() if k is not None}
    assert asdict(vocabulary.counts_of(sets, kin, members, seen)) == asdict(vocabulary.group_counts(mentions, members))
    merged = members.withColumn("group", F.when(F.col("group") == "new C", "C").otherwise(F.col("group")))
    assert asdict(vocabulary.counts_of(sets, kin, merged, seen)) == asdict(vocabulary.group_counts(mentions, merged))
    assert vocabulary.families_of([("b c", "c"), ("a b c", "c"), ("y", "z")]) == {"b c": "a b c", "c": "a b c", "a b c": "a b c", "y": "y", "z": "y"}
    baskets.unpersist()


def test_noun_baskets_meet_no_other_order(spark, tmp_path):
    from basketry.plans import queries

    keys = [i + far for far in (0, 10_000_000) for i in range(4)]
    tables = {"lineitem": [(k, int(k >= 10_000_000), 1) for k in keys], "orders": [(k, "x") for k in keys], "part": [(0, "blue gear"), (1, "new gear")]}
    for name, schema in (("lineitem", "l_orderkey long, l_partkey long, l_linenumber long"), ("orders", "o_orderkey long, o_orderpriority string"), ("part", "p_partkey long, p_name string")):
        spark.createDataFrame(tables[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r["id"]: (r["parent_id"], r["train_mention_count"]) for r in queries.QUERIES["vocabulary_build"](spark, str(tmp_path)).collect()}
    assert found == {"gear": (None, 12), "blue_gear": ("gear", 4)}
