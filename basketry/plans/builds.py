"""The builds of the four tiers, one after another: each reads the tables of the tier before, checks what it made and
writes it, so that every step has a short plan and can be run again by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicons
from ..operators import evaluation, exports, features, gates, model, resolver, taxonomy, validators, vocabulary
from ..session import counted
from ..sources import artifacts, readers, sinks

#: Digits of stored shares; fixed value.
SHARE_DIGITS = 4


def _labels(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.col("id").alias("basket_id"), "label")


def vocabulary_build(train: DataFrame, lexicons: Lexicons, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The compiled vocabulary of train(id, label, items) and the review queue as it is stored.

    Without decisions pairs under review stay apart and unlinked."""
    baskets = vocabulary.baskets_of(train)
    seen = counted(vocabulary.item_counts_of(baskets))
    members = counted(vocabulary.group_mechanically(seen, lexicons.singular, lexicons.aliases))
    members, frozen = vocabulary.reduce_groups(None, members, lexicons.modifiers, lexicons.brands, lexicons.singular, lexicons.gate, seen=seen)
    members = counted(members)
    names = counted(vocabulary.representatives(None, members, frozen, seen))
    tokens = lexicons.variant_tokens | lexicons.modifiers.tokens | lexicons.modifiers.never
    most = members.join(seen, "item").groupBy("group").agg(F.sum("train_frequency").alias("n"))  # no group is in more baskets
    links = [(r["variant"], r["base"]) for r in vocabulary.cuts(most, tokens).collect()]  # a vocabulary's pairs
    kin = counted(vocabulary.kin_of(members, vocabulary.families_of(links)))
    sets = counted(vocabulary.basket_sets(baskets, kin))
    pairs = vocabulary.candidate_pairs(vocabulary.counts_of(sets, kin, members, seen), tokens)
    labelled = sets.select("family", "groups", F.explode("labels").alias("label"), "n").groupBy("family", "groups", "label").agg(F.sum("n").alias("n"))
    members, preserved, queue = vocabulary.judge(pairs, labelled, vocabulary.priors_of(baskets), members, lexicons.gate, names)
    entries = vocabulary.review_entries(queue, readers.mentions_of(train), members)
    if decisions is not None:  # they may merge groups of several families
        members, preserved = vocabulary.apply_decisions(members, preserved, queue, decisions)
        kin = counted(vocabulary.kin_of(members, {}))
        sets = counted(vocabulary.basket_sets(baskets, kin))
    counts = counted(vocabulary.counts_of(sets, kin, members, seen))
    baskets.unpersist()
    own = vocabulary.representatives(None, members, names, seen)  # a group that took others in keeps its name
    return vocabulary.compile_vocabulary(None, members, own, preserved, seen=seen, counts=counts), entries


def silver(spark: SparkSession, train: DataFrame, test: DataFrame, lexicons: Lexicons, folder: str, decisions: DataFrame | None = None, floors: dict[str, float] = validators.CHAIN_FLOORS, alias_floor: float = validators.ALIAS_FLOOR) -> dict:
    """Vocabulary, staged baskets of both splits and the taxonomy, checked and written to folder; returns the build block."""
    build = artifacts.fingerprint({"train": train.select("id", "label", "items"), "test": test.select("id", "items")}, seed=42)
    compiled, entries = vocabulary_build(train, lexicons, decisions)
    compiled.write.mode("overwrite").parquet(f"{folder}/vocabulary")
    entries.write.mode("overwrite").parquet(f"{folder}/review_queue")
    vocab = spark.read.parquet(f"{folder}/vocabulary")
    found = resolver.Resolver(vocab, lexicons.modifiers, lexicons.brands, lexicons.singular, lexicons.variant_tokens)
    splits, statistics, totals, unresolved = {}, None, None, None
    for name, baskets in (("train", train), ("test", test)):
        mentions = readers.mentions_of(baskets)
        found.resolve(mentions).write.mode("overwrite").parquet(f"{folder}/resolved_{name}")
        resolved = spark.read.parquet(f"{folder}/resolved_{name}")
        gates.run([gates.Gate(f"resolutions of {name} fit their methods", resolver.bad_resolutions(resolved))])
        splits[name] = resolver.stage(mentions, _labels(baskets), resolved)
        split = F.lit(name).alias("split")
        stats = resolver.resolution_statistics(mentions, resolved).select(split, "*")
        total = mentions.agg(split, F.count("*").alias("mentions_total"))
        lost = resolver.top_unresolved(mentions, resolved).select(split, "*")
        statistics = stats if statistics is None else statistics.union(stats)
        totals = total if totals is None else totals.union(total)
        unresolved = lost if unresolved is None else unresolved.union(lost)
    staged = {f"baskets_{k}": v for k, v in splits.items()}
    tables = {**staged, "statistics": statistics, "unresolved": unresolved}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    ids = tables["baskets_train"].select("basket_id", F.explode("item_ids").alias("item"))
    labels = tables["baskets_train"].select("basket_id", "label")
    rows = taxonomy.taxonomy(ids, labels, lexicons.families)
    names = sorted(lexicons.families)
    gates.run(
        [
            *validators.compiled_gates(vocab, readers.mentions_of(train), alias_floor),
            *validators.staged_gates(tables["baskets_train"], vocab, None, names),
            *validators.staged_gates(tables["baskets_test"], vocab, None, None),
            *validators.statistics_gates(tables["statistics"], totals, tables["unresolved"], floors, alias_floor),
            *validators.family_gates(labels, lexicons.families),
        ]
    )
    artifacts.write_tables(folder, {"taxonomy": rows}, build)
    return build


def gold(spark: SparkSession, silver_folder: str, folder: str, assign: Callable[[DataFrame], DataFrame] = features.folds) -> dict:
    """Feature space, rows of both splits, folds and their balance; assign deals labelled baskets into folds."""
    inputs = artifacts.load_silver_inputs(spark, silver_folder)
    build = artifacts.fingerprint({"vocabulary": inputs.vocabulary.select("id", "parent_id"), "baskets_train": inputs.baskets_train, "baskets_test": inputs.baskets_test}, seed=42)
    space = features.feature_space(inputs.vocabulary.select("id", "parent_id"))
    rows = {}
    for split, staged in (("train", inputs.baskets_train), ("test", inputs.baskets_test)):
        ids = staged.select("basket_id", F.explode("item_ids").alias("item"))
        rows[f"rows_{split}"] = features.feature_rows(ids, staged.select("basket_id", "label"), space)
    folded = assign(inputs.baskets_train.select("basket_id", "label"))
    artifacts.write_tables(folder, {"space": space, **rows, "folds": folded}, build)
    made = {x: artifacts.read_table(spark, folder, x) for x in artifacts.GOLD[:4]}
    artifacts.write_tables(folder, {"fold_balance": features.fold_balance(made["folds"])}, build)
    gates.run(
        [
            *validators.space_gates(made["space"], inputs.vocabulary),
            *validators.rows_gates(made["rows_train"], made["space"], inputs.baskets_train, empty=0),
            *validators.rows_gates(made["rows_test"], made["space"], inputs.baskets_test),
            *validators.fold_gates(made["folds"], inputs.baskets_train),
            *validators.balance_gates(artifacts.read_table(spark, folder, "fold_balance"), made["folds"]),
        ]
    )
    return build


def blends(shares: DataFrame) -> DataFrame:
    """(basket_id, blend, top): rounded shares in the order of labels; the top label from unrounded ones."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("label", "share"))), lambda s: F.round(s["share"], SHARE_DIGITS))
    return shares.groupBy("basket_id").agg(ordered.alias("blend")).join(model.top_label(shares).select("basket_id", "top"), "basket_id")


def neighbour_similarity(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("label").alias("truth"), F.explode("neighbours").alias("n")).select("truth", F.col("n.id").alias("predicted"), "n.similarity")


def train(spark: SparkSession, gold_folder: str, silver_folder: str, folder: str, weights: Iterable[float] = model.PARENT_WEIGHTS, cs: Iterable[float] = model.C_VALUES, max_iterations: int = model.MAX_ITERATIONS) -> dict:
    """Grid search, temperature, final fit, blends of the test split and the evaluation; returns the build's constants."""
    inputs = artifacts.load_gold_model_inputs(spark, gold_folder, silver_folder)
    labels = inputs.rows_train.select("basket_id", "label")
    names = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()]
    n = inputs.space.count()
    matrix_of = lambda weight: features.design_matrix(inputs.rows_train, weight)
    grid = model.cross_validate(matrix_of, labels, inputs.folds, n, names, weights, cs, max_iterations)
    loss, c, weight = grid[0]
    vectors = model.as_vectors(matrix_of(weight), labels, n, names).join(inputs.folds.select("basket_id", "fold"), "basket_id").cache()
    model.out_of_fold(vectors, names, c, max_iterations).select("basket_id", "label", "logit").write.mode("overwrite").parquet(f"{folder}/out_of_fold")
    vectors.unpersist()
    scores = spark.read.parquet(f"{folder}/out_of_fold")
    temperature = model.fit_temperature(scores, labels)
    calibrated = evaluation.calibration(scores, labels, temperature)
    similarity = neighbour_similarity(inputs.taxonomy)
    judged = evaluation.evaluate(scores, labels, inputs.folds, temperature, similarity)
    coefficients, intercepts = model.train_final(matrix_of, labels, n, names, c, weight, max_iterations)
    test = inputs.rows_test.select("basket_id")
    shares = model.softmax(model.logits(features.design_matrix(inputs.rows_test, weight), test, coefficients, intercepts), temperature)
    configuration = {"c": c, "parent_weight": weight, "max_iterations": max_iterations, "tolerance": model.TOLERANCE}
    figures = {k: v for k, v in calibrated.items() if not isinstance(v, DataFrame)}
    constants = {"labels": names, "configuration": configuration, "selection": {"metric": "pooled_oof_log_loss", "value": round(loss, 6)}, "grid": [list(x) for x in grid], "calibration": figures, "baseline": evaluation.baseline(matrix_of(weight), labels, inputs.folds, n)}
    tables = {"coefficients": coefficients, "intercepts": intercepts, "blends": blends(shares), "folds_evaluated": judged["folds"], "mean": judged["mean"], "per_label": judged["per_label"], "confusion_pairs": judged["confusion_pairs"]}
    tables |= {k: v for k, v in calibrated.items() if isinstance(v, DataFrame)}
    build = artifacts.fingerprint({"rows_train": inputs.rows_train, "rows_test": inputs.rows_test, "folds": inputs.folds, "space": inputs.space}, seed=42, spark_version=spark.version)
    artifacts.write_document(spark, constants, f"{folder}/constants.json")
    artifacts.write_tables(folder, tables, build)
    made = {x: artifacts.read_table(spark, folder, x) for x in tables}
    sinks.write_submission(made["blends"].select("basket_id", "top"), f"{folder}/submission")
    submitted = spark.read.option("header", True).csv(f"{folder}/submission")
    stored = {"folds": made["folds_evaluated"], "mean": made["mean"], "per_label": made["per_label"], "confusion_pairs": made["confusion_pairs"]}
    odd = [x for x in validators.parameter_gates(made["coefficients"], made["intercepts"], configuration, names, n) if "grid" not in x.name]  # a smaller grid may be asked for
    gates.run(
        [
            *odd,
            *validators.calibration_gates(spark, figures),
            *validators.blend_gates(made["blends"], names, test),
            *validators.submission_gates(submitted, made["blends"]),
            *validators.evaluation_gates(stored, configuration, names, grid, similarity),
        ]
    )
    return constants


def app(spark: SparkSession, trained: str, gold_folder: str, silver_folder: str, folder: str, recipes: Iterable[tuple[str, bool, tuple[str, ...]]] = (), overrides: dict[str, str] | None = None) -> dict:
    """The application's assets, checked and written; recipes are (name, example, ids) of the contract vectors."""
    inputs = artifacts.load_app_export_inputs(spark, trained, gold_folder, silver_folder)
    constants = inputs.constants
    figures = constants["calibration"]
    asset = exports.scoring_model(inputs.coefficients, inputs.intercepts, inputs.space, figures["temperature"], constants["configuration"]["parent_weight"])
    calibrated = figures | {k: artifacts.read_table(spark, trained, k) for k in ("reliability_before", "reliability_after")}
    judged = {"folds": artifacts.read_table(spark, trained, "folds_evaluated"), **{k: artifacts.read_table(spark, trained, k) for k in ("mean", "per_label", "confusion_pairs")}}
    card = exports.model_card(judged, calibrated, constants["baseline"], constants["configuration"], [tuple(x) for x in constants["grid"]], overrides)
    items, places, links = exports.ingredients(inputs.vocabulary), exports.cuisines(inputs.taxonomy, inputs.per_label, overrides), exports.edges(inputs.taxonomy)
    tables = {"ingredients": items, "cuisines": places, "edges": links, "asset_coefficients": asset["coefficients"], "asset_intercepts": asset["intercepts"], "asset_features": asset["features"]}
    tables |= {f"card_{k}": v for k, v in card.items() if isinstance(v, DataFrame)}
    rows = list(recipes)
    if rows:
        tables["contract_vectors"] = exports.contract_vectors(exports.recipes_of(spark, rows), asset)
    build = artifacts.fingerprint({"coefficients": inputs.coefficients, "space": inputs.space, "per_label": inputs.per_label, "vocabulary": inputs.vocabulary.select("id", "name", "parent_id"), "labels": inputs.taxonomy.select("label", "family")})
    small = {k: v for k, v in card.items() if not isinstance(v, DataFrame)} | {"temperature": asset["temperature"], "parent_weight": asset["parent_weight"]}
    artifacts.write_document(spark, small, f"{folder}/model_card.json")
    artifacts.write_tables(folder, tables, build)
    made = {x: artifacts.read_table(spark, folder, x) for x in tables}
    n, k = inputs.space.count(), len(constants["labels"])
    stored = {"coefficients": made["asset_coefficients"], "intercepts": made["asset_intercepts"], "features": made["asset_features"], "temperature": asset["temperature"], "parent_weight": asset["parent_weight"]}
    checks = [
        *validators.model_asset_gates(stored, k, n),
        *validators.ingredients_asset_gates(made["ingredients"], made["asset_features"]),
        *validators.cuisines_asset_gates(made["cuisines"], made["edges"], made["ingredients"], k),
        *validators.card_gates({"per_label": made["card_per_label"], "reliability_before": made["card_reliability_before"], "reliability_after": made["card_reliability_after"]}, k),
    ]
    if rows:
        checks += validators.vector_gates(made["contract_vectors"], constants["labels"])
    gates.run(checks)
    return build
