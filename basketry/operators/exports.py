"""What the application reads: ingredients, atlas, scoring model, model card and contract vectors, as frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import features, gates, model, search, taxonomy

#: Digits of the application's coefficients, shares and explanations; fixed values.
COEFFICIENT_DIGITS, SHARE_DIGITS, EXPLANATION_DIGITS = 4, 4, 6
#: Ids that contract vectors may name though the model doesn't know them begin so; fixed value.
UNKNOWN_PREFIX = "not_a_real"


def ingredients(vocabulary: DataFrame) -> DataFrame:
    """(id, name, mentions, aliases, parent_id, children, evidence): aliases without the name and without provenance."""
    kin = search.children(vocabulary.select("id", "parent_id")).select(F.col("parent_id").alias("id"), "children")
    own = F.filter("aliases", lambda a: a["alias"] != F.col("name"))
    slim = F.transform(own, lambda a: F.struct(a["alias"].alias("alias"), a["train_frequency"].alias("train_frequency")))
    none = F.expr("cast(array() as array<string>)")
    out = vocabulary.select("id", "name", F.col("train_mention_count").alias("mentions"), slim.alias("aliases"), "parent_id", F.col("preserve_evidence").alias("evidence"))
    return out.join(kin, "id", "left").withColumn("children", F.coalesce("children", none))


def alias_listing(vocabulary: DataFrame) -> DataFrame:
    """(id, alias, train_frequency) of all aliases but the name, to be shown by frequency."""
    return ingredients(vocabulary).select("id", F.explode("aliases").alias("a")).select("id", "a.alias", "a.train_frequency")


def cuisines(rows: DataFrame, recall: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(label, name, family, basket_count, recall, neighbours, distinctive, x, y) of taxonomy rows; a label without a
    recall has null, which a gate reports."""
    shown = lambda x: F.struct(x["id"].alias("id"), F.translate(x["id"], "_", " ").alias("name"), x["lift"].alias("lift"), x["coverage"].alias("coverage"))
    places = taxonomy.atlas(rows, F.col("family")).select("label", "x", "y")
    out = rows.join(recall.select("label", "recall"), "label", "left").join(places, "label")
    return out.select("label", T.display_name(F.col("label"), overrides).alias("name"), "family", "basket_count", "recall", "neighbours", F.transform("distinctive", shown).alias("distinctive"), "x", "y")


def cuisine_grid(rows: DataFrame) -> DataFrame:
    """(family, labels): the labels of each family in order, as the overview shows them."""
    return rows.groupBy("family").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def edges(rows: DataFrame) -> DataFrame:
    """(a, b, similarity) of the neighbour lists of taxonomy rows, each pair once."""
    lists = rows.select("label", F.explode("neighbours").alias("n")).select("label", F.col("n.id").alias("neighbour"), "n.similarity")
    return taxonomy.similarity_edges(lists)


def scoring_model(coefficients: DataFrame, intercepts: DataFrame, space: DataFrame, temperature: float, parent_weight: float) -> dict:
    """The scoring asset: frames and two constants; coefficients at COEFFICIENT_DIGITS."""
    short = coefficients.withColumn("coefficient", F.round("coefficient", COEFFICIENT_DIGITS))
    return {"coefficients": short, "intercepts": intercepts, "features": space.select("index", "id", "parent_index"), "temperature": temperature, "parent_weight": parent_weight}


def model_card(evaluation: dict, calibration: dict, baseline: dict, configuration: dict, grid: list[tuple[float, float, float]], overrides: dict[str, str] | None = None) -> dict:
    """What the model card states: frames of the evaluation with names to show, calibration figures, facts of the training."""
    shown = lambda c: T.display_name(F.col(c), overrides)
    per_label = evaluation["per_label"].withColumn("name", shown("label"))
    pairs = evaluation["confusion_pairs"].withColumns({"true_name": shown("truth"), "predicted_name": shown("predicted")})
    figures = {k: calibration[k] for k in ("temperature", "log_loss_before", "log_loss_after", "ece_before", "ece_after")}
    bins = {k: calibration[k] for k in ("reliability_before", "reliability_after")}
    training = evaluation["per_label"].agg(F.sum("basket_count").alias("basket_count"))
    return {"folds": evaluation["folds"], "mean": evaluation["mean"], "per_label": per_label, "confusion_pairs": pairs, "training": training, "calibration": figures, "baseline": dict(baseline), "configuration": dict(configuration), "grid": list(grid), **bins}


def unknown_ids(recipes: DataFrame, space: DataFrame) -> DataFrame:
    """(name, id) of recipes(name, example, ids) that the model doesn't know and that aren't unknown on purpose."""
    asked = recipes.select("name", F.explode("ids").alias("id")).filter(~F.startswith("id", F.lit(UNKNOWN_PREFIX)))
    return asked.join(space.select("id"), "id", "left_anti").select("name", "id")


def score(baskets: DataFrame, asset: dict) -> DataFrame:
    """(basket_id, label, share) of baskets(basket_id, ids) under a scoring asset; unknown ids and repeats count for nothing."""
    return model.softmax(model.logits(basket_matrix(baskets, asset), baskets, asset["coefficients"], asset["intercepts"]), asset["temperature"])


def basket_matrix(baskets: DataFrame, asset: dict) -> DataFrame:
    mentions = baskets.select("basket_id", F.explode("ids").alias("item"))
    rows = features.feature_rows(mentions, baskets.select("basket_id", F.lit(None).cast("string").alias("label")), asset["features"])
    return features.design_matrix(rows, asset["parent_weight"])


def contract_vectors(recipes: DataFrame, asset: dict) -> DataFrame:
    """Of recipes(name, example, ids) the expected blend in the order of labels, leader, runner-up and explanations."""
    gates.run([gates.Gate("contract vectors name known ids", unknown_ids(recipes, asset["features"]))])
    baskets = recipes.select(F.col("name").alias("basket_id"), "ids")
    matrix, shares = basket_matrix(baskets, asset), score(baskets, asset)
    blend = shares.groupBy("basket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "share"))), lambda s: F.round(s["share"], SHARE_DIGITS)).alias("blend"))
    two = model.leader_and_runner_up(shares)
    top = model.contributions(matrix, asset["coefficients"], two.select("basket_id", F.col("leader").alias("label")))
    against = model.differentiators(matrix, asset["coefficients"], two)
    listed = lambda df, c: df.join(asset["features"].select("index", "id"), "index").groupBy("basket_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", F.round(c, EXPLANATION_DIGITS).alias(c)))), lambda s: F.struct(s["id"].alias("id"), s[c].alias(c))).alias(f"{c}s")
    )
    out = recipes.withColumnRenamed("name", "basket_id").join(blend, "basket_id").join(two, "basket_id")
    out = out.join(listed(top, "contribution"), "basket_id", "left").join(listed(against, "advantage"), "basket_id", "left")
    return out.select(F.col("basket_id").alias("name"), "example", "ids", "blend", F.col("leader").alias("top"), "runner_up", F.col("contributions"), F.col("advantages").alias("differentiators"))


def recipes_of(spark: SparkSession, rows: Iterable[tuple[str, bool, tuple[str, ...]]]) -> DataFrame:
    return spark.createDataFrame([(n, e, list(ids)) for n, e, ids in rows], "name string, example boolean, ids array<string>")
