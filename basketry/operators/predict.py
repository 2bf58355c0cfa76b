"""One basket asked for by hand: how its strings resolve, its blend, and what moves it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exports, model
from .resolver import Resolver

UNRESOLVED, TOP, EXPLANATIONS = "UNRESOLVED", 5, 5


@dataclass(frozen=True)
class Prediction:
    """Frames: resolution(pos, item, id, method, dropped), blend(label, share), contributions and differentiators."""

    resolution: DataFrame
    blend: DataFrame
    contributions: DataFrame
    differentiators: DataFrame


def split_items(text: str) -> list[str]:
    """A list of items as it is typed: cut at commas, trimmed, without blanks."""
    return [x.strip() for x in text.split(",") if x.strip()]


def predict(spark: SparkSession, items: list[str], resolver: Resolver, asset: dict) -> Prediction:
    """items through the resolver and a scoring asset (exports.scoring_model). What doesn't resolve is shown and left out."""
    asked = spark.createDataFrame(list(enumerate(items)), "pos int, item string")
    resolution = asked.join(resolver.resolve(asked.select("item")), "item").select("pos", "item", "id", "method", "dropped")
    basket = resolution.agg(F.lit(0).cast("long").alias("basket_id"), F.collect_set("id").alias("ids"))  # one basket
    shares = exports.score(basket, asset)
    matrix, two = exports.basket_matrix(basket, asset), model.leader_and_runner_up(shares)
    names = asset["features"].select("index", "id")
    top = model.contributions(matrix, asset["coefficients"], two.select("basket_id", F.col("leader").alias("label")), EXPLANATIONS).join(names, "index")
    against = model.differentiators(matrix, asset["coefficients"], two, EXPLANATIONS).join(names, "index")
    return Prediction(resolution, shares.select("label", "share"), top.select("rank", "label", "id", "contribution"), against.select("rank", "id", "advantage"))


def resolution_lines(resolution: DataFrame) -> DataFrame:
    """(pos, line): the table that shows how each string resolved."""
    dropped = F.when(F.coalesce("dropped", F.lit("")) != "", F.concat(F.lit(" (dropped: "), F.replace("dropped", F.lit(" "), F.lit(", ")), F.lit(")"))).otherwise("")
    quoted = F.concat(F.lit("'"), F.col("item"), F.lit("'"))
    line = F.concat(F.lit("  "), quoted, F.lit(" -> "), F.coalesce("id", F.lit(UNRESOLVED)), F.lit(" ["), F.col("method"), F.lit("]"), dropped)
    return resolution.select("pos", line.alias("line"))


def blend_lines(blend: DataFrame, k: int = TOP) -> DataFrame:
    """(line) of the k largest shares, ties by label."""
    line = F.concat(F.format_string("%.1f", F.col("share") * 100), F.lit("%  "), F.col("label"))
    return blend.orderBy(F.col("share").desc(), "label").limit(k).select(line.alias("line"))
