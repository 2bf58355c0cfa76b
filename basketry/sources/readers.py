"""Sources: JSON arrays and JSON lines under fixed schemas, and gates over what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BASKETS, DECISIONS


class SourceError(ValueError):
    """A source has rows that its schema or rules don't allow."""


def _require(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(5).collect():
        raise SourceError(f"{what}: {rows}")


def read_baskets(spark: SparkSession, path: str, labelled: bool = True, rows: int | None = None, labels: int | None = None, names: tuple[str, str, str] = ("id", "cuisine", "ingredients")) -> DataFrame:
    """Baskets from a JSON array of {id, label, items}; fails on malformed rows, doubled ids, wrong counts."""
    i, label, items = names
    schema = f"`{i}` long, `{label}` string, `{items}` array<string>"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = read.select(F.col(i).alias("id"), (F.col(label) if labelled else F.lit(None).cast("string")).alias("label"), F.col(items).alias("items"))
    bad = F.col("id").isNull() | F.col("items").isNull() | (F.size("items") == 0) | F.exists("items", lambda x: x.isNull())
    if labelled:
        bad = bad | F.col("label").isNull() | (F.trim("label") == "")
    _require(out.filter(bad), "bad records")
    _require(out.groupBy("id").count().filter("count > 1"), "ids that stand twice")
    if rows is not None and (n := out.count()) != rows:
        raise SourceError(f"{n} rows, not {rows}")
    if labels is not None and (n := out.select("label").distinct().count()) != labels:
        raise SourceError(f"{n} labels, not {labels}")
    return out


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions from JSON lines; blank lines are skipped."""
    out = spark.read.schema(DECISIONS).option("mode", "FAILFAST").json(path)
    grammar = r"^(?:merge|preserve|merge_into:.+)$"
    _require(out.filter(F.col("decision_id").isNull() | F.col("decided_by").isNull() | F.col("note").isNull() | ~F.coalesce(F.col("decision").rlike(grammar), F.lit(False))), "bad decisions")
    _require(out.groupBy("decision_id").count().filter("count > 1"), "decisions that stand twice")
    return out


def mentions_of(baskets: DataFrame) -> DataFrame:
    """(basket_id, item, pos): the long form that every operator takes."""
    return baskets.select(F.col("id").alias("basket_id"), F.posexplode("items").alias("pos", "item"))


def empty_baskets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BASKETS)
