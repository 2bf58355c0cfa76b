"""What the application asks: search, comparison, profiles, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(corpus: DataFrame, query: str, k: int = 8) -> DataFrame:
    """corpus(id, name, mentions, aliases) by prefix of the name, prefix of an alias, substring; then mentions, id."""
    q = " ".join(query.lower().split())
    if not q:
        return corpus.limit(0).select("id", F.lit(0).cast("long").alias("tier"), "mentions")
    q = F.lit(q)
    low = F.transform("aliases", F.lower)
    tier = F.when(F.startswith("name", q), 0).when(F.exists(low, lambda a: a.startswith(q)), 1).when(F.contains("name", q) | F.exists(low, lambda a: a.contains(q)), 2)
    return corpus.withColumn("tier", tier.cast("long")).filter("tier is not null").orderBy("tier", F.col("mentions").desc(), "id").limit(k).select("id", "tier", "mentions")


def coefficient_deltas(coefficients: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(side, rank, index, delta): features that speak for a against b, and for b against a."""
    left = coefficients.filter(F.col("label") == a).select("index", F.col("coefficient").alias("x"))
    right = coefficients.filter(F.col("label") == b).select("index", F.col("coefficient").alias("y"))
    d = left.join(right, "index").withColumn("d", F.col("x") - F.col("y"))
    both = d.filter("d > 0").select(F.lit("a").alias("side"), "index", F.col("d").alias("delta")).union(d.filter("d < 0").select(F.lit("b"), "index", -F.col("d")))
    w = Window.partitionBy("side").orderBy(F.round("delta", 9).desc(), "index")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("side", "rank", "index", "delta")


def item_profile(coefficients: DataFrame, index: int, k: int = 4) -> DataFrame:
    """The k labels an item speaks for most and the k it speaks for least."""
    x = coefficients.filter(F.col("index") == index)
    up = F.row_number().over(Window.partitionBy("index").orderBy(F.round("coefficient", 9).desc(), "label"))
    down = F.row_number().over(Window.partitionBy("index").orderBy(F.round("coefficient", 9), F.col("label").desc()))
    return x.withColumns({"up": up.cast("long"), "down": down.cast("long")}).filter((F.col("up") <= k) | (F.col("down") <= k)).select("label", "up", "coefficient")


def common_items(corpus: DataFrame, k: int = 20) -> DataFrame:
    return corpus.orderBy(F.col("mentions").desc(), "id").limit(k).select("id", "mentions")


def children(links: DataFrame) -> DataFrame:
    """(parent_id, children) of links(id, parent_id)."""
    return links.filter("parent_id is not null").groupBy("parent_id").agg(F.sort_array(F.collect_list("id")).alias("children"))


def family(vocabulary: DataFrame, item: str) -> DataFrame:
    """(role, id, name, mentions, evidence): an item's parent, itself, its siblings and its children, as its page shows them."""
    x = vocabulary.select("id", "name", "parent_id", F.col("train_mention_count").alias("mentions"), F.col("preserve_evidence").alias("evidence"))
    own = x.filter(F.col("id") == item).select(F.col("parent_id").alias("_parent"))  # one row
    both = x.crossJoin(F.broadcast(own))
    role = F.when(F.col("id") == item, "self").when(F.col("id") == F.col("_parent"), "parent").when(F.col("parent_id") == item, "child").when(F.col("parent_id") == F.col("_parent"), "sibling")
    return both.withColumn("role", role).filter("role is not null").select("role", "id", "name", "mentions", "evidence")


def weakest_recall(per_label: DataFrame, ceiling: float) -> DataFrame:
    return per_label.filter(F.col("recall") < ceiling).orderBy("recall", "label").select("label", "recall")
