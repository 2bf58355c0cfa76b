"""Corpus counts, TF-IDF, cosine neighbours, distinctive items, similarity edges.

All take mentions(basket_id, item) and labels(basket_id, label). Pairs are counted once for each basket. What grows
with labels only (a few dozen to thousands) is small; items and mentions stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the taxonomy's limits.
NEIGHBOURS, DISTINCTIVE, MIN_SUPPORT, MIN_COVERAGE = 4, 15, 10, 0.02


def label_items(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, item, n): baskets of a label that have an item."""
    pairs = mentions.select("basket_id", "item").distinct().join(labels, "basket_id")
    return pairs.groupBy("label", "item").agg(F.count("*").alias("n"))


def corpus_statistics(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of baskets by (label, item), item, label and in all, from one pass; label and item null where summed over."""
    pairs = mentions.select("basket_id", "item").distinct().join(labels, "basket_id")
    grains = pairs.groupingSets([["label", "item"], ["item"]], "label", "item").agg(F.count("*").alias("n"))
    totals = labels.groupingSets([["label"], []], "label").agg(F.count_distinct("basket_id").alias("n"))
    return grains.select("label", "item", "n").unionByName(totals.select("label", F.lit(None).cast("string").alias("item"), "n"))


def tfidf(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, item, n, weight): n(l,i)/n(l) times ln(N/df), unsmoothed."""
    counts = label_items(mentions, labels)
    df = counts.groupBy("item").agg(F.sum("n").alias("df"))
    per_label = labels.groupBy("label").agg(F.count_distinct("basket_id").alias("n_label"))
    total = labels.agg(F.count_distinct("basket_id").alias("total"))
    joined = counts.join(df, "item").join(F.broadcast(per_label), "label").crossJoin(F.broadcast(total))  # one row
    return joined.select("label", "item", "n", (F.col("n") / F.col("n_label") * F.log(F.col("total") / F.col("df"))).alias("weight"))


def cosine(vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of all ordered pairs of labels that share an item of weight; labels are few, items many."""
    norms = vectors.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    left = vectors.select(F.col("label").alias("a"), "item", F.col("weight").alias("wa"))
    right = vectors.select(F.col("label").alias("b"), "item", F.col("weight").alias("wb"))
    dots = left.join(right, "item").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.toDF("a", "na"), norms.toDF("b", "nb")
    return dots.join(na, "a").join(nb, "b").select("a", "b", F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"))


def neighbours(mentions: DataFrame, labels: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(label, rank, neighbour, similarity): ranked before rounding, ties by name."""
    w = Window.partitionBy("a").orderBy(F.round("similarity", 9).desc(), "b")
    ranked = cosine(tfidf(mentions, labels)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("label"), F.col("rank").cast("long").alias("rank"), F.col("b").alias("neighbour"), F.round("similarity", 4).alias("similarity"))


def similarity_edges(neighbour_lists: DataFrame) -> DataFrame:
    """Each pair once, with the larger similarity."""
    return neighbour_lists.groupBy(F.least("label", "neighbour").alias("a"), F.greatest("label", "neighbour").alias("b")).agg(F.max("similarity").alias("similarity"))


def distinctive(mentions: DataFrame, labels: DataFrame, k: int = DISTINCTIVE, support: int = MIN_SUPPORT, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(label, rank, item, lift, coverage): a label's share of an item over the corpus's, by lift."""
    counts = label_items(mentions, labels)
    df = counts.groupBy("item").agg(F.sum("n").alias("df"))
    per_label = labels.groupBy("label").agg(F.count_distinct("basket_id").alias("n_label"))
    total = labels.agg(F.count_distinct("basket_id").alias("total"))
    x = counts.filter(F.col("n") >= support).join(F.broadcast(per_label), "label").withColumn("coverage", F.col("n") / F.col("n_label")).filter(F.col("coverage") >= coverage)
    x = x.join(df, "item").crossJoin(F.broadcast(total)).withColumn("lift", F.col("coverage") / (F.col("df") / F.col("total")))
    w = Window.partitionBy("label").orderBy(F.round("lift", 9).desc(), "item")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("label", "rank", "item", F.round("lift", 4).alias("lift"), F.round("coverage", 4).alias("coverage"))


def taxonomy(mentions: DataFrame, labels: DataFrame, families: dict[str, str]) -> DataFrame:
    """One row for each label: family, basket count, neighbours, distinctive items."""
    spark = mentions.sparkSession
    near = neighbours(mentions, labels).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").alias("id"), "similarity"))), lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"))).alias("neighbours"))
    own = distinctive(mentions, labels).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("item").alias("id"), "lift", "coverage"))), lambda x: F.struct(x["id"].alias("id"), x["lift"].alias("lift"), x["coverage"].alias("coverage"))).alias("distinctive"))
    family = spark.createDataFrame(sorted(families.items()), "label string, family string")
    counts = labels.groupBy("label").agg(F.count_distinct("basket_id").alias("basket_count"))
    return counts.join(family, "label", "left").join(near, "label", "left").join(own, "label", "left")


def atlas(labels: DataFrame, family: Column) -> DataFrame:
    """Labels on the unit circle in the order of (family, label), from the top."""
    rows = labels.select("label", family.alias("family")).distinct()
    numbered = rows.withColumn("place", F.row_number().over(Window.orderBy("family", "label")) - 1).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("place") / F.col("n")
    return numbered.select("label", "family", F.round(F.cos(angle), 4).alias("x"), F.round(F.sin(angle), 4).alias("y"))
