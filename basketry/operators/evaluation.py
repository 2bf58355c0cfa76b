"""Calibration and evaluation of held-out scores: figures before and after, by fold, label and pair, and a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model

#: Digits of stored figures; fixed value.
DIGITS = 6
METRICS = ("accuracy", "macro_f1", "log_loss")


def rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumns({c: F.round(c, DIGITS) for c in ("confidence", "accuracy")})


def calibration(scores: DataFrame, labels: DataFrame, temperature: float) -> dict:
    """What the temperature does to held-out logits: log loss, calibration error and reliability bins, before and after."""
    out: dict = {"temperature": temperature, "ece_bin_count": model.BINS, "optimizer": {"points": model.POINTS, "log10_range": list(model.LOG_RANGE), "method": "multisection"}}
    for phase, t in (("before", 1.0), ("after", temperature)):
        shares = model.softmax(scores, t)
        bins = model.reliability(model.top_label(shares), labels)
        out[f"log_loss_{phase}"] = round(model.log_loss(shares, labels).first()[0], DIGITS)
        out[f"ece_{phase}"] = round(model.calibration_error(bins).first()[0], DIGITS)
        out[f"reliability_{phase}"] = rounded_bins(bins)
    return out


def fold_metrics(shares: DataFrame, labels: DataFrame, folded: DataFrame) -> DataFrame:
    """(fold, accuracy, macro_f1, log_loss); every label counts in each fold's macro F1."""
    truth = labels.join(folded.select("basket_id", "fold"), "basket_id")
    own = truth.join(shares, ["basket_id", "label"]).groupBy("fold").agg(F.avg(-F.log(F.greatest("share", F.lit(model.FLOOR)))).alias("log_loss"))
    x = model.top_label(shares).join(truth, "basket_id")
    right = (F.col("top") == F.col("label")).cast("long")
    by_truth = x.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum(right).alias("hits"))
    guessed = x.groupBy("fold", F.col("top").alias("label")).agg(F.count("*").alias("predicted"))
    grid = truth.select("fold").distinct().crossJoin(labels.select("label").distinct())  # a few folds times a few labels
    full = grid.join(by_truth, ["fold", "label"], "left").join(guessed, ["fold", "label"], "left").na.fill(0)
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("n") + F.col("predicted")), F.lit(0.0))
    scored = full.groupBy("fold").agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
    return scored.join(own, "fold").select("fold", *(F.round(c, DIGITS).alias(c) for c in METRICS))


def mean_metrics(folds: DataFrame) -> DataFrame:
    return folds.agg(*(F.round(F.avg(c), DIGITS).alias(c) for c in METRICS))


def bayes_out_of_fold(matrix: DataFrame, labels: DataFrame, folded: DataFrame, n_features: int) -> DataFrame:
    """(basket_id, label, share) of the multinomial baseline, each fold by a model of all others.

    One pass for all folds: a fold's counts are those of all baskets less its own."""
    fold = folded.select("basket_id", "fold")
    truth = labels.join(fold, "basket_id")
    folds = truth.select("fold").distinct()
    own = truth.groupBy("label", "fold").agg(F.count("*").alias("c"))
    names = labels.select("label").distinct()
    less = folds.crossJoin(names)
    per_label = own.groupBy("label").agg(F.sum("c").alias("all"))
    prior = less.join(per_label, "label").join(own, ["label", "fold"], "left").na.fill(0, ["c"]).withColumn("c", F.col("all") - F.col("c")).select("label", "fold", "c")
    totals = prior.groupBy("fold").agg(F.sum("c").alias("n"))
    prior = prior.join(totals, "fold").select("label", "fold", F.log(F.col("c") / F.col("n")).alias("prior"))
    counts = matrix.join(truth, "basket_id").groupBy("label", "index", "fold").agg(F.sum("value").alias("c"))
    everywhere = counts.groupBy("label", "index").agg(F.sum("c").alias("all"))
    dense = less.crossJoin(matrix.select("index").distinct()).join(everywhere, ["label", "index"], "left").join(counts, ["label", "index", "fold"], "left").na.fill(0.0, ["all", "c"])
    left = dense.withColumn("c", F.col("all") - F.col("c")).select("label", "index", "fold", "c")
    mass = left.groupBy("label", "fold").agg(F.sum("c").alias("mass"))
    loglik = left.join(mass, ["label", "fold"]).select("label", "index", "fold", F.log((F.col("c") + 1) / (F.col("mass") + n_features)).alias("w"))
    held = matrix.join(fold, "basket_id").join(loglik, ["index", "fold"]).groupBy("basket_id", "label").agg(F.sum(F.col("value") * F.col("w")).alias("x"))
    scores = fold.join(prior, "fold").join(held, ["basket_id", "label"], "left").select("basket_id", "label", (F.col("prior") + F.coalesce("x", F.lit(0.0))).alias("logit"))
    return model.softmax(scores)


def recall_by_label(tops: DataFrame, labels: DataFrame) -> DataFrame:
    return model.per_label(tops, labels).select("label", F.col("n").alias("basket_count"), F.round("recall", DIGITS).alias("recall"))


def baseline(matrix: DataFrame, labels: DataFrame, folded: DataFrame, n_features: int) -> dict:
    shares = bayes_out_of_fold(matrix, labels, folded, n_features).cache()
    mean = mean_metrics(fold_metrics(shares, labels, folded)).first()
    out = {"mean_accuracy": mean["accuracy"], "mean_macro_f1": mean["macro_f1"], "pooled_oof_log_loss": round(model.log_loss(shares, labels).first()[0], DIGITS)}
    shares.unpersist()
    return out


def evaluate(scores: DataFrame, labels: DataFrame, folded: DataFrame, temperature: float, similarity: DataFrame | None = None) -> dict:
    """The frames of an evaluation of held-out logits at a temperature: folds, mean, labels, confusions."""
    shares = model.softmax(scores, temperature)
    tops = model.top_label(shares)
    folds = fold_metrics(shares, labels, folded)
    return {"folds": folds, "mean": mean_metrics(folds), "per_label": recall_by_label(tops, labels), "confusion_pairs": model.confusion(tops, labels, similarity)}
