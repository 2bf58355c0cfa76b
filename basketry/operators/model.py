"""Training, calibration, scoring, evaluation and exact linear explanations, over long tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of training and calibration.
PARENT_WEIGHTS, C_VALUES = (0.0, 0.3, 1.0), (0.1, 0.3, 1.0, 3.0)
MAX_ITERATIONS, TOLERANCE, LOG_RANGE, BINS, FLOOR = 1000, 1e-4, (-2.0, 2.0), 10, 1e-15
TOP_CONTRIBUTIONS, TOP_CONFUSIONS = 5, 15
#: Temperatures that one pass tries.
POINTS = 15


def naive_bayes(matrix: DataFrame, labels: DataFrame, n_features: int, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, prior) and (label, index, loglik): multinomial with additive smoothing, prior unsmoothed."""
    total = labels.agg(F.count("*").alias("n"))
    prior = labels.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("label", F.log(F.col("c") / F.col("n")).alias("prior"))
    counts = matrix.join(labels, "basket_id").groupBy("label", "index").agg(F.sum("value").alias("c"))
    mass = counts.groupBy("label").agg(F.sum("c").alias("mass"))
    dense = labels.select("label").distinct().crossJoin(matrix.select("index").distinct())  # labels times features
    full = dense.join(counts, ["label", "index"], "left").na.fill(0.0, ["c"]).join(mass, "label")
    return prior, full.select("label", "index", F.log((F.col("c") + alpha) / (F.col("mass") + alpha * n_features)).alias("loglik"))


def logits(matrix: DataFrame, baskets: DataFrame, coefficients: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(basket_id, label, logit): coefficients(label, index, coefficient) folded in the order of features onto the
    intercept, so that the sum's order is part of the result; a basket without features has the intercepts.

    Each feature carries the coefficients of all labels as one array, so the matrix is exchanged once as it is and only
    the result has a row for each label. A coefficient that isn't there is 0."""
    start = intercepts.agg(F.array_sort(F.collect_list(F.struct("label", "intercept"))).alias("start"))  # one row, a few labels
    start = start.select(F.col("start.label").alias("names"), F.col("start.intercept").alias("base"))
    known = coefficients.groupBy("index").agg(F.map_from_entries(F.collect_list(F.struct("label", "coefficient"))).alias("by_label"))
    weights = known.crossJoin(F.broadcast(start)).select("index", F.transform("names", lambda n: F.coalesce(F.try_element_at("by_label", n), F.lit(0.0))).alias("weights"))
    terms = matrix.join(weights, "index").groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("index", "value", "weights"))).alias("terms"))
    out = baskets.select("basket_id").join(terms, "basket_id", "left").crossJoin(F.broadcast(start))
    add = lambda acc, t: F.zip_with(acc, t["weights"], lambda a, w: a + t["value"] * w)
    sums = F.coalesce(F.aggregate("terms", F.col("base"), add), F.col("base"))
    return out.select("basket_id", F.explode(F.arrays_zip(F.col("names").alias("label"), sums.alias("logit"))).alias("s")).select("basket_id", "s.label", "s.logit")


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(basket_id, label, share): of logits over temperature, shifted by their maximum."""
    w = Window.partitionBy("basket_id")
    x = scores.withColumn("z", F.col("logit") / temperature).withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return x.withColumn("share", F.col("e") / F.sum("e").over(w)).select("basket_id", "label", "share")


def top_label(shares: DataFrame, digits: int = 9) -> DataFrame:
    """(basket_id, top, confidence): the largest share, ties by the smaller label."""
    w = Window.partitionBy("basket_id").orderBy(F.round("share", digits).desc(), "label")
    return shares.withColumn("n", F.row_number().over(w)).filter("n = 1").select("basket_id", F.col("label").alias("top"), F.col("share").alias("confidence"))


def log_loss(shares: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.join(shares, ["basket_id", "label"])
    return own.agg(F.avg(-F.log(F.greatest("share", F.lit(FLOOR)))).alias("log_loss"))


def reliability(tops: DataFrame, labels: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n, confidence, accuracy): all bins, zeros where none falls."""
    x = tops.join(labels, "basket_id").select(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin"), "confidence", (F.col("top") == F.col("label")).cast("double").alias("right"))
    got = x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("right").alias("accuracy"))
    return tops.sparkSession.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left").na.fill(0)


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def confusion(tops: DataFrame, labels: DataFrame, similarity: DataFrame | None = None, k: int = TOP_CONFUSIONS) -> DataFrame:
    x = tops.join(labels, "basket_id").filter("top <> label").groupBy(F.col("label").alias("truth"), F.col("top").alias("predicted")).agg(F.count("*").alias("n"))
    if similarity is not None:
        x = x.join(similarity.toDF("truth", "predicted", "similarity"), ["truth", "predicted"], "left")
    return x.orderBy(F.col("n").desc(), "truth", "predicted").limit(k)


def per_label(tops: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, hits, predicted, recall, f1) for all labels, zero where undefined."""
    x = tops.join(labels, "basket_id")
    truth = x.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("top") == F.col("label")).cast("long")).alias("hits"))
    guessed = x.groupBy(F.col("top").alias("label")).agg(F.count("*").alias("predicted"))
    out = labels.select("label").distinct().join(truth, "label", "left").join(guessed, "label", "left").na.fill(0)
    return out.withColumns({"recall": F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("n") + F.col("predicted")), F.lit(0.0))})


def accuracy_macro_f1(labelled: DataFrame) -> DataFrame:
    return labelled.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def _excess(rows: DataFrame, tried: list[float]) -> list[float | None]:
    """For each temperature how much more, summed over rows(z, own), the logit that a softmax expects is than own."""

    def partial(batches):
        for batch in batches:
            held = batch.column("z")
            own = batch.column("own").to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            z, sizes = held.flatten().to_numpy(zero_copy_only=False), held.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            top = np.maximum.reduceat(z, starts)
            below, above = z - np.repeat(top, sizes), own - top
            out = []
            for t in tried:
                weight = np.exp(below / t)
                n, s = np.add.reduceat(weight, starts), np.add.reduceat(weight * z, starts)
                floored = np.exp(above / t) < FLOOR * n  # where the loss doesn't change
                out.append(float(np.where(floored, 0.0, s / n - own).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=names)

    names = [f"t{k}" for k in range(len(tried))]
    sums = rows.mapInArrow(partial, ", ".join(f"{n} double" for n in names))
    return list(sums.agg(*(F.sum(n) for n in names)).first())


def fit_temperature(scores: DataFrame, labels: DataFrame, points: int = POINTS) -> float:
    """The temperature of the least log loss, at six digits.

    The loss falls as long as the logit that a softmax at T expects is more than the true label's, on average, and then
    rises; each pass over a cached compact frame takes that difference at several temperatures at once, batch by batch,
    and keeps the stretch of log10 T in which it changes its sign. The scores are worked out once."""
    z = scores.groupBy("basket_id").agg(F.collect_list(F.struct("label", "logit")).alias("by_label"))
    same = F.filter("by_label", lambda x: x["label"] == F.col("label"))
    compact = labels.select("basket_id", "label").join(z, "basket_id").select(F.col("by_label.logit").alias("z"), F.get(same, F.lit(0))["logit"].alias("own"))
    compact = compact.filter("own is not null").cache()
    low, high = LOG_RANGE
    while high - low > 1e-10:
        tried = [low + (high - low) * k / (points + 1) for k in range(1, points + 1)]
        signs = _excess(compact, [10.0**x for x in tried])
        falling = [x for x, e in zip(tried, signs, strict=True) if e is not None and e > 0]
        below = max(falling, default=low)
        high = min((x for x in tried if x > below), default=high)
        low = below
    compact.unpersist()
    return round(10.0 ** ((low + high) / 2), 6)


def as_vectors(matrix: DataFrame, labels: DataFrame, n_features: int, names: list[str]) -> DataFrame:
    """(basket_id, label, y, features): the label's place in names, and the features as sparse vectors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    rows = matrix.groupBy("basket_id").agg(F.map_from_entries(F.collect_list(F.struct("index", "value"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    index = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    out = labels.join(rows, "basket_id", "left").select("basket_id", "label", index.cast("double").alias("y"), array_to_vector(full).alias("full"))
    return VectorAssembler(inputCols=["full"], outputCol="features").transform(out).drop("full")  # which stores what isn't zero


def fit_logistic(vectors: DataFrame, c: float, max_iterations: int = MAX_ITERATIONS):
    """Multinomial regression; the penalty of scale C over n rows is regParam 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression

    n = vectors.count()
    return LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iterations, tol=TOLERANCE / 100).fit(vectors)


def parameters(model, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rounded coefficients and intercepts; all scoring uses these."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(names[i], j, round(float(w[i, j]), 6)) for i in range(w.shape[0]) for j in range(w.shape[1])]
    return spark.createDataFrame(rows, "label string, index int, coefficient double"), spark.createDataFrame([(names[i], round(float(x), 6)) for i, x in enumerate(b)], "label string, intercept double")


def out_of_fold(vectors: DataFrame, names: list[str], c: float, max_iterations: int = MAX_ITERATIONS, parallel: int = 4) -> DataFrame:
    """(basket_id, fold, label, logit) of vectors(basket_id, label, y, features, fold): each fold is scored by a model of
    all others. The fits of the folds are submitted side by side."""
    from pyspark.ml.functions import vector_to_array

    def scored(fold: int) -> DataFrame:
        fitted = fit_logistic(vectors.filter(F.col("fold") != fold), c, max_iterations)
        return fitted.transform(vectors.filter(F.col("fold") == fold)).select("basket_id", "fold", vector_to_array("rawPrediction").alias("z"))

    folds = [r[0] for r in vectors.select("fold").distinct().orderBy("fold").collect()]
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(scored, folds))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    known = F.array(*map(F.lit, names))
    return out.select("basket_id", "fold", F.explode(F.arrays_zip(known.alias("label"), F.col("z").alias("logit"))).alias("s")).select("basket_id", "fold", "s.label", "s.logit")


def pooled_loss(scores: DataFrame, labels: DataFrame) -> float:
    return log_loss(softmax(scores), labels).first()[0]


def cross_validate(matrix_of, labels: DataFrame, folded: DataFrame, n_features: int, names: list[str], weights=PARENT_WEIGHTS, cs=C_VALUES, max_iterations: int = MAX_ITERATIONS) -> list[tuple[float, float, float]]:
    """(loss, C, weight) of each configuration, pooled over held-out folds, best first; ties by C, then weight."""
    out = []
    for weight in weights:
        vectors = as_vectors(matrix_of(weight), labels, n_features, names).join(folded.select("basket_id", "fold"), "basket_id").cache()
        out += [(pooled_loss(out_of_fold(vectors, names, c, max_iterations), labels), c, weight) for c in cs]
        vectors.unpersist()
    return sorted(out)


def train_final(matrix_of, labels: DataFrame, n_features: int, names: list[str], c: float, weight: float, max_iterations: int = MAX_ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """Rounded coefficients and intercepts of the winning configuration, fitted on all baskets."""
    vectors = as_vectors(matrix_of(weight), labels, n_features, names).cache()
    out = parameters(fit_logistic(vectors, c, max_iterations), names)
    vectors.unpersist()
    return out


def contributions(matrix: DataFrame, coefficients: DataFrame, leaders: DataFrame, k: int = TOP_CONTRIBUTIONS) -> DataFrame:
    """(basket_id, label, rank, index, contribution): what moves each basket most towards leaders(basket_id, label)."""
    x = leaders.join(matrix, "basket_id").join(coefficients, ["label", "index"]).withColumn("contribution", F.col("value") * F.col("coefficient"))
    w = Window.partitionBy("basket_id", "label").orderBy(F.round("contribution", 9).desc(), "index")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("basket_id", "label", "rank", "index", "contribution")


def differentiators(matrix: DataFrame, coefficients: DataFrame, pairs: DataFrame, k: int = TOP_CONTRIBUTIONS) -> DataFrame:
    """(basket_id, rank, index, advantage): what speaks most for a basket's leader against its runner-up."""
    x = pairs.join(matrix, "basket_id")
    x = x.join(coefficients.select(F.col("label").alias("leader"), "index", F.col("coefficient").alias("a")), ["leader", "index"]).join(coefficients.select(F.col("label").alias("runner_up"), "index", F.col("coefficient").alias("b")), ["runner_up", "index"])
    x = x.withColumn("advantage", F.col("value") * (F.col("a") - F.col("b")))
    w = Window.partitionBy("basket_id").orderBy(F.round("advantage", 9).desc(), "index")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("basket_id", "rank", "index", "advantage")


def leader_and_runner_up(shares: DataFrame) -> DataFrame:
    w = Window.partitionBy("basket_id").orderBy(F.round("share", 9).desc(), "label")
    x = shares.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    return x.groupBy("basket_id").agg(F.min_by("label", "n").alias("leader"), F.max_by("label", "n").alias("runner_up"))


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)
