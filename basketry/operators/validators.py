"""Which gates each stored table has to hold. A validator returns gates; gates.run() raises on the first rows of those
that are broken. Everything that grows with the corpus is checked by joins and aggregates; figures of a build (a
configuration, a temperature) are a few values on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features, gates, model
from .gates import Gate
from .resolver import ALIAS_METHODS, METHODS
from .vocabulary import ALIAS_SOURCES, compile_statistics

# Fixed values of the gates.
ALIAS_FLOOR, CHAIN_FLOORS = 0.988, {"train": 0.990, "test": 0.985}
SPLITS, TOP_UNRESOLVED, SPREAD = ("train", "test"), 50, 1
BLEND_TOLERANCE, LOSS_TOLERANCE, MEAN_TOLERANCE, CIRCLE_TOLERANCE = 0.002, 1e-6, 1e-6, 1e-3
ASSET_DIGITS, BINS = 4, 10


def _claims(spark: SparkSession, broken: Iterable[str]) -> DataFrame:
    """Violations among values that the driver has."""
    return spark.createDataFrame([(x,) for x in broken], "claim string")


def build_gates(spark: SparkSession, builds: dict[str, dict], keys: Iterable[str], expected: dict | None = None) -> list[Gate]:
    """All artifacts carry one build block with exactly these keys, and it is the expected one."""
    want = set(keys)
    first = next(iter(builds.values()), {})
    return [
        Gate("build blocks are complete", _claims(spark, [name for name, b in builds.items() if set(b) != want])),
        Gate("build blocks are alike", _claims(spark, [name for name, b in builds.items() if b != first])),
        Gate("build blocks are fresh", _claims(spark, [name for name, b in builds.items() if expected is not None and b != expected])),
    ]


def vocabulary_gates(vocabulary: DataFrame) -> list[Gate]:
    alias = vocabulary.select("id", F.explode_outer("aliases").alias("a")).select("id", "a.alias", "a.source")
    texts = vocabulary.select("id", F.col("aliases.alias").alias("alias"))
    count = F.col("train_mention_count")
    return [
        Gate("ids are slugs and stand once", gates.bad_slug(vocabulary.select("id"))),
        Gate("names are there", vocabulary.filter(F.col("name").isNull() | (F.trim("name") == "")).select("id")),
        Gate("mentions are counted", vocabulary.filter(count.isNull() | (count < 0)).select("id", "train_mention_count")),
        Gate("aliases are there", vocabulary.filter(F.coalesce(F.size("aliases"), F.lit(0)) < 1).select("id")),
        Gate("aliases have text", alias.filter("alias is null or alias = ''")),
        Gate("sources are known", alias.filter(~F.coalesce(F.col("source").isin(list(ALIAS_SOURCES)), F.lit(False)))),
        Gate("aliases are sorted and stand once", gates.unsorted_in_row(texts, "id", "alias")),
        Gate("an alias has one owner", gates.shared_alias(alias.filter("alias is not null"))),
        Gate("no name is another's alias", gates.foreign_name(vocabulary, alias)),
        Gate("parents are roots that are there", gates.bad_parent(vocabulary.select("id", "parent_id"))),
    ]


def compiled_gates(vocabulary: DataFrame, mentions: DataFrame, floor: float = ALIAS_FLOOR) -> list[Gate]:
    """What a vocabulary has to hold right after it was compiled from mentions."""
    covered = compile_statistics(mentions, vocabulary).filter(F.col("coverage_ratio") < floor)
    return [*vocabulary_gates(vocabulary), Gate("aliases cover the mentions", covered)]


def staged_gates(staged: DataFrame, vocabulary: DataFrame, expected: int | None, names: Iterable[str] | None) -> list[Gate]:
    """staged(basket_id, label, item_ids, unresolved, raw_count); names are the labels of a labelled split, None of one without."""
    known = F.col("label").isin(list(names)) if names is not None else F.col("label").isNull()
    empty = F.size("item_ids") < 1 if names is not None else F.lit(False)
    ids = staged.select("basket_id", F.explode("item_ids").alias("id"))
    out = [
        Gate("baskets stand once", gates.repeated(staged, "basket_id")),
        Gate("labels are known", staged.filter(~F.coalesce(known, F.lit(False))).select("basket_id", "label")),
        Gate("ids are in the vocabulary", gates.unknown_key(ids, "id", vocabulary, "id")),
        Gate("ids stand once in a basket", gates.repeated_in_row(staged, "basket_id", "item_ids")),
        Gate("labelled baskets have ids", staged.filter(empty).select("basket_id")),
        Gate("unresolved items have text", staged.filter(F.exists("unresolved", lambda x: x.isNull() | (x == ""))).select("basket_id")),
        Gate("items are counted", staged.filter("raw_count is null or raw_count < 0").select("basket_id", "raw_count")),
    ]
    return out if expected is None else [Gate("baskets are as many as expected", gates.wrong_count(staged, expected)), *out]


def statistics_gates(statistics: DataFrame, totals: DataFrame, unresolved: DataFrame, floors: dict[str, float] = CHAIN_FLOORS, alias_floor: float = ALIAS_FLOOR) -> list[Gate]:
    """statistics(split, method, mentions), totals(split, mentions_total), unresolved(split, item, mentions)."""
    spark = statistics.sparkSession
    grid = spark.createDataFrame([(s, m) for s in SPLITS for m in METHODS], "split string, method string")
    summed = statistics.groupBy("split").agg(F.sum("mentions").alias("n"), F.sum(F.when(F.col("method") == METHODS[-1], F.col("mentions")).otherwise(0)).alias("lost"))
    sums = totals.join(summed, "split", "full")
    one = lambda split: statistics.filter(F.col("split") == split)
    return [
        Gate("both splits have every method", grid.join(statistics.select("split", "method"), ["split", "method"], "left_anti")),
        Gate("no other method is counted", statistics.select("split", "method").join(grid, ["split", "method"], "left_anti")),
        Gate("counts are not negative", statistics.filter("mentions is null or mentions < 0")),
        Gate("totals are positive and the sum", sums.filter("mentions_total is null or n is null or mentions_total <= 0 or n <> mentions_total")),
        Gate("lists of unresolved items are cut", unresolved.groupBy("split").agg(F.count("*").alias("n")).filter(F.col("n") > TOP_UNRESOLVED)),
        Gate("aliases cover the training split", gates.coverage_below(one("train"), ALIAS_METHODS, alias_floor)),
        *(Gate(f"the chain covers the {s} split", gates.coverage_below(one(s), METHODS[:-1], floor)) for s, floor in floors.items()),
    ]


def family_gates(labels: DataFrame, families: dict[str, str]) -> list[Gate]:
    """Labels and assigned families match one by one."""
    assigned = labels.sparkSession.createDataFrame(sorted(families.items()), "label string, family string")
    return [Gate("labels have a family and families a label", gates.unmatched(labels, assigned, "label"))]


def space_gates(space: DataFrame, vocabulary: DataFrame, expected: int | None = None) -> list[Gate]:
    """space(index, id, parent_index): ids of the vocabulary in their order, indexes from 0 one by one, parents by index."""
    by_id = space.select(F.col("id").alias("parent_id"), F.col("index").alias("wanted"))
    linked = space.join(vocabulary.select("id", "parent_id"), "id").join(by_id, "parent_id", "left")
    ends = space.agg(F.min("index").alias("low"), F.max("index").alias("high"), F.count_distinct("index").alias("n"), F.count("*").alias("rows"))
    out = [
        Gate("ids are those of the vocabulary", gates.unmatched(space, vocabulary, "id")),
        Gate("indexes run from 0 one by one", ends.filter("rows > 0 and (low <> 0 or high <> n - 1 or rows <> n)")),
        Gate("ids rise with the index", gates.not_ascending(space, "id", "index")),
        Gate("parents are linked by index", linked.filter(~F.col("parent_index").eqNullSafe(F.col("wanted"))).select("id", "parent_index", "wanted")),
    ]
    return out if expected is None else [Gate("features are as many as expected", gates.wrong_count(space, expected)), *out]


def rows_gates(rows: DataFrame, space: DataFrame, staged: DataFrame, expected: int | None = None, empty: int | None = None) -> list[Gate]:
    """rows(basket_id, label, indices, parents) against what the staged baskets give again."""
    mentions = staged.select("basket_id", F.explode("item_ids").alias("item"))
    again = features.feature_rows(mentions, staged.select("basket_id", "label"), space)
    index = rows.select("basket_id", F.explode(F.concat("indices", "parents")).alias("index"))
    out = [
        Gate("baskets stand once", gates.repeated(rows, "basket_id")),
        Gate("baskets are those that were staged", gates.unmatched(rows, staged, "basket_id")),
        Gate("indexes are in the space", gates.unknown_key(index, "index", space, "index")),
        Gate("indexes rise", gates.unsorted_in_row(rows, "basket_id", "indices")),
        Gate("parents rise", gates.unsorted_in_row(rows, "basket_id", "parents")),
        Gate("rows follow from the staged baskets", gates.differing(rows.select("basket_id", "label", "indices", "parents"), again)),
    ]
    if expected is not None:
        out.append(Gate("rows are as many as expected", gates.wrong_count(rows, expected)))
    if empty is not None:
        out.append(Gate("empty rows are as many as expected", gates.wrong_count(rows.filter(F.size("indices") < 1), empty)))
    return out


def fold_gates(folded: DataFrame, staged: DataFrame, k: int = features.FOLDS) -> list[Gate]:
    """folded(basket_id, label, fold): each staged basket once, folds in range, each label spread evenly."""
    return [
        Gate("baskets stand once", gates.repeated(folded, "basket_id")),
        Gate("baskets are those that were staged", gates.unmatched(folded, staged, "basket_id")),
        Gate("labels are those that were staged", gates.differing(folded.select("basket_id", "label"), staged.select("basket_id", "label"))),
        Gate("folds are in range", folded.filter(F.col("fold").isNull() | ~F.col("fold").between(0, k - 1))),
        Gate("labels are spread evenly", gates.fold_spread(features.fold_balance(folded, k), k)),
    ]


def balance_gates(balance: DataFrame, folded: DataFrame, k: int = features.FOLDS) -> list[Gate]:
    return [Gate("the balance is that of the folds", gates.differing(balance, features.fold_balance(folded, k)))]


def parameter_gates(coefficients: DataFrame, intercepts: DataFrame, configuration: dict, names: Iterable[str], n_features: int) -> list[Gate]:
    spark, names = coefficients.sparkSession, sorted(names)
    known = spark.createDataFrame([(x,) for x in names], "label string")
    per_label = known.join(coefficients.groupBy("label").agg(F.count_distinct("index").alias("n"), F.max("index").alias("high")), "label", "left")
    odd = [f"{k} {configuration.get(k)}" for k, grid in (("c", model.C_VALUES), ("parent_weight", model.PARENT_WEIGHTS)) if configuration.get(k) not in grid]
    return [
        Gate("intercepts are those of the labels", gates.unmatched(intercepts, known, "label").union(gates.repeated(intercepts, "label").select("label"))),
        Gate("each label has each feature", per_label.filter((F.coalesce("n", F.lit(0)) != n_features) | (F.col("high") != n_features - 1))),
        Gate("no other label has coefficients", gates.unmatched(coefficients, known, "label")),
        Gate("coefficients are rounded", gates.not_rounded(coefficients, "coefficient", 6)),
        Gate("intercepts are rounded", gates.not_rounded(intercepts, "intercept", 6)),
        Gate("the configuration is in the grid", _claims(spark, odd)),
    ]


def calibration_gates(spark: SparkSession, calibration: dict) -> list[Gate]:
    low, high = (10.0**x for x in model.LOG_RANGE)
    t, worse = calibration["temperature"], calibration["log_loss_after"] > calibration["log_loss_before"] + LOSS_TOLERANCE
    return [Gate("the temperature is in range", _claims(spark, [] if low <= t <= high else [str(t)])), Gate("calibration loses nothing", _claims(spark, ["log loss"] if worse else []))]


def blend_gates(blends: DataFrame, names: Iterable[str], baskets: DataFrame, expected: int | None = None) -> list[Gate]:
    """blends(basket_id, blend, top): shares in the order of names for each of baskets, the top one the largest."""
    order = F.array(*map(F.lit, names))
    total = F.aggregate("blend", F.lit(0.0), lambda acc, x: acc + x)
    own = F.get("blend", (F.array_position(order, F.col("top")) - 1).cast("int"))
    out = [
        Gate("baskets stand once", gates.repeated(blends, "basket_id")),
        Gate("baskets are those asked for", gates.unmatched(blends, baskets, "basket_id")),
        gates.of_rows("each label has a share", blends, F.size("blend") != F.size(order), "basket_id"),
        gates.of_rows("shares lie between 0 and 1", blends, F.exists("blend", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "basket_id"),
        gates.of_rows("shares add up to 1", blends, F.abs(total - 1) > BLEND_TOLERANCE, "basket_id"),
        gates.of_rows("the top label has the largest share", blends, ~F.coalesce(own == F.array_max("blend"), F.lit(False)), "basket_id", "top"),
    ]
    return out if expected is None else [*out, Gate("blends are as many as expected", gates.wrong_count(blends, expected))]


def submission_gates(submission: DataFrame, blends: DataFrame, names: tuple[str, str] = ("id", "cuisine")) -> list[Gate]:
    """A submission as it was read back, with its header's names, against the blends' top labels."""
    spark = submission.sparkSession
    if tuple(submission.columns) != names:
        return [Gate("the header is as fixed", _claims(spark, [",".join(submission.columns)]))]
    text = lambda df, a, b: df.select(F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("top"))
    return [Gate("rows are the blends' top labels", gates.differing(text(submission, *names), text(blends, "basket_id", "top")))]


def evaluation_gates(evaluation: dict, configuration: dict, names: Iterable[str], grid: list[tuple[float, float, float]], similarity: DataFrame) -> list[Gate]:
    """An evaluation's frames against its configuration, the grid's (loss, C, weight), labels and similarity(truth, predicted, similarity)."""
    folds, mean, pairs = evaluation["folds"], evaluation["mean"], evaluation["confusion_pairs"]
    spark, names = folds.sparkSession, sorted(names)
    known = spark.createDataFrame([(x,) for x in names], "label string")
    metrics = [c for c in folds.columns if c != "fold"]
    again = folds.agg(*(F.avg(c).alias(f"_{c}") for c in metrics))
    drift = mean.crossJoin(F.broadcast(again))  # one row each
    drift = drift.filter(" or ".join(f"abs({c} - _{c}) > {MEAN_TOLERANCE}" for c in metrics))
    broken = [f"C {c}, weight {w}" for _, c, w in grid if c not in model.C_VALUES or w not in model.PARENT_WEIGHTS]
    best = min(grid, default=None)
    own = (configuration["c"], configuration["parent_weight"])
    ends = pairs.select(F.col("truth").alias("label")).union(pairs.select("predicted"))
    looked_up = pairs.select("truth", "predicted", F.col("similarity").alias("got")).join(similarity.toDF("truth", "predicted", "wanted"), ["truth", "predicted"], "left")
    return [
        Gate("there are folds, each once", gates.repeated(folds, "fold").select("fold").union(folds.agg(F.count("*").alias("fold")).filter("fold = 0"))),
        Gate("means are those of the folds", drift),
        Gate("every label has a recall", gates.unmatched(evaluation["per_label"], known, "label")),
        Gate("the grid is the fixed one", _claims(spark, broken)),
        Gate("the configuration is the grid's best", _claims(spark, [str(own)] if best is not None and best[1:] != own else [])),
        Gate("confusions join two labels", pairs.filter("truth = predicted").select("truth", "predicted")),
        Gate("confusions are of known labels", gates.unknown_key(ends, "label", known, "label")),
        Gate("similarities are the taxonomy's", looked_up.filter(~F.col("got").eqNullSafe(F.col("wanted")))),
    ]


def model_asset_gates(asset: dict, n_labels: int, n_features: int) -> list[Gate]:
    """asset: frames coefficients, intercepts and features of the scoring asset, its temperature and parent_weight."""
    spark = asset["coefficients"].sparkSession
    per_label = asset["coefficients"].groupBy("label").agg(F.count("*").alias("n"))
    odd = [f"{k} {asset[k]}" for k, ok in (("temperature", asset["temperature"] > 0), ("parent_weight", asset["parent_weight"] >= 0)) if not ok]
    return [
        Gate("labels are as many as expected", gates.wrong_count(asset["intercepts"], n_labels)),
        Gate("features are as many as expected", gates.wrong_count(asset["features"], n_features)),
        Gate("each label has each feature", per_label.filter(F.col("n") != n_features)),
        Gate("coefficients are rounded", gates.not_rounded(asset["coefficients"], "coefficient", ASSET_DIGITS)),
        Gate("constants are in range", _claims(spark, odd)),
    ]


def ingredients_asset_gates(ingredients: DataFrame, feature_ids: DataFrame) -> list[Gate]:
    """ingredients(id, parent_id, children, ...) against the features(id) of the scoring asset."""
    kin = ingredients.select(F.col("parent_id").alias("id")).filter("id is not null").union(ingredients.select(F.explode("children").alias("id")))
    return [
        Gate("ids stand once", gates.repeated(ingredients, "id")),
        Gate("ids are those of the features", gates.unmatched(ingredients, feature_ids, "id")),
        Gate("parents and children are there", gates.unknown_key(kin, "id", ingredients, "id")),
    ]


def cuisines_asset_gates(places: DataFrame, edges: DataFrame, ingredients: DataFrame, n_labels: int) -> list[Gate]:
    """places(label, x, y, recall, distinctive) and edges(a, b, similarity)."""
    ends = edges.select(F.col("a").alias("label")).union(edges.select("b"))
    shown = places.select(F.explode("distinctive.id").alias("id"))
    return [
        Gate("labels are as many as expected", gates.wrong_count(places, n_labels)),
        Gate("labels lie on the circle", gates.off_circle(places, CIRCLE_TOLERANCE)),
        Gate("labels have a recall", places.filter("recall is null").select("label")),
        Gate("distinctive items are known", gates.unknown_key(shown, "id", ingredients, "id")),
        Gate("edges join known labels", gates.unknown_key(ends, "label", places, "label")),
    ]


def card_gates(card: dict, n_labels: int) -> list[Gate]:
    return [
        Gate("labels are as many as expected", gates.wrong_count(card["per_label"], n_labels)),
        *(Gate(f"bins {phase} calibration are complete", gates.wrong_count(card[f"reliability_{phase}"], BINS)) for phase in ("before", "after")),
    ]


def vector_gates(vectors: DataFrame, names: Iterable[str]) -> list[Gate]:
    """vectors(name, blend, top, ...): expected scores of fixed baskets."""
    order = F.array(*map(F.lit, names))
    own = F.get("blend", (F.array_position(order, F.col("top")) - 1).cast("int"))
    total = F.aggregate("blend", F.lit(0.0), lambda acc, x: acc + x)
    return [
        Gate("each label has a share", vectors.filter(F.size("blend") != F.size(order)).select("name")),
        Gate("shares add up to 1", vectors.filter(F.abs(total - 1) > BLEND_TOLERANCE).select("name")),
        Gate("the top label has the largest share", vectors.filter(~F.coalesce(own == F.array_max("blend"), F.lit(False))).select("name", "top")),
    ]
