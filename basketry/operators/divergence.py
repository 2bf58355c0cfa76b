"""How differently two groups of items are spread over labels, and what the merge gate makes of it."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.lexicon import Gate

#: Names of the gate's layers; fixed values.
EXCEPTION, PATTERN, OVERRIDE, STATISTICS = "do_not_merge_exception", "always_merge_lexicon", "forced_merge_override", "statistical_gate"
VARIETY, SMALL_DEFAULT, SMALL_REVIEWED = "named_variety_lexicon", "small_sample_default", "small_sample_review"
# Fixed values of the gate.
PRESERVE_BITS, PRESERVE_RATIO = 0.07, 1.5
BORDER_BITS, BORDER_RATIO = (0.06, 0.08), (1.3, 1.7)
TESTABLE, SMALL_REVIEW, CONCENTRATED = 20, 5, 0.80
TRIALS, SEED, QUANTILE, TOP = 1000, 42, 0.95, 5
#: Numbers that a worker draws at once.
DRAWN_AT_ONCE = 1 << 18


def shares_of(baskets: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, label, n, total, share) of distinct baskets(group, basket_id, label); labels without one get zero."""
    return shares_of_counts(baskets.groupBy("group", "label").agg(F.count("*").alias("n")), groups, labels)


def shares_of_counts(counts: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """shares_of() from counts(group, label, n)."""
    full = groups.crossJoin(labels.select("label").distinct()).join(counts, ["group", "label"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("group"))
    return full.withColumn("total", total).withColumn("share", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)))


def label_shares(mentions: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, label, n, total, share): over the baskets that have any item of groups(group, item)."""
    baskets = mentions.join(groups, "item").select("group", "basket_id").distinct().join(labels, "basket_id")
    return shares_of(baskets, groups.select("group").distinct(), labels)


def jsd_bits(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two share arrays of equal length, in bits, at least 0."""
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)

    def kl(x):
        terms = F.zip_with(x, m, lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    return F.greatest(F.lit(0.0), (kl(p) + kl(q)) / 2)


def null95s(base: list[float], ns: Iterable[int], trials: int = TRIALS, seed: int = SEED) -> dict[int, float]:
    """For each n the 95th percentile (nearest rank) of the divergence between a base and samples of n draws from it.

    Draws follow Mersenne Twister seeded with the list [seed], one uniform number each, looked up in cumulative shares.
    The k-th sample of n is the k-th run of n numbers of that one stream, whatever n is, so the stream is drawn once for
    all of ns: what lies below each cumulative share is counted between the ends of samples. The stream is taken
    DRAWN_AT_ONCE at a time and only each sample's divergence is kept, so that memory doesn't grow with n."""
    p = np.asarray(base, float)
    out = {int(n): 0.0 for n in ns}
    if p.sum() <= 0:
        return out
    asked = sorted(n for n in out if n > 0)
    upto = np.cumsum(p)
    draws = np.random.RandomState([seed])
    bits = {n: np.empty(trials) for n in asked}
    done = dict.fromkeys(asked, 0)  # samples that have ended
    last = {n: np.zeros(len(p) - 1, np.int64) for n in asked}  # numbers below each share where the last one ended
    before, at, whole = np.zeros(len(p) - 1, np.int64), 0, trials * max(asked, default=0)
    while at < whole:
        u = draws.random_sample(min(whole - at, DRAWN_AT_ONCE))
        u *= upto[-1]
        ending = {n: ends for n in asked if len(ends := np.arange((done[n] + 1) * n - at, min(len(u), trials * n - at) + 1, n))}
        cuts = np.unique(np.concatenate([*ending.values(), [len(u)]]))
        below = np.empty((len(cuts), len(p) - 1), np.int64)
        for j, share in enumerate(upto[:-1]):
            hit = u < share
            if len(cuts) * 256 < len(u):
                below[:, j] = np.cumsum([np.count_nonzero(x) for x in np.split(hit, cuts[:-1])])
            else:
                below[:, j] = np.cumsum(hit)[cuts - 1]
        below += before
        for n, ends in ending.items():
            seen = below[np.searchsorted(cuts, ends)]
            counts = np.diff(seen, axis=0, prepend=last[n][None])
            counts = np.diff(counts, axis=1, prepend=0, append=n)
            bits[n][done[n] : done[n] + len(ends)] = _bits(p, counts / n)
            done[n], last[n] = done[n] + len(ends), seen[-1]
        before, at = below[-1], at + len(u)
        asked = [n for n in asked if done[n] < trials]
    rank = min(trials - 1, math.ceil(QUANTILE * trials) - 1)
    return out | {n: float(np.sort(x)[rank]) for n, x in bits.items()}


def _bits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence of each row of q from p."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        towards_p = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
        towards_q = np.where(q > 0, q * np.log2(q / m), 0.0).sum(1)
    return np.maximum(0.0, (towards_p + towards_q) / 2)


def null95(base: list[float], n: int, trials: int = TRIALS, seed: int = SEED) -> float:
    """null95s() of one n."""
    return null95s(base, [n], trials, seed)[int(n)]


@F.pandas_udf(ArrayType(DoubleType()))
def _null95s(base: pd.Series, ns: pd.Series) -> pd.Series:
    return pd.Series([[found[int(n)] for n in k] for found, k in ((null95s(list(b), k), k) for b, k in zip(base, ns, strict=True))])


def with_null95(pairs: DataFrame, base: str = "base_shares", n: str = "variant_count") -> DataFrame:
    """Adds null95_bits, simulated once for each distinct (base at six decimals, n).

    The pairs of a base are simulated together, and bases are dealt to tasks of their own: few as the rows are, each is
    as much work as a thousand times its largest n."""
    once = pairs.groupBy(F.transform(base, lambda x: F.round(x, 6)).alias("_base")).agg(F.collect_list(F.struct(*pairs.columns)).alias("_pairs"))
    once = once.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "_base")
    once = once.withColumn("_ns", F.array_sort(F.array_distinct(F.transform("_pairs", lambda x: x[n]))))
    once = once.withColumn("_null", F.map_from_arrays("_ns", _null95s("_base", "_ns")))
    return once.select("_null", F.explode("_pairs").alias("_pair")).select("_pair.*", F.try_element_at("_null", F.col(f"_pair.{n}")).alias("null95_bits"))


def top_shares(shares: DataFrame, priors: DataFrame, k: int = TOP) -> DataFrame:
    """(group, rank, label, share, lift): the largest shares above zero, lift over the label's share of all baskets."""
    w = Window.partitionBy("group").orderBy(F.round("share", 9).desc(), "label")
    ranked = shares.filter("share > 0").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.join(priors, "label").select("group", "rank", "label", "share", (F.col("share") / F.col("prior")).alias("lift"))


def shown_top(top: Column) -> Column:
    """Top labels as a line: "label share% (liftx)", or (none)."""
    line = F.transform(top, lambda x: F.concat(x["label"], F.lit(" "), F.format_string("%.1f", x["share"] * 100), F.lit("% ("), F.format_string("%.1f", x["lift"]), F.lit("x)")))
    return F.when(F.coalesce(F.size(top), F.lit(0)) > 0, F.array_join(line, ", ")).otherwise("(none)")


def label_priors(labels: DataFrame) -> DataFrame:
    total = labels.agg(F.count_distinct("basket_id").alias("all"))  # one row
    counts = labels.groupBy("label").agg(F.count_distinct("basket_id").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("all")).alias("prior"))


def evidence_of(pairs: DataFrame, shares: DataFrame, priors: DataFrame, simulate: bool = True) -> DataFrame:
    """pairs(variant, base) with counts, divergence, its null level, their ratio and both sides' top labels."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("label", "share"))), lambda x: x["share"])
    wide = shares.groupBy("group").agg(F.max("total").alias("count"), ordered.alias("shares"))
    entry = lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share"), x["lift"].alias("lift"))
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "share", "lift"))), entry)
    side = wide.join(top_shares(shares, priors).groupBy("group").agg(top.alias("top")), "group", "left")
    out = pairs
    for name in ("variant", "base"):
        own = side.select(F.col("group").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("count", "shares", "top")))
        out = out.join(own, name)
    out = out.withColumn("jsd_bits", jsd_bits(F.col("variant_shares"), F.col("base_shares")))
    out = with_null95(out) if simulate else out.withColumn("null95_bits", F.lit(0.0))
    return out.withColumn("jsd_to_null_ratio", ratio_to_null(F.col("jsd_bits"), F.col("null95_bits")))


def evidence(pairs: DataFrame, mentions: DataFrame, labels: DataFrame, members: DataFrame, simulate: bool = True) -> DataFrame:
    """evidence_of() the pairs, over the mentions of the groups that stand in pairs; members has (group, item)."""
    asked = pairs.select(F.col("variant").alias("group")).union(pairs.select("base")).distinct()
    own = members.select("group", "item").join(asked, "group", "left_semi")
    return evidence_of(pairs, label_shares(mentions, labels, own), label_priors(labels), simulate)


def over_null(jsd: Column, null95_bits: Column) -> Column:
    """Whether a divergence clears the floor and the null level; a null level of 0 holds nothing back."""
    return (jsd >= PRESERVE_BITS) & (jsd >= PRESERVE_RATIO * null95_bits)


def verdict(jsd: Column, null95_bits: Column, n: Column) -> Column:
    """The plain statistical verdict, for information."""
    return F.when(n < TESTABLE, "review").when(over_null(jsd, null95_bits), "preserve").otherwise("merge")


def ratio_to_null(jsd: Column, null95_bits: Column) -> Column:
    return F.when(null95_bits > 0, jsd / null95_bits).otherwise(0.0)


def decide(variant: Column, n: Column, jsd: Column, null95_bits: Column, top_share: Column, gate: Gate) -> Column:
    """struct(action, layer) of the layered gate: exact exceptions, lexicon merges, statistics for testable variants, small samples."""
    say = lambda action, layer: F.struct(F.lit(action).alias("action"), F.lit(layer).alias("layer"))
    matches = F.lit(False)
    for p in gate.always_merge:
        matches = matches | variant.rlike(p)
    named = F.lit(False)
    for phrase in sorted(gate.varieties):
        named = named | variant.rlike(rf"(?<!\w)\Q{phrase}\E(?!\w)")
    border = jsd.between(*BORDER_BITS) | ratio_to_null(jsd, null95_bits).between(*BORDER_RATIO)
    out = F.when(variant.isin(sorted(gate.never_merge) or [""]), say("preserve", EXCEPTION))
    out = out.when(matches, say("merge", PATTERN)).when(variant.isin(sorted(gate.forced) or [""]), say("merge", OVERRIDE))
    out = out.when((n >= TESTABLE) & border, say("review", STATISTICS))
    out = out.when((n >= TESTABLE) & over_null(jsd, null95_bits), say("preserve", STATISTICS)).when(n >= TESTABLE, say("merge", STATISTICS))
    out = out.when(named, say("preserve", VARIETY))
    return out.when((n >= SMALL_REVIEW) & (top_share >= CONCENTRATED), say("review", SMALL_REVIEWED)).otherwise(say("merge", SMALL_DEFAULT))
