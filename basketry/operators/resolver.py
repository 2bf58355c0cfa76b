"""The tiered lookup: raw alias, cleaned form, key, stripped key, brand, dropped tokens. Distinct strings are resolved once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Brands, Modifiers, Singular

#: Methods in the order of their tiers; fixed values.
METHODS = ("exact_alias", "cleaned_match", "modifier_stripped_match", "brand_resolved_match", "token_drop_match", "unresolved")
#: Methods whose hit is an alias or a rule's, without dropped tokens; fixed values.
ALIAS_METHODS = METHODS[:4]
#: Tokens that must be left after a drop, and tokens that allow two to be dropped; fixed values.
LEAST_LEFT, TWO_DROPS = 2, 4


def _preferred(rows: DataFrame, key: str, space: str) -> DataFrame:
    """(space, key, id, mentions), one id for each text: more mentions win, then the smaller id."""
    best = F.min_by(F.struct("id", "mentions"), F.struct(-F.col("mentions"), F.col("id"))).alias("hit")
    found = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(best)
    return found.select(F.lit(space).alias("space"), "key", "hit.id", "hit.mentions")


def _probe(tier: int, space: str, key):
    return F.struct(F.lit(tier).alias("tier"), F.lit(space).alias("space"), key.alias("key"))


class Resolver:
    """One index of a vocabulary(id, name, train_mention_count, aliases), by raw alias, cleaned form and key, and the
    tiers that look into it.

    Every item asks all its early tiers at once, as rows that are joined to the index in one go; the least tier that
    has a hit wins. Only what is left asks for keys with dropped tokens, in a second join."""

    def __init__(self, vocabulary: DataFrame, modifiers: Modifiers = Modifiers(), brands: Brands = Brands(), singular: Singular = Singular(), variant_tokens: Iterable[str] = (), python: bool = True):
        self.modifiers, self.brands, self.singular, self.python = modifiers, brands, singular, python
        self.droppable_first = sorted(modifiers.tokens | modifiers.never | frozenset(variant_tokens))
        alias = vocabulary.select("id", F.col("train_mention_count").alias("mentions"), F.explode("aliases.alias").alias("raw"))
        surface = alias.union(vocabulary.select("id", "train_mention_count", "name")).withColumn("cleaned", T.clean(F.col("raw"), python))
        keyed = surface.withColumn("key", T.lookup_key(F.col("cleaned"), singular))
        self.index = _preferred(alias, "raw", "raw").union(_preferred(surface, "cleaned", "cleaned")).union(_preferred(keyed, "key", "key"))

    def _keys(self, items: DataFrame) -> DataFrame:
        """Distinct items with their cleaned form, keys and stripped key.

        What is cleaned is an aggregate of the distinct items: a filter on a grouping column would be pushed below the
        grouping, and with it the cleaning of every mention."""
        x = items.select("item").distinct().groupBy("item").agg(F.any_value("item").alias("text"))
        x = x.withColumn("cleaned", T.clean(F.col("text"), self.python)).drop("text")
        x = x.withColumn("stripped", T.strip_modifiers(F.col("cleaned"), self.modifiers))
        return x.withColumns({"key": T.lookup_key(F.col("cleaned"), self.singular), "strip_key": T.lookup_key(F.col("stripped"), self.singular)})

    def _generic_key(self, column: str):
        return T.lookup_key(T.clean(T.brand_generic(F.col(column), self.brands), self.python), self.singular)

    def _early(self, keys: DataFrame) -> DataFrame:
        """(item, tier, id) of the first of raw, cleaned, key, stripped key, and the generics of cleaned and stripped."""
        tiers = [_probe(0, "raw", F.col("item")), _probe(1, "cleaned", F.col("cleaned")), _probe(2, "key", F.col("key")), _probe(3, "key", F.col("strip_key"))]
        if self.brands.rules:
            tiers += [_probe(4, "key", self._generic_key("cleaned")), _probe(5, "key", self._generic_key("stripped"))]
        asked = keys.select("item", F.explode(F.array(*tiers)).alias("p")).select("item", "p.tier", "p.space", "p.key").filter("key is not null")
        hits = asked.join(self.index, ["space", "key"])
        return hits.groupBy("item").agg(F.min("tier").alias("tier"), F.min_by("id", "tier").alias("id"))

    def token_drop_candidates(self, keys: DataFrame) -> DataFrame:
        """(item, n_dropped, dropped, only_modifiers, id, mentions) of every indexed key that is left when one token of
        strip_key, or two of at least TWO_DROPS, are dropped; never the last, and LEAST_LEFT stay."""
        first = self.droppable_first or [""]
        x = keys.select("item", F.split("strip_key", " ").alias("t")).filter(F.size("t") > LEAST_LEFT)
        one = x.select("item", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("i")).withColumn("j", F.lit(0))
        two = one.filter(F.size("t") >= TWO_DROPS).filter(F.col("i") < F.size("t") - 1)
        two = two.select("item", "t", "i", F.explode(F.sequence(F.col("i") + 1, F.size("t") - 1)).alias("j"))
        gone = lambda k: (k + 1 == F.col("i")) | (k + 1 == F.col("j"))
        both = one.union(two).withColumns({"key": F.array_join(F.filter("t", lambda _, k: ~gone(k)), " "), "dropped": F.filter("t", lambda _, k: gone(k))})
        hits = both.join(self.index.filter("space = 'key'").select("key", "id", "mentions"), "key")
        only = F.forall("dropped", lambda d: d.isin(first))
        return hits.select("item", F.size("dropped").alias("n_dropped"), "dropped", only.alias("only_modifiers"), "id", "mentions")

    def token_drops(self, keys: DataFrame) -> DataFrame:
        """(item, drop_id, dropped): the best candidate. Fewer dropped tokens win, then drops that are all modifiers, then
        mentions, the smaller id and what was dropped."""
        rank = F.struct("n_dropped", (~F.col("only_modifiers")).alias("other"), (-F.col("mentions")).alias("fewer"), "id", "dropped")
        best = self.token_drop_candidates(keys).groupBy("item").agg(F.min(rank).alias("best"))
        return best.select("item", F.col("best.id").alias("drop_id"), F.array_join("best.dropped", " ").alias("dropped"))

    def resolve(self, items: DataFrame) -> DataFrame:
        """items(item) to (item, id, method, dropped), one row for each distinct item; blank items are unresolved."""
        keys = self._keys(items)
        x = keys.join(self._early(keys), "item", "left")
        rest = x.filter(F.col("tier").isNull() & F.col("cleaned").isNotNull())
        x = x.select("item", "tier", "id").join(self.token_drops(rest), "item", "left")
        method = F.when(F.col("tier") == 0, METHODS[0]).when(F.col("tier") <= 2, METHODS[1]).when(F.col("tier") == 3, METHODS[2]).when(F.col("tier") <= 5, METHODS[3]).when(F.col("drop_id").isNotNull(), METHODS[4]).otherwise(METHODS[5])
        return x.select("item", F.coalesce("id", "drop_id").alias("id"), method.alias("method"), "dropped")


def bad_resolutions(resolved: DataFrame) -> DataFrame:
    """Resolved rows of an unknown method, or whose id doesn't fit the method."""
    named, has = F.col("method").isin(list(METHODS)), F.col("id").isNotNull()
    return resolved.filter(~F.coalesce(named, F.lit(False)) | (has != (F.col("method") != METHODS[-1])))


def stage(mentions: DataFrame, labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each basket of labels: distinct ids in the order first seen, unresolved items with repeats, raw count.

    A basket's mentions meet once: it is bounded by its own length, and what it holds is sorted in place."""
    x = mentions.join(resolved.select("item", F.col("id").alias("item_id")), "item", "left")
    rows = x.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "item"))).alias("seen"))
    ids = F.array_distinct(F.transform(F.filter("seen", lambda s: s["item_id"].isNotNull()), lambda s: s["item_id"]))
    rest = F.transform(F.filter("seen", lambda s: s["item_id"].isNull()), lambda s: s["item"])
    rows = rows.select("basket_id", ids.alias("item_ids"), rest.alias("unresolved"), F.size("seen").cast("long").alias("raw_count"))
    empty = F.expr("cast(array() as array<string>)")
    out = labels.join(rows, "basket_id", "left")
    return out.select("basket_id", "label", F.coalesce("item_ids", empty).alias("item_ids"), F.coalesce("unresolved", empty).alias("unresolved"), F.coalesce("raw_count", F.lit(0)).cast("long").alias("raw_count"))


def _counted(mentions: DataFrame) -> DataFrame:
    """(item, mentions): counted before any join, so that no row of a mention is exchanged."""
    return mentions.groupBy("item").agg(F.count("*").alias("mentions"))


def resolution_statistics(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(method, mentions, share): every method has a row."""
    spark = mentions.sparkSession
    counted = _counted(mentions)
    counts = counted.join(resolved, "item").groupBy("method").agg(F.sum("mentions").alias("mentions"))
    every = spark.createDataFrame([(m,) for m in METHODS], "method string").join(counts, "method", "left").na.fill(0, ["mentions"])
    total = counted.agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("total"))
    return every.crossJoin(F.broadcast(total)).select("method", "mentions", F.coalesce(F.round(F.try_divide("mentions", "total"), 4), F.lit(0.0)).alias("share"))


def top_unresolved(mentions: DataFrame, resolved: DataFrame, k: int = 50) -> DataFrame:
    x = _counted(mentions).join(resolved.filter("id is null").select("item"), "item").groupBy("item").agg(F.sum("mentions").alias("mentions"))
    return x.orderBy(F.col("mentions").desc(), "item").limit(k)


def merge_top_unresolved(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    """Two lists made one; each was cut before, as the report has it."""
    return a.unionByName(b).groupBy("item").agg(F.sum("mentions").alias("mentions")).orderBy(F.col("mentions").desc(), "item").limit(k)


#: Upper ends and names of the alias histogram; fixed values.
BUCKETS = ((1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"))


def alias_histogram(sizes: DataFrame) -> DataFrame:
    """(bucket, groups) of sizes(n)."""
    out = F.when(F.col("n") <= BUCKETS[0][0], BUCKETS[0][1])
    for most, name in BUCKETS[1:]:
        out = out.when(F.col("n") <= most, name)
    return sizes.groupBy(out.otherwise("21+").alias("bucket")).agg(F.count("*").alias("groups"))


def vocabulary_summary(vocabulary: DataFrame) -> DataFrame:
    """One row: ids, aliases and preserved variants of a vocabulary(id, parent_id, aliases)."""
    return vocabulary.agg(
        F.count("*").alias("ingredient_count"),
        F.coalesce(F.sum(F.size("aliases")), F.lit(0)).cast("long").alias("alias_count"),
        F.count("parent_id").alias("preserved_variant_count"),
    )


def aliases_by_source(vocabulary: DataFrame, sources: Iterable[str]) -> DataFrame:
    """(source, aliases): every known source has a row, and so has an unknown one that stands in the vocabulary."""
    counts = vocabulary.select(F.explode("aliases.source").alias("source")).groupBy("source").agg(F.count("*").alias("aliases"))
    known = vocabulary.sparkSession.createDataFrame([(x,) for x in sources], "source string")
    return known.join(counts, "source", "full").na.fill(0, ["aliases"])


def coverage_summary(statistics: DataFrame) -> DataFrame:
    """One row of a split's statistics(method, mentions): the total, and the shares that aliases and all tiers resolve."""
    total = F.sum("mentions")
    part = lambda keep: F.coalesce(F.round(F.try_divide(F.sum(F.when(keep, F.col("mentions")).otherwise(0)), total), 4), F.lit(0.0))
    method = F.col("method")
    return statistics.agg(total.alias("mentions_total"), part(method.isin(list(ALIAS_METHODS))).alias("alias_tier_coverage"), part(method != METHODS[-1]).alias("full_chain_coverage"))
