"""From raw item strings to groups: mechanical grouping, reduction moves, candidate pairs, gate outcomes, decisions, compilation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Brands, Gate, Modifiers, Singular
from ..session import dealt
from .divergence import OVERRIDE, PATTERN, PRESERVE_BITS, PRESERVE_RATIO, SMALL_DEFAULT, STATISTICS, decide, evidence, evidence_of, label_priors, shares_of_counts

#: Baskets that a group needs to be in scope, and rounds of reduction; fixed values.
SCOPE, ROUNDS = 4, 3
#: Sources of an alias, and the one that a merge records by the gate's layer; fixed values.
ALIAS_SOURCES = (
    "canonical_surface_form",
    "mechanical_normalization",
    "modifier_strip",
    "always_merge_lexicon",
    "forced_merge_override",
    "statistical_gate",
    "named_variety_lexicon",
    "brand_pattern",
    "manual_alias",
    "manual_review",
)
MERGE_SOURCE = {PATTERN: "always_merge_lexicon", OVERRIDE: "forced_merge_override", STATISTICS: "statistical_gate", SMALL_DEFAULT: "statistical_gate"}
#: Example baskets of a review entry; fixed value.
EXAMPLES = 5
_TOP = "array<struct<label:string,share:double,lift:double>>"
PRESERVED = "variant string, base string, layer string, jsd_bits double, null95_bits double, variant_count long"
QUEUE = f"decision_id string, variant string, base string, variant_string string, base_string string, variant_count long, base_count long, jsd_bits double, null95_bits double, jsd_to_null_ratio double, variant_top {_TOP}, base_top {_TOP}, gate_route string, suggested string, reason string, target string"


def group_mechanically(raw: DataFrame, singular: Singular = Singular(), aliases: dict[str, str] | None = None, python: bool = True) -> DataFrame:
    """raw(item) to members(item, cleaned, source, rule, group): aliases redirect, the rest is cleaned; the singular key groups."""
    once = raw.select("item").distinct()
    if aliases:
        table = F.broadcast(raw.sparkSession.createDataFrame(sorted(aliases.items()), "item string, target string"))  # a lexicon
        once = once.join(table, "item", "left")
    else:
        once = once.withColumn("target", F.lit(None).cast("string"))
    out = once.withColumn("cleaned", T.clean(F.coalesce("target", "item"), python))
    out = out.withColumns({"source": F.when(F.col("target").isNotNull(), "manual_alias").otherwise("mechanical_normalization"), "rule": F.coalesce("target", F.lit("")), "group": T.lookup_key(F.col("cleaned"), singular)})
    return out.select("item", "cleaned", "source", "rule", "group")


def group_counts(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """(group, n): baskets that have any member, each once."""
    return mentions.join(members.select("item", "group"), "item").select("group", "basket_id").distinct().groupBy("group").agg(F.count("*").alias("n"))


def item_counts(mentions: DataFrame) -> DataFrame:
    """(item, train_frequency): baskets that have the item, each once."""
    return mentions.select("basket_id", "item").distinct().groupBy("item").agg(F.count("*").alias("train_frequency"))


def baskets_of(train: DataFrame) -> DataFrame:
    """train(id, label, items) as (basket_id, labels, items), one row for each basket, dealt by basket and cached: what a
    build counts is counted there, so that train is read once. Rows of one id are one basket with all their labels."""
    label = F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>"))
    items = F.array_distinct(F.filter("items", lambda x: x.isNotNull()))
    out = dealt(train.select(F.col("id").alias("basket_id"), label.alias("labels"), items.alias("items")), "basket_id").cache()
    if not out.groupBy("basket_id").count().agg(F.max("count") > 1).first()[0]:
        return out
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = out.groupBy("basket_id").agg(whole("labels"), whole("items")).cache()
    merged.count()
    out.unpersist()
    return merged


def item_counts_of(baskets: DataFrame) -> DataFrame:
    """item_counts() of baskets_of()."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("train_frequency"))


def priors_of(baskets: DataFrame) -> DataFrame:
    """label_priors() of baskets_of(), as a frame of the driver's: one row for each label."""
    known = baskets.filter(F.col("basket_id").isNotNull())
    n = known.count()
    rows = known.select(F.explode("labels").alias("label")).groupBy("label").count().collect()
    return baskets.sparkSession.createDataFrame([(r["label"], r["count"] / n) for r in rows], "label string, prior double")


def kin_of(members: DataFrame, families: dict[str, str]) -> DataFrame:
    """(item, group, family) of all items whose group has a family or other items; a group without one is its own."""
    table = members.sparkSession.createDataFrame(sorted(families.items()), "group string, family string")
    sized = members.select("item", "group", F.count("*").over(Window.partitionBy("group")).alias("size"))
    known = sized.join(F.broadcast(table), "group", "left").filter(F.col("group").isNotNull() & (F.col("family").isNotNull() | (F.col("size") > 1)))
    return known.select("item", "group", F.coalesce("family", "group").alias("family"))


def basket_sets(baskets: DataFrame, kin: DataFrame) -> DataFrame:
    """(family, groups, labels, n): how many baskets have just these groups of a family. Counts of any groups of a family
    taken together come from there; it has a row for each combination that occurs, however many baskets there are."""
    x = baskets.select("basket_id", "labels", F.explode("items").alias("item")).join(kin, "item")
    own = x.groupBy("basket_id", "labels", "family").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    return own.groupBy("family", "groups", "labels").agg(F.count("*").alias("n"))


def counts_of(sets: DataFrame, kin: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """group_counts() of members from the sets of kin, where no group of members has items of several families; a group
    without kin has one item."""
    now = kin.select("item", F.col("group").alias("was")).join(members.select("item", "group"), "item").select("was", "group").distinct()
    together = sets.withColumn("was", F.explode("groups")).join(now, "was").select("group", "family", "groups", "labels", "n").distinct()
    alone = members.join(kin, "item", "left_anti").join(seen, "item").select("group", F.col("train_frequency").alias("n"))
    return together.groupBy("group").agg(F.sum("n").alias("n")).unionByName(alone)


def representatives(mentions: DataFrame | None, members: DataFrame, frozen: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(group, name): a frozen name, else the cleaned form of the most frequent member, ties by the smaller string.
    seen: item_counts() of the mentions, where they are known."""
    seen = item_counts(mentions) if seen is None else seen
    f = F.coalesce("train_frequency", F.lit(0))
    names = members.join(seen, "item", "left").groupBy("group").agg(F.min_by("cleaned", F.struct(-f, F.col("item"))).alias("name"))
    if frozen is None:
        return names
    return names.join(frozen.withColumnRenamed("name", "frozen"), "group", "left").select("group", F.coalesce("frozen", "name").alias("name"))


def proposed_moves(names: DataFrame, modifiers: Modifiers, brands: Brands, singular: Singular, always_merge: Iterable[str] = ()) -> DataFrame:
    """(group, target, target_name, source): a brand's generic wins over stripped modifiers; the latter need a group that is there."""
    x = names.withColumns({"generic": T.brand_generic(F.col("name"), brands), "stripped": T.strip_modifiers(F.col("name"), modifiers)})
    x = x.withColumns({"brand_key": T.lookup_key(F.col("generic"), singular), "strip_key": T.lookup_key(F.col("stripped"), singular)})
    hit = F.lit(False)
    for p in always_merge:
        hit = hit | F.col("name").rlike(p)
    there = names.select(F.col("group").alias("strip_key"), F.lit(True).alias("there"))
    x = x.join(there, "strip_key", "left")
    brand = F.col("brand_key").isNotNull() & (F.col("brand_key") != F.col("group"))
    strip = F.col("there") & (F.col("strip_key") != F.col("group"))
    x = x.withColumns({"target": F.when(brand, F.col("brand_key")).when(strip, F.col("strip_key")), "target_name": F.when(brand, F.col("generic")), "source": F.when(brand, F.lit("brand_pattern")).when(hit, F.lit("always_merge_lexicon")).otherwise(F.lit("modifier_strip"))})
    return x.filter("target is not null").select("group", "target", "target_name", "source")


def replay_moves(moves: list[tuple], groups: dict[str, str]) -> tuple[dict[str, tuple[str, str]], dict[str, str]]:
    """Applies one round in key order on the driver: where each moved group ends and by which source, and frozen names.

    Moves were proposed on one snapshot. A target's name is frozen before it takes another in; a strip move whose
    target has gone this round waits; a brand's target that is not there is made, under the generic's name."""
    gone: dict[str, tuple[str, str]] = {}
    frozen: dict[str, str] = {}
    here = set(groups)
    names = dict(groups)
    for group, target, generic, source in sorted(moves):
        if group not in here or (target not in here and generic is None):
            continue
        if target not in here:
            here.add(target)
            names[target] = generic
            gone.pop(target, None)
        frozen.setdefault(target, names[target])
        here.discard(group)
        gone[group] = target, source
    return gone, frozen


def reduce_groups(mentions: DataFrame | None, members: DataFrame, modifiers: Modifiers, brands: Brands, singular: Singular = Singular(), gate: Gate = Gate(), rounds: int = ROUNDS, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members and frozen names after up to `rounds` of moves. Moves are one row for each distinct name that a lexicon
    touches, so the driver replays them; everything else stays distributed."""
    spark = members.sparkSession
    frozen = spark.createDataFrame([], "group string, name string")
    held: dict[str, str] = {}
    for _ in range(rounds):
        names = representatives(mentions, members, F.broadcast(frozen), seen).cache()
        moves = [tuple(r) for r in proposed_moves(names, modifiers, brands, singular, gate.always_merge).collect()]
        touched = sorted({m[0] for m in moves} | {m[1] for m in moves})
        known = spark.createDataFrame([(t,) for t in touched], "group string")
        own = {r[0]: r[1] for r in names.join(F.broadcast(known), "group", "left_semi").collect()}
        names.unpersist()
        gone, named = replay_moves(moves, own)
        if not gone:
            break
        map_ = spark.createDataFrame([(g, t, s) for g, (t, s) in gone.items()], "group string, target string, how string")
        moved = members.join(F.broadcast(map_), "group", "left")
        members = moved.select("item", "cleaned", F.coalesce("how", "source").alias("source"), F.when(F.col("how").isNotNull(), F.col("target")).otherwise(F.col("rule")).alias("rule"), F.coalesce("target", "group").alias("group"))
        held |= named
        frozen = spark.createDataFrame(sorted(held.items()), "group string, name string")
    return members, frozen


def cuts(counts: DataFrame, modifier_tokens: Iterable[str], scope: int = SCOPE) -> DataFrame:
    """(variant, base, k): every base that is left when only modifiers, k of them, are cut from a variant's front, both in
    scope."""
    inside = counts.filter(F.col("n") >= scope).select("group")
    allowed = sorted(set(modifier_tokens)) or [""]
    x = inside.withColumn("t", F.split("group", " ")).filter(F.size("t") > 1)
    x = x.select("group", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("k"))
    x = x.filter(F.forall(F.slice("t", F.lit(1), F.col("k")), lambda m: m.isin(allowed)))
    x = x.withColumn("base", F.array_join(F.slice("t", F.col("k") + 1, F.size("t")), " ")).join(inside.withColumnRenamed("group", "base"), "base")
    return x.select(F.col("group").alias("variant"), "base", "k")


def candidate_pairs(counts: DataFrame, modifier_tokens: Iterable[str], scope: int = SCOPE) -> DataFrame:
    """(variant, base): the longest base that is left when only modifiers are cut from a variant's front, both in scope."""
    return cuts(counts, modifier_tokens, scope).groupBy("variant").agg(F.min_by("base", "k").alias("base"))


def families_of(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The family of each group in pairs: the least group that pairs connect it to."""
    up: dict[str, str] = {}

    def top(g: str) -> str:
        while up.setdefault(g, g) != g:
            up[g] = g = up[up[g]]
        return g

    for pair in pairs:
        low, high = sorted(map(top, pair))
        up[high] = low
    return {g: top(g) for g in up}


def gate_pairs(found: DataFrame, gate: Gate, name: str = "variant") -> DataFrame:
    """Evidence rows with the gate's action and layer; the lexicons see the column name."""
    top = F.coalesce(F.get("variant_top", F.lit(0))["share"], F.lit(0.0))
    judged = decide(F.col(name), F.col("variant_count"), F.col("jsd_bits"), F.col("null95_bits"), top, gate)
    return found.withColumn("gate", judged).select("*", "gate.action", "gate.layer").drop("gate")


def _end(redirects: dict[str, str], group: str) -> str:
    while group in redirects:
        group = redirects[group]
    return group


def next_wave(left: list[tuple[str, str]], redirects: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Of pairs in their order those that can be judged now, and the rest: a pair waits for every earlier one that may
    change its variant or base, and for all with longer variants."""
    wave, rest, touched = [], [], set()
    length = max((len(v.split()) for v, _ in left), default=0)
    for v, b in left:
        b = _end(redirects, b)
        if v == b:
            continue
        if len(v.split()) == length and not touched & {v, b}:
            wave.append((v, b))
        else:
            rest.append((v, b))
        touched |= {v, b}
    return wave, rest


def apply_outcomes(pairs: DataFrame, mentions: DataFrame, labels: DataFrame, members: DataFrame, gate: Gate, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """judge() of the pairs over mentions and labels."""
    kin = kin_of(members, families_of((r["variant"], r["base"]) for r in pairs.select("variant", "base").collect()))  # a vocabulary's pairs
    own = mentions.join(kin, "item").groupBy("basket_id", "family").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    sets = own.join(labels.select("basket_id", "label").distinct(), "basket_id").groupBy("family", "groups", "label").agg(F.count("*").alias("n")).cache()
    out = judge(pairs, sets, label_priors(labels), members, gate, names)
    sets.unpersist()
    return out


def judge(pairs: DataFrame, sets: DataFrame, priors: DataFrame, members: DataFrame, gate: Gate, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members after all merges, preserved links (variant, base) and the review queue.

    Pairs are judged longest variant first, and evidence counts what earlier merges brought. The gate's lexicons see
    the groups' names (their keys where names is None); a group that takes another in keeps its own. How many baskets of
    a label have which groups of a family, (family, groups, label, n), is worked out before; each wave of pairs reads
    only its own groups from there, and its evidence, one row for each pair, comes to the driver. A base is in one wave
    at a time, so waves are as many as the variants of the base that has most."""
    spark = pairs.sparkSession
    left = sorted(((r["variant"], r["base"]) for r in pairs.collect()), key=lambda p: (-len(p[0].split()), p[0]))  # a vocabulary's pairs
    inside = spark.createDataFrame(sorted({(g,) for p in left for g in p}), "group string")
    shown = {} if names is None else {r["group"]: r["name"] for r in names.join(F.broadcast(inside), "group", "left_semi").collect()}
    single, priors = sets.withColumn("group", F.explode("groups")), F.broadcast(priors)
    taken: dict[str, list[str]] = {}
    redirects: dict[str, str] = {}
    how: dict[str, tuple[str, str]] = {}
    preserved, review = [], []
    while left:
        wave, left = next_wave(left, redirects)
        if not wave:
            continue
        parts = [(g, part) for pair in wave for g in pair for part in (g, *taken.get(g, ()))]
        of = F.broadcast(spark.createDataFrame(parts, "root string, group string"))
        together = single.join(of, "group").select(F.col("root").alias("group"), "family", "groups", "label", "n").distinct()
        counts = together.groupBy("group", "label").agg(F.sum("n").alias("n"))
        asking = F.broadcast(spark.createDataFrame(sorted({(g,) for pair in wave for g in pair}), "group string"))
        asked = F.broadcast(spark.createDataFrame([(v, b, shown.get(v, v)) for v, b in wave], "variant string, base string, name string"))
        found = evidence_of(asked, shares_of_counts(counts, asking, priors), priors)
        for r in sorted(gate_pairs(found, gate, "name").collect(), key=lambda r: r["variant"]):
            v, b, said = r["variant"], r["base"], f"jsd={r['jsd_bits']:.4f} bits, {r['jsd_to_null_ratio']:.2f} x null95, n={r['variant_count']}"
            if r["action"] == "merge":
                redirects[v], how[v] = b, (MERGE_SOURCE[r["layer"]], said)
                taken.setdefault(b, []).extend([v, *taken.pop(v, ())])
            elif r["action"] == "preserve":
                preserved.append((v, b, r["layer"], r["jsd_bits"], r["null95_bits"], r["variant_count"]))
            else:
                suggested = "preserve" if r["jsd_bits"] >= PRESERVE_BITS and r["jsd_to_null_ratio"] >= PRESERVE_RATIO else "merge"
                review.append((f"{v}__vs__{b}".replace(" ", "_"), v, b, r["name"], shown.get(b, b), r["variant_count"], r["base_count"], r["jsd_bits"], r["null95_bits"], r["jsd_to_null_ratio"], r["variant_top"] or [], r["base_top"] or [], r["layer"], suggested, said))
    moved = []
    for group in redirects:
        last = group
        while redirects[last] in redirects:
            last = redirects[last]
        moved.append((group, redirects[last], *how[last]))  # the merge that came last names the source
    m = members.join(F.broadcast(spark.createDataFrame(moved, "group string, target string, how string, said string")), "group", "left")
    members = m.select("item", "cleaned", F.coalesce("how", "source").alias("source"), F.coalesce("said", "rule").alias("rule"), F.coalesce("target", "group").alias("group"))
    kept = spark.createDataFrame([(v, _end(redirects, b), *more) for v, b, *more in preserved], PRESERVED)
    queue = [(*r, _end(redirects, r[2])) for r in sorted(review, key=lambda r: r[0])]  # the group that the base is in by now
    return members, kept, spark.createDataFrame(queue, QUEUE)


def review_entries(queue: DataFrame, mentions: DataFrame, members: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The queue as it is stored: figures at four digits, and the smallest baskets of each variant as examples."""
    own = members.join(queue.select(F.col("variant").alias("group")), "group", "left_semi").select("group", "item")
    baskets = mentions.join(own, "item").select("group", "basket_id").distinct()
    w = Window.partitionBy("group").orderBy("basket_id")
    few = baskets.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    examples = few.groupBy(F.col("group").alias("variant")).agg(F.sort_array(F.collect_list("basket_id")).alias("example_ids"))
    four = {c: F.round(c, 4) for c in ("jsd_bits", "null95_bits", "jsd_to_null_ratio")}
    entry = lambda x: F.struct(x["label"].alias("label"), F.round(x["share"], 4).alias("share"), F.round(x["lift"], 4).alias("lift"))
    tops = {c: F.transform(c, entry) for c in ("variant_top", "base_top")}
    return queue.withColumns(four | tops).join(examples, "variant", "left")


class DecisionError(ValueError):
    """Decisions and review queue don't fit."""


def apply_decisions(members: DataFrame, preserved: DataFrame, queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges before preserves, by id; every queued pair needs one decision and no other may stand."""
    odd = queue.select("decision_id").join(decisions.select("decision_id"), "decision_id", "left_anti").union(decisions.select("decision_id").join(queue.select("decision_id"), "decision_id", "left_anti"))
    if rows := odd.limit(5).collect():
        raise DecisionError(f"no match for {[r[0] for r in rows]}")
    into = F.when(F.startswith("decision", F.lit("merge_into:")), F.substring("decision", len("merge_into:") + 1, 1 << 30)).otherwise(F.col("target"))
    if "target" not in queue.columns:
        queue = queue.withColumn("target", F.col("base"))
    asked = decisions.join(queue, "decision_id").select(into.alias("group")).union(queue.select("target")).union(queue.select("variant")).distinct()
    groups = {r[0] for r in members.select("group").distinct().join(asked, "group", "left_semi").collect()}  # of the reviewed pairs
    redirects: dict[str, str] = {}
    moved, kept = [], []
    for r in sorted(decisions.join(queue, "decision_id").collect(), key=lambda r: (r["decision"] == "preserve", r["decision_id"])):
        target = _end(redirects, r["decision"].removeprefix("merge_into:") if r["decision"].startswith("merge_into:") else r["target"])
        if target == r["variant"]:
            raise DecisionError(f"{r['decision_id']} merges a group into itself")
        if r["decision"] == "preserve":
            kept.append((r["variant"], target, "manual_review", r["jsd_bits"], r["null95_bits"], r["variant_count"]))
        else:
            if target not in groups:
                raise DecisionError(f"{r['decision_id']}: no group {target}")
            redirects[r["variant"]] = target
            moved.append((r["variant"], target, r["note"]))
    spark = members.sparkSession
    m = members.join(spark.createDataFrame(moved, "group string, target string, note string"), "group", "left")
    how = F.col("note").isNotNull()
    members = m.select("item", "cleaned", F.when(how, "manual_review").otherwise(F.col("source")).alias("source"), F.coalesce("note", "rule").alias("rule"), F.coalesce("target", "group").alias("group"))
    return members, preserved.unionByName(spark.createDataFrame(kept, preserved.schema))


def roots(links: DataFrame, rounds: int = 20) -> DataFrame:
    """(variant, root) by pointer jumping: the distance covered doubles each round; a cycle is an error."""
    out = links.select("variant", F.col("base").alias("root"))
    for _ in range(rounds):
        up = out.select(F.col("variant").alias("root"), F.col("root").alias("next"))
        step = out.join(up, "root", "left").select("variant", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).cache()
        out = step.drop("moved")
        if not step.filter("moved").limit(1).collect():
            return out
    raise ValueError("links go round in a circle")


def compile_statistics(mentions: DataFrame, compiled: DataFrame) -> DataFrame:
    """One row: ids, aliases and parent links of a compiled vocabulary, and how many (basket, item) mentions its aliases cover."""
    pairs = mentions.select("basket_id", "item").distinct()
    known = compiled.select(F.explode("aliases.alias").alias("item")).distinct().withColumn("known", F.lit(1))
    covered = pairs.join(known, "item", "left").agg(F.count("known").alias("covered_mention_count"), F.count("*").alias("total_mention_count"))
    sizes = compiled.agg(F.count("*").alias("ingredient_count"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).cast("long").alias("alias_count"), F.count("parent_id").alias("parent_link_count"))
    ratio = F.coalesce(F.try_divide("covered_mention_count", "total_mention_count"), F.lit(0.0))
    return sizes.crossJoin(F.broadcast(covered)).withColumn("coverage_ratio", ratio)  # one row each


def compile_vocabulary(mentions: DataFrame | None, members: DataFrame, names: DataFrame, preserved: DataFrame, scope: int = SCOPE, seen: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The stored vocabulary: groups in scope with slug, name, root parent, evidence and aliases by string. seen and counts:
    item_counts() and group_counts(), where they are known."""
    seen = item_counts(mentions) if seen is None else seen
    keep = (group_counts(mentions, members) if counts is None else counts).filter(F.col("n") >= scope)
    named = names.withColumn("id", T.slug(F.col("name")))
    best = F.min(F.struct((-F.col("train_frequency")).alias("f"), F.col("item").alias("alias"))).alias("best")
    entry = F.struct(F.col("item").alias("alias"), "source", "rule", "train_frequency")
    own = members.join(seen, "item").groupBy("group").agg(best, F.array_sort(F.collect_list(entry)).alias("entries"))
    shown = lambda x: F.when(x["alias"] == F.col("best.alias"), F.lit("canonical_surface_form")).otherwise(x["source"])
    entry = lambda x: F.struct(x["alias"].alias("alias"), shown(x).alias("source"), x["rule"].alias("rule"), x["train_frequency"].alias("train_frequency"))
    aliases = own.select("group", F.transform("entries", entry).alias("aliases"))
    parent = roots(preserved).join(named.select(F.col("group").alias("root"), F.col("id").alias("parent_id")), "root").join(preserved, "variant")
    parent = parent.select(F.col("variant").alias("group"), "parent_id", F.struct("layer", F.round("jsd_bits", 4).alias("jsd_bits"), F.round("null95_bits", 4).alias("null95_bits"), "variant_count").alias("preserve_evidence"))
    out = named.join(keep, "group").join(aliases, "group").join(parent, "group", "left")
    return out.select("id", "name", F.lit(None).cast("string").alias("category"), "parent_id", F.col("n").alias("train_mention_count"), "preserve_evidence", "aliases")
