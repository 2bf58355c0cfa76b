"""The engine's queries over the driver's tables, each with the SQL that says the same.

Baskets are orders, items part names ("adjective noun"), labels order priorities; documents serve the text chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Brands, Gate, Lexicons, Modifiers, Singular
from ..operators import divergence, features, gates, model, resolver, search, taxonomy, vocabulary
from ..session import spread

from . import builds

# The lexicons of these queries; all words come from the driver's part names.
STRIP, NEVER, OWN = ("new", "small"), ("blue",), ("blue", "red")
MODIFIERS = Modifiers(tokens=frozenset(STRIP), never=frozenset(NEVER))
BRANDS = Brands(keep=(("\\bred widget\\b", "red widget"),), patterns=(("\\bred\\b", "red goods"), ("\\bsmall gizmo\\b", "tiny goods"), ("\\bgizmo\\b", "widget")))
GATE = Gate(always_merge=(r"\bnew\b",), forced=frozenset({"small gear"}), varieties=frozenset({"blue"}), never_merge=frozenset({"red widget"}))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mentions(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = _read(spark, d, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket_id"), F.col("p_name").alias("item"), F.col("l_linenumber").alias("pos"))


def labels(spark, d):
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("label"))


def _items(spark, d):
    return _read(spark, d, "part").select(F.col("p_name").alias("item")).distinct()


def _noun(c):
    return F.element_at(F.split(c, " "), -1)


def _members(spark, d):
    """Each item as a group of its own, and each noun with all its items."""
    x = _items(spark, d)
    return x.select(F.col("item").alias("group"), "item").union(x.select(_noun(F.col("item")), "item"))


def _pairs(spark, d):
    return _items(spark, d).select(F.col("item").alias("variant"), _noun(F.col("item")).alias("base"))


def _priors(spark, d):
    l = labels(spark, d)
    return l.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(l.agg(F.count("*").alias("all")))).select("label", (F.col("n") / F.col("all")).alias("prior"))


def _space(spark, d):
    x = _items(spark, d)
    nouns = x.select(_noun(F.col("item")).alias("id")).distinct().withColumn("parent_id", F.lit(None).cast("string"))
    return features.feature_space(nouns.union(x.select("item", _noun(F.col("item")))))


def _rows(spark, d):
    return features.feature_rows(mentions(spark, d), labels(spark, d), _space(spark, d))


def _matrix(spark, d, weight=0.3):
    return features.design_matrix(_rows(spark, d), weight)


def _coefficients(spark, d):
    """Coefficients by a formula of the label's place and the feature's index."""
    l = labels(spark, d).select("label").distinct().withColumn("i", F.row_number().over(Window.orderBy("label")) - 1)
    grid = l.crossJoin(_space(spark, d).select("index"))
    return grid.select("label", "index", (((F.col("i") * 31 + F.col("index") * 17) % 23 - 11) / 10.0).alias("coefficient"))


def _intercepts(spark, d):
    l = labels(spark, d).select("label").distinct().withColumn("i", F.row_number().over(Window.orderBy("label")) - 1)
    return l.select("label", (F.col("i") / 10.0).alias("intercept"))


def _logits(spark, d):
    return model.logits(_matrix(spark, d), labels(spark, d), _coefficients(spark, d), _intercepts(spark, d))


def _shares(spark, d):
    return model.softmax(_logits(spark, d), 2.0)


def _vocabulary(spark, d):
    """Nouns but one, and the items of some adjectives, each with itself as alias; the rest has to be resolved."""
    x = _items(spark, d)
    own = x.filter(F.split("item", " ")[0].isin(list(OWN))).select(F.col("item").alias("id"))
    ids = x.select(_noun(F.col("item")).alias("id")).filter("id <> 'gizmo'").distinct().union(own)
    alias = F.array(F.struct(F.col("id").alias("alias"), F.lit("seed").alias("source"), F.lit("").alias("rule"), F.lit(1).cast("long").alias("train_frequency")))
    return ids.select("id", F.col("id").alias("name"), F.length("id").cast("long").alias("train_mention_count"), alias.alias("aliases"))


def _asked(spark, d):
    x = _items(spark, d)
    zz = lambda *parts: x.select(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    item, noun = F.col("item"), _noun(F.col("item"))
    return x.union(zz(F.upper(item))).union(zz("zz yy ", item)).union(zz("zz ", item)).union(zz("zz ", noun, " qq")).union(zz("small ", item, "s")).distinct()


def _resolver(spark, d):
    return resolver.Resolver(_vocabulary(spark, d), MODIFIERS, BRANDS, variant_tokens=("zz",), python=False)


def _resolved(spark, d):
    return _resolver(spark, d).resolve(_asked(spark, d))


def _noisy(spark, d):
    m = mentions(spark, d)
    return m.withColumn("item", F.when((F.col("basket_id") + F.col("pos")) % 3 == 0, F.concat(F.lit("zz "), F.col("item"))).otherwise(F.col("item")))


def _resolved_mentions(spark, d):
    return _resolver(spark, d).resolve(_noisy(spark, d))


def _tokens(spark, d):
    return _read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token")).distinct()


def _nb(spark, d):
    prior, loglik = model.naive_bayes(_matrix(spark, d, 0.0), labels(spark, d), _space(spark, d).count())
    return model.logits(_matrix(spark, d, 0.0), labels(spark, d), loglik.withColumnRenamed("loglik", "coefficient"), prior.withColumnRenamed("prior", "intercept"))


def _nb_tops(spark, d):
    return model.top_label(model.softmax(_nb(spark, d)))


def _balance(spark, d):
    return features.fold_balance(features.folds(labels(spark, d)))


def _join(column, sep=","):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


R = F.round
BASE = """
mentions AS (SELECT l_orderkey AS basket_id, p_name AS item, l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
labels AS (SELECT o_orderkey AS basket_id, o_orderpriority AS label FROM orders),
items AS (SELECT DISTINCT p_name AS item, split_part(p_name, ' ', 2) AS noun FROM part),
pairs AS (SELECT DISTINCT m.basket_id, m.item, l.label FROM mentions m JOIN labels l USING (basket_id)),
li AS (SELECT label, item, count(*) AS n FROM pairs GROUP BY ALL),
df AS (SELECT item, sum(n)::BIGINT AS df FROM li GROUP BY ALL),
nl AS (SELECT label, count(*) AS n_label FROM labels GROUP BY ALL),
tot AS (SELECT count(*) AS total FROM labels)"""
TFIDF = """, v AS (SELECT label, item, n, n / n_label * ln(total / df) AS weight FROM li JOIN df USING (item) JOIN nl USING (label), tot)"""
COS = TFIDF + """, norm AS (SELECT label, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT x.label AS a, y.label AS b, sum(x.weight * y.weight) AS dot FROM v x JOIN v y ON x.item = y.item AND x.label <> y.label GROUP BY ALL),
cosine AS (SELECT a, b, CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE dot / (p.norm * q.norm) END AS s FROM dots JOIN norm p ON p.label = a JOIN norm q ON q.label = b),
near AS (SELECT a AS label, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank, b AS neighbour, round(s, 4) AS similarity FROM cosine QUALIFY rank <= 4)"""
GROUPS = """, members AS (SELECT item AS grp, item FROM items UNION ALL SELECT noun, item FROM items),
gb AS (SELECT DISTINCT grp, basket_id, label FROM members JOIN mentions USING (item) JOIN labels USING (basket_id)),
gs AS (SELECT g.grp, l.label, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT grp FROM members) g CROSS JOIN (SELECT DISTINCT label FROM labels) l
       LEFT JOIN (SELECT grp, label, count(*) AS n FROM gb GROUP BY ALL) c ON c.grp = g.grp AND c.label = l.label),
sh AS (SELECT *, (sum(n) OVER (PARTITION BY grp))::BIGINT AS total, CASE WHEN sum(n) OVER (PARTITION BY grp) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY grp) END AS share FROM gs)"""
JSD = GROUPS + """, j AS (SELECT i.item AS variant, i.noun AS base, max(p.total) AS n, max(p.share) AS top,
  greatest(0, sum(CASE WHEN p.share > 0 THEN p.share * log2(p.share / ((p.share + q.share) / 2)) ELSE 0 END
    + CASE WHEN q.share > 0 THEN q.share * log2(q.share / ((p.share + q.share) / 2)) ELSE 0 END) / 2) AS bits
  FROM items i JOIN sh p ON p.grp = i.item JOIN sh q ON q.grp = i.noun AND q.label = p.label GROUP BY ALL)"""
SPACE = """, ids AS (SELECT noun AS id, NULL AS parent_id FROM items UNION SELECT item, noun FROM items),
numbered AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS index, id, parent_id FROM ids),
space AS (SELECT a.index, a.id, b.index AS parent_index FROM numbered a LEFT JOIN numbered b ON a.parent_id = b.id)"""


def matrix_sql(weight: float) -> str:
    up = f" UNION ALL SELECT basket_id, parent_index, {weight}::DOUBLE FROM mentions JOIN space ON id = item WHERE parent_index IS NOT NULL" if weight else ""
    return SPACE + f""", matrix AS (SELECT basket_id, index, max(value) AS value FROM (SELECT basket_id, index, 1.0::DOUBLE AS value FROM mentions JOIN space ON id = item{up}) GROUP BY ALL)"""


SCORE = matrix_sql(0.3) + """, li2 AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM labels)),
coef AS (SELECT label, index, ((i * 31 + index * 17) % 23 - 11) / 10.0 AS coefficient FROM li2, space),
logit AS (SELECT b.basket_id, l.label, l.i / 10.0 + coalesce(s.x, 0) AS logit FROM labels b CROSS JOIN li2 l
  LEFT JOIN (SELECT basket_id, c.label, sum(value * coefficient) AS x FROM matrix JOIN coef c USING (index) GROUP BY ALL) s ON s.basket_id = b.basket_id AND s.label = l.label),
e AS (SELECT *, exp(logit / 2 - max(logit / 2) OVER (PARTITION BY basket_id)) AS e FROM logit),
share AS (SELECT basket_id, label, e / sum(e) OVER (PARTITION BY basket_id) AS share FROM e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY round(share, 9) DESC, label) AS r FROM share)"""
NB = matrix_sql(0) + """, mass AS (SELECT label, index, sum(value) AS c FROM matrix JOIN labels USING (basket_id) GROUP BY ALL),
whole AS (SELECT label, sum(c) AS m FROM mass GROUP BY ALL),
ll AS (SELECT d.label, d.index, ln((coalesce(c, 0) + 1) / (m + (SELECT count(*) FROM space))) AS w FROM (SELECT label, index FROM (SELECT DISTINCT label FROM labels), (SELECT DISTINCT index FROM matrix)) d LEFT JOIN mass USING (label, index) JOIN whole USING (label)),
nb AS (SELECT b.basket_id, p.label, ln(p.n_label / total) + coalesce(s.x, 0) AS logit FROM labels b CROSS JOIN nl p CROSS JOIN tot
  LEFT JOIN (SELECT basket_id, ll.label, sum(value * w) AS x FROM matrix JOIN ll USING (index) GROUP BY ALL) s ON s.basket_id = b.basket_id AND s.label = p.label),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY basket_id)) AS e FROM nb),
share AS (SELECT basket_id, label, e / sum(e) OVER (PARTITION BY basket_id) AS share FROM e),
tops AS (SELECT basket_id, label AS top, share AS confidence FROM share QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY round(share, 9) DESC, label) = 1),
truth AS (SELECT label, top, confidence FROM tops JOIN labels USING (basket_id)),
pl AS (SELECT l.label, coalesce(t.n, 0) AS n, coalesce(t.hits, 0) AS hits, coalesce(g.predicted, 0) AS predicted FROM (SELECT DISTINCT label FROM labels) l
  LEFT JOIN (SELECT label, count(*) AS n, count(*) FILTER (top = label) AS hits FROM truth GROUP BY ALL) t USING (label)
  LEFT JOIN (SELECT top AS label, count(*) AS predicted FROM truth GROUP BY ALL) g USING (label)),
bins AS (SELECT b.bin, coalesce(n, 0) AS n, coalesce(c, 0) AS confidence, coalesce(a, 0) AS accuracy FROM (SELECT unnest(range(10)) AS bin) b
  LEFT JOIN (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS c, avg((top = label)::INT) AS a FROM truth GROUP BY 1) USING (bin))"""
CLEAN = r"""trim(regexp_replace(translate(replace(replace(translate(regexp_replace(regexp_replace(translate(replace(lower(translate({x}, '®™©', '')), 'ß', 'ss'), '’‘', ''''''), '""" + T.PARENTHESISED_QUANTITY + r"""', ' ', 'g'), '""" + T.LEADING_QUANTITY + r"""', ''), '&', '&'), '&', ' and '), '''', ''), '-,.()!/', '       '), '\s+', ' ', 'g'))"""
SINGULAR = """CASE WHEN length({t}) >= 5 AND {t} LIKE '%ies' THEN left({t}, -3) || 'y' WHEN length({t}) >= 5 AND {t} LIKE '%ves' THEN left({t}, -1)
  WHEN length({t}) >= 5 AND regexp_matches({t}, '(ches|shes|sses|xes|zes)$') THEN left({t}, -2)
  WHEN length({t}) >= 4 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, -1) ELSE {t} END"""
TOKENS = ", tok AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)"
STRIPPED = "CASE WHEN split_part({x}, ' ', 1) IN ('new', 'small') THEN split_part({x}, ' ', 2) ELSE {x} END"
KEY = "array_to_string(list_transform(string_split({x}, ' '), lambda t: " + SINGULAR.format(t="t") + "), ' ')"
GENERIC = r"""CASE WHEN regexp_matches({x}, '\bred widget\b') THEN 'red widget' WHEN regexp_matches({x}, '\bred\b') THEN 'red goods' WHEN regexp_matches({x}, '\bsmall gizmo\b') THEN 'tiny goods' WHEN regexp_matches({x}, '\bgizmo\b') THEN 'widget' END"""
ASKED = """SELECT item FROM items UNION SELECT upper(item) FROM items UNION SELECT 'zz yy ' || item FROM items UNION SELECT 'zz ' || item FROM items
  UNION SELECT 'zz ' || noun || ' qq' FROM items UNION SELECT 'small ' || item || 's' FROM items"""


def resolver_sql(asked: str) -> str:
    """Tables voc, cand (token drops) and res of the strings that asked selects."""
    g1, g2 = (KEY.format(x=f"({GENERIC.format(x=c)})") for c in ("cleaned", "stripped"))
    return f""", voc AS (SELECT id, length(id)::BIGINT AS mentions FROM (SELECT DISTINCT noun AS id FROM items WHERE noun <> 'gizmo' UNION SELECT item FROM items WHERE split_part(item, ' ', 1) IN ('blue', 'red'))),
idx AS (SELECT {KEY.format(x="id")} AS key, arg_min(id, lpad((100 - mentions)::VARCHAR, 4, '0') || id) AS id FROM voc GROUP BY 1),
keyed AS (SELECT item, lower(item) AS cleaned, array_to_string(list_filter(string_split(lower(item), ' '), lambda t: t NOT IN ('new', 'small')), ' ') AS stripped FROM ({asked})),
k AS (SELECT item, cleaned, {KEY.format(x="cleaned")} AS key, {KEY.format(x="stripped")} AS strip_key, {g1} AS g1, {g2} AS g2 FROM keyed),
early AS (SELECT k.item, k.strip_key, coalesce(a.id, b.id, c.id, d.id, e.id, f.id) AS id,
    CASE WHEN a.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 WHEN c.id IS NOT NULL THEN 2 WHEN d.id IS NOT NULL THEN 3 WHEN e.id IS NOT NULL THEN 4 WHEN f.id IS NOT NULL THEN 5 END AS tier
  FROM k LEFT JOIN voc a ON a.id = k.item LEFT JOIN voc b ON b.id = cleaned LEFT JOIN idx c ON c.key = k.key LEFT JOIN idx d ON d.key = strip_key LEFT JOIN idx e ON e.key = g1 LEFT JOIN idx f ON f.key = g2),
tok2 AS (SELECT item, string_split(strip_key, ' ') AS t FROM early WHERE tier IS NULL),
pos AS (SELECT item, t, i, j FROM tok2, (SELECT unnest(range(1, 12)) AS i), (SELECT unnest(range(0, 12)) AS j) WHERE len(t) > 2 AND i < len(t) AND (j = 0 OR (len(t) >= 4 AND j > i AND j < len(t)))),
drops AS (SELECT item, CASE WHEN j = 0 THEN 1 ELSE 2 END AS n_dropped, list_filter([t[i], CASE WHEN j > 0 THEN t[j] END], lambda x: x IS NOT NULL) AS dropped,
  array_to_string(list_filter(list_transform(range(1, len(t) + 1), lambda p: CASE WHEN p <> i AND p <> j THEN t[p] END), lambda x: x IS NOT NULL), ' ') AS key FROM pos),
cand AS (SELECT item, n_dropped::BIGINT AS n_dropped, array_to_string(dropped, ' ') AS dropped, len(list_filter(dropped, lambda x: x NOT IN ('new', 'small', 'blue', 'zz'))) = 0 AS only_modifiers, idx.id, length(idx.id)::BIGINT AS mentions FROM drops JOIN idx USING (key)),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY item ORDER BY n_dropped, only_modifiers DESC, mentions DESC, id, dropped) = 1),
res AS (SELECT e.item, coalesce(e.id, best.id) AS id, best.dropped,
    CASE WHEN tier = 0 THEN 'exact_alias' WHEN tier <= 2 THEN 'cleaned_match' WHEN tier = 3 THEN 'modifier_stripped_match' WHEN tier <= 5 THEN 'brand_resolved_match' WHEN best.id IS NOT NULL THEN 'token_drop_match' ELSE 'unresolved' END AS method
  FROM early e LEFT JOIN best USING (item))"""


RES = resolver_sql(ASKED)
#: Mentions with a token of noise before the item of every third line, so that all tiers are met.
RM = ", noisy AS (SELECT basket_id, pos, CASE WHEN (basket_id + pos) % 3 = 0 THEN 'zz ' || item ELSE item END AS item FROM mentions)" + resolver_sql("SELECT DISTINCT item FROM noisy")
METHOD_LIST = "(SELECT unnest(['exact_alias', 'cleaned_match', 'modifier_stripped_match', 'brand_resolved_match', 'token_drop_match', 'unresolved']) AS method)"
STATS = RM + f""", stats AS (SELECT m.method, coalesce(c.n, 0) AS mentions, round(coalesce(c.n, 0) / (SELECT count(*) FROM noisy), 4) AS share
  FROM {METHOD_LIST} m LEFT JOIN (SELECT method, count(*) AS n FROM noisy JOIN res USING (item) GROUP BY ALL) c USING (method))"""
FOLD = """, fold AS (SELECT basket_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(basket_id::VARCHAR), basket_id) - 1) % 5 AS fold FROM labels)"""

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, base: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {BASE.strip()}{base} {sql}" if not sql.lstrip().upper().startswith("WITH") else sql
        return f

    return add


@query("mention_index", "SELECT item, count(*) AS baskets FROM pairs GROUP BY ALL")
def _(s, d):
    return spread(mentions(s, d), "basket_id").join(labels(s, d), "basket_id").select("basket_id", "item").distinct().groupBy("item").agg(F.count("*").alias("baskets"))


@query("corpus_statistics", "SELECT label, item, n FROM li UNION ALL SELECT NULL, item, df FROM df UNION ALL SELECT label, NULL, n_label FROM nl UNION ALL SELECT NULL, NULL, total FROM tot")
def _(s, d):
    return taxonomy.corpus_statistics(mentions(s, d), labels(s, d))


@query("tfidf_vectors", "SELECT label, item, n, round(weight, 6) AS weight FROM v", TFIDF)
def _(s, d):
    return taxonomy.tfidf(mentions(s, d), labels(s, d)).withColumn("weight", R("weight", 6))


@query("label_cosine_neighbors", "SELECT * FROM near", COS)
def _(s, d):
    return taxonomy.neighbours(mentions(s, d), labels(s, d))


@query("similarity_edges", "SELECT least(label, neighbour) AS a, greatest(label, neighbour) AS b, max(similarity) AS similarity FROM near GROUP BY 1, 2", COS)
def _(s, d):
    return taxonomy.similarity_edges(taxonomy.neighbours(mentions(s, d), labels(s, d)))


@query("distinctive_items", """SELECT label, row_number() OVER (PARTITION BY label ORDER BY round(lift, 9) DESC, item) AS rank, item, round(lift, 4) AS lift, round(coverage, 4) AS coverage
  FROM (SELECT label, item, n, n / n_label AS coverage, (n / n_label) / (df / total) AS lift FROM li JOIN df USING (item) JOIN nl USING (label), tot) WHERE n >= 10 AND coverage >= 0.02 QUALIFY rank <= 15""")
def _(s, d):
    return taxonomy.distinctive(mentions(s, d), labels(s, d))


@query("label_distribution", 'SELECT grp AS "group", label, n, total, round(share, 6) AS share FROM sh', GROUPS)
def _(s, d):
    return divergence.label_shares(mentions(s, d), labels(s, d), _members(s, d)).withColumn("share", R("share", 6))


@query("top_label_shares_with_lift", """SELECT grp AS "group", row_number() OVER (PARTITION BY grp ORDER BY round(share, 9) DESC, label) AS rank, label, round(share, 6) AS share, round(share / (n_label / total), 6) AS lift
  FROM (SELECT grp, sh.label, sh.share FROM sh WHERE share > 0) JOIN nl USING (label), tot QUALIFY rank <= 5""", GROUPS)
def _(s, d):
    x = divergence.top_shares(divergence.label_shares(mentions(s, d), labels(s, d), _members(s, d)), _priors(s, d))
    return x.withColumns({"share": R("share", 6), "lift": R("lift", 6)})


def _evidence(s, d, simulate=False):
    return divergence.evidence(_pairs(s, d), mentions(s, d), labels(s, d), _members(s, d), simulate)


@query("jsd_variant_vs_head", "SELECT variant, base, n AS variant_count, round(bits, 6) AS jsd_bits FROM j", JSD)
def _(s, d):
    return _evidence(s, d).select("variant", "base", "variant_count", R("jsd_bits", 6).alias("jsd_bits"))


#: Null levels of the gate's query: none for some variants, so that the floor alone decides there.
NULLS = "CASE WHEN starts_with(variant, 'old') THEN 0.0 WHEN starts_with(variant, 'hot') THEN bits / 1.4 ELSE 0.0005 END"


def _judged(s, d):
    bits, v = F.col("jsd_bits"), F.col("variant")
    null = F.when(F.startswith(v, F.lit("old")), 0.0).when(F.startswith(v, F.lit("hot")), bits / 1.4).otherwise(0.0005)
    return _evidence(s, d).withColumn("null95_bits", null)


@query("merge_gate_decision", rf"""SELECT variant, CASE WHEN variant = 'red widget' THEN 'preserve' WHEN regexp_matches(variant, '\bnew\b') OR variant = 'small gear' THEN 'merge'
  WHEN n >= 20 AND (bits BETWEEN 0.06 AND 0.08 OR (z > 0 AND bits / z BETWEEN 1.3 AND 1.7)) THEN 'review' WHEN n >= 20 AND bits >= 0.07 AND bits >= 1.5 * z THEN 'preserve' WHEN n >= 20 THEN 'merge'
  WHEN regexp_matches(variant, '\bblue\b') THEN 'preserve' WHEN n >= 5 AND top >= 0.8 THEN 'review' ELSE 'merge' END AS action,
  CASE WHEN variant = 'red widget' THEN 'do_not_merge_exception' WHEN regexp_matches(variant, '\bnew\b') THEN 'always_merge_lexicon' WHEN variant = 'small gear' THEN 'forced_merge_override' WHEN n >= 20 THEN 'statistical_gate'
    WHEN regexp_matches(variant, '\bblue\b') THEN 'named_variety_lexicon' WHEN n >= 5 AND top >= 0.8 THEN 'small_sample_review' ELSE 'small_sample_default' END AS layer FROM (SELECT *, {NULLS} AS z FROM j)""", JSD)
def _(s, d):
    top = F.get("variant_top", F.lit(0))["share"]
    g = divergence.decide(F.col("variant"), F.col("variant_count"), F.col("jsd_bits"), F.col("null95_bits"), top, GATE)
    return _judged(s, d).select("variant", g.alias("g")).select("variant", "g.action", "g.layer")


@query("merge_verdict", f"SELECT variant, CASE WHEN n < 20 THEN 'review' WHEN bits >= 0.07 AND bits >= 1.5 * z THEN 'preserve' ELSE 'merge' END AS verdict FROM (SELECT *, {NULLS} AS z FROM j)", JSD)
def _(s, d):
    return _judged(s, d).select("variant", divergence.verdict(F.col("jsd_bits"), F.col("null95_bits"), F.col("variant_count")).alias("verdict"))


@query("candidate_pairs", "SELECT item AS variant, noun AS base FROM items JOIN (SELECT grp FROM gb GROUP BY grp HAVING count(DISTINCT basket_id) >= 4) c ON c.grp = item JOIN (SELECT grp FROM gb GROUP BY grp HAVING count(DISTINCT basket_id) >= 4) e ON e.grp = noun WHERE split_part(item, ' ', 1) IN ('blue', 'red', 'new', 'small')", GROUPS)
def _(s, d):
    counts = vocabulary.group_counts(spread(mentions(s, d), "basket_id").join(labels(s, d), "basket_id", "left_semi"), _members(s, d))
    return vocabulary.candidate_pairs(counts, {"blue", "red", "new", "small"})


@query("clean_text", f"SELECT doc_id, CASE WHEN regexp_matches(c, '\\p{{L}}') THEN c END AS cleaned FROM (SELECT doc_id, {CLEAN.format(x='text')} AS c FROM documents)")
def _(s, d):
    return _read(s, d, "documents").select("doc_id", T.clean(F.col("text"), python=False).alias("cleaned"))


@query("accent_fold")
def _(s, d):
    return _read(s, d, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("singular_keys", f"SELECT token, {SINGULAR.format(t='token')} AS key FROM tok", TOKENS)
def _(s, d):
    return _tokens(s, d).select("token", T.lookup_key(F.col("token"), Singular()).alias("key"))


@query("mechanical_groups", f"SELECT key AS \"group\", count(*) AS members, min(token) AS first FROM (SELECT token, {SINGULAR.format(t='token')} AS key FROM tok) GROUP BY key", TOKENS)
def _(s, d):
    x = vocabulary.group_mechanically(_tokens(s, d).withColumnRenamed("token", "item"), python=False)
    return x.groupBy("group").agg(F.count("*").alias("members"), F.min("item").alias("first"))


@query("strip_modifiers", f"SELECT item, {STRIPPED.format(x='item')} AS stripped FROM items")
def _(s, d):
    return _items(s, d).select("item", T.strip_modifiers(F.col("item"), MODIFIERS).alias("stripped"))


@query("brand_first_match", f"SELECT item, {GENERIC.format(x='item')} AS generic FROM items")
def _(s, d):
    return _items(s, d).select("item", T.brand_generic(F.col("item"), BRANDS).alias("generic"))


#: Quantities before and behind an item, as they leak from lists.
AMOUNTS = ("2 1/2 to 3 lb. {}", "8 ounc {}", "(14.5 oz.) {}", "(2 lb.) {}", "1% {}", "{}, 1 inch thick", "3 inches {}", "12 {}")


@query("strip_quantities", """SELECT item, i, CASE i WHEN 0 THEN item WHEN 1 THEN item WHEN 2 THEN '  ' || item WHEN 3 THEN '(2 lb.) ' || item WHEN 4 THEN '1% ' || item
  WHEN 5 THEN item || ', 1 inch thick' WHEN 6 THEN item ELSE '12 ' || item END AS stripped FROM items, (SELECT unnest(range(8)) AS i)""")
def _(s, d):
    x = _items(s, d)
    texts = F.array(*(F.replace(F.lit(a), F.lit("{}"), F.col("item")) for a in AMOUNTS))
    return x.select("item", F.posexplode(texts).alias("i", "text")).select("item", F.col("i").cast("long").alias("i"), T.strip_quantities(F.col("text")).alias("stripped"))


@query("punctuation_fold", r"SELECT doc_id, trim(regexp_replace(translate(translate(replace(text, '&', ' and '), chr(39), ''), '-,.()!/', '       '), '\s+', ' ', 'g')) AS folded FROM documents")
def _(s, d):
    folded = T.collapse_whitespace(T.punctuation_to_space(T.delete_apostrophes(T.ampersand_to_and(F.col("text")))))
    return _read(s, d, "documents").select("doc_id", folded.alias("folded"))


@query("slugify", "SELECT item, replace(item, ' ', '_') AS slug, replace(item, ' ', '_') || '__vs__' || noun AS decision_id FROM items")
def _(s, d):
    return _items(s, d).select("item", T.slug(F.col("item")).alias("slug"), T.decision_id(F.col("item"), _noun(F.col("item"))).alias("decision_id"))


@query("resolve_tiered", "SELECT * FROM res", RES)
def _(s, d):
    return _resolved(s, d)


@query("token_drop_candidates", "SELECT * FROM cand", RES)
def _(s, d):
    r = _resolver(s, d)
    keys = r._keys(_asked(s, d))
    left = keys.join(r._early(keys), "item", "left_anti")
    return r.token_drop_candidates(left).withColumns({"n_dropped": F.col("n_dropped").cast("long"), "dropped": F.array_join("dropped", " ")})


@query("gate_bad_resolution", "SELECT item, id, method FROM (SELECT item, CASE WHEN item LIKE 'zz%' THEN NULL ELSE id END AS id, method FROM res) WHERE (id IS NULL) <> (method = 'unresolved')", RES)
def _(s, d):
    spoiled = _resolved(s, d).withColumn("id", F.when(~F.startswith("item", F.lit("zz")), F.col("id")))
    return resolver.bad_resolutions(spoiled).select("item", "id", "method")


@query("resolution_statistics", "SELECT * FROM stats", STATS)
def _(s, d):
    return resolver.resolution_statistics(_noisy(s, d), _resolved_mentions(s, d))


@query("coverage_summary", """SELECT sum(mentions)::BIGINT AS mentions_total, round(sum(mentions) FILTER (method NOT IN ('token_drop_match', 'unresolved')) / sum(mentions), 4) AS alias_tier_coverage,
  round(sum(mentions) FILTER (method <> 'unresolved') / sum(mentions), 4) AS full_chain_coverage FROM stats""", STATS)
def _(s, d):
    return resolver.coverage_summary(resolver.resolution_statistics(_noisy(s, d), _resolved_mentions(s, d)))


@query("top_unresolved", "SELECT item, count(*) AS mentions FROM noisy JOIN res USING (item) WHERE id IS NULL GROUP BY ALL ORDER BY mentions DESC, item LIMIT 50", RM)
def _(s, d):
    return resolver.top_unresolved(_noisy(s, d), _resolved_mentions(s, d))


@query("merge_group_histogram", """SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS groups
  FROM (SELECT id, count(*) AS n FROM res WHERE id IS NOT NULL GROUP BY ALL) GROUP BY 1""", RM)
def _(s, d):
    return resolver.alias_histogram(_resolved_mentions(s, d).filter("id is not null").groupBy("id").agg(F.count("*").alias("n")))


@query("stage_baskets", """SELECT l.basket_id, l.label, coalesce(a.ids, '') AS item_ids, coalesce(u.rest, '') AS unresolved, coalesce(c.n, 0) AS raw_count FROM labels l
  LEFT JOIN (SELECT basket_id, string_agg(id, ',' ORDER BY pos, id) AS ids FROM (SELECT basket_id, id, min(pos) AS pos FROM noisy JOIN res USING (item) WHERE id IS NOT NULL GROUP BY ALL) GROUP BY ALL) a USING (basket_id)
  LEFT JOIN (SELECT basket_id, string_agg(item, ',' ORDER BY pos, item) AS rest FROM noisy JOIN res USING (item) WHERE id IS NULL GROUP BY ALL) u USING (basket_id)
  LEFT JOIN (SELECT basket_id, count(*) AS n FROM noisy GROUP BY ALL) c USING (basket_id)""", RM)
def _(s, d):
    out = resolver.stage(_noisy(s, d), labels(s, d), _resolved_mentions(s, d))
    return out.select("basket_id", "label", _join("item_ids").alias("item_ids"), _join("unresolved").alias("unresolved"), "raw_count")


@query("feature_space", "SELECT * FROM space", SPACE)
def _(s, d):
    return _space(s, d)


@query("feature_rows", """SELECT l.basket_id, l.label, coalesce(string_agg(DISTINCT lpad(index::VARCHAR, 4, '0'), ',' ORDER BY lpad(index::VARCHAR, 4, '0')), '') AS indices,
  coalesce(string_agg(DISTINCT lpad(parent_index::VARCHAR, 4, '0'), ',' ORDER BY lpad(parent_index::VARCHAR, 4, '0')), '') AS parents FROM labels l LEFT JOIN mentions m USING (basket_id) LEFT JOIN space ON id = item GROUP BY ALL""", SPACE)
def _(s, d):
    pad = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(x.cast("string"), 4, "0")), ",")
    return _rows(s, d).select("basket_id", "label", pad("indices").alias("indices"), pad("parents").alias("parents"))


@query("design_matrix_long", "SELECT basket_id, index, value FROM matrix JOIN labels USING (basket_id)", matrix_sql(0.3))
def _(s, d):
    return _matrix(s, d)


@query("stratified_folds", "SELECT * FROM fold", FOLD)
def _(s, d):
    return features.folds(labels(s, d))


@query("fold_balance", "SELECT label, " + ", ".join(f"count(*) FILTER (fold = {i}) AS fold_{i}" for i in range(5)) + " FROM fold GROUP BY label", FOLD)
def _(s, d):
    return _balance(s, d)


@query("nb_scores", "SELECT basket_id, label, round(logit, 6) AS logit FROM nb", NB)
def _(s, d):
    return _nb(s, d).withColumn("logit", R("logit", 6))


@query("nb_predictions", "SELECT basket_id, top, round(confidence, 6) AS confidence FROM tops", NB)
def _(s, d):
    return _nb_tops(s, d).withColumn("confidence", R("confidence", 6))


@query("linear_logits", "SELECT basket_id, label, CASE WHEN round(logit, 6) = 0 THEN 0 ELSE round(logit, 6) END AS logit FROM logit", SCORE)
def _(s, d):
    return _logits(s, d).withColumn("logit", F.when(R("logit", 6) == 0, 0.0).otherwise(R("logit", 6)))  # no negative zero


@query("softmax_blend", "SELECT basket_id, label, round(share, 6) AS share FROM share", SCORE)
def _(s, d):
    return _shares(s, d).withColumn("share", R("share", 6))


@query("top_blend", "SELECT basket_id, label AS top, round(share, 6) AS confidence FROM ranked WHERE r = 1", SCORE)
def _(s, d):
    return model.top_label(_shares(s, d)).withColumn("confidence", R("confidence", 6))


@query("log_loss", "SELECT round(avg(-ln(greatest(share, 1e-15))), 6) AS log_loss FROM share JOIN labels USING (basket_id, label)", NB)
def _(s, d):
    return model.log_loss(model.softmax(_nb(s, d)), labels(s, d)).select(R("log_loss", 6).alias("log_loss"))


@query("reliability_bins", "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins", NB)
def _(s, d):
    return model.reliability(_nb_tops(s, d), labels(s, d)).withColumns({"confidence": R("confidence", 6), "accuracy": R("accuracy", 6)})


@query("ece", "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bins", NB)
def _(s, d):
    return model.calibration_error(model.reliability(_nb_tops(s, d), labels(s, d))).select(R("ece", 6).alias("ece"))


@query("label_recall", "SELECT label, n, hits, predicted, round(CASE WHEN n = 0 THEN 0 ELSE hits / n END, 6) AS recall, round(CASE WHEN n + predicted = 0 THEN 0 ELSE 2 * hits / (n + predicted) END, 6) AS f1 FROM pl", NB)
def _(s, d):
    return model.per_label(_nb_tops(s, d), labels(s, d)).withColumns({"recall": R("recall", 6), "f1": R("f1", 6)})


@query("accuracy_macro_f1", "SELECT round(sum(hits) / sum(n), 6) AS accuracy, round(avg(CASE WHEN n + predicted = 0 THEN 0 ELSE 2 * hits / (n + predicted) END), 6) AS macro_f1 FROM pl", NB)
def _(s, d):
    return model.accuracy_macro_f1(model.per_label(_nb_tops(s, d), labels(s, d))).select(R("accuracy", 6).alias("accuracy"), R("macro_f1", 6).alias("macro_f1"))


@query("confusion_pairs", "SELECT label AS truth, top AS predicted, count(*) AS n FROM truth WHERE label <> top GROUP BY ALL ORDER BY n DESC, truth, predicted LIMIT 15", NB)
def _(s, d):
    return model.confusion(_nb_tops(s, d), labels(s, d))


@query("explain_contributions", """SELECT basket_id, label, row_number() OVER (PARTITION BY basket_id ORDER BY round(value * coefficient, 9) DESC, index) AS rank, index, round(value * coefficient, 6) AS contribution
  FROM (SELECT basket_id, label FROM ranked WHERE r = 1) JOIN matrix USING (basket_id) JOIN coef USING (label, index) QUALIFY rank <= 5""", SCORE)
def _(s, d):
    leaders = model.top_label(_shares(s, d)).select("basket_id", F.col("top").alias("label"))
    return model.contributions(_matrix(s, d), _coefficients(s, d), leaders).withColumn("contribution", R("contribution", 6))


@query("explain_differentiators", """SELECT x.basket_id, row_number() OVER (PARTITION BY x.basket_id ORDER BY round(value * (a.coefficient - b.coefficient), 9) DESC, m.index) AS rank, m.index, round(value * (a.coefficient - b.coefficient), 6) AS advantage
  FROM ranked x JOIN ranked y ON x.basket_id = y.basket_id AND x.r = 1 AND y.r = 2 JOIN matrix m ON m.basket_id = x.basket_id JOIN coef a ON a.label = x.label AND a.index = m.index JOIN coef b ON b.label = y.label AND b.index = m.index QUALIFY rank <= 5""", SCORE)
def _(s, d):
    return model.differentiators(_matrix(s, d), _coefficients(s, d), model.leader_and_runner_up(_shares(s, d))).withColumn("advantage", R("advantage", 6))


@query("coefficient_deltas", """SELECT side, row_number() OVER (PARTITION BY side ORDER BY round(delta, 9) DESC, index) AS rank, index, round(delta, 6) AS delta FROM (
  SELECT CASE WHEN a.coefficient > b.coefficient THEN 'a' ELSE 'b' END AS side, index, abs(a.coefficient - b.coefficient) AS delta FROM coef a JOIN coef b USING (index) WHERE a.label = '1-URGENT' AND b.label = '5-LOW' AND a.coefficient <> b.coefficient) QUALIFY rank <= 10""", SCORE)
def _(s, d):
    return search.coefficient_deltas(_coefficients(s, d), "1-URGENT", "5-LOW").withColumn("delta", R("delta", 6))


@query("item_profile", """SELECT label, up, coefficient::DOUBLE AS coefficient FROM (SELECT label, coefficient, row_number() OVER (ORDER BY coefficient DESC, label) AS up, row_number() OVER (ORDER BY coefficient, label DESC) AS down FROM coef WHERE index = 3) WHERE up <= 2 OR down <= 2""", SCORE)
def _(s, d):
    return search.item_profile(_coefficients(s, d), 3, 2)


def _corpus(s, d):
    n = mentions(s, d).groupBy("item").agg(F.count("*").alias("mentions"))
    return n.select(T.slug(F.col("item")).alias("id"), F.col("item").alias("name"), "mentions", F.array(F.upper(_noun(F.col("item")))).alias("aliases"))


@query("search_ranked", """SELECT id, tier::BIGINT AS tier, mentions FROM (SELECT replace(item, ' ', '_') AS id, count(*) AS mentions, CASE WHEN starts_with(item, 'bl') THEN 0 WHEN starts_with(split_part(item, ' ', 2), 'bl') THEN 1 WHEN contains(item, 'bl') THEN 2 END AS tier FROM mentions GROUP BY item)
  WHERE tier IS NOT NULL ORDER BY tier, mentions DESC, id LIMIT 8""")
def _(s, d):
    return search.search(_corpus(s, d), "  BL ")


@query("common_items", "SELECT replace(item, ' ', '_') AS id, count(*) AS mentions FROM mentions GROUP BY item ORDER BY mentions DESC, id LIMIT 20")
def _(s, d):
    return search.common_items(_corpus(s, d))


@query("parent_children", "SELECT noun AS parent_id, string_agg(item, ',' ORDER BY item) AS children FROM items GROUP BY noun")
def _(s, d):
    return search.children(_items(s, d).select(F.col("item").alias("id"), _noun(F.col("item")).alias("parent_id"))).withColumn("children", _join("children"))


@query("atlas_layout", "SELECT label, family, round(cos(-pi() / 2 + 2 * pi() * i / n), 4) AS x, round(sin(-pi() / 2 + 2 * pi() * i / n), 4) AS y FROM (SELECT label, left(label, 1) AS family, row_number() OVER (ORDER BY left(label, 1), label) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM labels))")
def _(s, d):
    return taxonomy.atlas(labels(s, d), F.substring("label", 1, 1))


@query("gate_shared_alias", "SELECT noun AS alias, count(DISTINCT item) AS owners FROM items GROUP BY noun HAVING count(DISTINCT item) > 1")
def _(s, d):
    return gates.shared_alias(_items(s, d).select(F.col("item").alias("id"), _noun(F.col("item")).alias("alias")))


@query("gate_uncovered", "SELECT item, n FROM (SELECT item, count(DISTINCT basket_id) AS n FROM mentions GROUP BY item HAVING n >= 4) WHERE split_part(item, ' ', 1) NOT IN ('blue', 'red')")
def _(s, d):
    return gates.uncovered(mentions(s, d), _vocabulary(s, d).select("id", F.explode("aliases.alias").alias("alias")))


@query("gate_orders_without_items", "SELECT basket_id FROM labels WHERE basket_id NOT IN (SELECT basket_id FROM mentions)")
def _(s, d):
    return gates.unknown_key(labels(s, d), "basket_id", mentions(s, d), "basket_id")


@query("gate_repeated_items", "SELECT basket_id FROM mentions GROUP BY basket_id HAVING count(*) > count(DISTINCT item)")
def _(s, d):
    return gates.repeated_in_row(mentions(s, d).groupBy("basket_id").agg(F.collect_list("item").alias("items")), "basket_id", "items")


@query("null95_bits")
def _(s, d):
    return _evidence(s, d, True).select("variant", "base", R("null95_bits", 6).alias("null95_bits"), R("jsd_to_null_ratio", 4).alias("ratio"))


@query("seeded_folds")
def _(s, d):
    return features.seeded_folds(labels(s, d))


@query("vocabulary_build")
def _(s, d):
    train = mentions(s, d).groupBy("basket_id").agg(F.collect_list("item").alias("items")).join(labels(s, d), "basket_id").select(F.col("basket_id").alias("id"), "label", "items")
    nouns = F.array_distinct(F.transform("items", _noun))
    both = (F.struct((F.col("id") * 2 + i).alias("id"), "label", x.alias("items")) for i, x in enumerate((F.col("items"), nouns)))  # no two ids meet
    train = train.select(F.inline(F.array(*both)))
    lexicons = Lexicons(modifiers=MODIFIERS, gate=GATE, variant_tokens=frozenset({"red", "cold"}))
    out, _ = builds.vocabulary_build(train, lexicons)
    return out.select("id", "name", "parent_id", "train_mention_count", F.size("aliases").alias("n_aliases"))


@query("temperature_fit")
def _(s, d):
    t = model.fit_temperature(_nb(s, d), labels(s, d))
    return s.createDataFrame([(t,)], "temperature double")


@query("logistic_fit")
def _(s, d):
    l = labels(s, d)
    names = [r[0] for r in l.select("label").distinct().orderBy("label").collect()]
    vectors = model.as_vectors(_matrix(s, d, 0.3), l, _space(s, d).count(), names).cache()
    coefficients, intercepts = model.parameters(model.fit_logistic(vectors, 1.0), names)
    vectors.unpersist()
    return coefficients.join(intercepts, "label")


@query("lr_fit_metrics")
def _(s, d):
    l = labels(s, d)
    names = [r[0] for r in l.select("label").distinct().orderBy("label").collect()]
    coefficients, intercepts = model.train_final(lambda w: _matrix(s, d, w), l, _space(s, d).count(), names, 1.0, 0.3)
    shares = model.softmax(model.logits(_matrix(s, d), l, coefficients, intercepts))
    scored = model.accuracy_macro_f1(model.per_label(model.top_label(shares), l))
    return scored.crossJoin(F.broadcast(model.log_loss(shares, l))).select(*(R(c, 6).alias(c) for c in ("accuracy", "macro_f1", "log_loss")))
