"""Queries of gates, evaluation and exports over the driver's tables. Gates see tables with planted faults, which the
SQL counts by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, exports, features, gates, model, predict, search, validators, vocabulary
from ..streaming import scorer
from . import queries as q
from .queries import FOLD, SCORE, SPACE, R, matrix_sql, query

def _item():
    return F.col("item")


def _noun():
    return q._noun(F.col("item"))


def _adjective():
    return F.split("item", " ")[0]


def _planted_vocabulary(s, d):
    """Items with faults by adjective: cold ids aren't slugs, hot counts are negative, new names are missing, old sources
    are unknown, red parents are missing, blue aliases are a noun that others have."""
    x = q._items(s, d)
    alias = F.when(_adjective() == "blue", _noun()).otherwise(_item())
    source = F.when(_adjective() == "old", F.lit("somewhere")).otherwise(F.lit("modifier_strip"))
    entry = F.struct(alias.alias("alias"), source.alias("source"), F.lit("").alias("rule"), F.lit(1).cast("long").alias("train_frequency"))
    return x.select(
        F.when(_adjective() == "cold", F.upper(T.slug(_item()))).otherwise(T.slug(_item())).alias("id"),
        F.when(_adjective() != "new", _item()).alias("name"),
        F.when(_adjective() == "red", F.lit("nothing")).alias("parent_id"),
        F.when(_adjective() == "hot", -1).otherwise(F.length(_item())).cast("long").alias("train_mention_count"),
        F.when(_adjective() == "small", F.array(entry, entry)).otherwise(F.array(entry)).alias("aliases"),
    )


COUNT = "(SELECT count(*) FROM items WHERE split_part(item, ' ', 1) = '{}')"


@query("vocabulary_gates", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {sql})" for name, sql in (
    ("ids are slugs and stand once", COUNT.format("cold")),
    ("names are there", COUNT.format("new")),
    ("mentions are counted", COUNT.format("hot")),
    ("aliases are there", "0"),
    ("aliases have text", "0"),
    ("sources are known", COUNT.format("old")),
    ("aliases are sorted and stand once", COUNT.format("small")),
    ("an alias has one owner", "0"),
    ("no name is another''s alias", "0"),
    ("parents are roots that are there", COUNT.format("red")),
)) + ") t(gate, violations)")
def _(s, d):
    return gates.report(validators.vocabulary_gates(_planted_vocabulary(s, d)))


@query("gate_bad_parent", """SELECT a.id, a.parent_id FROM (SELECT item AS id, CASE WHEN starts_with(item, 'old') THEN 'nothing' ELSE noun END AS parent_id FROM items UNION ALL SELECT DISTINCT noun, CASE noun WHEN 'gizmo' THEN 'gear' WHEN 'rod' THEN 'rod' END FROM items) a
  WHERE a.parent_id IS NOT NULL AND (a.parent_id IN ('nothing', 'gizmo', 'rod'))""")
def _(s, d):
    x = q._items(s, d)
    own = x.select(_item().alias("id"), F.when(_adjective() == "old", F.lit("nothing")).otherwise(_noun()).alias("parent_id"))
    nouns = x.select(_noun().alias("id")).distinct()
    return gates.bad_parent(own.union(nouns.select("id", F.when(F.col("id") == "gizmo", "gear").when(F.col("id") == "rod", "rod"))))


@query("gate_fold_spread", """SELECT label, max(n) - min(n) AS spread FROM (SELECT l.label, f.fold, count(b.basket_id) AS n FROM (SELECT DISTINCT label FROM labels) l CROSS JOIN (SELECT unnest(range(5)) AS fold) f
  LEFT JOIN (SELECT label, basket_id, basket_id % 5 AS fold FROM labels) b ON b.label = l.label AND b.fold = f.fold GROUP BY ALL) GROUP BY label HAVING max(n) - min(n) > 1""")
def _(s, d):
    uneven = q.labels(s, d).withColumn("fold", (F.col("basket_id") % 5).cast("long"))
    return gates.fold_spread(features.fold_balance(uneven))


SPOILED = ", spoiled AS (SELECT basket_id, label, share + CASE WHEN label = '1-URGENT' AND basket_id % 7 = 0 THEN 0.01 ELSE 0 END AS share FROM share)"


def _spoiled(s, d):
    more = F.when((F.col("label") == "1-URGENT") & (F.col("basket_id") % 7 == 0), 0.01).otherwise(0.0)
    return q._shares(s, d).withColumn("share", F.col("share") + more)


@query("gate_share_sum", "SELECT basket_id, round(sum(share), 6) AS total FROM spoiled GROUP BY basket_id HAVING abs(sum(share) - 1) > 0.002", SCORE + SPOILED)
def _(s, d):
    return gates.share_sum(_spoiled(s, d)).withColumn("total", R("total", 6))


@query("blend_gates", """SELECT * FROM (VALUES ('baskets stand once', 0), ('baskets are those asked for', (SELECT count(*) FROM labels WHERE basket_id % 11 = 0)), ('each label has a share', 0), ('shares lie between 0 and 1', (SELECT count(DISTINCT basket_id) FROM spoiled WHERE share > 1 AND basket_id % 11 <> 0)),
  ('shares add up to 1', (SELECT count(DISTINCT basket_id) FROM spoiled WHERE label = '1-URGENT' AND basket_id % 7 = 0 AND basket_id % 11 <> 0)),
  ('the top label has the largest share', (SELECT count(*) FROM (SELECT basket_id, label, max(round(share, 9)) OVER (PARTITION BY basket_id) AS most, round(share, 9) AS share FROM spoiled) WHERE basket_id % 11 <> 0 AND label = '5-LOW' AND share < most))) t(gate, violations)""", SCORE + SPOILED)
def _(s, d):
    names = [r[0] for r in q.labels(s, d).select("label").distinct().orderBy("label").collect()]
    blend = _spoiled(s, d).groupBy("basket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "share"))), lambda x: R(x["share"], 9)).alias("blend"))
    wrong = blend.filter("basket_id % 11 <> 0").withColumn("top", F.lit("5-LOW"))
    return gates.report(validators.blend_gates(wrong, names, q.labels(s, d)))


@query("space_gates", """SELECT * FROM (VALUES ('ids are those of the vocabulary', (SELECT count(*) FROM space WHERE index % 10 = 3)), ('indexes run from 0 one by one', 1), ('ids rise with the index', 0),
  ('parents are linked by index', (SELECT count(*) FROM space s JOIN space p ON p.index = s.parent_index WHERE s.index % 10 <> 3 AND p.index % 10 = 3))) t(gate, violations)""", SPACE)
def _(s, d):
    whole = q._space(s, d)
    x = q._items(s, d)
    links = x.select(_noun().alias("id")).distinct().withColumn("parent_id", F.lit(None).cast("string")).union(x.select(_item(), _noun()))
    return gates.report(validators.space_gates(whole.filter("index % 10 <> 3"), links))


@query("rows_gates", """SELECT * FROM (VALUES ('baskets stand once', 0), ('baskets are those that were staged', (SELECT count(*) FROM labels WHERE basket_id % 13 = 0)), ('indexes are in the space', (SELECT count(DISTINCT index) FROM spoiled WHERE index >= (SELECT count(*) FROM space))),
  ('indexes rise', 0), ('parents rise', 0),
  ('rows follow from the staged baskets', (SELECT count(*) FROM labels WHERE basket_id % 13 = 0) + 2 * (SELECT count(*) FROM labels WHERE basket_id % 13 = 1))) t(gate, violations)""",
  SPACE + ", spoiled AS (SELECT (SELECT count(*) FROM space) AS index FROM labels WHERE basket_id % 13 = 1)")
def _(s, d):
    n = q._space(s, d).count()
    ids = q.mentions(s, d).groupBy("basket_id").agg(F.collect_set("item").alias("item_ids"))
    staged = q.labels(s, d).join(ids, "basket_id", "left").withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))
    spoiled = F.when(F.col("basket_id") % 13 == 1, F.concat("indices", F.array(F.lit(n)))).otherwise(F.col("indices"))
    rows = q._rows(s, d).filter("basket_id % 13 <> 0").withColumn("indices", spoiled)
    return gates.report(validators.rows_gates(rows, q._space(s, d), staged))


@query("fold_gates", """SELECT * FROM (VALUES ('baskets stand once', 0), ('baskets are those that were staged', (SELECT count(*) FROM labels WHERE basket_id % 17 = 0)), ('labels are those that were staged', (SELECT count(*) FROM labels WHERE basket_id % 17 = 0)),
  ('folds are in range', (SELECT count(*) FROM labels WHERE basket_id % 17 = 1)),
  ('labels are spread evenly', (SELECT count(*) FROM (SELECT label, max(n) - min(n) AS spread FROM (SELECT l.label, f.i, count(x.basket_id) AS n FROM (SELECT DISTINCT label FROM labels) l CROSS JOIN (SELECT unnest(range(5)) AS i) f
     LEFT JOIN fold x ON x.label = l.label AND x.fold = f.i AND x.basket_id % 17 > 1 GROUP BY ALL) GROUP BY label) WHERE spread > 1))) t(gate, violations)""", FOLD)  # fmt: skip
def _(s, d):
    folded = features.folds(q.labels(s, d)).filter("basket_id % 17 <> 0")
    wrong = folded.withColumn("fold", F.when(F.col("basket_id") % 17 == 1, F.lit(5).cast("long")).otherwise(F.col("fold")))
    return gates.report(validators.fold_gates(wrong, q.labels(s, d)))


@query("parameter_gates", """SELECT * FROM (VALUES ('intercepts are those of the labels', 1), ('each label has each feature', 1), ('no other label has coefficients', 0), ('coefficients are rounded', (SELECT count(*) FROM coef WHERE label = '2-HIGH' AND index % 2 = 0)),
  ('intercepts are rounded', 0), ('the configuration is in the grid', 1)) t(gate, violations)""", SCORE)
def _(s, d):
    names = [r[0] for r in q.labels(s, d).select("label").distinct().orderBy("label").collect()]
    odd = (F.col("label") == "2-HIGH") & (F.col("index") % 2 == 0)
    c = q._coefficients(s, d).withColumn("coefficient", F.col("coefficient").cast("double") + F.when(odd, 1e-8).otherwise(0.0))
    c = c.filter((F.col("label") != "3-MEDIUM") | (F.col("index") > 0))
    i = q._intercepts(s, d).filter("label <> '5-LOW'")
    return gates.report(validators.parameter_gates(c, i, {"c": 2.0, "parent_weight": 0.3}, names, q._space(s, d).count()))


BAYES = matrix_sql(0) + FOLD + """, counts AS (SELECT label, index, fold, sum(value) AS c FROM matrix JOIN fold USING (basket_id) GROUP BY ALL),
fl AS (SELECT f.fold, l.label, (SELECT count(*) FROM fold x WHERE x.label = l.label AND x.fold <> f.fold) AS c FROM (SELECT DISTINCT fold FROM fold) f CROSS JOIN (SELECT DISTINCT label FROM fold) l),
dense AS (SELECT fl.fold, fl.label, i.index, coalesce((SELECT sum(c) FROM counts y WHERE y.label = fl.label AND y.index = i.index AND y.fold <> fl.fold), 0) AS c FROM fl CROSS JOIN (SELECT DISTINCT index FROM matrix) i),
mass2 AS (SELECT fold, label, sum(c) AS m FROM dense GROUP BY ALL),
ll AS (SELECT fold, label, index, ln((c + 1) / (m + (SELECT count(*) FROM space))) AS w FROM dense JOIN mass2 USING (fold, label)),
held AS (SELECT b.basket_id, ll.label, sum(value * w) AS x FROM matrix JOIN fold b USING (basket_id) JOIN ll ON ll.index = matrix.index AND ll.fold = b.fold GROUP BY ALL),
nb AS (SELECT b.basket_id, b.fold, fl.label, ln(fl.c / sum(fl.c) OVER (PARTITION BY b.basket_id)) + coalesce(h.x, 0) AS logit FROM fold b JOIN fl USING (fold) LEFT JOIN held h ON h.basket_id = b.basket_id AND h.label = fl.label),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY basket_id)) AS e FROM nb),
share AS (SELECT basket_id, fold, label, e / sum(e) OVER (PARTITION BY basket_id) AS share FROM e),
tops AS (SELECT t.basket_id, t.fold, t.label AS top, f.label FROM (SELECT * FROM share QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY round(share, 9) DESC, label) = 1) t JOIN fold f USING (basket_id)),
pf AS (SELECT g.fold, g.label, count(*) FILTER (t.label = g.label) AS n, count(*) FILTER (t.label = g.label AND t.top = g.label) AS hits, count(*) FILTER (t.top = g.label) AS predicted FROM fl g LEFT JOIN tops t ON t.fold = g.fold GROUP BY ALL),
fm AS (SELECT fold, sum(hits) / sum(n) AS accuracy, avg(CASE WHEN n + predicted = 0 THEN 0 ELSE 2 * hits / (n + predicted) END) AS macro_f1 FROM pf GROUP BY fold),
fll AS (SELECT f.fold, avg(-ln(greatest(share, 1e-15))) AS log_loss FROM fold f JOIN share USING (basket_id, label) GROUP BY ALL),
folds AS (SELECT fold, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(log_loss, 6) AS log_loss FROM fm JOIN fll USING (fold))"""


def _held(s, d):
    return evaluation.bayes_out_of_fold(q._matrix(s, d, 0.0), q.labels(s, d), features.folds(q.labels(s, d)), q._space(s, d).count())


@query("out_of_fold_bayes", "SELECT basket_id, label, round(share, 6) AS share FROM share", BAYES)
def _(s, d):
    return _held(s, d).withColumn("share", R("share", 6))


@query("fold_metrics", "SELECT * FROM folds", BAYES)
def _(s, d):
    return evaluation.fold_metrics(_held(s, d), q.labels(s, d), features.folds(q.labels(s, d)))


@query("ingredients_asset", "SELECT * FROM (SELECT noun AS id, noun AS name, '' AS aliases, string_agg(item, ',' ORDER BY item) AS children FROM items GROUP BY noun UNION ALL SELECT item, item, upper(item) || ':1', '' FROM items)")
def _(s, d):
    x = q._items(s, d)
    entry = lambda c: F.struct(c.alias("alias"), F.lit("x").alias("source"), F.lit("").alias("rule"), F.lit(1).cast("long").alias("train_frequency"))
    nothing = F.lit(None).cast("string")
    nouns = x.select(_noun().alias("id")).distinct().select("id", F.col("id").alias("name"), nothing.alias("parent_id"), F.array(entry(F.col("id"))).alias("aliases"))
    own = x.select(_item().alias("id"), _item().alias("name"), _noun().alias("parent_id"), F.array(entry(_item()), entry(F.upper(_item()))).alias("aliases"))
    out = exports.ingredients(nouns.union(own).withColumns({"train_mention_count": F.lit(1).cast("long"), "preserve_evidence": nothing}))
    shown = F.array_join(F.transform("aliases", lambda a: F.concat(a["alias"], F.lit(":"), a["train_frequency"].cast("string"))), ",")
    return out.select("id", "name", shown.alias("aliases"), q._join("children").alias("children"))


@query("cuisine_grid", "SELECT left(label, 1) AS family, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT label FROM labels) GROUP BY 1")
def _(s, d):
    rows = q.labels(s, d).select("label").distinct().withColumn("family", F.substring("label", 1, 1))
    return exports.cuisine_grid(rows).withColumn("labels", q._join("labels"))


@query("weakest_recall", "SELECT label, round(recall, 6) AS recall FROM (SELECT label, CASE WHEN n = 0 THEN 0 ELSE hits / n END AS recall FROM pl) WHERE recall < 0.5", q.NB)
def _(s, d):
    return search.weakest_recall(model.per_label(q._nb_tops(s, d), q.labels(s, d)), 0.5).withColumn("recall", R("recall", 6))


@query("live_blend", """SELECT label, round(e / sum(e) OVER (), 4) AS share FROM (SELECT label, exp(logit / 2 - max(logit / 2) OVER ()) AS e FROM (
  SELECT l.label, l.i / 10.0 + sum(c.coefficient * w) AS logit FROM li2 l JOIN coef c USING (label) JOIN (
    SELECT index, max(w) AS w FROM (SELECT index, 1.0 AS w FROM space WHERE id IN ('red gear', 'blue widget') UNION ALL SELECT parent_index, 0.3 FROM space WHERE id IN ('red gear', 'blue widget')) GROUP BY index) v USING (index) GROUP BY l.label, l.i))""", SCORE)
def _(s, d):
    asset = exports.scoring_model(q._coefficients(s, d).withColumn("coefficient", F.col("coefficient").cast("double")), q._intercepts(s, d).withColumn("intercept", F.col("intercept").cast("double")), q._space(s, d), 2.0, 0.3)
    found = predict.predict(s, predict.split_items("red gear, BLUE widget, , nothing like it"), q._resolver(s, d), asset)
    return found.blend.withColumn("share", R("share", 4))


@query("resolution_lines", """SELECT row_number() OVER (ORDER BY item) - 1 AS pos, '  ''' || item || ''' -> ' || coalesce(id, 'UNRESOLVED') || ' [' || method || ']' || CASE WHEN coalesce(dropped, '') <> '' THEN ' (dropped: ' || replace(dropped, ' ', ', ') || ')' ELSE '' END AS line FROM res""", q.RES)
def _(s, d):
    from pyspark.sql import Window

    found = q._resolved(s, d).withColumn("pos", (F.row_number().over(Window.orderBy("item")) - 1).cast("long"))  # a few asked strings
    return predict.resolution_lines(found)


@query("review_queue", """SELECT variant, base, n AS variant_count, round(bits, 4) AS jsd_bits, ids AS example_ids FROM j JOIN (
  SELECT item, string_agg(basket_id, ',' ORDER BY basket_id) AS ids FROM (SELECT DISTINCT item, basket_id FROM mentions QUALIFY dense_rank() OVER (PARTITION BY item ORDER BY basket_id) <= 5) GROUP BY item) e ON e.item = variant""", q.JSD)
def _(s, d):
    members = q._items(s, d).select("item", _item().alias("group"))
    found = q._evidence(s, d).select("variant", "base", "variant_count", "jsd_bits", "null95_bits", "jsd_to_null_ratio", "variant_top", "base_top")
    out = vocabulary.review_entries(found, q.mentions(s, d), members)
    return out.select("variant", "base", "variant_count", "jsd_bits", q._join("example_ids").alias("example_ids"))


@query("compile_statistics", """SELECT (SELECT count(*) FROM voc) AS ingredient_count, (SELECT count(*) FROM voc) AS alias_count, 0 AS parent_link_count, count(*) FILTER (item IN (SELECT id FROM voc)) AS covered_mention_count,
  count(*) AS total_mention_count, round(count(*) FILTER (item IN (SELECT id FROM voc)) / count(*), 6) AS coverage_ratio FROM (SELECT DISTINCT basket_id, item FROM mentions)""", q.RES)
def _(s, d):
    out = vocabulary.compile_statistics(q.mentions(s, d), q._vocabulary(s, d).withColumn("parent_id", F.lit(None).cast("string")))
    return out.withColumns({"parent_link_count": F.col("parent_link_count").cast("int"), "coverage_ratio": R("coverage_ratio", 6)})


@query("stream_scores", "SELECT basket_id, label, round(share, 6) AS share FROM share", SCORE)
def _(s, d):
    space = {r["index"]: r for r in q._space(s, d).collect()}  # the queries' model: a few dozen items
    weights: dict[str, dict[str, float]] = {}
    for r in q._coefficients(s, d).collect():
        weights.setdefault(r["label"], {})[space[r["index"]]["id"]] = float(r["coefficient"])
    intercepts = {r["label"]: float(r["intercept"]) for r in q._intercepts(s, d).collect()}
    parents = {r["id"]: space[r["parent_index"]]["id"] for r in space.values() if r["parent_index"] is not None}
    items = q.mentions(s, d).groupBy("basket_id").agg(F.collect_list("item").alias("items"))
    baskets = q.labels(s, d).join(items, "basket_id", "left").select(F.col("basket_id").alias("id"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    scored = scorer.label_scores(baskets, weights, intercepts, 2.0, parents, 0.3)
    return scored.select(F.col("id").alias("basket_id"), F.explode("shares").alias("label", "share")).withColumn("share", R("share", 6))


@query("item_family", """SELECT CASE WHEN id = 'red gear' THEN 'self' WHEN id = 'gear' THEN 'parent' ELSE 'sibling' END AS role, id, length(id)::BIGINT AS mentions FROM (SELECT item AS id FROM items WHERE noun = 'gear' UNION ALL SELECT 'gear')""")
def _(s, d):
    x = q._items(s, d)
    nothing = F.lit(None).cast("string")
    v = x.select(_item().alias("id"), _noun().alias("parent_id")).union(x.select(_noun(), nothing).distinct())
    v = v.select("id", F.col("id").alias("name"), "parent_id", F.length("id").cast("long").alias("train_mention_count"), nothing.alias("preserve_evidence"))
    return search.family(v, "red gear").select("role", "id", "mentions")
