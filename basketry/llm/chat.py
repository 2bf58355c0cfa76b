"""Quotation linking: reply-ordered conversations without quotes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, numbered, table

#: Words that a single quoted line needs to link by itself, when its passage as a whole doesn't.
LINE_WORDS = 4
#: The marks before a quoted line's content: blanks and > up to the last > of them.
PREFIX = r"^[ \t>]*>"
ADDED = ["level", "n_passages", "n_linked", "parent_turn", "root_turn", "depth", "clean_text"]


def _normal(x):
    return F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " "))


def _level(line):
    return F.length(F.translate(F.regexp_extract(line, PREFIX, 0), " \t", ""))


def _content(line):
    return F.regexp_replace(line, PREFIX, "")


def _let(value, f):
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _passages(text):
    """Maximal runs of lines of one level: (first line, level, contents)."""

    def of_levels(lines, levels):
        places = F.sequence(F.lit(0), F.size(levels) - 1)
        starts = F.filter(places, lambda i: ~F.coalesce(F.get(levels, i - 1) == F.get(levels, i), F.lit(False)))
        return _let(starts, lambda at: F.transform(at, lambda i, k: of_run(lines, levels, i, F.coalesce(F.get(at, k + 1), F.size(levels)))))

    def of_run(lines, levels, i, upto):
        return F.struct(i.alias("nth"), F.get(levels, i).alias("level"), F.array_join(F.transform(F.slice(lines, i + 1, upto - i), _content), "\n").alias("p"))

    return _let(F.split(text, "\n"), lambda lines: _let(F.transform(lines, _level), lambda levels: of_levels(lines, levels)))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", rounds: int = 40) -> DataFrame:
    """messages with their quotes linked and removed.

    A line's level is the number of > before its content. A passage is a maximal run of lines of one level above 0,
    normalised (lower case, white space made one space) and hashed. It links to the first message of the conversation
    with that text: as the whole of what it says itself, or as one of its lines; a quoted line of LINE_WORDS words or
    more links likewise. parent_turn is the latest earlier turn linked from the message's lowest linked level,
    root_turn and depth follow the parents (by pointer jumping, so rounds grow with the logarithm of a thread's depth).
    Ordered by root_turn and turn, a conversation has each reply after what it answers. clean_text is the text without
    quoted lines; a text without any is unchanged, a null text stays null and has level 0.

    No conversation is gathered in one place: first sayings are least turns by conversation and hash. Rows that share
    conversation and turn get equal links from equal texts; rows without a conversation or turn link to nothing and are
    their own root. An empty table gives no rows; added columns replace those of the same name.
    """
    messages = messages.drop(*(c for c in ADDED if c in messages.columns and c not in (conv_col, turn_col, text_col)))
    messages, own = numbered(messages)
    conv_col, turn_col, text_col = (own[c] for c in (conv_col, turn_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    quoted = text.rlike(r"(?m)^[ \t]*>")
    clean = F.when(quoted, F.array_join(F.filter(F.split(text, "\n"), lambda x: _level(x) == 0), "\n")).otherwise(F.col(text_col))
    rows = messages.withColumns({"_conv": F.col(conv_col), "_turn": F.col(turn_col).cast("long"), "_quoted": quoted, "clean_text": clean})
    keyed = rows.select("_conv", "_turn", F.col(text_col).alias("text"), "clean_text", "_quoted")
    parts = keyed.filter("_quoted").select("_conv", "_turn", F.explode(_passages(F.col("text"))).alias("q"))
    parts = parts.select("_conv", "_turn", "q.nth", "q.level", "q.p").filter("level > 0")
    lines = F.filter(F.transform(F.split("p", "\n"), _normal), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS)
    hashes = F.array_distinct(F.concat(F.array(F.xxhash64(_normal(F.col("p")))), F.transform(lines, lambda x: F.xxhash64(x))))
    parts = materialise(parts.filter(_normal(F.col("p")) != "").select("_conv", "_turn", "level", "nth", hashes.alias("hashes")), "quotes")
    said = keyed.join(parts.select("_conv").distinct(), "_conv", "left_semi").filter(F.col("clean_text").isNotNull() & F.col("_turn").isNotNull())
    units = F.array_distinct(F.concat(F.array(_normal(F.col("clean_text"))), F.transform(F.split("clean_text", "\n"), _normal)))
    first = said.select("_conv", "_turn", F.explode(F.filter(units, lambda x: x != "")).alias("u")).groupBy("_conv", F.xxhash64("u").alias("hash")).agg(F.min("_turn").alias("source"))
    linked = parts.select("_conv", "_turn", "level", "nth", F.explode("hashes").alias("hash")).join(first, ["_conv", "hash"]).filter("source < _turn")
    linked = linked.groupBy("_conv", "_turn", "level", "nth").agg(F.max("source").alias("source")).groupBy("_conv", "_turn", "level").agg(F.max("source").alias("source"), F.count("*").alias("n"))
    linked = linked.groupBy("_conv", "_turn").agg(F.min_by("source", "level").alias("parent_turn"), F.sum("n").alias("n_linked"))
    counts = parts.groupBy("_conv", "_turn").agg(F.max("level").alias("level"), F.count_distinct("level", "nth").alias("n_passages"))
    links = materialise(linked, "links")
    roots = links.select("_conv", "_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    for _ in range(rounds):
        above = roots.select("_conv", F.col("_turn").alias("root_turn"), F.col("root_turn").alias("up"), F.col("depth").alias("more"))
        step = materialise(roots.join(above, ["_conv", "root_turn"], "left").select("_conv", "_turn", F.coalesce("up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "roots")
        roots = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"roots have not converged in {rounds} rounds")
    out = rows.join(counts, ["_conv", "_turn"], "left").join(links, ["_conv", "_turn"], "left").join(roots, ["_conv", "_turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *(F.col(n).alias(c) for c, n in own.items()),
        F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_linked", zero).alias("n_linked"),
        "parent_turn", F.coalesce("root_turn", "_turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), "clean_text",
    )


def query(spark, sf_dir):
    return link_quotes(table(spark, sf_dir, "conversations")).drop("text")


_N = "trim(regexp_replace(lower({}), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
SQL = f"""
WITH RECURSIVE m AS (SELECT *, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '(?m)^[ \\t]*>') AS quoted FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m WHERE quoted),
v AS (SELECT *, length(translate(regexp_extract(line, '{PREFIX}', 0), chr(32) || chr(9), '')) AS level, regexp_replace(line, '{PREFIX}', '') AS content FROM l),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM v),
p AS (SELECT conv_id, turn, level, run, {_N.format("string_agg(content, chr(10) ORDER BY i)")} AS p, list(content ORDER BY i) AS contents FROM g WHERE level > 0 GROUP BY ALL),
q AS (SELECT conv_id, turn, level, run, unnest(list_distinct(list_concat([p], list_filter(list_transform(contents, lambda x: {_N.format("x")}), lambda x: len(string_split(x, ' ')) >= {LINE_WORDS})))) AS h FROM p WHERE p <> ''),
c AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS clean FROM v WHERE level = 0 GROUP BY ALL),
cl AS (SELECT m.*, CASE WHEN m.quoted THEN coalesce(c.clean, '') ELSE m.text END AS clean_text FROM m LEFT JOIN c USING (conv_id, turn)),
u AS (SELECT conv_id, turn, unnest(list_concat([{_N.format("clean_text")}], list_transform(string_split(clean_text, chr(10)), lambda x: {_N.format("x")}))) AS h FROM cl WHERE clean_text IS NOT NULL),
f AS (SELECT conv_id, h, min(turn) AS source FROM u WHERE h <> '' GROUP BY ALL),
k AS (SELECT q.conv_id, q.turn, q.level, q.run, max(f.source) AS source FROM q JOIN f ON q.conv_id = f.conv_id AND q.h = f.h AND f.source < q.turn GROUP BY ALL),
par AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(source, level * 1000000 - source) AS parent_turn FROM k GROUP BY ALL),
cnt AS (SELECT conv_id, turn, max(level) AS level, count(*) AS n_passages FROM p WHERE p <> '' GROUP BY ALL),
up AS (SELECT conv_id, turn, parent_turn AS root, 1 AS depth FROM par
       UNION ALL SELECT up.conv_id, up.turn, par.parent_turn, up.depth + 1 FROM up JOIN par ON par.conv_id = up.conv_id AND par.turn = up.root),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY ALL)
SELECT cl.conv_id, cl.turn, cl.role, coalesce(cnt.level, 0)::BIGINT AS level, coalesce(cnt.n_passages, 0)::BIGINT AS n_passages,
       coalesce(par.n_linked, 0)::BIGINT AS n_linked, par.parent_turn::BIGINT AS parent_turn,
       coalesce(top.root_turn, cl.turn)::BIGINT AS root_turn, coalesce(top.depth, 0)::BIGINT AS depth, cl.clean_text
FROM cl LEFT JOIN cnt USING (conv_id, turn) LEFT JOIN par USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)
"""
