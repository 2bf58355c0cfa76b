"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, numbered, table

#: A line stands out on a host when more than MIN_DOCUMENTS distinct texts, and more than this share of the host's, have it.
MIN_DOCUMENTS, HOST_SHARE = 20, 0.01
#: ... and when at least this share of them are no near-copies of each other (0: whatever they are).
CONTEXT_SHARE = 0.5
#: A document is depleted when lines were removed and less than this share of its words is left.
LEAST_LEFT = 0.2
WORD = r"[^\x20\x09-\x0D]+"


def _words(text):
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _normal(line):
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _has_word(line):
    return line.rlike(WORD)


def _key(line):
    """60 bits of a line's MD5: a number that SQL can give as well."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _let(value, f):
    """f(value), with the value worked out once however often f names it and wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), f), 0)


def _text_key(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Columns host and k1, k2: rows alike in them have the same host and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"_host": F.coalesce(F.col(host_col), F.lit("")), "_k1": F.xxhash64(text), "_k2": F.struct(F.octet_length(text).alias("n"), F.crc32(text).alias("c"))})


def repeated_words(words):
    """How many words lie in a window of three words that occurs twice or more: windows by hash, sorted only in texts
    that have an equal pair, then the gaps between their starts, at most three each, are summed."""
    none = F.lit(0).cast("long")

    def of_places(at):
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), none, lambda a, x: a + x)

    def of_sorted(s):
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), of_places)

    def of_hashes(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered, of_sorted)).otherwise(none)

    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0))), of_hashes)


def _word_counts(text):
    """n_words, word_chars, n_repeat_words and base_failed of a text, as one struct."""

    def judged(w, r):
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"))

    return _let(_words(text), lambda w: _let(repeated_words(w), lambda r: judged(w, r)))


def _line_counts(text):
    """How many lines with a word equal an earlier one."""
    return _let(F.filter(F.split(text, "\n"), _has_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def line_frequency(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE, context_share: float = CONTEXT_SHARE) -> DataFrame:
    """(host, text key, hashes): for each distinct text of a host its normalised lines that are boilerplate there.

    Copies of a text on a host count as one document, and are reduced to one before lines are exploded, so that a
    group of copies is summed on its way. Lines are counted for each host with partial sums; a line beyond both limits
    is common, wherever it stands in a block. A common line stays only where more than 1 - context_share of its texts
    are near-copies, which are left to near-duplicate removal: they hold less than LEAST_LEFT of their words outside
    common lines, and agree in the common line of least hash.
    """
    keyed = _text_key(docs, text_col, host_col)
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _has_word)
    texts = keyed.select("_host", "_k1", "_k2", F.transform(F.transform(lines, _normal), lambda x: F.struct(_key(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"))).alias("h"))
    texts = materialise(texts.groupBy("_host", "_k1", "_k2").agg(F.first("h").alias("h")), "line-hashes")
    counts = texts.select("_host", F.explode(F.array_distinct("h.line")).alias("line")).groupBy("_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    hosts = texts.groupBy("_host").agg(F.count("*").alias("texts"))
    common = materialise(counts.join(hosts, "_host").filter(F.col("n") > F.col("texts") * host_share).select("_host", "line"), "common-lines")
    all_words = F.aggregate("h.words", F.lit(0).cast("long"), lambda acc, n: acc + n)
    places = texts.select("_host", "_k1", "_k2", all_words.alias("all"), F.explode("h").alias("h")).select("_host", "_k1", "_k2", "all", "h.line", "h.words").join(common, ["_host", "line"])
    places = places.groupBy("_host", "_k1", "_k2", "all").agg(F.sum("words").alias("common"), F.min("line").alias("least"), F.collect_set("line").alias("lines"))
    copy = F.when(F.col("all") - F.col("common") < F.col("all") * LEAST_LEFT, F.col("least"))
    places = materialise(places.select("_host", "_k1", "_k2", copy.alias("copy"), "lines"), "common-places")
    groups = places.select("_host", "copy", F.explode("lines").alias("line")).groupBy("_host", "line", "copy").agg(F.count("*").alias("c"))
    near = F.coalesce(F.max(F.when(F.col("copy").isNotNull(), F.col("c"))), F.lit(0))
    gone = groups.groupBy("_host", "line").agg(F.sum("c").alias("n"), near.alias("near")).filter(F.col("n") - F.col("near") >= F.col("n") * context_share)
    own = places.select("_host", "_k1", "_k2", F.explode("lines").alias("line"))
    return own.join(gone.select("_host", "line"), ["_host", "line"]).groupBy("_host", "_k1", "_k2").agg(F.collect_set("line").alias("drop"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """docs with columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text.

    clean_text is the text without its host's boilerplate lines. A text is rejected (kept false) if base rules fail
    (fewer than 50 words, or more than half of them in repeated three-word windows), or if lines were removed and
    less than least_left of its words is left. Null texts have no words; a null host is a host of its own; repeated
    rows and equal texts get equal verdicts; an empty table gives no rows. Names of docs that clash with the added
    columns are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    docs = docs.drop(*(c for c in added if c in docs.columns and c not in (id_col, text_col, host_col)))
    docs, own = numbered(docs)
    text_col, host_col = own[text_col], own[host_col]
    drops = line_frequency(docs, host_col, text_col, **limits)
    full = F.coalesce(F.col(text_col), F.lit(""))
    # A partition's number is not deterministic to the optimizer, so that a filter on the verdict isn't moved below the
    # counts, which would then be taken twice.
    out = _text_key(docs, text_col, host_col).withColumn("_counts", F.when(F.spark_partition_id() >= 0, _word_counts(full)))
    out = out.withColumns(
        {
            "n_words": F.col("_counts.n_words"),
            "word_chars": F.col("_counts.word_chars"),
            "n_symbols": (F.length(full) - F.length(F.regexp_replace(full, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": _line_counts(full),
            "n_repeat_words": F.col("_counts.n_repeat_words"),
            "base_failed": F.col("_counts.base_failed"),
        }
    ).drop("_counts")
    out = out.join(drops.hint("merge"), ["_host", "_k1", "_k2"], "left")  # texts are exchanged at every size, so that disk grows in proportion
    clean = F.array_join(F.filter(F.split(full, "\n"), lambda x: ~F.coalesce(F.array_contains("drop", _key(_normal(x))), F.lit(False)) | ~_has_word(x)), "\n")
    out = out.withColumn("clean_text", F.when(F.col("drop").isNull(), F.col(text_col)).otherwise(clean))
    left = F.when(F.col("drop").isNotNull(), F.size(_words(F.col("clean_text"))))
    depleted = F.coalesce(left < least_left * F.col("n_words"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), *added)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(COLUMNS)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
win AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, a, b, c FROM win WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT w.doc_id, w.i + k AS i FROM win w JOIN twice USING (doc_id, a, b, c), range(3) r(k)) GROUP BY doc_id),
texts AS (SELECT DISTINCT host, text, list_transform(lines, lambda x: trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS lines FROM d),
hosts AS (SELECT host, count(*) AS texts FROM texts GROUP BY host),
places AS (SELECT host, text, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM (SELECT host, text, unnest(lines) AS line FROM texts)),
counts AS (SELECT host, line, count(DISTINCT text) AS n FROM places GROUP BY ALL HAVING count(DISTINCT text) > {MIN_DOCUMENTS}),
common AS (SELECT c.* FROM counts c JOIN hosts USING (host) WHERE c.n > hosts.texts * {HOST_SHARE}),
whole AS (SELECT host, text, sum(words) AS all_words FROM places GROUP BY ALL),
own AS (SELECT host, text, line, sum(words) AS words FROM places JOIN common USING (host, line) GROUP BY ALL),
copies AS (SELECT host, text, CASE WHEN all_words - sum(words) < all_words * {LEAST_LEFT} THEN min(('0x' || substr(md5(line), 1, 15))::BIGINT) END AS copy
           FROM own JOIN whole USING (host, text) GROUP BY host, text, all_words),
parts AS (SELECT host, line, copy, count(*) AS c FROM own JOIN copies USING (host, text) GROUP BY ALL),
gone AS (SELECT host, line FROM parts GROUP BY ALL HAVING sum(c) - coalesce(max(c) FILTER (copy IS NOT NULL), 0) >= sum(c) * {CONTEXT_SHARE}),
removed AS (SELECT host, text, sum(words) AS n FROM own JOIN gone USING (host, line) GROUP BY ALL),
base AS (SELECT d.doc_id, d.host, d.text, len(d.words)::BIGINT AS n_words,
  length(translate(d.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(d.lines) - len(list_distinct(d.lines)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT coalesce(n_words - r.n < {LEAST_LEFT} * n_words, false) AS kept
FROM base LEFT JOIN removed r USING (host, text)
"""
