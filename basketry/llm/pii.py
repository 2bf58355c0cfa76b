"""Personal data: patterns, and terms that disclose them by how often they stand beside them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, numbered, table

#: Patterns of the kinds, leftmost and non-overlapping. A match can begin only where a run of its first class begins or
#: where the match before ended, which the look-behinds say so that long runs are read once; runs are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to have for the kind to be looked for.
HINTS = {"email": "@", "phone": "+"}
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]{3,}"
#: ... and no part of a longer run that reaches into a span, in a text whose spans are each one NUL.
FREE_TERM = r"(?<![\p{L}\p{N}\x00])[\p{L}\p{N}]{3,}+(?!\x00)"
#: Terms in more than this share of the texts are set aside before texts are joined with telling terms (unless they tell).
HOT_SHARE = 0.01
#: Terms on each side of an entity, and the characters they are looked for in.
SIDE_TERMS, SIDE_CHARS = 3, 80
#: A term discloses an entity when it tells this share of the entity's information content, seen in so many distinct texts.
DISCLOSURE, MIN_TEXTS = 0.8, 3
#: Above this share a term is removed, below it is replaced by a general word.
REMOVAL = 0.95
_SPAN = "array<struct<start:int,end:int,value:string>>"
_TERMS = "array<struct<start:int,end:int,share:double>>"
_LAST_ID = (1 << 63) - 1


def _matches(text, pattern: str):
    """Spans (start, end in code points, value) of a pattern: the lengths of what lies between matches, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
    both = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def add(acc, x):
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    return F.aggregate(both, start, add, lambda acc: acc["out"])


def _luhn(value):
    digits = F.split(F.reverse(F.regexp_replace(value, r"[\x20-]", "")), "")

    def weigh(acc, d):
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((acc["sum"] + F.when(acc["even"], twice).otherwise(n)).alias("sum"), (~acc["even"]).alias("even"))

    return F.aggregate(F.filter(digits, lambda d: d != ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even")), weigh, lambda acc: acc["sum"] % 10 == 0)


_VALID = {
    "email": None,
    "ip": lambda v: v.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"),
    "card": _luhn,
    "phone": lambda v: F.length(F.regexp_replace(v, r"[^0-9]", "")).between(8, 15),
}


def base_spans(text, kind: str):
    """Spans of one kind in a text column (no nulls)."""
    spans = _matches(text, PATTERNS[kind])
    if kind in HINTS:
        spans = F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    elif kind == "card":
        spans = F.when(text.rlike(PATTERNS[kind]), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    valid = _VALID[kind]
    return F.filter(spans, lambda s: valid(s["value"])) if valid else spans


def _side_terms(text, spans, left: bool):
    """For each span the terms beside it: (start, end, value) in the text, none cut by the window and none in a span."""

    def around(s):
        begin = F.greatest(s["start"] - SIDE_CHARS, F.lit(0)) if left else s["end"]
        piece = F.substring(text, begin + 1, s["start"] - begin) if left else F.substring(text, begin + 1, F.lit(SIDE_CHARS))
        size = F.length(piece)
        terms = _matches(piece, TERM)
        terms = F.filter(terms, lambda t: ((t["start"] > 0) | (begin == 0)) if left else ((t["end"] < size) | (size < SIDE_CHARS)))
        terms = F.transform(terms, lambda t: F.struct((t["start"] + begin).alias("start"), (t["end"] + begin).alias("end"), F.lower(t["value"]).alias("value")))
        terms = F.filter(terms, lambda t: ~F.exists(spans, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))
        return F.slice(terms, F.greatest(F.size(terms) - SIDE_TERMS + 1, F.lit(1)), SIDE_TERMS) if left else F.slice(terms, 1, SIDE_TERMS)

    return around


def _entity(kind, value):
    return F.concat(kind, F.lit(":"), F.lower(F.regexp_replace(value, r"[\x20()-]", "")))


def _tagged(kind: str):
    return F.transform(kind, lambda s: F.struct(_entity(F.lit(kind), s["value"]).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))


def _marked(kind: str):
    by = (lambda s: F.when(s["share"] >= REMOVAL, F.lit("")).otherwise(F.lit("[TERM]"))) if kind == "term" else (lambda s: F.lit(f"[{kind.upper()}]"))
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by")))


def _replaced(text, marks):
    """The text with each mark (start, end, by) replaced; of overlapping ones the first that begins counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(out).alias("out"))

    return F.aggregate(F.array_sort(marks), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _digest_of(text, kinds):
    """SHA-256 of the text with the spans of these columns replaced."""
    marks = F.concat(*map(_marked, kinds))
    return F.sha2(F.when(F.size(marks) > 0, _replaced(text, marks)).otherwise(text), 256)


def _blanked(text, spans):
    """The text with each span replaced by a NUL."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("\0"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(cut).alias("out"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _occurrences(text, shares):
    """Spans (start, end, share) of the terms of a text that are keys of the map shares."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    both = F.zip_with(found, F.slice(F.split(text, TERM, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_TERMS})").alias("out"))

    def add(acc, x):
        begin, share = acc["at"] + x["g"], F.try_element_at(shares, F.lower(x["m"]))
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.when(share.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), share.alias("share"))))).alias("out"))

    return F.aggregate(both, start, add, lambda acc: acc["out"])


def _find_in_whole_texts(rows: DataFrame, found: DataFrame, disclosure: float, min_texts: int) -> DataFrame:
    """What find() gives with whole_texts.

    A text's entities and terms are paired only for entities in min_texts texts or more, as no other can reach n(t,e),
    and pairs are added up before the exchange.
    """
    entities = F.array_distinct(F.transform("tagged", lambda s: s["entity"]))
    free = F.array_distinct(F.regexp_extract_all(F.lower(_blanked(F.col("text"), F.col("spans"))), F.lit(FREE_TERM), F.lit(0)))
    found = found.withColumns({"entities": entities, "plain": _digest_of(F.col("text"), KINDS)})
    found = materialise(found.select("doc_id", "id", "tie", *KINDS, "plain", "entities", F.when(F.size("entities") > 0, free).alias("terms")), "pii-base")
    total = found.select("tie").distinct().agg(F.count("*").alias("total"))  # one row
    holders = materialise(found.filter(F.size("entities") > 0).groupBy("tie").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "pii-holders")
    held = holders.select("tie", F.explode("entities").alias("entity"))
    frequent = materialise(held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= min_texts), "pii-entities")
    own = held.join(frequent, "entity").groupBy("tie").agg(F.collect_list("entity").alias("entities"))
    pairs = holders.select("tie", "terms").join(own, "tie").select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= min_texts)
    joint = materialise(joint.join(frequent, "entity"), "pii-joint")
    # Each of a text's c copies counts 1 / c, so that terms are added up before the exchange and no (term, text) pair is sent.
    copies = materialise(found.groupBy("tie").agg(F.count("*").alias("c")).filter("c > 1"), "pii-copies")
    terms = rows.select("tie", "text").join(copies, "tie", "left").select(F.lit(1.0) / F.coalesce("c", F.lit(1)), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))))).toDF("part", "term")
    counts = terms.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t")).filter(F.col("n_t") >= min_texts)
    counts = materialise(counts.join(F.broadcast(total)), "pii-terms")
    share = F.try_divide(F.log(F.col("total") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))), F.log(F.col("total") / F.col("n_e")))
    scored = joint.join(counts, "term").withColumn("share", share).filter(F.col("share") >= disclosure)
    telling = materialise(scored.groupBy("term").agg(F.max("share").alias("share")), "pii-telling")
    # At most 1 / HOT_SHARE times the terms of a text, however many texts there are.
    hot = counts.filter(F.col("n_t") > F.col("total") * HOT_SHARE).select("term").join(telling.select("term"), "term", "left_anti")
    standing = rows.select("id", "tie", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).join(F.broadcast(hot), "term", "left_anti")
    shares = standing.join(telling, "term").groupBy("id", "tie").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares"))
    told = rows.select("id", "tie", "text").join(shares, ["id", "tie"]).withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    base = F.concat(*KINDS)
    free = F.filter("all", lambda t: ~F.exists(base, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))
    told = told.withColumn("all", _occurrences(F.col("text"), F.col("shares"))).withColumn("term", free)
    told = told.select("id", "tie", "term", _digest_of(F.col("text"), (*KINDS, "term")).alias("told")).groupBy("id", "tie").agg(F.first("term").alias("term"), F.first("told").alias("told"))
    out = found.drop("entities", "terms").join(told, ["id", "tie"], "left")
    return out.withColumns({"term": F.coalesce("term", F.expr(f"cast(array() as {_TERMS})")), "sanitised_sha256": F.coalesce("told", "plain")}).drop("told", "plain")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS, whole_texts: bool = False) -> DataFrame:
    """One row for each of docs: id, tie, the spans of each kind, and term spans with the share of information they disclose.

    Protected entities are the values of the base kinds. A term is a run of three or more letters or digits. Over the
    whole corpus, N is the number of distinct texts, n(e) those with entity e, n(t) those with term t, n(t,e) those
    where t stands beside e (SIDE_TERMS on each side). Pointwise mutual information log(N n(t,e) / (n(t) n(e))) over the
    entity's information content log(N / n(e)) is the share of e that t discloses. Where it reaches the threshold, with
    min_texts texts at least, the term beside that entity is a span too. Equal texts count once in all counts.

    With whole_texts, as in the registered query and in sanitise(), n(t,e) counts the texts with e that have t
    anywhere outside the base spans, and each occurrence of a telling term is a span, in texts without the entity too;
    sanitised_sha256 is the digest of the text that sanitise() gives.

    Counting is partial before each exchange. Null texts are empty; null ids stay null; repeated rows get equal results; an empty table gives no
    rows; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found = rows.withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    all_spans = F.concat(*KINDS)
    tagged = F.concat(*map(_tagged, KINDS))
    found = found.withColumns({"spans": all_spans, "tagged": tagged})
    if whole_texts:
        return _find_in_whole_texts(rows, found, disclosure, min_texts)
    left, right = _side_terms(F.col("text"), F.col("spans"), True), _side_terms(F.col("text"), F.col("spans"), False)
    beside = F.transform("tagged", lambda s: F.struct(s["entity"].alias("entity"), F.concat(left(s), right(s)).alias("terms")))
    found = materialise(found.select("doc_id", "id", "tie", *KINDS, beside.alias("beside")), "pii-base")
    pairs = found.filter(F.size("beside") > 0).select("id", "tie", F.explode("beside").alias("b")).select("id", "tie", "b.entity", F.explode_outer("b.terms").alias("t"))
    pairs = pairs.select("id", "tie", "entity", F.col("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    entities = pairs.select("entity", "tie").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = pairs.filter("term is not null").select("entity", "term", "tie").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= min_texts)
    total = F.broadcast(found.select("tie").distinct().agg(F.count("*").alias("total")))  # one row
    beside_any = pairs.filter("term is not null").select("term", "tie").distinct().groupBy("term").agg(F.count("*").alias("at_least"))
    # Texts with the term beside any entity are no more than n(t); where they are too many already, the share can't be reached.
    most = F.col("n_te") * F.pow(F.col("total") / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    joint = joint.join(beside_any, "term").join(entities, "entity").join(total).filter(F.col("at_least") <= most)
    joint = materialise(joint.select("entity", "term", "n_te", "n_e", "total"), "pii-joint")
    # Each of a text's c copies counts 1 / c, so that terms are added up before the exchange and no (term, text) pair is sent.
    copies = materialise(found.groupBy("tie").agg(F.count("*").alias("c")).filter("c > 1"), "pii-copies")
    terms = rows.select("tie", "text").join(copies, "tie", "left").select(F.lit(1.0) / F.coalesce("c", F.lit(1)), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))))).toDF("part", "term")
    counts = terms.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t"))
    scored = joint.join(counts, "term")
    share = F.try_divide(F.log(F.col("total") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))), F.log(F.col("total") / F.col("n_e")))
    telling = scored.withColumn("share", share).filter(F.col("share") >= disclosure).select("entity", "term", "share")
    spans = pairs.join(telling, ["entity", "term"]).groupBy("id", "tie", "start", "end").agg(F.max("share").alias("share"))
    spans = spans.groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("term"))
    out = found.drop("beside").join(spans, ["id", "tie"], "left")
    return out.withColumn("term", F.coalesce("term", F.expr("cast(array() as array<struct<start:int,end:int,share:double>>)")))


def digest(found: DataFrame) -> DataFrame:
    def listed(kind):
        return F.transform(kind, lambda s: F.concat(F.lit(kind), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    base = F.array_join(F.concat(*(listed(k) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(listed(k) for k in (*KINDS, "term"))), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), sum(F.size(k) for k in KINDS).cast("long").alias("n_base"), F.size("term").cast("long").alias("n_term"), *([F.col("sanitised_sha256")] if "sanitised_sha256" in found.columns else []))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with each base span replaced by its kind in brackets, telling terms by [TERM] or, above REMOVAL, by nothing."""
    docs, own = numbered(docs)
    at, id_col, text_col = text_col, own[id_col], own[text_col]
    found = find(docs, id_col, text_col, **{"whole_texts": True, **limits})
    marks = F.concat(*map(_marked, (*KINDS, "term")))
    found = found.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.array_sort(marks).alias("_marks")).dropDuplicates(["_id", "_tie"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)), "_tie": F.xxhash64(text)}).join(found, ["_id", "_tie"])
    clean = _replaced(text, F.col("_marks"))
    clean = F.when(F.col(text_col).isNotNull(), clean)
    return out.select(*((clean if c == at else F.col(n)).alias(c) for c, n in own.items()))


def query(spark, sf_dir):
    return digest(find(table(spark, sf_dir, "documents"), whole_texts=True))
