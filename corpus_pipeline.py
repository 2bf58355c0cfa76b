"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a frame that run() writes as
Parquet and reads again for the next one.

Odd rows: quality rules reject null, empty and short texts (fewer than 50 words), so later stages meet none unless they
are called by themselves; they keep a null text as it is. Rows with a null id are nobody's near-duplicate and stay;
rows alike in id and text are one document and go the same way. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontam, fuzzy_lines, line_quality, near_dup, packing
from basketry.llm.runtime import drop_materialised, materialise, table

#: Near-duplicates of the pipeline share 80 % of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _like(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of docs, with the new text and its length."""
    length = F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))
    return changed.select(*(F.col(text).alias("text") if c == "text" else length.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their hosts' boilerplate lines."""
    return _like(docs, line_quality.judge(docs).filter("kept"), "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one that has no line left goes, and its lines are all in others."""
    out = fuzzy_lines.dedup_lines(docs)
    return _like(docs, out.filter((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0)), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id."""
    verdict = near_dup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY).filter(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(verdict, docs["doc_id"] == verdict["_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in windows of the benchmark."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["_id"], "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_materialised(spark, docs)  # what the stage wrote on its way
    return docs


#: SQL can't express the similarity joins, ids and packing; the stages are tested against brute force.
ORACLE_SQL = None
