"""Stored artifacts: tables and small documents of a tier in one folder, each tier with the build block it came from.

A table is Parquet; frames that an asset consists of are tables too, its constants a JSON document. Folders may be on
any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sinks import canonical_json, table_fingerprint

BUILD = "build"
#: Tables of each tier.
SILVER = ("vocabulary", "baskets_train", "baskets_test", "taxonomy")
GOLD = ("space", "rows_train", "rows_test", "folds", "fold_balance")
MODEL = ("coefficients", "intercepts", "blends", "folds_evaluated", "mean", "per_label", "confusion_pairs", "reliability_before", "reliability_after")
APP = ("ingredients", "cuisines", "edges", "contract_vectors", "asset_coefficients", "asset_intercepts", "asset_features")


class ArtifactError(ValueError):
    """An artifact is missing or can't be read."""


@dataclass(frozen=True)
class SilverInputs:
    vocabulary: DataFrame
    baskets_train: DataFrame
    baskets_test: DataFrame
    taxonomy: DataFrame


@dataclass(frozen=True)
class GoldInputs:
    space: DataFrame
    rows_train: DataFrame
    rows_test: DataFrame
    folds: DataFrame
    taxonomy: DataFrame


@dataclass(frozen=True)
class AppInputs:
    coefficients: DataFrame
    intercepts: DataFrame
    space: DataFrame
    per_label: DataFrame
    vocabulary: DataFrame
    taxonomy: DataFrame
    constants: dict


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_document(spark: SparkSession, payload: object, path: str) -> None:
    """A small JSON document, written beside its place and moved there."""
    fs, at = _filesystem(spark, path)
    _, beside = _filesystem(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(canonical_json(payload).encode())
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise ArtifactError(f"{path} can't be replaced")


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON document; the session's file systems hold it."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        raise ArtifactError(f"{path} is missing")
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ArtifactError(f"{path}: {e}") from e


_assets: dict[str, dict] = {}


def fetch_asset(spark: SparkSession, path: str) -> dict:
    """A document that is read once; a failed read isn't remembered."""
    if path not in _assets:
        _assets[path] = read_document(spark, path)
    return _assets[path]


def write_tables(folder: str, tables: dict[str, DataFrame], build: dict) -> None:
    """Tables of a tier and their build block, which is written last: a folder without one isn't finished."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    write_document(spark, build, f"{folder}/{BUILD}.json")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    fs, at = _filesystem(spark, f"{folder}/{name}")
    if not fs.exists(at):
        raise ArtifactError(f"{folder}/{name} is missing")
    return spark.read.parquet(f"{folder}/{name}")


def load_silver_inputs(spark: SparkSession, silver: str) -> SilverInputs:
    return SilverInputs(*(read_table(spark, silver, x) for x in SILVER))


def load_gold_model_inputs(spark: SparkSession, gold: str, silver: str) -> GoldInputs:
    return GoldInputs(*(read_table(spark, gold, x) for x in GOLD[:4]), read_table(spark, silver, "taxonomy"))


def load_app_export_inputs(spark: SparkSession, trained: str, gold: str, silver: str) -> AppInputs:
    tables = [read_table(spark, trained, "coefficients"), read_table(spark, trained, "intercepts"), read_table(spark, gold, "space"), read_table(spark, trained, "per_label")]
    return AppInputs(*tables, read_table(spark, silver, "vocabulary"), read_table(spark, silver, "taxonomy"), read_document(spark, f"{trained}/constants.json"))


def fingerprint(tables: dict[str, DataFrame], **constants: object) -> dict:
    """A build block: a digest of each input table whatever its order, and the constants that the build depends on."""
    return {f"{k}_sha256": hashlib.sha256(table_fingerprint(df).encode()).hexdigest() for k, df in sorted(tables.items())} | constants
