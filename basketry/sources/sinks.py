"""Sinks: canonical JSON documents, JSON lines, CSV, Markdown, fingerprints and comparison with what is stored."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sha256_of_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build_fingerprint(train: str | Path, lexicons: str | Path, seed: int = 42) -> dict:
    """What a build depends on: the training file's digest, a fold of the lexicons' names and digests, the seed."""
    folded = hashlib.sha256()
    for p in sorted(Path(lexicons).glob("*.json*")):
        folded.update(f"{p.name}:{sha256_of_file(p)}\n".encode())
    return {"train_sha256": sha256_of_file(train), "lexicons_sha256": folded.hexdigest(), "seed": seed}


def table_fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: the sum of row hashes, and the number of rows."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    total, n = df.agg(F.sum(row.cast("decimal(38,0)")), F.count("*")).first()
    return f"{int(total or 0) % (1 << 64):016x}-{n}"


def canonical_json(payload: object, compact: bool = False) -> str:
    style = {"separators": (",", ":")} if compact else {"indent": 2}
    return json.dumps(payload, sort_keys=True, ensure_ascii=False, **style) + "\n"


def write_text_atomically(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_review_queue(queue: DataFrame, path: str) -> None:
    queue.repartitionByRange("decision_id").sortWithinPartitions("decision_id").write.mode("overwrite").json(path)


def write_submission(predictions: DataFrame, path: str, names: tuple[str, str] = ("id", "cuisine")) -> None:
    predictions.toDF(*names).repartitionByRange(names[0]).sortWithinPartitions(names[0]).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A small report's table; rows come from aggregates."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)]) + "\n"


def mismatches(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one of two builds has, with the side that has them."""
    columns = sorted(expected.columns)
    a, b = expected.select(columns), stored.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stored")))
