"""Integrity gates: each is a frame of violations; a runner fails if one has rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    """A gate found violations."""


@dataclass(frozen=True)
class Gate:
    """A frame of violations; where they are those rows of a frame that a condition picks, both are kept too."""

    name: str
    violations: DataFrame
    rows: DataFrame | None = None
    broken: Column | None = None


def of_rows(name: str, rows: DataFrame, broken: Column, *columns: str) -> Gate:
    """The gate that no row is broken; its violations show the given columns."""
    return Gate(name, rows.filter(broken).select(*columns), rows, broken)


def run(gates: Iterable[Gate], show: int = 5) -> list[str]:
    """The names of gates that hold; raises with the first rows of each that doesn't."""
    held, broken = [], []
    for g in gates:
        rows = g.violations.limit(show).collect()
        (broken if rows else held).append(f"{g.name}: {[r.asDict() for r in rows]}" if rows else g.name)
    if broken:
        raise GateError("; ".join(broken))
    return held


def shared_alias(aliases: DataFrame) -> DataFrame:
    """Aliases(id, alias) with more than one owner."""
    return aliases.groupBy("alias").agg(F.count_distinct("id").alias("owners")).filter("owners > 1")


def foreign_name(vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    return vocabulary.select("id", "name").join(aliases.select(F.col("id").alias("other"), F.col("alias").alias("name")), "name").filter("id <> other")


def bad_slug(ids: DataFrame) -> DataFrame:
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter(~F.col("id").rlike("^[a-z0-9][a-z0-9_]*$") | (F.col("n") > 1))


def bad_parent(links: DataFrame) -> DataFrame:
    """links(id, parent_id) whose parent is missing, itself, or has a parent."""
    up = links.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"), F.col("parent_id").alias("above"))
    x = links.filter("parent_id is not null").join(up, "parent_id", "left")
    return x.filter(F.col("there").isNull() | (F.col("id") == F.col("parent_id")) | F.col("above").isNotNull()).select("id", "parent_id")


def uncovered(mentions: DataFrame, aliases: DataFrame, scope: int = 4) -> DataFrame:
    counts = mentions.select("basket_id", "item").distinct().groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= scope)
    return counts.join(aliases.select(F.col("alias").alias("item")).distinct(), "item", "left_anti")


def coverage_below(statistics: DataFrame, methods: Iterable[str], floor: float) -> DataFrame:
    share = F.sum(F.when(F.col("method").isin(list(methods)), F.col("mentions")).otherwise(0)) / F.sum("mentions")
    return statistics.agg(share.alias("coverage")).filter(F.col("coverage") < floor)


def unknown_key(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    return rows.select(column).distinct().join(known.select(F.col(key).alias(column)), column, "left_anti")


def not_ascending(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Rows whose column doesn't rise over the row before, where by counts the rows up one by one."""
    before = rows.select((F.col(by) + 1).alias(by), F.col(column).alias("before"))
    return rows.select(by, column).join(before, by).filter(F.col(column) <= F.col("before")).select(by, column, "before")


def repeated_in_row(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.filter(F.size(F.array_distinct(column)) < F.size(column)).select(key)


def unsorted_in_row(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.filter(F.sort_array(F.array_distinct(column)) != F.col(column)).select(key)


def fold_spread(balance: DataFrame, folds: int = 5) -> DataFrame:
    cells = [f"fold_{i}" for i in range(folds)]
    return balance.withColumn("spread", F.greatest(*cells) - F.least(*cells)).filter("spread > 1").select("label", "spread")


def not_rounded(rows: DataFrame, column: str, digits: int) -> DataFrame:
    x = F.col(column)
    return rows.filter(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")) | (F.round(x, digits) != x))


def share_sum(shares: DataFrame, tolerance: float = 0.002) -> DataFrame:
    return shares.groupBy("basket_id").agg(F.sum("share").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def off_circle(places: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    return places.filter(F.abs(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - 1) > tolerance).select("label")


def wrong_count(rows: DataFrame, expected: int) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).filter(F.col("n") != expected)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two frames has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").union(y.join(x, key, "left_anti"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two frames has, counted as often as they stand."""
    columns = sorted(a.columns)
    return a.select(columns).exceptAll(b.select(columns)).union(b.select(columns).exceptAll(a.select(columns)))


def report(checks: Iterable[Gate]) -> DataFrame:
    """(gate, violations): how many rows each gate holds against its table, in one plan. Gates on rows of one frame are
    counted in one pass over it."""
    checks = list(checks)
    frames = {id(g.rows): g.rows for g in checks if g.rows is not None}
    parts = [g.violations.agg(F.lit(g.name).alias("gate"), F.count("*").alias("violations")) for g in checks if g.rows is None]
    for key, rows in frames.items():
        own = [g for g in checks if g.rows is not None and id(g.rows) == key]
        counts = rows.agg(*(F.count(F.when(g.broken, 1)).alias(f"n{k}") for k, g in enumerate(own)))
        pairs = F.array(*(F.struct(F.lit(g.name).alias("gate"), F.col(f"n{k}").alias("violations")) for k, g in enumerate(own)))
        parts.append(counts.select(F.inline(pairs)))
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return out
