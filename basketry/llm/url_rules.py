"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, partitions, prepare, table

#: (verdict, host, path) of the rules that the query applies; fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE_PER_PARTITION = 64


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: F.Column) -> F.Column:
    """The host's labels reversed, each ended by a dot: a host and all its subdomains share a prefix, so they form an interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, key and kind (rules first). The stack holds one frame for each host that has rules and
    whose interval covers the current key; a frame has its paths, and their lengths, longest first."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []
    part, last = None, None
    for batch in batches:
        cols = batch.to_pydict()
        out: dict[str, list] = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
        for p, key, host, path, verdict, page in zip(cols["part"], cols["key"], cols["host"], cols["path"], cols["verdict"], cols["page_id"], strict=True):
            if p != part:
                part, last, stack = p, None, []
            if key != last:
                last = key
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
            if verdict is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                if path not in paths:
                    paths[path] = f"{host}{path}", verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                elif paths[path][1] == "allow":  # the same rule twice: block wins
                    paths[path] = f"{host}{path}", verdict
                continue
            best, found = None, None
            for k, (prefix, paths, lengths) in enumerate(stack):
                for n in lengths:
                    if n <= len(path) and (hit := paths.get(path[:n])):
                        rank = (len(prefix) + n, k)
                        if best is None or rank > best:
                            best, found = rank, hit
                        break
            out["page_id"].append(page)
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(found[0] if found else None)
            out["verdict"].append(found[1] if found else "allow")
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", batch.schema.field("page_id").type), *((k, pa.string()) for k in ("host", "path", "rule", "verdict"))]))


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The longest rule of rules(host, path, verdict) that fits each url of pages.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest host and path
    together win, then the longer host. Urls and rules are sorted by reversed-host key in ranges between sampled
    splitters, and a sweep keeps a stack of the rules whose interval is open. Splitters carry a hash of the id after
    the key, so that a url or host with a third of all rows is spread over several ranges. A rule opens in its own
    range and in each later range whose first key still lies in its interval, which that key's prefixes tell.
    Null urls, and those without ://, have empty host and path and fit no rule but one of an empty host; without a
    rule the verdict is allow. Repeated rows stay; null ids are allowed; other columns of pages are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"key": host_key(F.col("host")), "salt": F.expr("xxhash64(page_id, path) & 65535L").cast("int")})
    urls = materialise(urls, "urls")
    parts = max(2, partitions(spark))
    n = urls.count()
    drawn = urls.filter(F.expr("(xxhash64(page_id, host, path) & 1073741823) / 1073741824.0D") < F.lit(parts * SAMPLE_PER_PARTITION / max(n, 1))).select("key", "salt").collect()
    drawn = sorted((r[0], r[1]) for r in drawn)  # about SAMPLE_PER_PARTITION for each part
    cuts = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []

    keys = np.array([f"{k}\0{s:05d}" for k, s in cuts], dtype=object)

    def part_of(batches):
        for b in batches:
            probe = np.array([f"{k}\0{s:05d}" for k, s in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)], dtype=object)
            yield b.append_column("part", pa.array(np.searchsorted(keys, probe, side="right").astype("int32")))

    urls = urls.mapInArrow(part_of, "page_id " + dict(urls.dtypes)["page_id"] + ", host string, path string, key string, salt int, part int")
    rules = rules.select(F.lit(None).cast(dict(urls.dtypes)["page_id"]).alias("page_id"), "host", "path", host_key(F.col("host")).alias("key"), F.lit(-1).alias("salt"), "verdict")
    starts = [(i + 1, k[:j]) for i, (k, _) in enumerate(cuts) for j in range(1, len(k) + 1) if k[j - 1] == "."]
    opened = spark.createDataFrame(starts, "part int, prefix string")  # as many rows as labels in the cuts
    again = rules.join(opened, rules["key"] == opened["prefix"]).drop("prefix")
    own = rules.mapInArrow(lambda it: part_of(it), "page_id " + dict(urls.dtypes)["page_id"] + ", host string, path string, key string, salt int, verdict string, part int")
    columns = ["part", "key", "salt", "page_id", "host", "path", "verdict"]
    rules_rows = own.select(columns).unionByName(again.select(columns)).distinct()
    both = urls.withColumn("verdict", F.lit(None).cast("string")).select(columns).unionByName(rules_rows)
    swept = both.repartitionById(parts, "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path")
    return swept.mapInArrow(_sweep, "page_id " + dict(urls.dtypes)["page_id"] + ", host string, path string, rule string, verdict string")


def query(spark, sf_dir):
    rules = spark.createDataFrame([(h, p, v) for v, h, p in RULES], "host string, path string, verdict string")
    return apply_rules(table(spark, sf_dir, "pages"), rules)


_CASES = "\n".join(f"      UNION ALL SELECT '{v}', '{h}', '{p}'" for v, h, p in RULES[1:])
SQL = f"""
WITH rules AS (SELECT '{RULES[0][0]}' AS verdict, '{RULES[0][1]}' AS host, '{RULES[0][2]}' AS path
{_CASES}),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
