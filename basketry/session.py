"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of input whose rows meet in one task, and what Spark gives as the size of a frame that it knows nothing of.
TASK_BYTES, UNKNOWN = 16 << 20, 1 << 60


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("basketry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """The frame dealt by key to as many tasks as its stored input asks for, so that what a task holds doesn't grow with
    the input; as it is where the session's shuffles have that many anyway."""
    n = tasks(df)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, key)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The frame dealt by key, to as many tasks as spread() would or the session's shuffles have."""
    return df.repartition(max(tasks(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def counted(df: DataFrame) -> DataFrame:
    """The frame cached and worked out, so that Spark knows its size and sends a small one to the rows of a large one."""
    df = df.cache()
    df.count()
    return df


def tasks(df: DataFrame) -> int:
    """The tasks that the stored input of a frame asks for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return -(-sum(x for x in sizes if x < UNKNOWN) // TASK_BYTES)
