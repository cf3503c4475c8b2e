"""Equi-joins of growing tables, and of rows with per-key facts where one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.plans.durable import plan_bytes

#: A key is hot if it holds at least one row in HOT_SHARE: there are at most HOT_SHARE such keys, whatever the input.
HOT_SHARE = 1000

#: Spark's spark.shuffle.sort.bypassMergeThreshold: a shuffle into so many partitions writes rows as they come.
BYPASS = 200


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, and so is never broadcast.

    Catalyst takes a table for as large as its file, which is compressed, and knows nothing of exploded rows: what it holds
    to be 10 MB may be a gigabyte in the driver and in each task. A sort-merge join spills, and its skewed partitions are
    split by the adaptive planner. The hint goes through projections, filters and aggregations up to the next join.
    """
    return df.hint("merge")


def spread(df: DataFrame, keys: Sequence[str], bytes_each: int = 1 << 20) -> DataFrame:
    """``df`` dealt over more tasks where its scan has few, for what is about to be exploded.

    A row group is read by one task, however many rows it holds and bytes the file is split at, and a shuffle into more than BYPASS partitions keeps the task's
    output in memory. Dealing out at most so many parts keeps nothing. Small tables, and plans with a shuffle, stay as they are.
    """
    size, run = plan_bytes(df), df._jdf.queryExecution()
    parts = min(BYPASS, size // bytes_each + 1)
    if parts == 1 or size > 1 << 50 or run.executedPlan().nodeName() == "AdaptiveSparkPlan" or run.toRdd().getNumPartitions() >= parts:
        return df
    return df.repartition(parts, *keys)


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], payload: Sequence[str], size: str, spread: Column, total: int
) -> DataFrame:
    """Left join ``rows`` with ``facts`` (unique by ``keys``), adding the columns ``payload``.

    ``size`` names the column of ``facts`` with the key's number of rows, ``total`` is the number of all rows. Keys with
    ``size * HOT_SHARE >= total`` are broadcast (at most HOT_SHARE of them exist); rows of such keys take the hash of
    ``spread`` into the shuffle of the second join, so no task receives a hot key.
    ``facts`` should be materialised (``durable``): it is read twice. Null keys match nothing.
    """
    hot = facts.where(F.col(size) * HOT_SHARE >= F.lit(total))
    cold = facts.where(F.col(size) * HOT_SHARE < F.lit(total))
    names = [f"__k{i}" for i in range(len(keys))]

    def side(df: DataFrame, out: str) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.struct(*payload).alias(out))

    h = F.broadcast(side(hot, "__hot"))
    joined = rows.join(h, [rows[k] == h[n] for k, n in zip(keys, names)], "left").drop(*names)
    joined = joined.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1))))
    c = side(cold, "__cold").withColumn("__csalt", F.lit(0).cast("long"))
    joined = joined.join(c, [joined[k] == c[n] for k, n in zip(keys, names)] + [joined["__salt"] == c["__csalt"]], "left")
    joined = joined.drop(*names, "__csalt", "__salt")
    value = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[value[p].alias(p) for p in payload])
