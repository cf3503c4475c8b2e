"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.plans.durable import durable
from swathe.plans.skew import join_facts

#: Code points of the normalised text that the second level hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without the characters U+0020 and U+0009 to U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full_digest: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept (and text_sha256 if ``full_digest``).

    ``row_col`` names a number that tells rows of one id apart: it breaks ties, ``kept`` goes by it instead of the id, and
    it is returned as well. It needs ``full_digest``.

    Level 1 and 2 are one aggregation over (byte length, prefix hash) of the normalised text: a row that is alone with
    its length is alone with the pair too. Only rows whose pair repeats go on to level 3, the SHA-256 of the whole
    normalised text. Without ``full_digest`` the contents are read again for those rows alone; with it the digest of
    every row is asked for anyway, so one scan yields all three levels and the texts are never read twice.

    Of equal texts the row with most code points in its original text stays, then the smallest id, a null id last.
    Null text counts as empty and equals every text of white space only. Rows that repeat an id are rows of their own:
    each is counted, and with equal texts they share ``kept``. An empty table gives an empty result. Further columns of
    any name are ignored. Hot groups: counts are combined in the map tasks, and ``join_facts`` spreads a hot group's rows.
    """
    if row_col and not full_digest:
        raise ValueError("row_col needs full_digest")
    norm = normalised(F.col(f"`{text_col}`"))
    row = [F.col(f"`{row_col}`").alias("__row")] if row_col else []
    cols = [
        *row,
        F.col(f"`{id_col}`").alias("__id"),
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__points"),
        F.octet_length(norm).alias("__bytes"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("__prefix"),
    ]
    sketch = durable(docs.select(*cols, *([F.sha2(norm, 256).alias("__sha")] if full_digest else [])))
    total = sketch.count()
    pairs = durable(sketch.groupBy("__bytes", "__prefix").agg(F.count("*").alias("__n")).where("__n > 1"))
    seen = join_facts(sketch, pairs, ["__bytes", "__prefix"], ["__n"], "__n", F.col("__id"), total)
    if full_digest:
        survivors = seen.where("__n is not null").select("__id", "__points", "__sha", *(["__row"] if row else []))
    else:
        ids = seen.where("__n is not null").select("__id", "__bytes", "__prefix").distinct()
        text = docs.select(*cols, F.col(f"`{text_col}`").alias("__text"))
        same = [text["__id"].eqNullSafe(ids["__id"]), text["__bytes"] == ids["__bytes"], text["__prefix"] == ids["__prefix"]]
        survivors = durable(text.join(ids, same, "left_semi").select("__id", "__points", F.sha2(normalised(F.col("__text")), 256).alias("__sha")))
    order = F.struct("__points", F.col("__id").isNotNull(), F.bitwise_not("__id"), *([F.bitwise_not("__row")] if row else []))
    best = [F.max_by("__id", order).alias("keep_id"), *([F.max_by("__row", order).alias("keep_row")] if row else [])]
    groups = durable(survivors.groupBy("__sha").agg(F.count("*").alias("group_size"), *best).where("group_size > 1"))
    if full_digest:
        out = join_facts(sketch, groups, ["__sha"], ["keep_id", "group_size", *(["keep_row"] if row else [])], "group_size", F.col("__row" if row else "__id"), total)
    else:
        found = join_facts(survivors, groups, ["__sha"], ["keep_id", "group_size"], "group_size", F.col("__id"), total)
        alone = seen.where("__n is null").select("__id", *[F.lit(None).cast("long").alias(c) for c in ("keep_id", "group_size")])
        out = alone.unionByName(found.select("__id", "keep_id", "group_size"))
    grouped = F.col("group_size").isNotNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("__id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("keep_row") == F.col("__row") if row else F.col("keep_id").eqNullSafe(F.col("__id")))).alias("kept"),
        *([F.col("__sha").alias("text_sha256")] if full_digest else []),
        *([F.col("__row").alias(row_col)] if row else []),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, full_digest=True)


OP1_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS s FROM n),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY points DESC, doc_id) AS keep_id,
      count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, keep_id = doc_id AS kept, s AS text_sha256 FROM k
"""
