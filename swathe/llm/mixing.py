"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathe.plans.durable import durable
from swathe.plans.skew import join_facts

#: Rows of a source among which one fractional repetition is dealt out; also bounds the rows of one window.
STRATUM = 256
#: Seeded starts that a stratum tries; the one whose words come nearest to the fraction stays.
STARTS = 8


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Adds target to one row per source (ord, size, n): shares of the total size by weight, none above ``max_epochs`` sizes.

    Clamping and handing on the excess by weight until none is above ends at min(cap, level * weight) for one level, which
    is found by prefix sums over the sources in the order of cap/weight. The table has one row per source, not per document.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("size"))
    run = Window.orderBy(F.col("cap") / F.col("w"), "ord")
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("size").over(everything).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    )
    # the first source that its own level does not clamp sets the level of all that follow
    s = s.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "ord", "level"))).over(everything)["level"])
    return s.withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w")))).drop(
        "total", "cap_before", "w_left", "level", "final", "w", "cap"
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, copies.

    Sources, ordered by code point with null last, get the ``weights`` in turn. Each document is taken whole floor(r)
    times, r = target / source_size, and the fractional repetition takes one more copy of a share of the documents:
    inside seeded strata of a source the documents are ordered by size and every (1/fraction)-th is taken, from that
    one of a few seeded starts whose words come nearest to the fraction. The strata keep a hot source off one task.

    Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, last. Rows that
    repeat an id are rows of their own (and drawn alike). An empty table gives an empty result. Reruns agree.
    """
    base = durable(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n")).alias("skey"),
            n_words(F.col(f"`{text_col}`")).alias("size"),
        )
    )
    per = base.groupBy("source", "skey").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    per = per.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = durable(water_fill(per, weights, max_epochs).withColumnRenamed("size", "source_size"))
    total = base.count()
    rows = join_facts(base, per, ["skey"], ["source_size", "target", "n"], "n", F.col("id"), total)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    h = _hash32(F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = (
        rows.withColumn("h", h)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("frac", ratio - F.floor(ratio))
        .withColumn("strata", F.floor((F.col("n") + STRATUM - 1) / STRATUM).cast("long"))
        .withColumn("stratum", F.col("h") % F.col("strata"))
    )
    cell = Window.partitionBy("skey", "stratum")
    rows = rows.withColumn("rank", F.row_number().over(cell.orderBy(F.col("size").desc(), "h", "id")))
    start = [(F.lit(float(j)) + _hash32(F.lit(str(seed)), F.col("skey"), F.col("stratum").cast("string")) / F.lit(2.0**32)) / STARTS for j in range(STARTS)]
    flag = [(F.floor(F.col("frac") * F.col("rank") + u) - F.floor(F.col("frac") * (F.col("rank") - 1) + u)).cast("long") for u in start]
    whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", *[f.alias(f"f{j}") for j, f in enumerate(flag)])
    rows = rows.select("*", (F.sum("size").over(whole) * F.col("frac")).alias("want"), *[F.sum(F.col("size") * F.col(f"f{j}")).over(whole).alias(f"g{j}") for j in range(STARTS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"g{j}") - F.col("want")).alias("e"), F.lit(j).alias("j"), F.col(f"f{j}").alias("f")) for j in range(STARTS)]))
    copies = F.col("whole") + best["f"]
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(table: str = "documents") -> str:
    """The same mix as DuckDB SQL over ``table``, with a column copies."""
    h = "CAST('0x' || substr(md5('7|' || {0}), 1, 8) AS BIGINT)"
    u = f"({{0}} + {h.format("skey || '|' || CAST(stratum AS VARCHAR)")} / 4294967296.0::DOUBLE) / {STARTS}"
    f = "CAST(floor(frac * rank + {0}) - floor(frac * (rank - 1) + {0}) AS BIGINT)"
    flags = ", ".join(f"{f.format(u.format(f'{j}.0::DOUBLE'))} AS f{j}" for j in range(STARTS))
    sums = ", ".join(f"CAST(sum(size * f{j}) OVER w AS BIGINT) AS g{j}" for j in range(STARTS))
    best = "list_min([" + ", ".join(f"{{'e': abs(g{j} - want), 'j': {j}, 'f': f{j}}}" for j in range(STARTS)) + "]).f"
    return rf"""
WITH b AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
p AS (SELECT source, skey, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM b GROUP BY source, skey),
c AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT skey, source_size, n, least(cap, (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, ord LIMIT 1) * w) AS target FROM l),
r AS (SELECT b.doc_id, b.skey, b.size, source_size, target, n, {h.format("CAST(doc_id AS VARCHAR)")} AS h,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM b JOIN t USING (skey)),
s AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS frac, h % ((n + {STRATUM - 1}) // {STRATUM}) AS stratum FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY skey, stratum ORDER BY size DESC, h, doc_id) AS rank FROM s),
f AS (SELECT *, {flags} FROM k),
g AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) * frac AS want, {sums} FROM f WINDOW w AS (PARTITION BY skey, stratum)),
z AS (SELECT *, whole + {best} AS copies FROM g)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM z
"""


OP3_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql()}) AS mixed"
