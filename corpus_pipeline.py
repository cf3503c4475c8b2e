"""A corpus from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.exact_dedup import exact_dedup
from swathe.llm.mixing import mix_sources
from swathe.llm.packing import pack_documents
from swathe.llm.simhash import near_duplicates
from swathe.llm.toxicity import fit_toxicity, flag_toxic, score_toxicity
from swathe.plans.durable import ensure_checkpoint_dir, remove


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit hash of all columns, and its name: rows that repeat an id differ in it unless they are the same."""
    row = _free(docs, "__row")
    cols = [docs[f"`{c}`"] for c in docs.columns]
    return docs.withColumn(row, F.xxhash64(*cols, *[c.isNull() for c in cols])), row


def _only(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """Rows of ``docs``, as from ``_keyed``, whose key is among ``rows``; of equal rows one."""
    return docs.join(rows.select(row), row, "left_semi").dropDuplicates([row]).drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold of their language; learns from a bounded sample of ``labels``."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    score = _free(docs, "__score")
    scored = score_toxicity(docs, model, tuple(docs.columns), score)
    return scored.where(~flag_toxic(model, score=score)).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, also of those that share an id or have none."""
    docs, row = _keyed(docs)
    return _only(docs, row, exact_dedup(docs.select("doc_id", "text", row), full_digest=True, row_col=row).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays,
    a null id last; ids may repeat."""
    docs, row = _keyed(docs)
    groups = near_duplicates(docs.select(row, "text"), id_col=row).join(docs.select(row, "doc_id").distinct(), row)
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row))
    return _only(docs, row, groups.groupBy("component_id").agg(first.alias(row)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those that it doesn't take go. Equal rows are taken alike."""
    keyed, row = _keyed(docs)
    copies = _free(keyed, "__copies")
    taken = mix_sources(keyed.select(row, "text", "source"), id_col=row).groupBy(row).agg(F.max("copies").alias(copies)).where(f"{copies} > 0")
    rows = keyed.join(taken, row).withColumn(_free(keyed, "__copy"), F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; every id of every document lies in one piece."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("packing", pack)]

#: The classifier has no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next. A stage's
    folder goes when the next one's is written; the last is read by the result and stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
