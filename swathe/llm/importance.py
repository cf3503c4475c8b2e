"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.words import mix, slices, split, word_hashes
from swathe.plans.durable import durable

#: Hash buckets of the two models (words and word pairs), pseudo-count of each, labelled rows that fit the target model.
BUCKETS, SMOOTH, TARGET_ROWS = 10_000, 1.0, 20_000
#: Rows among which the last refinement of the k-th largest key sorts.
FEW = 2000


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, ASCII lower-cased, and their number by text."""
    docs = [split(t.lower()) for t in texts]
    n = np.array([len(d) for d in docs], np.int64)
    h = word_hashes([w for d in docs for w in d])
    pairs = mix(h[:-1], h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(n)
    inside[ends[n > 0] - 1] = False
    both = np.zeros((len(h), 2), np.int64)
    both[:, 0] = (h % np.uint64(BUCKETS)).astype(np.int64)
    both[:-1, 1] = (pairs % np.uint64(BUCKETS)).astype(np.int64)
    use = np.stack([np.ones(len(h), bool), inside], axis=1)
    return both[use], np.maximum(2 * n - 1, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for texts, wanted in slices(batches, "text", "target"):
        b, n = ngram_buckets(texts)
        raw += np.bincount(b, minlength=BUCKETS)
        target += np.bincount(b[np.repeat(np.array(wanted, bool), n)], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def fit_ratio(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket. The raw model counts every document, the target model those of ``target_ids``
    (at most TARGET_ROWS rows, by contract of the caller, so it is broadcast). BUCKETS sums reach the driver."""
    flagged = docs.join(F.broadcast(target_ids.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for b, r, t in sums.collect():
        raw[b] += r
        target[b] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids in slices(batches, "text", "doc_id"):
            b, n = ngram_buckets(texts)
            sums = np.bincount(np.repeat(np.arange(len(texts)), n), ratio[b], len(texts)) if len(b) else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(sums)], ["doc_id", "n_grams", "log_weight"])

    return run


def gumbel(seed: int, column: str) -> Column:
    """Standard Gumbel noise from a seeded hash of the column."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def top_k(keyed: DataFrame, k: int, key: str, tie: str) -> Column:
    """Whether a row is among the k largest by (key desc, tie): a threshold found exactly by narrowing histograms.

    Each round counts the rows of 256 equal ranges of the key that still holds the k-th; when FEW rows or one value are
    left, those are looked at. If a tie of key and id straddles k, all of its rows are in.
    """
    total, low, high = keyed.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= total:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    above, inside = 0, total  # rows over ``high``; rows in [low, high]
    while inside > FEW and low < high:
        step = (high - low) / 256
        if low + step == low:
            break
        bins = keyed.where(F.col(key).between(low, high)).groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(255)).alias("b")).agg(
            F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("z")
        )
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high, inside = r["a"], r["z"], r["n"]
                break
            above += r["n"]
    last = keyed.where(F.col(key).between(low, high)).orderBy(F.col(key).desc(), F.col(tie)).select(key, tie).limit(k - above)
    edge = last.orderBy(F.col(key), F.col(tie).desc_nulls_first()).first()
    same = F.col(tie).isNull() if edge[1] is None else (F.col(tie).isNull() | (F.col(tie) <= edge[1]))
    return (F.col(key) > edge[0]) | ((F.col(key) == edge[0]) & same)


def importance_resample(docs: DataFrame, target_ids: DataFrame, share: float, seed: int = 13, temper: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, sample_key, kept.

    log_weight is the sum of the log ratios of a document's n-grams, the log of its importance weight; sample_key adds
    Gumbel noise, and the largest round(share * rows) keys are kept: a sample without replacement in proportion to the
    weights. ``temper`` divides the log weights by that power of the number of n-grams (off by default). Null and empty texts weigh 0. Repeated ids share their noise.
    An empty table gives an empty result; other columns are ignored. Without target rows all weights follow the raw text.
    """
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ratio = fit_ratio(cols, target_ids)
    scored = cols.mapInArrow(_scorer(ratio), "doc_id long, n_grams long, log_weight double")
    if temper:
        scored = scored.withColumn("log_weight", F.when(F.col("n_grams") > 0, F.col("log_weight") / F.pow("n_grams", F.lit(temper))).otherwise(F.lit(0.0)))
    keyed = durable(scored.withColumn("sample_key", F.col("log_weight") + gumbel(seed, "doc_id")))
    k = math.floor(share * keyed.count() + 0.5)
    return keyed.withColumn("kept", top_k(keyed, k, "sample_key", "doc_id"))


def target_sample(labels: DataFrame, column: str = "quality", rows: int = TARGET_ROWS) -> tuple[DataFrame, float]:
    """(ids of at most ``rows`` rows labelled 1, by hash order; share of label 1 among the labelled)."""
    known = labels.where(f"doc_id is not null and `{column}` is not null").groupBy("doc_id").agg(F.max(column).alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    ids = [(r[0],) for r in known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").select(F.col("doc_id").cast("long")).limit(rows).collect()]
    return labels.sparkSession.createDataFrame(ids, "doc_id long"), 1.0 if share is None else float(share)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target is a bounded sample of rows labelled of quality 1, the share kept is that of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids, share = target_sample(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return importance_resample(docs, ids, share)
