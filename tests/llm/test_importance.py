import math
from collections import Counter

import numpy as np
from xxhash import xxh3_64_intdigest

from swathe.llm import importance as I


def test_top_k_equals_sorting(spark):
    rng = np.random.default_rng(1)
    keys = [*rng.normal(0, 1, 6000), *[0.5] * 3000, *rng.normal(1e9, 1, 50)]
    df = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "doc_id long, key double")
    order = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    for k in (0, 1, 49, 50, 51, 2500, 4000, len(keys) - 1, len(keys), len(keys) + 5):
        got = {r[0] for r in df.where(I.top_k(df, k, "key", "doc_id")).select("doc_id").collect()}
        assert got == set(order[:k]), k


def plain_weights(rows, target):
    """(id, n-grams, log weight) in plain Python: whole numbers of 64 bits, counts in a dictionary."""
    full = (1 << 64) - 1

    def grams(text):
        h = [xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
        out = [x % I.BUCKETS for x in h]
        for a, b in zip(h, h[1:]):
            x = (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 31)) * 0xC2B2AE3D27D4EB4F) & full
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & full
            out.append((x ^ (x >> 32)) % I.BUCKETS)
        return out

    raw, wanted = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            wanted.update(grams(t))
    n, m = sum(raw.values()) + I.BUCKETS, sum(wanted.values()) + I.BUCKETS
    return [(i, len(grams(t)), sum(math.log((wanted[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in grams(t))) for i, t in rows]


def test_weights_equal_plain_python_and_good_text_wins(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choice(good if k % 3 else bad, 40))) for k in range(300)]
    odd = [(1000, None), (1001, ""), (1002, "one"), (1003, "g1 " * 5000), (1003, "g1 g2"), (None, "g3 g4")]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows + odd], "doc_id long, text string, log_weight double, target boolean").repartition(3)
    ids = spark.createDataFrame([(k,) for k in range(0, 300, 2) if k % 3], "doc_id long")
    out = I.importance_resample(df, ids, 0.6).collect()
    assert len(out) == 306 and sum(r["kept"] for r in out) == round(0.6 * 306)
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (1003, None)}
    want = plain_weights(rows + odd, {k for k in range(0, 300, 2) if k % 3})
    assert sorted((str(r["doc_id"]), r["n_grams"], round(r["log_weight"], 6)) for r in out) == sorted((str(i), n, round(w, 6)) for i, n, w in want)
    tempered = {r["doc_id"]: r["log_weight"] for r in I.importance_resample(df, ids, 0.6, temper=0.5).collect()}
    assert all(abs(tempered[i] - by[i]["log_weight"] / by[i]["n_grams"] ** 0.5) < 1e-9 for i, _ in rows)
    assert by[1000]["log_weight"] == by[1001]["log_weight"] == 0 and by[1002]["n_grams"] == 1
    kept_good = np.mean([by[k]["kept"] for k in range(300) if k % 3])
    kept_bad = np.mean([by[k]["kept"] for k in range(300) if not k % 3])
    assert kept_good > 0.8 > 0.3 > kept_bad


def test_empty_and_no_labels(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    ids, share = I.target_sample(labels)
    assert share == 1.0 and I.importance_resample(df, ids, share).count() == 0
