import hashlib
import re

import numpy as np
import pyarrow as pa

from swathe.llm import substring_dedup as S
from swathe.llm.words import squeeze

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    low = {}
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                low[k] = min(low.get(k, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if low[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, bucket int, kind string" if rows and len(rows[0]) == 4 else "doc_id long, text string"), window)
    return sorted((tuple(r) for r in df.drop("kept_text").collect()), key=str)


def sample():
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(int(k * 7 % 101), " ".join(rng.choice(["a", "b", "c", "é", "D."], int(rng.integers(0, 60))))) for k in range(60)]
    rows += [(1000 + k, f"x{k} {passage}\t y{k}\n z") for k in range(20)]
    rows += [(5, None), (6, ""), (7, " \n"), (2000, "w " * 3000), (2001, "w " * 2000), (2001, "w " * 20), (None, passage), (None, None), (2002, "no break " * 20)]
    return rows


def test_against_plain_python(spark):
    for window in (3, 13):
        assert run(spark, sample(), window) == plain(sample(), window)


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], 13) == []
    rows = [(1, "a b c d", 3, "k"), (2, "a b c e", 3, "k")]
    assert run(spark, rows, 3) == plain([r[:2] for r in rows], 3)


def test_levels_double_until_none_survives(spark):
    passage = [f"p{k}" for k in range(40)]
    rows = [(1, " ".join(passage)), (2, "q " + " ".join(passage[:25])), (3, " ".join(passage[:9]) + " zz"), (4, "alone in here")]
    got = {r["doc_id"]: r["longest"] for r in S.repeat_levels(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {1: 20, 2: 20, 3: 5}


def test_keys_that_agree_in_64_bits_stay_apart():
    u = np.uint64
    keys = np.array([(7, 1), (7, 2), (3, 9), (7, 1), (7, 3), (3, 9)], u)
    order, starts = S.by_key(keys)
    groups = {frozenset(order[a:z].tolist()) for a, z in zip(starts, [*starts[1:], len(keys)])}
    assert groups == {frozenset({0, 3}), frozenset({1}), frozenset({2, 5}), frozenset({4})}
    flags = np.array([(7, 3), (7, 2), (8, 1)], u)
    assert S.member(keys, flags).tolist() == [False, True, False, False, True, False]
    assert not S.member(keys, flags[:0]).any() and len(S.member(keys[:0], flags)) == 0
    bodies = [keys[[0, 2]].tobytes(), keys[[1, 2]].tobytes()]  # two chunks: (7, 1) and (7, 2) differ, (3, 9) repeats
    cols = [pa.array([0, 0], pa.int32()), pa.array([1, 2]), *[pa.array([squeeze(np.array(d, t)) for d in ds]) for ds, t in (([[10], [20]], np.uint64), ([[2], [2]], np.uint8))], pa.array(bodies)]
    rows = list(S._matches(True, 4, False)(iter([pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "docs", "counts", "hashes"])])))
    got = [(c, b) for r in rows for c, b in zip(r.column("chunk").to_pylist(), r.column("body").to_pylist())]
    assert got == [(2, keys[2:3].tobytes())]


def test_levels_of_a_window():
    assert [S.levels(w) for w in (1, 2, 3, 13, 16, 17)] == [(1, 1), (1, 2), (2, 3), (8, 13), (8, 16), (16, 17)]
