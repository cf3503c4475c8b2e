import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from swathe.llm.mixing import mix_sources, mix_sql


def rows():
    rng = np.random.default_rng(3)
    out = [(k, "w " * int(rng.integers(0, 90)), ["a", "b", "c", None, "é", "B"][min(int(rng.exponential(1.2)), 5)]) for k in range(900)]
    return [*out, (2000, None, "a"), (2001, "", None), (2002, " \t", "empty"), (2003, "v\n" * 5000, "b")]


def fill(sizes, weights, limit):
    """Clamps and hands on until no target is above its limit."""
    total, fixed = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left = total - sum(fixed.values())
        target = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if target[k] > limit * sizes[k] + 1e-9]
        if not over:
            return [fixed.get(k, target.get(k)) for k in range(len(sizes))]
        fixed |= {k: limit * sizes[k] for k in over}


def test_equals_sql_and_meets_targets(spark):
    data = rows()
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)).toPandas()
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.sql(mix_sql()).df()
    cols = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    pd.testing.assert_frame_equal(got[cols].sort_values("doc_id").reset_index(drop=True), want[cols].sort_values("doc_id").reset_index(drop=True), check_dtype=False)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    assert (got["size"] == got.doc_id.map(words)).all() and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(1) == 0).all()
    order = sorted({s for _, _, s in data if s is not None}) + [None]
    sizes = [sum(words[i] for i, _, s in data if s == o) for o in order]
    targets = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    for o, target, size in zip(order, targets, sizes):
        own = got[got.source.isna()] if o is None else got[got.source == o]
        assert own.target.iloc[0] == pytest.approx(target)
        largest = own["size"].max()
        assert abs(own.taken.sum() - target) <= max(largest, 1), (o, target, size)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, source string, size string, n int"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    odd = [(None, "a b", "s", "x", 1), (1, "a", "s", "x", 1), (1, "a", "s", "x", 1), (2, None, None, None, None)]
    assert mix_sources(spark.createDataFrame(odd, schema)).count() == 4
    assert mix_sources(spark.createDataFrame([(1, "", "s", "", 1)], schema)).first()["taken"] == 0
