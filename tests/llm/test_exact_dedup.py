import hashlib
import re

import pytest

from swathe.llm.exact_dedup import exact_dedup

ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r"), (7, "x"), (7, "x "), (8, "A b"), (9, "a b"), (10, "é" * 70 + "1"), (11, "é" * 70 + "2"),
    (12, "w " * 9000), (13, "w" * 9000), (None, "ab"), (None, "only here"), (20, "a b "),
]


def plain(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = sorted(g, key=lambda x: (x[0], x[1], x[2] or 0))[0][2]
        out.append((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("full", [True, False])
def test_against_plain_python(spark, full):
    docs = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, group_size int, `__id` string").repartition(5)
    got = exact_dedup(docs, full_digest=full)
    cols = ["doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if full else [])]
    want = [r if full else r[:4] for r in plain(ROWS)]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("full", [True, False])
def test_one_group_of_all_rows_and_none(spark, full):
    hot = spark.range(3000).selectExpr("id AS doc_id", "'same text' AS text")
    got = exact_dedup(hot, full_digest=full)
    assert got.where("group_size = 3000 AND keep_id = 0").count() == 3000
    assert [r["doc_id"] for r in got.where("kept").collect()] == [0]
    assert exact_dedup(hot.limit(0), full_digest=full).count() == 0
