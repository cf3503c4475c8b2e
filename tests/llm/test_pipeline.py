import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(240):
        text = list(rng.choice(words, int(rng.integers(30, 90))))
        toxic = k % 5 == 0
        for _ in range(4 * toxic):
            text[int(rng.integers(len(text)))] = "vileness"
        rows.append((k, " ".join(text), "en", f"s{k % 4}" if k % 7 else None, 0))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[k][1].replace(" ", "  "), "en", "s0", 0) for k in range(1, 20)]  # copies
    edited = [rows[k][1].split() for k in range(1, 60) if k % 5]
    rows += [(1100 + k, " ".join([*w[:-1], "other"]), "en", "s2", 0) for k, w in enumerate(edited)]  # near copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "long " * 9000, "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def test_each_stage_acts_on_what_the_one_before_kept(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, path)
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    clean, exact, near, mixed, packed = ([r["doc_id"] for r in d.select("doc_id").collect()] for d in seen)
    toxic = {i for i, r in rows.items() if "vileness" in (r[1] or "")}
    assert len(toxic & set(clean)) <= 0.05 * len(toxic) and len(set(clean) - toxic) >= 0.97 * (len(rows) - len(toxic))
    groups = {}
    for i in clean:
        groups.setdefault("".join((rows[i][1] or "").split()), []).append((-len(rows[i][1] or ""), i))
    assert sorted(exact) == sorted(min(g)[1] for g in groups.values())
    from tests.llm.test_simhash import similar_groups

    groups = similar_groups([(i, rows[i][1]) for i in exact])
    assert sorted(near) == sorted({min(g) for g in groups})
    assert sum(len(g) > 1 for g in groups) > 30
    assert set(mixed) <= set(near) and max(mixed.count(i) for i in set(mixed)) <= 3
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert all(texts[i] == rows[i][1] for i in texts)
    assert set(packed) == set(mixed)
    assert sum(r["length"] for r in seen[4].collect() if r["doc_id"] == mixed[0]) == mixed.count(mixed[0]) * seen[4].where(f"doc_id = {mixed[0]}").first()["doc_tokens"]


def test_dedup_stages_keep_one_row_of_repeated_and_null_ids(spark):
    base = [f"w{k}" for k in range(200)]
    long, near, other, third = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{k}" for k in range(200)), " ".join(f"u{k}" for k in range(200))
    schema = "doc_id long, text string, lang string, source string"

    def left(stage, rows):
        out = stage(spark, spark.createDataFrame(rows, schema).repartition(3), None).collect()
        return sorted(((r["doc_id"], r["text"]) for r in out), key=str)

    rows = [(5, "A", "en", "s"), (5, "A", "en", "s"), (5, "A", None, "en"), (5, "A", "en", None), (6, "A", "en", "s"), (None, "B", "en", "s"), (None, "B", "en", "s"), (7, "C", "en", "s"), (None, "C", "en", "s"), (5, "D", "en", "s")]
    assert left(pipeline.exact, rows) == sorted([(5, "A"), (None, "B"), (7, "C"), (5, "D")], key=str)
    rows = [(5, long, "en", "s"), (5, long, "en", "s"), (5, other, "en", "s"), (4, near, "en", "s"), (None, third, "en", "s"), (None, third + " z", "en", "s")]
    got = left(pipeline.near, rows)
    assert len(got) == 3 and {(4, near), (5, other)} <= set(got) and [t[:200] for i, t in got if i is None] == [third[:200]]


def test_run_and_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    assert pipeline.run(spark, path).count() > 0
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_this_package():
    code = "import sys; sys.modules['swathe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'raster_count' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
