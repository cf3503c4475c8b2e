import numpy as np

from swathe.llm import toxicity as T


def sample(n, seed):
    rng = np.random.default_rng(seed)
    plain, nasty = [f"word{k}" for k in range(400)], ["vile", "nastyness", "nastyous", "foul"]
    rows = []
    for k in range(n):
        text = list(rng.choice(plain, int(rng.integers(3, 120))))
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            text[int(rng.integers(len(text)))] = str(rng.choice(nasty)) + str(rng.choice(["", ".", "!!"]))
        rows.append((seed * 10_000 + k, " ".join(text), ["en", "de", None][k % 3], int(toxic)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    train, test = sample(900, 1), sample(300, 2)
    docs = spark.createDataFrame([r[:3] for r in train + test], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in train] + [(None, 1), (10_001, None)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " \n", "xx"), (3, "vile", "en"), (None, "fine " * 20_000, "en")], docs.schema)
    out = T.score_toxicity(docs.unionByName(odd), model, ("doc_id", "lang", "text"))
    got = {r["doc_id"]: r["score"] for r in out.where("doc_id >= 20000").collect()}
    truth = {r[0]: r[3] for r in test}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in truth.items()]) > 0.95
    rows = out.where("doc_id is null or doc_id < 10").collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if (r["text"] or "").strip() == ""}) == 1
    assert out.select(T.flag_toxic(model).alias("x")).where("x").count() >= 50


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit_toxicity(docs, none) is None
    assert T.fit_toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert [r["score"] for r in T.score_toxicity(docs, None).collect()] == [0.0]
    assert T.score_toxicity(docs.limit(0), None).count() == 0
    assert docs.select(T.flag_toxic(None)).first()[0] is False


def test_a_score_does_not_hang_on_its_neighbours():
    rows = [(i, t.encode(), y, lang) for i, t, lang, y in sample(200, 3)]
    model = T.fit(rows, 0.25)
    texts = [r[1] for r in rows]
    together = T.Scorer(model).scores(texts)
    alone = np.concatenate([T.Scorer(model).scores([t]) for t in texts[:10]])
    assert np.allclose(together[:10], alone)


def test_scores_equal_a_plain_convolution():
    """Windows, zero padding, pooling and the two layers, one number at a time; long texts in parts give the same."""
    rng = np.random.default_rng(6)
    m = T.Model(
        rng.normal(0, 1, (T.BUCKETS, T.DIM)).astype(np.float32), [rng.normal(0, 1, (w, T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS],
        [rng.normal(0, 1, T.FILTERS).astype(np.float32) for _ in T.WIDTHS], rng.normal(0, 0.2, (len(T.WIDTHS), T.FILTERS)).astype(np.float32), 0.3, 0.7, -0.2,
    )

    def plain(text):
        words = text.split()
        rows = [np.mean([m.embed[f] for f in T.features(w)], axis=0) for w in words] or [np.zeros(T.DIM)]
        rows += [np.zeros(T.DIM)] * (max(T.WIDTHS) - 1)
        z = m.out_bias
        for k, w in enumerate(T.WIDTHS):
            for f in range(T.FILTERS):
                top = max(sum(float(rows[at + j] @ m.conv[k][j][:, f]) for j in range(w)) for at in range(max(len(words), 1)))
                z += m.out[k, f] * max(top + m.bias[k][f], 0)
        return 1 / (1 + np.exp(-(z * m.scale + m.shift)))

    words = [f"w{k}" for k in range(30)] + ["Loud!", "(it)", "x"]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (1, 2, 3, 10, 57)] + [b"", b" ", b"one", b"a  b\n"]
    scorer = T.Scorer(m)
    want = [plain(t) for t in texts]
    assert np.allclose(scorer.scores(texts), want, atol=1e-5)
    for size in (1, 7, 40):
        z = scorer.logits(texts, size)
        assert np.allclose(T._sigmoid(z * m.scale + m.shift), want, atol=1e-5), size


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "SAMPLE_CLASS_BYTES", 1000)
    monkeypatch.setattr(T, "fit", lambda rows, share: seen.append(rows))
    docs = spark.createDataFrame([(k, "x" * 90, "en") for k in range(60)], "doc_id long, text string, lang string")
    T.fit_toxicity(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    assert [sum(r[2] == y for r in seen[0]) for y in (0, 1)] == [11, 11]
