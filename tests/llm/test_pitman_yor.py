import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from swathe.llm import pitman_yor as P

SCHEMA = "doc_id long, text string, score int, chunk string"


def corpus():
    rng = np.random.default_rng(4)
    words = ["the", "Of", "and", *[f"w{k}" for k in range(300)]]
    p = 1 / np.arange(2, len(words) + 2)
    rows = []
    for k in range(400):
        text = [words[int(rng.choice(len(words), p=p / p.sum()))] for _ in range(int(rng.integers(1, 60)))]
        rows.append((k, " ".join(x + (" next" if x == "w3" else "") for x in text)))
    return [*rows, (500, None), (501, ""), (502, "unseen1 unseen2\t"), (502, "the THE"), (None, "the of"), (503, "the " * 4000)]


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_counts_and_base_equal_plain_python(spark):
    data = corpus()
    df = spark.createDataFrame([(*r, 0, "c") for r in data], SCHEMA).repartition(4)
    got = P.score_documents(df).collect()
    train = Counter(w for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted(
        (str(i), len(tokens(t)), sum(w in train for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in data
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_reruns_agree_and_empty(spark):
    df = spark.createDataFrame([(*r, 0, "c") for r in corpus()], SCHEMA).coalesce(2)
    a, b = (sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in P.score_documents(df).collect()) for _ in range(2))
    assert a == b
    assert P.score_documents(df.limit(0)).count() == 0


def test_reseating_keeps_the_models_distribution():
    """Tables of one dish against p(t), in proportion to the generalised Stirling number of (c, t) and the openings' weights."""
    d = 0.6
    for c, weights in ((7, lambda k, i: (0.5 + d * k) * (0.1 + k) / (2 + k)), (60, lambda k, i: (1 + d * (3 + k)) * (1 + k) / (40 + k)), (45, lambda k, i: 2.0 + 0 * k)):
        stirling = np.zeros(c + 1)
        stirling[1] = 1.0
        for n in range(1, c):
            stirling = (np.concatenate(([0.0], stirling[:-1])) + np.maximum(n - d * np.arange(c + 1), 0) * stirling) / n
        p = np.array([stirling[t] * np.prod([weights(np.array([k]), 0)[0] for k in range(1, t)]) for t in range(1, c + 1)])
        p /= p.sum()
        rng = np.random.default_rng(c)
        many = np.full(4000, float(c))
        t = P.tables_of(many, P.reseat(many, None, d, weights, rng, 120), np.arange(len(many)))
        got = np.bincount(t.astype(int), minlength=c + 1)[1:] / len(many)
        assert np.abs(got - p).sum() < 0.12, (c, np.abs(got - p).sum())


def test_probabilities_of_all_texts_add_up_to_one(spark):
    """Every text of up to five words out of three known ones and an unseen one: what is left is what longer texts have."""
    rng = np.random.default_rng(2)
    words = ["a", "b", "c"]
    texts = [" ".join(rng.choice(words, int(rng.choice([0, 1, 1, 2])), p=[0.6, 0.3, 0.1])) for _ in range(300)]
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    every = [" ".join(x) for n in range(6) for x in itertools.product([*words, "new"], repeat=n)]
    rows = [*zip(train, texts), *zip(held, every)]
    got = P.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    mass = {}
    for r in got.collect():
        mass[r["n_tokens"]] = mass.get(r["n_tokens"], 0.0) + 10 ** r["score"]
    total = sum(mass.values())
    longer = mass[6] ** 2 / (mass[5] - mass[6])  # the shares of lengths fall by a steady factor
    assert total < 1 + 1e-9 and abs(total + longer - 1) < 2e-3, (total, longer)


def plain_scores(train, wanted, theta, d, d0, rounds=300, burn=100, seed=5):
    """A plain sampler of the model with explicit tables, one customer at a time; the mean probability of each wanted pair."""
    rnd = random.Random(seed)
    pairs = [p for t in train for p in zip([b"\n", *tokens(t)[:-1]], tokens(t))]
    vocabulary = {w for _, w in pairs}
    inner, root = {}, {}  # (context, word) -> sizes of tables; word -> sizes of the root's tables

    def base(w):
        return (1 - P.UNSEEN) / len(vocabulary) if w in vocabulary else P.UNSEEN

    def root_p(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = root.get(w, [])
        return (sum(own) - d0 * len(own) + (1 + d0 * t) * base(w)) / (1 + n)

    def sums(v):
        rows = [x for (u, _), x in inner.items() if u == v]
        return sum(map(sum, rows)), sum(map(len, rows))

    def add(sizes, new, discount):
        weights = [x - discount for x in sizes] + [new]
        k = rnd.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rnd.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def arrive(v, w):
        if add(inner.setdefault((v, w), []), (theta + d * sums(v)[1]) * root_p(w), d):
            t = sum(map(len, root.values()))
            add(root.setdefault(w, []), (1 + d0 * t) * base(w), d0)

    for v, w in pairs:
        arrive(v, w)
    total = dict.fromkeys(wanted, 0.0)
    for r in range(rounds):
        for v, w in pairs:
            if leave(inner[v, w]):
                leave(root[w])
            arrive(v, w)
        if r >= burn:
            for v, w in wanted:
                n, t = sums(v)
                own = inner.get((v, w), [])
                p = root_p(w)
                total[v, w] += (sum(own) - d * len(own) + (theta + d * t) * p) / (theta + n) if n else p
    return {k: x / (rounds - burn) for k, x in total.items()}


def test_scores_are_near_those_of_a_plain_sampler(spark):
    rng = np.random.default_rng(9)
    words = ["the", "of", "cat", "sat", "on", "mat"]
    train = [" ".join(rng.choice(words, int(rng.integers(1, 6)), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])) for _ in range(25)]
    tests = ["the cat", "cat", "of the mat", "dog", "sat on the the of"]
    inside = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [*zip(inside, train), *zip(held, tests)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [{r["doc_id"]: r["score"] for r in P.score_documents(frame, rounds=4, sweeps=6, samples=3, seed=s, concentration=2.0, discounts=(0.5, 0.5)).collect()} for s in range(4)]
    pairs = [list(zip([b"\n", *tokens(t)[:-1]], tokens(t))) for t in tests]
    want = plain_scores(train, sorted({p for x in pairs for p in x}), 2.0, 0.5, 0.5)
    for i, x in zip(held, pairs):
        mean = sum(g[i] for g in got) / len(got)
        assert abs(mean - sum(math.log10(want[p]) for p in x)) < 0.06 * len(x), (i, mean)


def test_each_context_word_has_a_restaurant_of_its_own(spark):
    """Words whose hashes agree in their low 13 bits have followers of their own; so has each of 9,000 further words."""
    seen, pair = {}, None
    for k in range(10_000):
        low = P.xxh3_64_intdigest(f"c{k}".encode()) % 8192
        if low in seen:
            pair = seen[low], f"c{k}"
            break
        seen[low] = f"c{k}"
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 != 1]
    follower = dict(zip(pair, ("left", "right")))
    rows = [(i, f"{pair[i % 2]} {follower[pair[i % 2]]}", 0, "c") for i in train] + [(i, f"{w} {follower[w]}", 0, "c") for i, w in zip(held, pair)]
    got = {r["doc_id"]: r["score"] for r in P.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    # the first word is one of two; the follower and the end are all but certain
    assert all(abs(got[i] - math.log10(0.5)) < 0.1 for i in held)


def test_totals_of_contexts_equal_plain_counts(spark):
    data = [(i, t) for i, t in corpus() if i is not None]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    hot = P.hot_words(docs)
    schema = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
    packed = P._in_place(docs.mapInArrow(P._packer(5, hot), schema).repartition(5, "bucket").sortWithinPartitions("bucket"))
    answers, t, _ = P._meet(packed.mapInArrow(P._counting(hot, 5), P.MESSAGE), 5, len(hot), None)
    pairs = Counter()
    for i, text in data:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            words = tokens(text)
            pairs.update(zip([b"\n", *words[:-1]], words))
    assert (t.tokens, t.tables) == (sum(pairs.values()), len(pairs))
    want = {}
    for (u, _), n in pairs.items():
        a, b = want.get(P.xxh3_64_intdigest(u), (0, 0))
        want[P.xxh3_64_intdigest(u)] = a + n, b + 1

    def read(packed, answers):
        bucket, rows, _ = P._data(packed)
        if not rows:
            return P._table([], "u long, n long, t long")
        b = P.Bucket(rows, hot, 5)
        return P._table([(int(u.view("i8")), int(n), int(t)) for u, n, t in zip(b.contexts, *b.read(answers))], "u long, n long, t long")

    visit = packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(read, "u long, n long, t long")
    got = {(r["u"] % (1 << 64), r["n"], r["t"]) for r in visit.collect()}
    assert {x for x in got if x[1]} == {(u, *x) for u, x in want.items()}
    assert {u for u, n, _ in got if not n}.isdisjoint(want)
    assert visit._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1  # of the answers alone
