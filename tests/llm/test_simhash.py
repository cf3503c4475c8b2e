import numpy as np
from xxhash import xxh64_intdigest

from swathe.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([*range(9, 14)], " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, f"{prints[i]:016x}", least[root(i)]) for i, (k, _) in enumerate(rows))


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_groups(rows, least=0.8):
    """Lists of ids that links of at least this similarity connect."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similarity(sets[i], sets[j]) >= least:
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for g, (k, _) in zip(group, rows):
        out.setdefault(g, []).append(k)
    return list(out.values())


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(words, int(rng.integers(40, 400)))) for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base[:40]):
        w = list(w)
        w[-1 - k % 3 :] = ["new"] * (1 + k % 3)  # a few words at the end: similarity over 0.9
        rows.append((100 + k, "\n".join(w).upper()))
    for k, w in enumerate(base[40:]):
        rows.append((200 + k, " ".join([*w[: len(w) // 2], *rng.choice(words, len(w) // 2)])))  # half is shared: 0.33
    rows += [(300, None), (301, ""), (302, "short text"), (303, "Short  text"), (304, "text short"), (305, "one " * 40_000), (306, "one " * 50_000), (306, "one two")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "body").selectExpr("doc_id", "body", "1 AS fp", "'x' AS keys")
    got = {}
    for r in simhash.near_duplicates(docs, text_col="body").collect():
        got.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, similar_groups(rows)))
    assert simhash.near_duplicates(docs.limit(0), text_col="body").count() == 0


def test_fingerprints_tell_similarities_apart():
    rng = np.random.default_rng(4)
    far = close = 0
    for _ in range(200):
        words = [f"v{x}" for x in rng.integers(0, 1000, 300)]
        for share, kind in ((0.9, "close"), (0.6, "far")):
            k = round(300 * share)
            other = words[:k] + [f"u{x}" for x in rng.integers(0, 1000, round(k / share * (1 - share) / 2))]
            a, b = [" ".join(w).encode() for w in (words, other)]
            s = similarity(shingle_set(a.decode()), shingle_set(b.decode()))
            fp, keys = simhash.signatures([a, b], 5, 8, 8, 3)
            linked = int(np.bitwise_count(fp[0] ^ fp[1]).sum()) <= simhash.near_radius(0.8, 512) and bool((keys[0] == keys[1]).any())
            if kind == "close":
                assert s > 0.8
                close += linked
            else:
                assert s < 0.7
                far += linked
    assert close >= 190 and far <= 10


def run(spark, rows):
    out = simhash.simhash_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "component_id")
    return sorted(tuple(r) for r in out.collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["a", "Bé", "cc", "d!", "E"], 60)) for _ in range(12)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    for k in range(40):
        words = base[k % 12].split()
        words[int(rng.integers(60))] = "x"
        rows.append((200 + k, "\n".join(words)))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (7, "long " * 5000), (8, "Ångström É")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c", 5, "k")], "doc_id long, text string, n long, fp string")
    assert simhash.simhash_dedup(docs).count() == 1


def test_links_of_a_large_bucket_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 14, 700).astype(np.int64))  # one bucket: three lanes agree
    prints = spark.createDataFrame([(int(v), i) for i, v in enumerate(low)], "fp long, rep long")
    from swathe.plans.components import components

    links = simhash.link_fingerprints(prints, tile=64)
    assert all((int(low[a]) ^ int(low[b])).bit_count() <= 2 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    want = {}
    near = np.bitwise_count(low[:, None] ^ low[None, :]) <= 2
    for i in range(len(low)):
        if i not in want:
            todo, want[i] = [i], i
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in want:
                        want[int(j)] = i
                        todo.append(int(j))
    assert all(got.get(i, i) == c for i, c in want.items())


def near_pairs(lengths=(24, 90, 300)):
    """Rows of text pairs, each pair with a vocabulary of its own, whose similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(6)
    rows = []
    for p in range(120):
        n = lengths[p % len(lengths)]
        words = [f"p{p}x{x}" for x in rng.permutation(n)]
        other = words[: n - int(rng.integers(0, max(2, n // 4)))]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*other, *[f"q{p}y{k}" for k in range(int(rng.integers(0, max(2, n // 12))))]]))]
    return rows


def test_near_links_are_those_of_the_true_similarity(spark):
    rows = near_pairs()
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [shingle_set(t) for _, t in rows]
    true = [similarity(sets[i], sets[i + 1]) for i in range(0, len(rows), 2)]
    linked = [got[i + 1] == i for i in range(0, len(rows), 2)]
    assert 20 < sum(s >= 0.8 for s in true) < 100 and sum(0.6 < s < 0.8 for s in true) > 15
    assert not [s for s, x in zip(true, linked) if x and s < 0.8]
    missed = [s for s, x in zip(true, linked) if not x and s >= 0.8]
    assert len(missed) <= 1 and all(s < 0.85 for s in missed)


def test_texts_of_one_fingerprint_keep_the_buckets_of_each(spark):
    """Two texts with equal 64-bit fingerprints and different keys; each has a near copy that shares its own key alone."""
    rng = np.random.default_rng(9)

    def sign(texts):
        fp, keys = simhash.signatures([t.encode() for t in texts], 5, 1, 1, 1)
        return fp[:, 0], keys[:, 0]

    base = [f"b{x}" for x in range(400)]
    for _ in range(60):
        texts = [" ".join([*base, f"t{x}"]) for x in rng.integers(0, 1 << 40, 400)]
        fp, keys = sign([" ".join(base), *texts])
        hit = np.flatnonzero((fp == fp[0]) & (keys != keys[0]))
        if len(hit):
            break
    one, two = " ".join(base), texts[hit[0] - 1]
    copies = []
    for text, key in ((one, keys[0]), (two, keys[hit[0]])):
        words = text.split()
        tries = [" ".join([*words[:k], *[f"c{k}x{x}" for x in range(12)], *words[k + 12 :]]) for k in range(0, 380, 10)]
        copies.append(next(t for t, f, x in zip(tries, *sign(tries)) if x == key and f != fp[0]))
    rows = [(1, one), (2, two), (3, copies[0]), (4, copies[1])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=1, bands=1, each=1).collect()}
    assert got[3] == got[1] and got[4] == got[2]
