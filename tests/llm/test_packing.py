import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathe.llm import packing

TEXTS = [
    None, "", " \n", "hello world", "Don't STOP's 12ab,3 it's x'll <|endoftext|>y <|startoftext|>", "É Ångström ÑANDÚ é ß ẞ ﬁ", "ΑΣ σς İstanbul naïve… «guillemets»",
    "日本語 текст 12.5% a.b.c...", "(wort) wort) *** --- a-b x|y |", " nbsp em​zero", "word " * 9000, "ein kurzer Text " * 300, "Ÿ ĲSSEL ŒUVRE ſtraße ŉ ǅ ŁÓDŹ",
]


def check(rows, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0 and at == parts[0]["context"]


def test_round_trip(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(packing.pack_documents(df).collect(), docs)


def test_ids_are_those_of_the_pieces(spark):
    df = spark.createDataFrame([(1, "some words here " * 700)], "doc_id long, text string")
    rows = packing.pack_documents(df, with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")
    assert ids.tolist() == [*tok.encode("some words here " * 700, add_special_tokens=False).ids, 2]


def test_odd_tables(spark):
    schema = "doc_id long, text string, sequence_id string, offset int"
    assert packing.pack_documents(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(1, "a", None, 3), (1, "a", None, 3), (None, "b", "x", 1)], schema)).collect()
    assert sum(r["length"] for r in rows) == 6


def test_pack_is_whole():
    rng = np.random.default_rng(0)
    for lengths in ([1], [4096], [4097, 1], [512] * 9, [int(x) for x in rng.lognormal(6, 1.3, 3000)]):
        windows = packing.pack(lengths)
        cover = {}
        for w in windows:
            size = sum(p[2] for p in w)
            assert size <= 4096 and size & (size - 1) == 0
            for d, s, n in w:
                cover.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(cover[d]):
                assert s == at and k > 0
                at += k
            assert at == n


def test_step_groups_are_balanced(spark):
    """Several chunks and a small last one: groups of about the same tokens, none far from the step's size."""
    rng = np.random.default_rng(1)
    words = ["one", "two", "other", "words", "more", "here"]
    texts = [" ".join(rng.choice(words, int(n))) for n in np.minimum(rng.lognormal(7, 1.2, 1400), 30_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    groups = [r["n"] for r in packing.pack_documents(df).groupBy("step_group").agg(F.sum("length").alias("n")).collect()]
    assert sum(groups) > 2 * packing.CHUNK_TOKENS and len(groups) > 15
    assert 2 / 3 * packing.STEP_TOKENS - 4096 <= min(groups) and max(groups) <= 3 / 2 * packing.STEP_TOKENS + 4096
    for sizes in ([4096] * 70 + [512] * 9, [4096] * 3 + [1], [2048] * 200 + [1024] * 31 + [64, 8, 1]):
        dealt = np.bincount(packing.deal(sizes, packing.STEP_TOKENS), sizes)
        assert len(dealt) == max(1, round(sum(sizes) / packing.STEP_TOKENS)) and dealt.max() - dealt.min() <= 4096


def test_sequence_ids_are_each_partitions_own(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(df).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
