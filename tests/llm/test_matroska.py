import hashlib
import zlib

import pytest

from swathe.llm import matroska as M


def digest(text):
    payload = (text or "").encode()
    n = len(payload)
    payload += bytes((-n) % 64 or (0 if n else 64))
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


TEXTS = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long text \n" * 40_000, "z" * 8192, "z" * 8193, "\x00\x01"]


def test_digest_is_that_of_the_payload(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, feature string").repartition(3)
    rows = {r["doc_id"]: r for r in M.media_digest(docs).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for k, r in rows.items():
        text = TEXTS[k % len(TEXTS)]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == digest(text)
        stored = M.mux(M.padded((text or "").encode()))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == rows[k % len(TEXTS)]["feature"]
    assert M.media_digest(docs.limit(0)).count() == 0


def test_cues_and_times():
    payload = bytes(range(256)) * 2048
    stored = M.mux(payload)
    media = M.demux(stored)
    assert b"".join(stored[a : a + n] for _, _, a, n, _ in media.packets) == payload
    assert [c[2] for c in media.cues] == media.clusters and media.codecs == {1: "A_PCM/INT/LIT"}
    times = [p[0] for p in media.packets]
    assert times == sorted(times) and times[0] == 0


def test_all_cues_are_counted():
    payload = bytes(70 << 17)  # 70 clusters of 131,072 bytes
    media = M.demux(M.mux(payload))
    assert len(media.clusters) == len(media.cues) == 70
    assert "clusters=70;cues=70;" in M.features(media, payload)


@pytest.mark.parametrize("sizes", [[5], [7, 7, 7], [300, 2, 70000, 9], [255, 510, 1], [1, 0, 3]])
@pytest.mark.parametrize("kind", ["own", "xiph"])
def test_lacing(sizes, kind):
    frames = [bytes([k + 1]) * n for k, n in enumerate(sizes)]
    if kind == "own":
        body = M.block(1, 3, frames)
    else:
        head = M.vint(1) + (3).to_bytes(2, "big") + bytes([0x80 | 1 << 1, len(frames) - 1])
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
        body = M.element(M.SIMPLE, head + b"".join(frames))
    cluster = M.uint(M.TIME, 10) + body
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster  # a live stream's cluster of unknown size
    for file in (M.element(M.SEGMENT, M.element(M.CLUSTER, cluster)), M.element(M.SEGMENT, unknown)):
        media = M.demux(M._HEAD + file)
        data = M._HEAD + file
        assert [data[a : a + n] for _, _, a, n, _ in media.packets] == frames
        assert {p[0] for p in media.packets} == {13_000_000}


def test_packet_table_of_good_and_broken_files(spark):
    good = M.mux(b"ab" * 3000)
    files = spark.createDataFrame([("a", good), ("b", good[:-7]), ("c", b""), ("d", None), ("e", b"\x00junk")], "path string, content binary")
    rows = M.packet_table(files).collect()
    own = sorted((r for r in rows if r["id"] == "a"), key=lambda r: r["packet"])
    assert b"".join(good[r["first_byte"] : r["first_byte"] + r["n_bytes"]] for r in own) == b"ab" * 3000
    assert {r["id"] for r in rows if r["error"]} == {"b", "c", "d", "e"}
