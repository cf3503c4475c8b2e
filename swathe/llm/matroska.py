"""Media columns: Matroska files parsed into packet tables with timestamps, tracks and byte ranges."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.words import slices

EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7,
)
TIME, SIMPLE, BLOCK, SCALE, NUMBER, CODEC, CUE_TIME, CUE_TRACK, CUE_AT = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0xD7, 0x86, 0xB3, 0xF7, 0xF1
PARENTS = {SEGMENT, CLUSTER, GROUP}
UNIT, FRAME, LACE, BLOCKS, RATE = 64, 1024, 8, 16, 8000


def vint(value: int, length: int = 0) -> bytes:
    """An EBML size; all ones means unknown, so that value takes a longer form."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, offset: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock: no lacing for one frame, fixed-size lacing for equal ones, EBML lacing otherwise."""
    equal = len({len(f) for f in frames}) == 1
    kind = 0 if len(frames) == 1 else 2 if equal else 3
    head = vint(track) + struct.pack(">hB", offset, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            n = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
            head += vint(d + (1 << 7 * n - 1) - 1, n)
    return element(SIMPLE, head + b"".join(frames))


_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_INFO = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"swathe") + element(0x5741, b"swathe"))
_TRACKS = element(
    TRACKS,
    element(ENTRY, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(0x83, 2) + element(CODEC, b"A_PCM/INT/LIT")
            + element(AUDIO, element(0xB5, struct.pack(">f", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))),
)


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples: frames laced into blocks, blocks in clusters, one cue for each cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues, n = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    for c in range(0, len(frames), LACE * BLOCKS):
        start = c * FRAME * 1000 // RATE
        blocks = [block(1, b * FRAME * 1000 // RATE - start, frames[b : b + LACE]) for b in range(c, min(c + LACE * BLOCKS, len(frames)), LACE)]
        cluster = element(CLUSTER, uint(TIME, start) + b"".join(blocks))
        cues.append(element(POINT, uint(CUE_TIME, start) + element(POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_AT, n))))
        body.append(cluster)
        n += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """(value, next place); None for an unknown size. ``keep`` leaves the length mark in, as identifiers do."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


@dataclass
class Media:
    """packets: (time in ns, track, first byte, bytes, key frame); cues: (time, track, place in the file); codecs by track."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    origin: int = 0


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        ident, body = read_vint(data, at, True)
        size, body = read_vint(data, body)
        stop = end if size is None else body + size
        if stop > end:
            raise ValueError(f"element at byte {at} runs over its parent")
        yield ident, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block, for each of the four kinds of lacing."""
    track, at = read_vint(data, a)
    offset, flags = struct.unpack_from(">hB", data, at)
    at, kind = at + 3, flags >> 1 & 3
    if not kind:
        return track, offset, flags, [(at, b)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (b - at) % n:
            raise ValueError("fixed lacing with unequal frames")
        sizes = [(b - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            raw, at = read_vint(data, at)
            raw = (1 << 7 * length) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * length - 1) - 1))
    if kind != 2:
        sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing runs over its block")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return track, offset, flags, out


def demux(data: bytes) -> Media:
    """Walks the elements of a file. Clusters and segments of unknown size end with what follows them or the file."""
    media, now = Media(), 0
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at < end:
            ident, body = read_vint(data, at, True)
            size, body = read_vint(data, body)
            stop = end if size is None else body + size
            if stop > end:
                raise ValueError(f"element at byte {at} runs over its parent")
            if ident == SEGMENT:
                media.origin = body
            if ident == CLUSTER:
                media.clusters.append(at)
            if ident in PARENTS:
                if stop < end:
                    todo.append((stop, end))
                at, end = body, stop
                continue
            if ident == TIME:
                now = _uint(data, body, stop)
            elif ident in (SIMPLE, BLOCK):
                track, offset, flags, ranges = _frames(data, body, stop)
                for a, b in ranges:
                    media.packets.append(((now + offset) * media.scale, track, a, b - a, ident == SIMPLE and flags >= 0x80))
            elif ident == INFO:
                media.scale = next((_uint(data, a, b) for i, a, b in _children(data, body, stop) if i == SCALE), media.scale)
            elif ident == TRACKS:
                for i, a, b in _children(data, body, stop):
                    if i == ENTRY:
                        parts = {j: data[c:d] for j, c, d in _children(data, a, b)}
                        media.codecs[int.from_bytes(parts.get(NUMBER, b""), "big")] = parts.get(CODEC, b"").decode("ascii", "replace")
            elif ident == CUES:
                for i, a, b in _children(data, body, stop):
                    if i == POINT:
                        time, places = 0, []
                        for j, c, d in _children(data, a, b):
                            if j == CUE_TIME:
                                time = _uint(data, c, d)
                            elif j == POSITIONS:
                                places.append({k: _uint(data, e, f) for k, e, f in _children(data, c, d)})
                        media.cues += [(time * media.scale, p.get(CUE_TRACK, 0), media.origin + p.get(CUE_AT, 0)) for p in places]
            at = stop
    return media


def padded(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def features(media: Media, payload: bytes) -> str:
    """Counts of the container and the level, spread and sign changes of the samples around 128, all whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32)
    signs = x >= 128
    starts = set(media.clusters)
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={sum(c[2] in starts for c in media.cues)};"
        f"tracks={len(media.codecs)};last_ns={media.packets[-1][0]};sum={int(x.sum(dtype=np.int64))};"
        f"energy={int((x * x).sum(dtype=np.int64))};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))};peak={int(x.max())}"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for texts, ids in slices(batches, "text", "doc_id"):
        rows = []
        for text, doc_id in zip(texts, ids):
            stored = mux(padded(text))
            media = demux(stored)
            back = b"".join([stored[a : a + n] for _, _, a, n, _ in media.packets])
            rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a Matroska file, reads it back from the packet table and returns digests and features.

    One row per row; null counts as empty, which is 64 zero bytes. Equal texts have equal values, whatever the id. Long
    texts are one file each and are held by one task. Repeated ids are rows of their own; an empty table gives an empty
    result; other columns are ignored. There is no shuffle.
    """
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return cols.mapInArrow(_digest, schema)


def packet_table(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per packet of each file: id, packet, time_ns, track, codec, first_byte, n_bytes, key_frame, error.

    A null, empty or broken file gives one row with ``error`` and nulls instead; files are read one at a time.
    """
    cols = files.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{content_col}`").alias("content"))
    names = ["id", "packet", "time_ns", "track", "codec", "first_byte", "n_bytes", "key_frame", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents, ids in slices(batches, "content", "id"):
            rows: list[tuple] = []
            for data, name in zip(contents, ids):
                try:
                    media = demux(data)
                    if not media.packets:
                        raise ValueError("no packets")
                    rows += [(name, k, t, tr, media.codecs.get(tr), a, n, key, None) for k, (t, tr, a, n, key) in enumerate(media.packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((name, *[None] * 7, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cols.mapInArrow(run, "id string, packet long, time_ns long, track long, codec string, first_byte long, n_bytes long, key_frame boolean, error string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
