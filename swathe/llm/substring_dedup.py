"""Substring dedup: windows of words that repeat across documents, found level by level."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.words import loosen, mix, slices, small, split, squeeze, word_digests
from swathe.plans.durable import durable, partitions_for

WINDOW = 13
#: Bytes of text in a chunk (a longer single text is one), and file bytes of input for each bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
FLAGS, TEXT = 0, 1
Chunk = tuple[int, list, list[bytes], list[bytes]]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` word hashes, by doubling: a window is two overlapping windows of half its size."""
    size, now = 1, h
    while size * 2 <= length:
        now, size = mix(now[:-size], now[size:]), size * 2
    rest = length - size
    return mix(now[: len(now) - rest], now[rest:])


def levels(window: int) -> tuple[int, int]:
    """The two lengths at which windows are looked for: the greatest power of two below ``window``, and ``window``, which is
    two overlapping windows of the first."""
    short = 1
    while short * 2 < window:
        short *= 2
    return min(short, window), window


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of ``keys`` together, and where each run of them starts."""
    order = np.argsort(keys[:, 0])
    k = keys[order]
    same = k[1:, 0] == k[:-1, 0]
    if keys.shape[1] > 1 and (same & (k[1:, 1] != k[:-1, 1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))


def member(values: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which rows of ``values`` are among the rows ``flags``."""
    out = np.zeros(len(values), bool)
    if not len(flags) or not len(values):
        return out
    flags = flags[np.lexsort(flags.T[::-1])]
    at, left = np.searchsorted(flags[:, 0], values[:, 0]), np.arange(len(values))
    while len(left):
        on = at < len(flags)
        at, left = at[on], left[on]
        on = flags[at, 0] == values[left, 0]  # rows with the same first number follow each other
        at, left = at[on], left[on]
        out[left] |= (flags[at] == values[left]).all(axis=1)
        at, left = at[~out[left]] + 1, left[~out[left]]
    return out


class Windows:
    """The windows of a chunk's documents: ``at`` in the concatenated words, ``doc`` (rank of the id in ``ids``), ``keys``
    and ``route``, from 128-bit hashes of the words. Rows with a null id have none.

    A key is the 128-bit hash of the window, or 32 bits of it if ``narrow``: enough to find what may repeat.
    """

    def __init__(self, ids: list, docs: list[list[bytes]], length: int, narrow: bool, digests: np.ndarray | None = None):
        self.n = np.array([len(d) for d in docs], np.int64)
        known = np.array([i is not None for i in ids], bool)
        self.ids, rank = np.unique(np.array([0 if i is None else i for i in ids], np.int64), return_inverse=True)
        self.digests = h = word_digests([w for d in docs for w in d]) if digests is None else digests
        where = np.arange(len(h))
        self.at = where[(where + length <= np.repeat(np.cumsum(self.n), self.n)) & np.repeat(known, self.n)]
        self.doc = np.repeat(rank, self.n)[self.at]
        a, b = (window_hashes(h[:, k], length)[self.at] if len(self.at) else np.empty(0, np.uint64) for k in (0, 1))
        self.keys, self.route = (a.astype(np.uint32)[:, None] if narrow else np.stack((a, b), axis=1)), b

    def only(self, places: np.ndarray) -> None:
        """Keeps the windows at which ``places`` (by word) is true."""
        keep = places[self.at]
        self.at, self.doc, self.keys, self.route = (x[keep] for x in (self.at, self.doc, self.keys, self.route))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order by key, where each key starts in it, and the least and the greatest document that have it."""
        order, starts = by_key(self.keys)
        d = self.doc[order]
        return order, starts, np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)

    def repeated(self, flags: np.ndarray, later_only: bool) -> np.ndarray:
        """The windows that another document has too (``later_only``: one with a smaller id), here or as ``flags`` tell."""
        if not len(self.at):
            return np.zeros(0, bool)
        order, starts, low, high = self.runs()
        n = np.diff(np.append(starts, len(order)))
        out = np.empty(len(order), bool)
        out[order] = self.doc[order] > np.repeat(low, n) if later_only else np.repeat(low < high, n)
        return out | member(self.keys, flags)


def _keys(blobs: list[bytes], narrow: bool) -> np.ndarray:
    """The keys of blobs from ``_blob``."""
    if narrow:
        return np.concatenate([np.empty(0, np.uint32), *[loosen(x, 4, steps=True) for x in blobs]])[:, None]
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)


def _blob(keys: np.ndarray, narrow: bool) -> bytes:
    """Keys in order, or sorted and compressed if ``narrow``."""
    return squeeze(np.sort(keys[:, 0]), True) if narrow else keys.tobytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """(chunk, ids, texts, no flags): rows in order, cut by bytes alone, so that reading again gives the same chunks."""
    first = TaskContext.get().partitionId() << 32
    for k, (texts, ids) in enumerate(slices(batches, "text", "doc_id", size=CHUNK_BYTES)):
        yield first | k, ids, texts, []


#: A chunk's flagged keys (``body``, kind FLAGS), or its documents: ids, sizes, which ids are null, texts (kind TEXT).
ROWS = "dest int, chunk long, kind int, ids binary, sizes binary, nulls binary, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["dest", "chunk", "kind", "ids", "sizes", "nulls", "body"])


def _home(chunks: np.ndarray, parts: int) -> np.ndarray:
    """Where a chunk's flags and its texts meet: the chunks of an input partition go to places in a row."""
    x = (chunks >> 32).view(np.uint64)
    return ((mix(x, x) % np.uint64(parts)).astype(np.int64) + (chunks & 0xFFFFFFFF)) % parts


def _compressed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for chunk, ids, texts, _ in _chunks(batches):
            known = np.array([0 if i is None else i for i in ids], np.int64).tobytes()
            sizes = np.array([len(t) for t in texts], np.uint32).tobytes()
            nulls = np.array([i is None for i in ids], np.uint8).tobytes()
            yield _batch([(int(_home(np.array([chunk]), parts)[0]), chunk, TEXT, known, sizes, nulls, tool.compress(b"".join(texts)))])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """(chunk, ids, texts, flagged keys) of a stream in order of chunk, flags first."""
    held: list[bytes] = []
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        for chunk, kind, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "ids", "sizes", "nulls", "body"))):
            if kind == FLAGS:
                held.append(row[3])
                continue
            ids, sizes, nulls = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.uint32, np.uint8)))
            ends, data = np.cumsum(sizes, dtype=np.int64), plain.decompress(row[3])
            texts = [data[z - s : z] for s, z in zip(sizes.tolist(), ends.tolist())]
            yield chunk, [None if gone else i for i, gone in zip(ids.tolist(), nulls.tolist())], texts, held
            held = []


def _together(texts: DataFrame, flags: DataFrame, parts: int) -> DataFrame:
    """A stream per partition with the flags of each chunk before its texts; one shuffle, texts compressed."""
    return texts.unionByName(flags).repartitionById(parts, "dest").sortWithinPartitions("chunk", "kind")


def _packed(bucket: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """(bucket, docs, counts, hashes) of entries sorted by bucket, and by document inside; a document's id, and its entries in
    the bucket, once."""
    new = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]))))
    ends = np.append(new, len(doc))
    runs, run_doc, run_bucket = np.diff(ends).astype(np.uint32), doc[new], bucket[new]
    cut = np.flatnonzero(np.concatenate(([True], run_bucket[1:] != run_bucket[:-1])))
    out = []
    for a, z in zip(cut, np.append(cut[1:], len(new))):
        out.append((int(run_bucket[a]), squeeze(run_doc[a:z].view(np.uint64), True), squeeze(small(runs[a:z])), hashes[ends[a] : ends[z]].tobytes()))
    return out


def _emitter(length: int, buckets: int, later_only: bool, narrow: bool, shorter: tuple[int, bool] | None):
    """Rows (bucket, chunk, docs, counts, hashes): of each of a chunk's windows one entry for the least document that has
    it (and one for the greatest unless ``later_only``), however many have it: that is all that other chunks need to know.
    Narrow keys go without documents.

    With ``shorter`` (a length of half the window or more, and whether its keys are narrow) the input is a grouped stream
    with the flags of that level, and a window is emitted only if the shorter ones at its start and its end both repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts, flags in (_grouped if shorter else _chunks)(batches):
            docs = [split(t) for t in texts]
            w = Windows(ids, docs, length, narrow)
            if shorter and len(w.at):
                size, few = shorter
                short, seen = Windows(ids, docs, size, few, w.digests), np.zeros(int(w.n.sum()) + length, bool)
                seen[short.at[short.repeated(_keys(flags, few), False)]] = True
                w.only(seen & np.append(seen[length - size :], np.zeros(length - size, bool)))
            if not len(w.at):
                continue
            order, starts, low, high = w.runs()
            first = order[starts]
            h, bucket, doc = w.keys[first], (w.route[first] % np.uint64(buckets)).astype(np.int64), low
            if narrow:
                order = np.argsort(bucket, kind="stable")
                h, bucket = h[order], bucket[order]
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                rows = [(int(bucket[a]), chunk, b"", b"", _blob(h[a:z], True)) for a, z in zip(cut, np.append(cut[1:], len(h)))]
                yield _entries(rows)
                continue
            if not later_only:
                more = high > low
                h, bucket, doc = np.concatenate((h, h[more])), np.append(bucket, bucket[more]), np.append(low, high[more])
            order = np.argsort(bucket * len(w.ids) + doc, kind="stable")
            rows = [(b, chunk, *x) for b, *x in _packed(bucket[order], w.ids[doc[order]], h[order])]
            yield _entries(rows)

    return run


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "chunk", "docs", "counts", "hashes"])


def _matches(later_only: bool, parts: int, narrow: bool):
    """For each bucket and chunk the keys that a document of another chunk has too (``later_only``: one with a smaller id
    than the chunk's least; of narrow keys those that another chunk has). One row for each bucket and chunk at most."""

    def close(chunks: list[int], docs: list[bytes], counts: list[bytes], hashes: list[bytes]) -> pa.RecordBatch | None:
        lists = [_keys([x], narrow) for x in hashes]
        h, c = np.concatenate(lists), np.repeat(np.array(chunks, np.int64), [len(x) for x in lists])
        if narrow:
            d = c
        else:
            ids = [loosen(x, 8, steps=True).view(np.int64) for x in docs]
            d = np.concatenate([np.repeat(i, loosen(x, n=len(i))) for i, x in zip(ids, counts)])
        order, starts = by_key(h)
        n = np.diff(np.append(starts, len(h)))
        twice = np.repeat(n > 1, n)
        order, n = order[twice], n[n > 1]
        if not len(order):
            return None
        h, d, c = h[order], d[order], c[order]
        starts = np.cumsum(n) - n
        low = np.repeat(np.minimum.reduceat(d, starts), n)
        hit = d > low if later_only and not narrow else np.repeat(np.maximum.reduceat(d, starts), n) > low
        h, c = h[hit], c[hit]
        if not len(h):
            return None
        order = np.argsort(c, kind="stable")
        h, c = h[order], c[order]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        dest = _home(c[cut], parts)
        return _batch([(int(k), int(c[a]), FLAGS, b"", b"", b"", _blob(h[a:z], narrow)) for k, a, z in zip(dest, cut, np.append(cut[1:], len(c)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "docs", "counts", "hashes"))):
                if bucket != now and now is not None:
                    if (out := close(*held)) is not None:
                        yield out
                    held = ([], [], [], [])
                now = bucket
                for h, x in zip(held, row):
                    h.append(x)
        if now is not None and (out := close(*held)) is not None:
            yield out

    return run


def repeated_windows(source: DataFrame, length: int, later_only: bool, parts: int, narrow: bool = False, shorter: tuple[int, bool] | None = None) -> DataFrame:
    """Rows of kind FLAGS: for chunks the keys of their windows that repeat in other chunks.

    The windows are shuffled as packed blobs, by a bucket from a hash. A passage that a third of the documents have is one
    entry a chunk for each of its windows, and these lie in as many buckets.
    """
    schema = "bucket int, chunk long, docs binary, counts binary, hashes binary"
    packed = source.mapInArrow(_emitter(length, parts, later_only, narrow, shorter), schema)
    return packed.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_matches(later_only, parts, narrow), ROWS)


def _hits(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts, flags in _grouped(batches):
            w = Windows(ids, [split(t) for t in texts], length, False)
            found = w.ids[np.unique(w.doc[w.repeated(_keys(flags, False), False)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found)], ["chunk", "doc_id"])

    return run


def _remover(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, flags in _grouped(batches):
            docs = [split(t) for t in texts]
            w = Windows(ids, docs, window, False)
            edge = np.zeros(int(w.n.sum()) + 1, np.int64)
            starts = w.at[w.repeated(_keys(flags, False), True)]
            edge[starts] += 1
            edge[starts + window] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            rows = []
            for doc_id, words, end in zip(ids, docs, np.cumsum(w.n).tolist()):
                own = stay[end - len(words) : end]
                kept = b" ".join(words if own.all() else compress(words, own.tolist()))
                rows.append((doc_id, len(words), int(len(words) - own.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _replayable(df: DataFrame) -> DataFrame:
    """``df`` if it only reads files, which gives the same rows in the same partitions each time; else a copy that does."""
    nodes = str(df._jdf.queryExecution().optimizedPlan()).strip().splitlines()
    return df if all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", x) for x in nodes) else durable(df)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Removes each word covered by a window of ``window`` words that also starts in a document with a smaller id. Windows
    are judged on the input. Words are runs of characters other than U+0020 and U+0009 to U+000D.

    Two levels: windows of the greatest power of two below ``window`` that repeat in any other document are found first, by
    32 bits of their hash (a false hit only costs work); ``window`` words are looked for only where those at the start and
    the end both repeat, by 128 bits. The texts are read in the same chunks each time. Inside a chunk all but the least
    document with a window are known to repeat it; only of that one the other chunks are asked. So copies are combined
    before the shuffle.

    Windows agree when a 128-bit hash of their words' 128-bit hashes does. Null and empty texts have no words. Texts shorter than the window lose nothing.
    Rows with a null id lose nothing and are no source; rows that repeat an id are judged as one document and each
    returned. An empty table gives an empty result; other columns are ignored.
    """
    cols = _replayable(_columns(docs, id_col, text_col))
    parts = partitions_for(cols, BUCKET_BYTES)
    texts, (short, _) = cols.mapInArrow(_compressed(parts), ROWS), levels(window)
    may = _together(texts, repeated_windows(cols, short, False, parts, narrow=True), parts)
    both = _together(texts, repeated_windows(may, window, True, parts, shorter=(short, True)), parts)
    return both.mapInArrow(_remover(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def repeat_levels(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, longest): the longest level, window * 2^k words, at which the document shares a window with another.

    Level-wise doubling: only windows whose two halves both repeated are hashed at twice the length, until none survives.
    Each level reads the chunks with survivors alone; documents without repeats are absent.
    """
    cols = _columns(docs, id_col, text_col)
    parts = partitions_for(cols, BUCKET_BYTES)
    source, length, found = _replayable(cols), window, None
    texts = durable(source.mapInArrow(_compressed(parts), ROWS))
    while True:
        flags = durable(repeated_windows(source, length, False, parts, shorter=None if found is None else (length // 2, False)))
        hit = durable(_together(texts, flags, parts).mapInArrow(_hits(length), "chunk long, doc_id long"))
        level = hit.select("doc_id", F.lit(length).cast("long").alias("longest"))
        found = level if found is None else found.unionAll(level)
        if hit.isEmpty():
            return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        texts = texts.join(hit.select("chunk").distinct(), "chunk", "left_semi")
        source = _together(texts, flags, parts)
        length *= 2


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).drop("kept_text")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda p: {'p': p, 'win': array_to_string(w[p:p + 12], ' ')})) AS x FROM d WHERE len(w) >= 13),
g AS (SELECT x.win AS win, min(doc_id) AS low FROM s GROUP BY 1),
c AS (SELECT DISTINCT s.doc_id, s.x.p + o.range AS q FROM s JOIN g ON s.x.win = g.win AND g.low < s.doc_id, range(13) AS o),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
j AS (SELECT k.doc_id, k.word, k.q, c.q IS NOT NULL AS gone FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.q = c.q),
t AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
