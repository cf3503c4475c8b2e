"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from swathe.llm.substring_dedup import window_hashes
from swathe.llm.words import mix, slices, word_hashes
from swathe.plans.components import components
from swathe.plans.durable import durable, partitions_for
from swathe.plans.skew import join_facts

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingle hashes whose bits are unpacked at a time (64 bytes each).
BLOCK = 100_000
#: Fingerprints of one tile side; a bucket with more is dealt out as pairs of tiles.
TILE = 2048
#: Sets of fewer shingles are compared without the fingerprint's estimate, which is rough for them.
SHORT = 64
#: Up to so many ids (8 bytes each) go to every executor instead of shuffling the texts; more are joined.
BROADCAST = 2_000_000
#: Units up to this size are compared by shifting the sorted array, larger ones tile by tile.
SMALL = 32
#: Pairs that are looked at one by one before those inside a part are dropped.
BATCH = 1024
LANES = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 (seed 42) of each 3-word shingle of the text with A-Z lower-cased; the whole sequence if it is shorter."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - SHINGLE + 1)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit of a text's fingerprint is 1 if set in over half of its shingle hashes; zero for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    at: list[int] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            n = np.array([len(h) for h in held])
            counts = _bit_counts(np.concatenate(held), np.concatenate(([0], np.cumsum(n)[:-1])))
            out[at] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        held.clear()
        at.clear()
        size = 0

    for i, text in enumerate(texts):
        h = shingle_hashes(text)
        if len(h) > BLOCK:
            counts = sum(_bit_counts(h[k : k + BLOCK], np.array([0]))[0].astype(np.int64) for k in range(0, len(h), BLOCK))
            out[i] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
        elif len(h):
            if size + len(h) > BLOCK:
                close()
            held.append(h)
            at.append(i)
            size += len(h)
    close()
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, ids in slices(batches, "text", "id"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprints(texts).view(np.int64))], ["id", "fp"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


class Forest:
    """Links that connect what the pairs given so far connect: one fewer than the nodes of each part."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.left: list[int] = []
        self.right: list[int] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, true: Callable[[int, int], bool] | None = None) -> None:
        """Pairs of nodes in order; one that joins two parts is a link if it is ``true``. Pairs inside a part are dropped
        many at a time, so that a dense group costs as many steps as it has members."""
        while len(a):
            labels = np.fromiter(map(self.root, range(len(self.parent))), np.int64, len(self.parent))
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
            for x, y in zip(a[:BATCH].tolist(), b[:BATCH].tolist()):
                r, s = self.root(x), self.root(y)
                if r != s and (true is None or true(x, y)):
                    self.parent[max(r, s)] = min(r, s)
                    self.left.append(x)
                    self.right.append(y)
            a, b = a[BATCH:], b[BATCH:]


def _tiles(fp: np.ndarray, ones: np.ndarray, side: np.ndarray, cross: bool, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the index pairs within the radius among rows sorted by ``ones``; tile pairs whose counts lie
    apart are skipped. One tile's pairs are held at a time."""
    step, forest = 512, Forest(len(fp))
    for i in range(0, len(fp), step):
        for j in range(i, len(fp), step):
            if int(ones[j]) - int(ones[min(i + step, len(fp)) - 1]) > radius:
                break
            near = sum(np.bitwise_count(fp[i : i + step, None, w] ^ fp[None, j : j + step, w]).astype(np.uint16) for w in range(fp.shape[1])) <= radius
            if cross:
                near &= side[i : i + step, None] != side[None, j : j + step]
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            forest.add(a + i, b + j)
    return forest.left, forest.right


def _compare(unit: np.ndarray, cross: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links inside each run of equal ``unit`` (rows sorted by unit, then bit count)."""
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int32)
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(unit)])))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    few = np.repeat(sizes <= SMALL, sizes)
    u, f, r, o = unit[few], fp[few], rep[few], ones[few]
    for d in range(1, SMALL):
        same = u[d:] == u[:-d]
        if not same.any():
            break
        near = same & (o[d:] - o[:-d] <= radius)
        near[near] = _apart(f[d:][near], f[:-d][near]) <= radius
        left.append(r[:-d][near])
        right.append(r[d:][near])
    for k in np.flatnonzero(sizes > SMALL):
        s = slice(starts[k], starts[k] + sizes[k])
        a, b = _tiles(fp[s], ones[s], side[s], bool(cross[starts[k]]), radius)
        left.append(rep[s][a])
        right.append(rep[s][b])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (left, right)], ["a", "b"])


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi", "side", "rep")]
            now.append(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(len(now[0]), -1))
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            key, lo, hi = held[:3]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield run(held, new, slice(0, last))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            key, lo, hi = held[:3]
            yield run(held, np.concatenate(([True], np.zeros(len(key) - 1, bool))), slice(0, len(key)))

    def run(held: list[np.ndarray], new: np.ndarray, s: slice) -> pa.RecordBatch:
        _, lo, hi, side, rep, fp = (x[s] for x in held)
        return _compare(np.cumsum(new[s]), lo != hi, side, fp, rep, radius)

    return link


def _link(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b): links between the rows (fp binary, ones, rep, keys) that share a key and whose fp are within the radius.

    Buckets of a key are compared in full, tile against tile; those above ``tile`` rows are dealt out as pairs of tiles
    over many tasks. Of the links of a pair of tiles a spanning forest is returned, so that a dense group costs as many
    links as it has members.
    """
    units = _units(prints, "fp", ["fp", "rep", "ones"], tile)
    parts = partitions_for(prints, 32 << 20, 6)
    units = units.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "ones").drop("ones")
    return units.mapInArrow(_linker(radius), "a long, b long")


def _units(prints: DataFrame, by: str, columns: list[str], tile: int) -> DataFrame:
    """(key, lo, hi, side, *columns): rows that share a key; a key with more than ``tile`` is dealt out as pairs of tiles."""
    keyed = prints.select(*columns, F.explode(F.array_distinct("keys")).alias("key"))
    sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = join_facts(keyed, sizes, ["key"], ["n"], "n", F.col(by), prints.select(F.sum(F.size("keys"))).first()[0] or 0).where("n is not null")
    rows = rows.withColumn("s", F.floor((F.col("n") + tile - 1) / tile).cast("int")).withColumn("t", F.pmod(F.xxhash64(by), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return rows.select("key", F.least("t", "other").alias("lo"), F.greatest("t", "other").alias("hi"), (F.col("t") > F.col("other")).cast("int").alias("side"), *columns)


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between the rows (fp long, rep) with distinct fp at Hamming distance ``radius`` (2 at most) or less.

    Exact by the pigeonhole principle: of four 16-bit lanes at most two differ, so two lanes agree; each of the six pairs
    of lanes is a bucket key.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four lanes cover radius 0 to 2")
    lane = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    keys = [F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(lane[i], 16)).bitwiseOR(lane[j]) for k, (i, j) in enumerate(LANES)]
    return _link(prints.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.bit_count("fp").alias("ones"), "rep", F.array(*keys).alias("keys")), radius, tile)


def _classes(signed: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """Adds to rows (id, fp) the least id that links (between ``rep``) reach from their fingerprint's class."""
    found = components(links, "a", "b")
    classes = durable(
        prints.join(found, prints["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    )
    return join_facts(signed.select("id", "fp"), classes, ["fp"], ["component_id"], "n", F.col("id"), signed.count())


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Texts with equal fingerprints are one class; classes are linked at ``radius`` or fewer differing bits, exactly and
    without any cap. Null and empty texts have fingerprint zero and link like any other. Texts of under three words are
    one shingle. Rows that repeat an id are rows of their own. An empty table gives an empty result. Whole texts are read,
    however long: the bits are counted in blocks. The fingerprints are materialised, so a lost executor repeats no text.
    """
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = durable(cols.mapInArrow(_sign, "id long, fp long"))
    prints = durable(signed.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    links = durable(link_fingerprints(prints.select("fp", "rep"), radius))
    return _classes(signed, prints, links).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signatures(texts: list[bytes], shingle: int, words: int, bands: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of ``words`` * 64 bits, ``bands`` bucket keys) from a text's distinct shingles. A key hashes ``each``
    of the text's least hashes."""
    return _signatures(*shingle_sets(texts, shingle), words, bands, each)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, sorted inside each text; how many each text has): shingles of
    ``shingle`` words, A-Z lower-cased; the whole sequence if it is shorter."""
    docs = [t.lower().split() for t in texts]
    n = np.array([len(d) for d in docs], np.int64)
    h = word_hashes([w for d in docs for w in d])
    end = np.repeat(np.cumsum(n), n)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.flatnonzero(np.arange(len(h)) + shingle <= end)
    parts, of = [window_hashes(h, shingle)[at] if len(at) else h[:0]], [owner[at]]
    for i in np.flatnonzero((n > 0) & (n < shingle)):
        own = word_hashes(docs[i])
        x = own[:1]
        for k in range(1, len(own)):
            x = mix(x, own[k : k + 1])
        parts.append(mix(x, np.full(1, len(own), np.uint64)))
        of.append(np.array([i]))
    h, of = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    once = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, bool)
    return h[once], np.bincount(of[once], minlength=len(texts))


def _signatures(h: np.ndarray, total: np.ndarray, words: int, bands: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(total)), total)
    keys = np.zeros((len(total), bands), np.uint64)
    counts = np.zeros((len(total), words * 64), np.int64)
    least = np.full((len(total), bands * each), np.iinfo(np.uint64).max)
    for s in range(0, len(h), BLOCK):
        x, o = h[s : s + BLOCK], of[s : s + BLOCK]
        starts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        for k in range(words):
            counts[o[starts], k * 64 : k * 64 + 64] += _bit_counts(mix(x, np.full(1, 2 * k + 1, np.uint64)), starts)
        for k in range(bands * each):
            least[o[starts], k] = np.minimum(least[o[starts], k], np.minimum.reduceat(mix(x, np.full(1, 2 * k + 2, np.uint64)), starts))
    fp = np.packbits(counts * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)
    for b in range(bands):
        x = np.full(len(total), b, np.uint64)
        for k in range(each):
            x = mix(x, least[:, b * each + k])
        keys[:, b] = x
    return fp, keys


def near_radius(similarity: float, bits: int, deviations: float = 1) -> int:
    """Differing bits within which texts of this Jaccard similarity stay: a bit differs with a chance of the angle between
    their sets over pi; so many standard deviations are added (one keeps five cases of six, six lose about 1 in 10^9)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets of hashes is at least ``similarity``; two empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _confirm(fp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links of a unit: a spanning forest of its similar pairs, tile by tile.

    Candidates have set sizes that allow the similarity, and fingerprints within the radius or a set too short for the
    estimate. Each is tested on the sets themselves unless confirmed links join its ends already; in a tile those that look
    closest come first.
    """
    n = np.array([len(x) for x in sets])
    step, short, forest = 512, n < SHORT, Forest(len(sets))
    for i in range(0, len(fp), step):
        for j in range(i, len(fp), step):
            x, y = slice(i, i + step), slice(j, j + step)
            apart = sum(np.bitwise_count(fp[x, None, w] ^ fp[None, y, w]).astype(np.uint16) for w in range(fp.shape[1]))
            may = (apart <= radius) | short[x, None] | short[None, y]
            may &= np.minimum(n[x, None], n[None, y]) >= similarity * np.maximum(n[x, None], n[None, y])
            if cross:
                may &= side[x, None] != side[None, y]
            if i == j:
                may = np.triu(may, 1)
            a, b = np.nonzero(may)
            order = np.argsort(apart[a, b], kind="stable")
            forest.add(a[order] + i, b[order] + j, lambda p, q: similar(sets[p], sets[q], similarity))
    return forest.left, forest.right


def _confirmer(radius: int, similarity: float):
    """Links of each unit of a stream that is sorted by unit; one unit is held at a time."""
    names = ("key", "lo", "hi", "side", "class", "fp", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        now, rows = None, []

        def close() -> None:
            side, nodes, fp, sets = zip(*rows)
            prints = np.frombuffer(b"".join(fp), np.uint64).reshape(len(rows), -1)
            a, b = _confirm(prints, [np.frombuffer(x, np.uint64) for x in sets], np.array(side), now[1] != now[2], radius, similarity)
            left.extend(nodes[x] for x in a)
            right.extend(nodes[x] for x in b)

        for batch in batches:
            for key, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if (key, lo, hi) != now:
                    if len(rows) > 1:
                        close()
                    now, rows = (key, lo, hi), []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            left.clear()
            right.clear()
        if len(rows) > 1:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _link_similar(cols: DataFrame, signed: DataFrame, prints: DataFrame, shingle: int, radius: int, similarity: float, tile: int) -> DataFrame:
    """(a, b): links between the classes of ``prints`` that share a key and whose sets are similar. The sets are not kept
    with ``signed``: only texts that share a key with another are read again for them."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in slices(batches, "text"):
            classes, sets = _classed(*shingle_sets(texts, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sets, pa.binary())], ["class", "set"])

    units = durable(_units(prints, "class", ["class", "fp"], tile))
    shared = durable(units.select("class").distinct())
    ids = durable(signed.select("id", "class").join(shared, "class", "left_semi").select(F.col("id").alias("__id")).distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    sets = cols.join(few, cols["id"].eqNullSafe(few["__id"]), "left_semi").select("text").mapInArrow(again, "class long, set binary")
    sets = durable(sets.groupBy("class").agg(F.first("set").alias("set")))
    parts = partitions_for(prints, 32 << 20, 6)
    units = units.join(sets, "class").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "class")
    return units.mapInArrow(_confirmer(radius, similarity), "a long, b long")


def _classed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(a 64-bit hash of each text's set, the sets as bytes)."""
    sets = [h[b - k : b].tobytes() for b, k in zip(np.cumsum(n).tolist(), n.tolist())]
    return np.fromiter(map(xxh3_64_intdigest, sets), np.uint64, len(sets)).view(np.int64), sets


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8, bands: int = 8, each: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, component_id (the smallest id reachable over links between similar texts).

    Texts link when the Jaccard similarity of their distinct shingles is at least ``similarity``, by the 64-bit hashes of
    the shingles. Candidates are texts that share ``each`` least shingle hashes, ``bands`` times over (at similarity 0.8 in
    0.997 of all cases, more above), and whose SimHash fingerprints of ``words`` * 64 bits are within six deviations of
    what the similarity gives; sets of under SHORT shingles are candidates by bucket alone. Every link is then confirmed on
    the sets. Texts with equal sets are one class, told by a 64-bit hash of the set.

    Null and empty texts are one class. Texts that are shorter than a shingle are one shingle. Rows that repeat an id are
    rows of their own; an empty table gives an empty result; whole texts are read, however long.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids in slices(batches, "text", "id", size=8 << 20, overhead=words * 512 + 4096):
            h, n = shingle_sets(texts, shingle)
            fp, keys = _signatures(h, n, words, bands, each)
            classes = _classed(h, n)[0]
            lists = pa.ListArray.from_arrays(np.arange(0, len(ids) * bands + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            columns = [pa.array(ids, pa.int64()), pa.array(classes), pa.array([x.tobytes() for x in fp], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "class", "fp", "keys"])

    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = durable(cols.mapInArrow(sign, "id long, class long, fp binary, keys array<long>"))
    prints = durable(signed.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    links = durable(_link_similar(cols, signed, prints, shingle, near_radius(similarity, words * 64, 6), similarity, TILE))
    found = components(links, "a", "b")
    linked = durable(prints.join(found, prints["class"] == found["node"]).select("class", "component", "rep"))
    least = linked.join(linked.groupBy("component").agg(F.min("rep").alias("least")), "component").select("class", "least")
    classes = durable(prints.join(least, "class", "left").select("class", "n", F.coalesce("least", "rep").alias("component_id")))
    out = join_facts(signed.select("id", "class"), classes, ["class"], ["component_id"], "n", F.col("id"), signed.count())
    return out.select(F.col("id").alias(id_col), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
