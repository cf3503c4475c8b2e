"""Language-model scoring with a hierarchical Pitman-Yor model: restaurants of contexts that share a parent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from swathe.llm.words import crc_fold, give_back, loosen, mix, slices, small, squeeze, word_hashes
from swathe.plans.durable import durable, plan_bytes

#: The token after each text. As nothing follows it inside a text, it stands for the start as a context too.
END = xxh3_64_intdigest(b"\n")
#: Tokens and documents that a task packs at a time; file bytes of input for each bucket of words.
CHUNK, CHUNK_DOCS, BUCKET_BYTES = 2_400_000, 65_000, 16 << 20
#: A word is routed by its context too if it has at least this share of the tokens of the routing sample.
HOT_SHARE, ROUTING_DOCS = 1000, 4000
#: Kind of a row: a chunk's header, or 1 + how many of the chunk's documents are learnt from (these come first).
HEADER = 0
#: Customers of a dish up to this place are seated one at a time in a proposal, later ones by waiting times.
STEPS = 32
#: Share of the root's base that is the one unseen word; the rest is even over the known words.
UNSEEN = 0.5
THETA, THETA_ROOT = 1.0, 1.0


@dataclass
class Totals:
    """What all buckets share: fixed in size, whatever the corpus. Per hot word; contexts have a table of their own."""

    tokens: float
    words: float
    tables: float  # of all contexts: the root's customers
    hot_tokens: np.ndarray
    hot_tables: np.ndarray
    hot_root: np.ndarray
    root_tables: float
    ones: np.ndarray  # pairs with 1 and 2 customers, words with 1 and 2 tables
    theta: float = THETA
    discounts: tuple[float, float] | None = None  # given ones, of the contexts and the root

    @property
    def discount(self) -> float:
        return self.discounts[0] if self.discounts else _discount(self.ones[0], self.ones[1])

    @property
    def root_discount(self) -> float:
        return self.discounts[1] if self.discounts else _discount(self.ones[2], self.ones[3])

    def base(self, known: np.ndarray) -> np.ndarray:
        """What the root gives to a new table, times its chance of one, for known words and the unseen one."""
        new = THETA_ROOT + self.root_discount * self.root_tables
        return new * np.where(known, (1 - UNSEEN) / max(self.words, 1), UNSEEN)


def _discount(one: float, two: float) -> float:
    """The usual estimate from the numbers of items seen once and twice, kept off 0 and 1."""
    return float(np.clip(one / max(one + 2 * two, 1.0), 0.05, 0.95))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after shifting by seven."""
    y = x + 7
    shift = sum(np.log(x + k) for k in range(7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


STRENGTHS = np.logspace(-1, 5, 61)


def likelihoods(tokens: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """The log likelihood of restaurants' numbers of customers and tables for each of STRENGTHS, which all would share."""
    used = tokens > 0
    c, t = tokens[used], np.maximum(tables[used], 1)
    return np.array([(_lgamma(x / d + t) - _lgamma(x / d + np.ones(1)) - _lgamma(x + c) + _lgamma(x + np.ones(1))).sum() for x in STRENGTHS])


def _label(parts: int) -> np.ndarray:
    """For each partition a number that Spark's hash sends there, so that buckets fill partitions evenly."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < parts:
        k = x * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = 42 ^ k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        found.setdefault((h - (h >> 31 << 32)) % parts, x)
        x += 1
    return np.array([found[p] for p in range(parts)], np.int32)


Path = tuple[np.ndarray, np.ndarray]
Opening = Callable[[np.ndarray, np.ndarray], np.ndarray]


def propose(customers: np.ndarray, strength: np.ndarray, d: float, rng: np.random.Generator) -> Path:
    """(dish, place) of the customers that open a table, but each dish's first; sorted by dish, then place.

    Customers are seated in turn, where with n of c seated at t tables a new one has odds ``strength`` * ((n + 1) / c)^d
    against n - d * t: a table that opens early costs those that come later, and this is how much of it is left. From place
    STEPS on the next opening is drawn from the integral of these odds.
    """
    order = np.argsort(-customers, kind="stable")
    c, s = customers[order], strength[order]
    share = s / c**d
    t, own, when = np.ones(len(c)), [np.empty(0, np.int64)], [np.empty(0)]
    for n in range(1, min(STEPS, int(c[0]) if len(c) else 0)):
        m = int(np.searchsorted(-c, -n))
        odds = share[:m] * (n + 1) ** d
        new = np.flatnonzero(rng.random(m) * (n - d * t[:m] + odds) < odds)
        t[new] += 1
        own.append(order[new])
        when.append(np.full(len(new), float(n)))
    live = np.arange(int(np.searchsorted(-c, -STEPS)))
    n = np.full(len(live), float(STEPS))
    with np.errstate(over="ignore"):
        while len(live):
            rate = _rate(share[live], n, t[live], d)
            place = np.maximum(np.floor((n**d - np.log(rng.random(len(live))) / rate) ** (1 / d)), n)
            on = place < c[live]
            live, n = live[on], place[on] + 1
            t[live] += 1
            own.append(order[live])
            when.append(n - 1)
    own, when = np.concatenate(own), np.concatenate(when)
    by = np.argsort(own, kind="stable")
    return own[by], when[by]


def _rate(share: np.ndarray, start: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    return np.maximum(share / d * start / (start - d * tables), 1e-300)


def log_weight(customers: np.ndarray, path: Path, strength: np.ndarray, d: float, opening: Opening) -> np.ndarray:
    """For each dish the log of how likely the model makes its path over how likely ``propose`` does.

    In the model a customer that joins has the weight n - d * t, one that opens a table after k others ``opening(k, dish)``.
    """
    own, when = path
    t = 1 + np.bincount(own, minlength=len(customers))
    share = strength / customers**d
    dish, last = np.repeat(np.arange(len(t)), t), np.cumsum(t) - 1
    tables = (np.arange(len(dish)) - (last - t + 1)[dish] + 1).astype(np.float64)
    opens = np.ones(len(dish), bool)
    opens[last] = False
    out = np.bincount(dish[opens], np.log(opening(tables[opens], dish[opens])), len(t)).astype(np.float64)

    order = np.argsort(-customers, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    early = when < STEPS
    at = np.zeros((STEPS, len(order)), bool)
    at[when[early].astype(np.int64), rank[own[early]]] = True
    c, odds_c, now, sums = customers[order], share[order], np.ones(len(order)), np.zeros(len(order))
    for n in range(1, min(STEPS, int(c[0]) if len(c) else 0)):
        m = int(np.searchsorted(-c, -n))
        odds, new = odds_c[:m] * (n + 1) ** d, at[n, :m]
        join = n - d * now[:m]
        sums[:m] += np.log(join + odds) - np.log(np.where(new, odds, 1.0))
        now[:m] += new
    out[order] += sums

    start, end = np.ones(len(dish)), np.empty(len(dish))
    end[opens], end[last] = when, customers
    start[tables > 1] = when + 1
    start = np.maximum(start, STEPS)
    k = np.flatnonzero((end > start) | (opens & (end >= STEPS)))
    a, b, v = start[k], end[k], d * tables[k]
    rate, o = _rate(share[dish[k]], a, tables[k], d), opens[k]
    late = _lgamma(b - v) - _lgamma(a - v) + rate * (b**d - a**d)
    late[o] -= np.log(np.maximum(-np.expm1(-rate[o] * ((b[o] + 1) ** d - b[o] ** d)), 1e-300))
    return out + np.bincount(dish[k], late, len(t))


def reseat(customers: np.ndarray, path: Path | None, d: float, opening: Opening, rng: np.random.Generator, moves: int = 1) -> Path:
    """Reseats all customers of each dish (two or more) given the rest: a block of the Gibbs sampler. A seating in turn is
    proposed and taken or left by the Metropolis-Hastings rule, so the model's own conditional is what stays the same."""
    every = np.arange(len(customers))
    strength = np.maximum(opening(np.ones(len(customers)), every), 1e-12)
    if path is None:
        path = propose(customers, strength, d, rng)
    now = log_weight(customers, path, strength, d, opening)
    for _ in range(moves):
        new = propose(customers, strength, d, rng)
        other = log_weight(customers, new, strength, d, opening)
        take = np.log(rng.random(len(customers))) < other - now
        kept, got = ~take[path[0]], take[new[0]]
        own, when = np.concatenate((path[0][kept], new[0][got])), np.concatenate((path[1][kept], new[1][got]))
        by = np.argsort(own, kind="stable")
        path, now = (own[by], when[by]), np.where(take, other, now)
    return path


def tables_of(customers: np.ndarray, path: Path, live: np.ndarray) -> np.ndarray:
    out = np.minimum(customers, 1.0)
    out[live] += np.bincount(path[0], minlength=len(live))
    return out


def root_seating(customers: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator, moves: int = 3) -> np.ndarray:
    """Tables of each word in the root restaurant, which serves new tables from a fixed base."""
    live = np.flatnonzero(customers > 1)
    return tables_of(customers, reseat(customers[live], None, d, lambda k, i: base[live][i], rng, moves), live)


def _packer(buckets: int, hot: np.ndarray):
    names, labels = ["bucket", "chunk", "kind", *"abcdef"], _label(buckets)

    def close(chunk: int, ids: list, n: list[np.ndarray], w: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.concatenate(n)
        train = np.array([i is not None and crc_fold(i) != 1 for i in ids])
        order = np.argsort(~train, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        doc, kind = np.repeat(rank, lengths), 1 + int(train.sum())
        ids, lengths = [ids[k] for k in order.tolist()], lengths[order]
        words = np.concatenate(w)
        w.clear()
        uw, at = np.unique(words, return_inverse=True)
        del words
        before = np.concatenate((at[-1:], at[:-1]))  # the word before; at the start of a text the END of another
        width = len(uw).bit_length()
        if 2 * width <= 47:
            key, times = np.unique((at << (width + 16)) | (before << 16) | doc, return_counts=True)
            wi, ki, di = key >> (width + 16), key >> 16 & ((1 << width) - 1), key & 0xFFFF
        else:
            pairs, pair = np.unique((at << 32) | before, return_inverse=True)
            key, times = np.unique((pair << 16) | doc, return_counts=True)
            wi, ki, di = pairs[key >> 16] >> 32, pairs[key >> 16] & 0xFFFFFFFF, key & 0xFFFF
        del key, at, before, doc
        wi, ki, di, times = wi.astype(np.int32), ki.astype(np.int32), di.astype(np.uint16), times.astype(np.uint32)
        route = uw[wi]
        if len(hot):
            is_hot = np.isin(uw, hot)
            both = is_hot[wi] & is_hot[ki]
            route = np.where(both, mix(route, uw[ki]), np.where(is_hot[wi], uw[ki], route))
        bucket = (mix(route, route) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        del route
        bucket, wi, ki, di, times = bucket[order], wi[order], ki[order], di[order], times[order]
        del order
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = [(int(labels[chunk % buckets]), chunk, HEADER, np.array([0 if i is None else i for i in ids], np.int64).tobytes(), lengths.astype(np.uint32).tobytes(),
                 np.array([i is None for i in ids], np.uint8).tobytes(), b"", b"", b"")]
        for s, z in zip(cut, np.append(cut[1:], len(bucket))):
            x = wi[s:z]
            new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            runs = np.diff(np.append(new, len(x))).astype(np.uint32)
            contexts, c = np.unique(ki[s:z], return_inverse=True)
            row = (squeeze(uw[x[new]], True), squeeze(runs), squeeze(small(c), True), squeeze(di[s:z]), squeeze(small(times[s:z])), squeeze(uw[contexts], True))
            rows.append((int(labels[bucket[s]]), chunk, kind, *row))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        n: list[np.ndarray] = []
        w: list[np.ndarray] = []
        size = 0
        for texts, doc_ids in slices(batches, "text", "doc_id"):
            for s in range(0, len(texts), CHUNK_DOCS):
                docs = [t.lower().split() for t in texts[s : s + CHUNK_DOCS]]
                lengths = np.array([len(d) + 1 for d in docs], np.int64)
                if ids and (size + lengths.sum() > CHUNK or len(ids) + len(docs) > CHUNK_DOCS):
                    yield close(chunk, ids, n, w)
                    chunk, ids, n, w, size = chunk + 1, [], [], [], 0
                ends = np.cumsum(lengths)
                words = np.full(int(ends[-1]), END, np.uint64)
                inner = np.ones(len(words), bool)
                inner[ends - 1] = False
                words[inner] = word_hashes([x for d in docs for x in d])
                ids += doc_ids[s : s + CHUNK_DOCS]
                n.append(lengths)
                w.append(words)
                size += len(words)
        if ids:
            yield close(chunk, ids, n, w)

    return run


class Bucket:
    """The (word, context) pairs of a bucket with their training counts, and the entries of its chunks. ``contexts`` are
    sorted by shard, where the totals of a context meet, then by hash."""

    def __init__(self, rows: list[tuple], hot: np.ndarray, shards: int):
        a = [loosen(r[2], 8, steps=True) for r in rows]
        self.words, inverse = np.unique(np.concatenate(a), return_inverse=True)
        runs = np.concatenate([loosen(r[3], 4) for r in rows])
        docs = [loosen(r[5], 2) for r in rows]
        counts = [len(d) for d in docs]
        lists = [loosen(r[7], 8, steps=True) for r in rows]
        contexts, at = np.unique(np.concatenate(lists), return_inverse=True)
        shard = (mix(contexts, contexts) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.contexts, self.cuts = contexts[order], np.searchsorted(shard[order], np.arange(shards + 1))
        starts = np.cumsum([0, *map(len, lists)])
        context = np.concatenate([rank[at[s : s + len(x)]][loosen(r[4], n=n, steps=True)] for r, n, s, x in zip(rows, counts, starts, lists)])
        key = np.repeat(inverse.astype(np.int64), runs) << 32 | context
        self.doc = np.concatenate(docs)
        self.times = np.concatenate([loosen(r[6], n=n).astype(np.uint32) for r, n in zip(rows, counts)])
        self.chunks, self.ends = [r[0] for r in rows], np.cumsum(counts)
        del context, inverse
        pair, entry = np.unique(key, return_inverse=True)
        del key
        self.entry = entry.astype(np.int32)
        del entry
        self.word, self.context = pair >> 32, pair & 0xFFFFFFFF
        train = self.times * np.concatenate([d < r[1] - 1 for r, d in zip(rows, docs)])
        self.count = np.bincount(self.entry, train, len(pair))
        self.word_count = np.bincount(self.word, self.count, len(self.words))
        self.hot = np.full(len(self.words), -1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
            self.hot = np.where(hot[at] == self.words, at, -1)

    def read(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(customers, tables) of each context over all buckets."""
        rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("shard", "tokens", "tables"))))
        sizes = np.diff(self.cuts).tolist()
        return tuple(np.concatenate([loosen(r[k], n=sizes[r[0]]) for r in rows]).astype(np.float64) for k in (1, 2))

    def tell(self, bucket: int, tables: np.ndarray, v: np.ndarray) -> list[tuple]:
        """Messages: this bucket's customers and tables of each context to the context's shard, and ``v`` to one of 16."""
        n, t = (np.bincount(self.context, x, len(self.contexts)) for x in (self.count, tables))
        out: list[tuple] = [(bucket % min(16, len(self.cuts) - 1), bucket, v.tobytes(), b"", b"", b"")]
        for shard in np.flatnonzero(np.diff(self.cuts)):
            s = slice(self.cuts[shard], self.cuts[shard + 1])
            out.append((int(shard), bucket, b"", squeeze(self.contexts[s], True), squeeze(small(n[s])), squeeze(small(t[s]))))
        return out

    def seated(self, t: Totals, context_tables: np.ndarray, sweeps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(tables of each pair, root tables of each word) after ``sweeps`` in which every dish is reseated given the rest:
        this bucket as it is now, the others as the totals tell. The same arguments give the same seating."""
        live = np.flatnonzero(self.count > 1)
        c, word = self.count[live], self.word[live]
        others, known, d, d0 = context_tables[self.context[live]], self.known(t), t.discount, t.root_discount
        base, tables, path = t.base(known), np.minimum(self.count, 1.0), None
        root = self.root(t, tables, base, rng)
        for _ in range(sweeps):
            mine = tables[live]
            rest, size = np.maximum(others - mine, 0), np.maximum(self.customers(t, tables)[word] - mine, 0)
            shelf, all_ = np.minimum(root[word], size), THETA_ROOT + np.maximum(t.tables - mine, 0)

            def opening(k: np.ndarray, i: np.ndarray) -> np.ndarray:
                served = np.maximum(size[i] + k - d0 * np.maximum(shelf[i], np.minimum(k, 1)), 0) + base[word[i]]
                return (t.theta + d * (rest[i] + k)) * served / (all_[i] + k)

            path = reseat(c, path, d, opening, rng)
            tables = tables_of(self.count, path, live)
            root = self.root(t, tables, base, rng)
        return tables, root

    def known(self, t: Totals) -> np.ndarray:
        return np.where(self.hot >= 0, t.hot_tokens[self.hot] if len(t.hot_tokens) else 0, self.word_count) > 0

    def customers(self, t: Totals, tables: np.ndarray) -> np.ndarray:
        """The root's customers of each word: tables in all contexts; of hot words, which other buckets have too, the totals'."""
        out, shared = np.bincount(self.word, tables, len(self.words)), self.hot >= 0
        out[shared] = t.hot_tables[self.hot[shared]]
        return out

    def root(self, t: Totals, tables: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        customers, shared = self.customers(t, tables), self.hot >= 0
        customers[shared] = 0
        out = root_seating(customers, base, t.root_discount, rng)
        out[shared] = t.hot_root[self.hot[shared]]
        return out

    def parent(self, t: Totals, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The root's predictive probability of each word, given a seating and its totals."""
        root = np.where(self.hot >= 0, t.hot_root[self.hot] if len(t.hot_root) else 0, root)
        return (np.maximum(self.customers(t, tables) - t.root_discount * root, 0) + t.base(self.known(t))) / (THETA_ROOT + t.tables)

    def predictive(self, t: Totals, tokens: np.ndarray, context_tables: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The probability of each pair's word after its context, given a seating and its totals: over all words they add
        up to one."""
        parent, c, d = self.parent(t, tables, root)[self.word], tokens[self.context], t.discount
        lower = (t.theta + d * context_tables[self.context]) * parent
        return np.where(c > 0, (np.maximum(self.count - d * tables, 0) + lower) / (t.theta + c), parent)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(bucket, data rows, headers) of a stream sorted by bucket."""
    now, rows, heads = None, [], []
    for batch in batches:
        for bucket, chunk, kind, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "kind", *"abcdef"))):
            if bucket != now and now is not None:
                yield now, rows, heads
                rows, heads = [], []
            now = bucket
            (heads if kind == HEADER else rows).append((chunk, kind, *blobs))
    if now is not None:
        yield now, rows, heads


def _vector(t: Totals) -> np.ndarray:
    return np.concatenate(([t.tokens, t.words, t.root_tables, t.tables], t.ones, t.hot_tokens, t.hot_tables))


def _totals(v: np.ndarray, hot: int) -> Totals:
    return Totals(v[0], v[1], v[3], v[8 : 8 + hot], v[8 + hot :], np.zeros(hot), v[2], v[4:8])


MESSAGE = "shard int, bucket int, v binary, contexts binary, tokens binary, tables binary"
ANSWER = "bucket int, shard int, v binary, tokens binary, tables binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for c, (name, kind) in zip(columns, fields)})


def _merging(d: float | None, width: int):
    """Adds up the messages of each shard, a stream sorted by shard: every bucket is told the customers and tables of the
    contexts that it asked for, in its order; row -1 has the sums of the vectors and, given ``d``, the likelihoods."""

    def close(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        v = sum((np.frombuffer(r[1]) for r in rows if r[1]), np.zeros(width))
        rows = [r for r in rows if r[2]]
        fit, out = np.zeros(len(STRENGTHS)), []
        if rows:
            lists = [loosen(r[2], 8, steps=True) for r in rows]
            contexts, at = np.unique(np.concatenate(lists), return_inverse=True)
            sizes = [len(x) for x in lists]
            n, t = (np.bincount(at, np.concatenate([loosen(r[k], n=size) for r, size in zip(rows, sizes)]), len(contexts)) for k in (3, 4))
            if d is not None:
                fit = likelihoods(n, t, d)
            ends = np.cumsum(sizes)
            out = [(r[0], shard, b"", squeeze(small(n[at[e - size : e]])), squeeze(small(t[at[e - size : e]]))) for r, size, e in zip(rows, sizes, ends)]
        return _table([*out, (-1, shard, np.concatenate((v, fit)).tobytes(), b"", b"")], ANSWER).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "bucket", "v", "contexts", "tokens", "tables"))):
                if shard != now and now is not None:
                    yield close(now, rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if now is not None:
            yield close(now, rows)

    return run


def _meet(messages: DataFrame, shards: int, hot: int, d: float | None) -> tuple[DataFrame, Totals, float]:
    """(what each bucket is told about its contexts, the sums of the buckets' vectors, the likeliest concentration)."""
    width = 8 + 2 * hot
    sorted_ = messages.repartitionById(shards, "shard").sortWithinPartitions("shard", "bucket")
    answers = durable(sorted_.mapInArrow(_merging(d, width), ANSWER))
    rows = sorted((r[0], bytes(r[1])) for r in answers.where("bucket = -1").select("shard", "v").collect())
    v = sum((np.frombuffer(x) for _, x in rows), np.zeros(width + len(STRENGTHS)))
    theta = float(STRENGTHS[int(np.argmax(v[width:]))]) if v[width:].any() else THETA
    return answers.where("bucket >= 0").drop("v"), _totals(v[:width], hot), theta


def _counting(hot: np.ndarray, shards: int):
    """Counts, with one table for each pair to begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows, _ in _buckets(batches):
            if rows:
                b = Bucket(rows, hot, shards)
                seen, own = b.count > 0, b.hot < 0
                kinds = np.bincount(b.word[seen], minlength=len(b.words))
                per_hot = [np.bincount(b.hot[~own], x[~own], len(hot)) if len(hot) else np.empty(0) for x in (b.word_count, kinds)]
                ones = np.array([(b.count == 1).sum(), (b.count == 2).sum(), (own & (kinds == 1)).sum(), (own & (kinds == 2)).sum()])
                v = _vector(Totals(b.count.sum(), (own & (b.word_count > 0)).sum(), seen.sum(), *per_hot, np.empty(0), 0.0, ones))
                yield from _table(b.tell(bucket, seen, v), MESSAGE).to_batches()

    return run


def _data(packed: pa.Table) -> tuple[int, list[tuple], list[tuple]]:
    give_back()  # what the task before this one has left
    return next(_buckets(iter(packed.to_batches())), (0, [], []))


def _sampling(t: Totals, hot: np.ndarray, sweeps: int, seed: list[int], shards: int):
    """Sweeps inside a bucket given the totals; what the seating adds up to."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, rows, _ = _data(packed)
        if not rows:
            return _table([], MESSAGE)
        b = Bucket(rows, hot, shards)
        tables, root = b.seated(t, b.read(answers)[1], sweeps, np.random.default_rng([*seed, bucket]))
        own = b.hot < 0
        sums = np.bincount(b.word, tables, len(b.words))
        hot_tables = np.bincount(b.hot[~own], sums[~own], len(hot)) if len(hot) else np.empty(0)
        ones = np.array([0, 0, (own & (sums == 1)).sum(), (own & (sums == 2)).sum()])
        return _table(b.tell(bucket, tables, _vector(Totals(0, 0, tables.sum(), np.zeros(len(hot)), hot_tables, np.empty(0), root[own].sum(), ones))), MESSAGE)

    return run


REPLY = "chunk long, kind int, a binary, b binary, c binary, d binary"


def _scoring(rounds: list[Totals], hot: np.ndarray, sweeps: int, samples: int, seed: int, shards: int):
    """For each chunk the sums over its documents' entries: known tokens, base and log10 of the averaged predictive.

    The last ``samples`` rounds of sampling are gone through again, with the same numbers, so each has the very seating
    that its totals are of. ``answers`` has those of every round since the one before them.
    """

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, rows, heads = _data(packed)
        out = [(h[0], HEADER, h[2], h[3], h[4], b"") for h in heads]
        if rows:
            b, total, t = Bucket(rows, hot, shards), 0.0, rounds[-1]
            told = answers.column("round").to_numpy()
            read = {k: b.read(answers.filter(pa.array(told == k))) for k in range(len(rounds) - samples - 1, len(rounds))}
            for k in range(len(rounds) - samples, len(rounds)):
                tables, root = b.seated(rounds[k - 1], read[k - 1][1], sweeps, np.random.default_rng([seed, k, bucket]))
                total += b.predictive(rounds[k], *read[k], tables, root)
            score = np.log10(total / samples)
            count = b.word_count.copy()
            shared = b.hot >= 0
            count[shared] = t.hot_tokens[b.hot[shared]]
            base = np.log10((count + 0.5) / (t.tokens + 0.5 * (t.words + 1)))[b.word]
            known = (count > 0)[b.word]
            start = 0
            for chunk, end in zip(b.chunks, b.ends):
                e, m = b.entry[start:end], b.times[start:end]
                docs, at = np.unique(b.doc[start:end], return_inverse=True)
                sums = [np.bincount(at, m * x[e], len(docs)) for x in (known, base, score)]
                out.append((chunk, 1, squeeze(docs.astype(np.uint16), True), squeeze(small(sums[0])), sums[1].tobytes(), sums[2].tobytes()))
                start = end
        return _table(out, REPLY)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the replies of a chunk, sorted by chunk with the header first."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def close(ids: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)

    ids = n = sums = None
    for batch in batches:
        for kind, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("kind", "a", "b", "c", "d"))):
            if kind == HEADER:
                if ids is not None:
                    yield close(ids, n, sums)
                ids = pa.array(np.frombuffer(a, np.int64), mask=np.frombuffer(c, np.uint8).astype(bool))
                n = np.frombuffer(b, np.uint32)
                sums = np.zeros((3, len(n)))
            else:
                at = loosen(a, 2, steps=True)
                for s, x in zip(sums, (loosen(b, n=len(at)), np.frombuffer(c), np.frombuffer(d))):
                    s[at] += x
    if ids is not None:
        yield close(ids, n, sums)


def hot_words(cols: DataFrame, docs: int = ROUTING_DOCS) -> np.ndarray:
    """Words with a thousandth of the tokens of a bounded sample of documents, so at most a thousand. They only decide
    which bucket counts a pair, never a count or a score."""
    count = cols.count()
    every = max(1, count // docs)
    sample = cols.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.lower(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)).alias("t"))
    words = sample.select(F.explode(F.split("t", " ")).alias("w")).where("w <> ''")
    words = durable(words.groupBy("w").count())
    total = words.agg(F.sum("count")).first()[0] or 0
    found = words.where(F.col("count") * HOT_SHARE >= F.lit(total)).select("w").collect()
    return np.unique(np.array([END, *(xxh3_64_intdigest(r[0].encode().lower()) for r in found)], np.uint64))


def _in_place(df: DataFrame) -> DataFrame:
    """``durable`` that remembers how its rows are partitioned, so that a cogroup by the same key moves only the other
    side. The adaptive planner forgets it; it is off while this is planned."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return durable(df)
    finally:
        conf.set(name, before)


def score_documents(
    docs: DataFrame, rounds: int = 3, sweeps: int = 2, samples: int = 2, seed: int = 11, concentration: float | None = None,
    discounts: tuple[float, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A token's context is the word before it, told by its 64-bit hash: a restaurant for each word of the corpus, all with
    the unigram restaurant as their parent; its base gives half to the one unseen word and the rest evenly to the known
    words. Documents with crc32(doc_id) mod 5 other than 1 are the customers.

    Sampling is by Gibbs, a dish at a time: its customers leave their restaurant and are seated again given everything
    else, with what its tables do to its parent (``reseat``). Buckets of words sample side by side, each given the totals
    of the others after the last round (as in distributed Gibbs samplers); with them the contexts' common concentration
    and the two discounts (contexts, root) are estimated, unless they are given. A token's probability is the mean over the last ``samples`` rounds, each taken with the
    totals of its own seating, so that the probabilities of all words after a context add up to one.

    The corpus is shuffled once, as packed blobs by word, and kept durably; counting, sampling and scoring read them in
    place. The customers and tables of the contexts are a distributed table: each bucket sends its share of them to shards
    by context, where they are added up, and is told the sums of its own contexts before the next round. Only vectors of
    fixed size reach the driver. Common words (by a sample) are dealt out by the word before them, and after a common word
    by both.
    Null and empty texts are one end token. Rows with a null id are scored and not learnt from; rows that repeat an id
    each count. An empty table gives an empty result; other columns are ignored. Reruns over the same files agree.
    """
    if not 0 < samples <= rounds:
        raise ValueError("samples are taken from the last rounds")
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hot = hot_words(cols)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(cols)
    parts = max(min(least, 32), size // BUCKET_BYTES + 1 if size < 1 << 50 else 0)
    schema = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
    packed = _in_place(cols.mapInArrow(_packer(parts, hot), schema).repartition(parts, "bucket").sortWithinPartitions("bucket"))

    def visit(run, answers: DataFrame, schema: str) -> DataFrame:
        return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)

    answers, t, _ = _meet(packed.mapInArrow(_counting(hot, parts), MESSAGE), parts, len(hot), None)
    t.hot_root, t.discounts, t.theta = np.minimum(t.hot_tables, 1), discounts, THETA if concentration is None else concentration
    t.words += float((t.hot_tokens > 0).sum())
    t.root_tables = t.words
    totals, told = [t], [answers]
    for k in range(1, rounds + 1):
        before = totals[-1]
        answers, s, theta = _meet(visit(_sampling(before, hot, sweeps, [seed, k], parts), told[-1], MESSAGE), parts, len(hot), before.discount)
        hot_root = root_seating(s.hot_tables, before.base(before.hot_tokens > 0), before.root_discount, np.random.default_rng([seed, k]))
        ones = np.concatenate((before.ones[:2], s.ones[2:]))
        totals.append(Totals(before.tokens, before.words, s.tables, before.hot_tokens, s.hot_tables, hot_root, s.root_tables + float(hot_root.sum()), ones, theta if concentration is None else concentration, discounts))
        told.append(answers)
    heard = [a.withColumn("round", F.lit(k)) for k, a in enumerate(told) if k >= rounds - samples]
    heard = reduce(DataFrame.unionByName, heard)
    replies = visit(_scoring(totals, hot, sweeps, samples, seed, parts), heard, REPLY)
    rows = replies.repartition(max(parts, least), "chunk").sortWithinPartitions("chunk", "kind").select("kind", "a", "b", "c", "d")
    out = rows.mapInArrow(_finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(t.tokens)).cast("long"))


def remainder(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs)
    return out.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
