"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings, with thresholds by language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.words import crc_fold, slices, stretches
from swathe.plans.durable import durable

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Bytes of a word's hashed prefixes; with the whole word they make its embedding.
PREFIXES = (4, 5, 6, 7, 8)
EDGE = b".,;:!?\"'()[]{}|*%&$#@<>-_~"
#: Rows of each class that training collects at most, bytes of a text used in training (scoring reads whole texts), and
#: bytes of all texts of a class.
SAMPLE_PER_CLASS, SAMPLE_BYTES, SAMPLE_CLASS_BYTES = 3000, 200_000, 24_000_000
#: Bytes of text above which a text is scored in parts.
LONG = 2_000_000
#: Distinct words whose filter responses a scoring task remembers.
MEMO_WORDS = 150_000


def features(word: bytes) -> list[int]:
    """Hashed buckets of a word: itself and its prefixes, ASCII lower-cased, punctuation at the edges dropped."""
    w = word.lower().strip(EDGE)
    return [zlib.crc32(w) % BUCKETS, *(zlib.crc32(w[:k], k) % BUCKETS for k in PREFIXES)]


@dataclass
class Model:
    """score(text) = sigmoid(scale * (sum over filters of v * max over positions of relu(conv)) + shift)."""

    embed: np.ndarray
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def tables(self, feats: np.ndarray) -> list[np.ndarray]:
        """For each width and place in the window, the response of every filter to each word."""
        x = self.embed[feats].mean(axis=1)
        return [x @ self.conv[k][j] for k, w in enumerate(WIDTHS) for j in range(w)]


def _layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all documents (0 is padding, after each) and the positions where a window may start, with their runs."""
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    first = np.zeros(1, np.int64)
    parts, starts, lengths, at = [], [], [], 0
    for d in docs:
        d = d if len(d) else first
        parts += [d, pad]
        starts.append(at)
        lengths.append(len(d))
        at += len(d) + len(pad)
    n = np.array(lengths)
    runs = np.concatenate(([0], np.cumsum(n)[:-1]))
    where = np.repeat(np.array(starts) - runs, n) + np.arange(n.sum())
    return np.concatenate(parts), where, runs


def _pooled(tables: list[np.ndarray], bias: list[np.ndarray], rows: np.ndarray, where: np.ndarray, runs: np.ndarray, arg: bool):
    """Max-pooled responses (documents x filters) per width, and the rows at the first maximum if asked for."""
    tops, args, k = [], [], 0
    for w, b in zip(WIDTHS, bias):
        c = tables[k][rows[where]]
        for j in range(1, w):
            c += tables[k + j][rows[where + j]]
        k += w
        top = np.maximum.reduceat(c, runs, axis=0) + b
        tops.append(top)
        if arg:
            ends = np.append(runs[1:], len(where))
            best = np.stack([c[a:e].argmax(axis=0) + a for a, e in zip(runs, ends)])
            args.append(where[best])
    return tops, args


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 10, seed: int = 3, batch: int = 32) -> Model:
    """Adagrad on the log loss of a class-balanced sample; gradients pass through the maxima only.

    The first dimension of the embeddings starts at how far a bucket's share of toxic and of other documents differ, in
    standard errors, and the filters start by looking at it: else a rare mark would seldom be a maximum and never learnt.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.15, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (len(WIDTHS), FILTERS)).astype(np.float32),
    )
    vocabulary: dict[bytes, int] = {b"": 0}
    feats: list[list[int]] = [[0] * (1 + len(PREFIXES))]
    docs = []
    for text in texts:
        ids = np.empty(len(words := text.split()), np.int64)
        for i, w in enumerate(words):
            if (k := vocabulary.get(w)) is None:
                k = vocabulary[w] = len(feats)
                feats.append(features(w))
            ids[i] = k
        docs.append(ids)
    table = np.array(feats, np.int64)
    y = labels.astype(np.float32)
    shares = np.zeros((2, BUCKETS))
    for ids, label in zip(docs, labels):
        shares[int(label), np.unique(table[np.unique(ids)])] += 1
    n = np.array([[(labels == 0).sum()], [(labels == 1).sum()]])
    rate_0, rate_1 = shares / np.maximum(n, 1)
    both = (shares.sum(axis=0) + 0.5) / (n.sum() + 1)
    z = (rate_1 - rate_0) / np.sqrt(both * (1 - both) * (1 / np.maximum(n, 1)).sum())
    model.embed[:, 0] = np.clip(z, -6, 6) / 3
    for c in model.conv:
        c[:, 0, :] += 1.0
    model.out += 0.3
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    seen = [np.full_like(a, 1e-3) for a in (model.embed, *model.conv, *model.bias, model.out)]
    seen_bias, rate, n_w = 1e-3, 0.08, len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(docs), batch):
            pick = order[s : s + batch]
            rows, where, runs = _layout([docs[i] for i in pick])
            used, rows = np.unique(rows, return_inverse=True)
            f = table[used]
            x = model.embed[f].mean(axis=1)
            x[used == 0] = 0
            tables = [x @ model.conv[k][j] for k, w in enumerate(WIDTHS) for j in range(w)]
            tops, args = _pooled(tables, model.bias, rows, where, runs, True)
            hidden = np.stack([np.maximum(t, 0) for t in tops], axis=1)
            g = (_sigmoid((hidden * model.out).sum(axis=(1, 2)) + model.out_bias) - y[pick]) * weight[pick] / len(pick)
            grad_out = (hidden * g[:, None, None]).sum(axis=0)
            g_hidden = g[:, None, None] * model.out * (hidden > 0)
            g_embed_rows, g_embed = [], []
            for k, w in enumerate(WIDTHS):
                gk = g_hidden[:, k, :]
                g_conv = np.empty_like(model.conv[k])
                for j in range(w):
                    at = rows[args[k] + j]
                    g_conv[j] = np.einsum("bfd,bf->df", x[at], gk)
                    g_embed_rows.append(at.ravel())
                    g_embed.append((gk[:, :, None] * model.conv[k][j].T[None]).reshape(-1, DIM))
                seen[1 + k] += g_conv**2
                model.conv[k] -= rate * g_conv / np.sqrt(seen[1 + k])
                g_b = gk.sum(axis=0)
                seen[1 + n_w + k] += g_b**2
                model.bias[k] -= rate * g_b / np.sqrt(seen[1 + n_w + k])
            seen[-1] += grad_out**2
            model.out -= rate * grad_out / np.sqrt(seen[-1])
            seen_bias += float(g.sum()) ** 2
            model.out_bias -= rate * float(g.sum()) / seen_bias**0.5
            gx = np.zeros_like(x)
            np.add.at(gx, np.concatenate(g_embed_rows), np.concatenate(g_embed))
            gx[used == 0] = 0
            hit = np.flatnonzero(np.abs(gx).sum(axis=1))
            flat, inverse = np.unique(f[hit].ravel(), return_inverse=True)
            ge = np.zeros((len(flat), DIM), np.float32)
            np.add.at(ge, inverse, np.repeat(gx[hit] / f.shape[1], f.shape[1], axis=0))
            seen[0][flat] += ge**2
            model.embed[flat] -= rate * ge / np.sqrt(seen[0][flat])
    return model


class Scorer:
    """Scores of whole texts; remembers the responses to a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[bytes, int] = {b"": 0}
        self.tables = [np.zeros((MEMO_WORDS, FILTERS), np.float32) for _ in range(sum(WIDTHS))]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        docs, rows = [t.split() for t in texts], self.rows
        new = {w for d in docs for w in d if w not in rows}
        if len(rows) + len(new) > MEMO_WORDS:
            self.reset()
            rows, new = self.rows, {w for d in docs for w in d}
            if len(new) >= MEMO_WORDS:
                self.tables = [np.zeros((len(new) + 1, FILTERS), np.float32) for _ in self.tables]
        if new:
            at, words = len(rows), list(new)
            for t, table in zip(self.model.tables(np.array([features(w) for w in words], np.int64)), self.tables):
                table[at : at + len(words)] = t
            rows.update(zip(words, range(at, at + len(words))))
        return [np.fromiter(map(rows.__getitem__, d), np.int64, len(d)) for d in docs]

    def _long(self, text: bytes, size: int) -> list[np.ndarray]:
        """Max-pooled responses of one text, part by part: the last words of a part, at which a window may run over its
        end, are looked at again with the next."""
        over, carry, best = max(WIDTHS) - 1, [], None
        parts = list(stretches(text, size))
        for k, part in enumerate(parts):
            words = [*carry, *part.split()]
            if len(words) <= over and k + 1 < len(parts):
                carry = words
                continue
            rows, where, runs = _layout(self._ids([b" ".join(words)]))
            where = where if k + 1 == len(parts) else where[:-over]
            tops = [t[0] for t in _pooled(self.tables, self.model.bias, rows, where, runs, False)[0]]
            best, carry = tops if best is None else [np.maximum(a, b) for a, b in zip(best, tops)], words[-over:]
        return best

    def logits(self, texts: list[bytes], long: int = LONG) -> np.ndarray:
        rows, where, runs = _layout(self._ids([t if len(t) <= long else b"" for t in texts]))
        tops, _ = _pooled(self.tables, self.model.bias, rows, where, runs, False)
        for i, text in enumerate(texts):
            if len(text) > long:
                for top, own in zip(tops, self._long(text, long)):
                    top[i] = own
        hidden = np.stack([np.maximum(t, 0) for t in tops], axis=1)
        return (hidden * self.model.out).sum(axis=(1, 2)).astype(np.float64) + self.model.out_bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.logits(texts) * self.model.scale + self.model.shift)


def _best_threshold(scores: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the best weighted F1's gap between neighbouring scores; 0.5 where it is as good."""
    order = np.argsort(-scores, kind="stable")
    s, t, w = scores[order], y[order], weights[order]
    all_toxic = (w * t).sum()
    f1 = np.where(np.append(s[1:] < s[:-1], True), 2 * np.cumsum(w * t) / (np.cumsum(w) + all_toxic), -1)
    k = int(f1.argmax())
    half = s >= 0.5
    at_half = 2 * (w * t)[half].sum() / (w[half].sum() + all_toxic)
    return 0.5 if at_half >= f1[k] else float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def fit(rows: list[tuple], toxic_share: float) -> Model | None:
    """rows: (id, text bytes, label, language). Every fourth row calibrates; None unless both classes are there.

    The logit is scaled and shifted (two parameters, Newton steps) on the calibration rows to the true class shares, so
    that 0.5 is the point of even odds. Languages with at least 20 calibration rows of either class get a threshold.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()[::-1]), str(r[0])))
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    held = np.zeros(len(rows), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::4]] = True
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    model = train([r[1] for r, h in zip(rows, held) if not h], y[~held])
    if held.any():
        z, t = Scorer(model).logits([r[1] for r, h in zip(rows, held) if h]), y[held].astype(float)
        w = np.where(t == 1, toxic_share / max(t.sum(), 1), (1 - toxic_share) / max((1 - t).sum(), 1)) * len(t)
        a, b = 1.0, np.log(max(toxic_share, 1e-6) / max(1 - toxic_share, 1e-6))
        for _ in range(50):
            p = _sigmoid(a * z + b)
            r, v = w * (p - t), w * p * (1 - p) + 1e-9
            h = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, [(r * z).sum() + 0.5 * (a - 1), r.sum()])
            a, b = a - float(np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -1, 1))
        model.scale, model.shift = max(a, 0.05), b
        scores, lang = _sigmoid(model.scale * z + model.shift), np.array([str(r[3]) for r, h in zip(rows, held) if h])
        for name in sorted(set(lang.tolist())):
            own = lang == name
            if min((t[own] == 1).sum(), (t[own] == 0).sum()) >= 20:
                model.thresholds[name] = _best_threshold(scores[own], t[own], w[own])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fits on a bounded sample: at most ``per_class`` labelled rows of each class, by hash order of the id.

    labels: (doc_id, toxic); rows with null are ignored, of repeated ids the largest label counts. ``usable`` restricts the
    ids that labels may be learnt from. At most 2 * per_class texts of at most SAMPLE_BYTES bytes, and of a class no more
    than SAMPLE_CLASS_BYTES (a prefix of the hash order), reach the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    known = known if usable is None else known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return None
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    chosen = [(int(r[0]), int(r[1])) for r in picked.collect()]
    ids = docs.sparkSession.createDataFrame(chosen or [(0, 0)], "id long, toxic int")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "lang")
    found = text.where(F.length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "id").withColumn("n", F.length("text"))
    found = durable(found.withColumn("place", F.xxhash64("id")).select("id", "text", "toxic", "lang", "n", "place"))
    taken, room = set(), {0: SAMPLE_CLASS_BYTES, 1: SAMPLE_CLASS_BYTES}
    for r in sorted(found.groupBy("id", "toxic", "place").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["place"], r["id"])):
        room[r["toxic"]] -= r["n"]
        if room[r["toxic"]] >= 0:
            taken.add((r["id"],))
    if not chosen or not taken:
        return None
    keep = F.broadcast(docs.sparkSession.createDataFrame(sorted(taken), "id long"))
    return fit([(r[0], bytes(r[1]), r[2], r[3]) for r in found.join(keep, "id").select("id", "text", "toxic", "lang").collect()], float(share))


def score_toxicity(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``keep`` columns and ``score`` of each row: whole texts, null as empty; 0 for all without a model. No shuffle."""
    text = "text" if "text" in keep else "__text"
    cols = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else [F.col("text").alias("__text")]))
    fields = [f for f in cols.schema if f.name in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            scores = [np.empty(0)]
            for (texts,) in slices(iter([batch]), text):
                scores.append(scorer.scores(texts) if scorer else np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.concatenate(scores))], [*names, score])

    return cols.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"`{score}` double"]))


def flag_toxic(model: Model | None, lang: str = "lang", score: str = "score") -> Column:
    """Whether ``score`` reaches the threshold of the row's language (the default one for others and null)."""
    if model is None:
        return F.lit(False)
    limit = F.lit(model.default_threshold)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang) == name, F.lit(value)).otherwise(limit)
    return F.col(score) >= limit


def remainder(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learnt from the labels of four folds in five.

    A null id is in no fold (held_out null). Null and empty texts get the score of a text without words. Repeated ids are
    rows of their own. Without labels of both classes every score is 0.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels, remainder("doc_id") != 0)
    scored = score_toxicity(docs, model, ("doc_id", "lang"))
    return scored.select(
        "doc_id",
        (remainder("doc_id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        flag_toxic(model).alias("flagged"),
    )


__all__ = ["Model", "Scorer", "crc_fold", "fit", "fit_toxicity", "flag_toxic", "op4_toxicity", "score_toxicity", "train"]
