"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.words import memory, slices

#: Context sizes, ascending powers of two; the last is the longest sequence.
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that are packed together inside a task, and tokens of one balanced step group.
CHUNK_TOKENS, STEP_TOKENS = 1 << 20, 1 << 17
#: Words as they stand, and lower-case words of letters (two generations), that a worker remembers the ids of.
MEMO_WORDS, MEMO_LETTERS = 400_000, 500_000
#: Punctuation that the tokenizer splits off the end of a word of letters, whatever follows.
TAIL = ".,;:!?*%&$#()[]{}/\\-_+=~"


def _byte_forms() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible character: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


BYTE_FORMS = _byte_forms()


def _simple(core: str, low: str) -> bool:
    """Latin letters whose lower case is one letter each and that normalisation leaves alone."""
    return core.isalpha() and len(core) == len(low) and max(core) < "\u0250" and max(low) < "\u0250" and unicodedata.is_normalized("NFC", core)


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, by a BPE with word ends, remembering the words.

    The tokenizer drops white space and never merges across it, so a text's ids are the ids of its words in order.
    Words of letters, with or without punctuation after them, go straight to its BPE model; any other word (digits,
    apostrophes, special tokens, scripts past Latin) goes through the whole tokenizer.
    """

    def __init__(self, file: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file or public_tokenizers.path("word_bpe_49k.json"))
        self.model = self.tok.model
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, core: str) -> bytes:
        """Ids of one lower-case word of letters: one pre-token, so the BPE model is asked without the steps around it."""
        if (found := self.letters.get(core)) is None:
            if (found := self.older.pop(core, None)) is None:
                form = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_FORMS)
                ids = [t.id for t in self.model.tokenize(form)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.letters) >= MEMO_LETTERS:
                self.letters, self.older = {}, self.letters
            self.letters[core] = found
        return found

    def _learn(self, words: set[bytes]) -> None:
        known, tails = self.known, self.tails
        for w in words:
            text = w.decode("utf-8", "replace")
            core = text.rstrip(TAIL)
            low = core.lower()
            if low.isalpha() and (low.isascii() and core.isascii() or _simple(core, low)):
                ids = self._letters(low)
                if len(core) < len(text):
                    tail = text[len(core) :]
                    if tail not in tails:
                        if len(tails) > 10_000:
                            tails.clear()
                        tails[tail] = self._alone(tail)
                    ids += tails[tail]
                known[w] = ids
            else:
                known[w] = self._alone(text)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        docs, known = [t.split() for t in texts], self.known
        new = {w for d in docs for w in d if w not in known}
        if len(known) + len(new) > MEMO_WORDS:
            known.clear()
            new = {w for d in docs for w in d}
        if new:
            self._learn(new)
        return [b"".join(map(known.__getitem__, d)) for d in docs]


OWNER = "tokenizer"


def tokenizer(file: str | None = None) -> WordTokenizer:
    """The worker's tokenizer, which serves its packing tasks until a task of another kind runs; bounded by MEMO_WORDS."""
    known = memory(OWNER)
    if file not in known:
        known[file] = WordTokenizer(file)
    return known[file]


class _Shelf:
    """Fragments (length, document, start) of one tier, by length."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []

    def add(self, item: tuple[int, int, int]) -> None:
        self.items.insert(bisect_left(self.items, item), item)

    def fitting(self, gap: int) -> tuple[int, int, int] | None:
        k = bisect_right(self.items, (gap, 1 << 60, 0))
        return self.items.pop(k - 1) if k else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), together each token once; every sequence's total is a power of two.

    Documents above the longest tier give whole windows first. What is left of each goes to the smallest tier that holds
    it. From the longest tier down, a fragment opens a window and the gap is filled with whole fragments of shorter tiers,
    longest first, then with the head of one that is cut. The rest of the last window is cut at powers of two.
    """
    top, windows = tiers[-1], []
    shelves = {t: _Shelf() for t in tiers}

    def route(length: int, doc: int, start: int, add: bool = True) -> None:
        shelf = shelves[tiers[bisect_left(tiers, length)]]
        shelf.add((length, doc, start)) if add else shelf.items.append((length, doc, start))

    for doc, n in enumerate(lengths):
        whole = n // top * top
        windows += [[(doc, s, top)] for s in range(0, whole, top)]
        if n > whole:
            route(n - whole, doc, whole, False)
    for shelf in shelves.values():
        shelf.items.sort()
    for k in range(len(tiers) - 1, -1, -1):
        shelf, shorter = shelves[tiers[k]], [shelves[t] for t in tiers[:k][::-1]]
        while shelf.items:
            length, doc, start = shelf.items.pop()
            window, gap = [(doc, start, length)], tiers[k] - length
            while gap:
                found = next((x for s in shorter if (x := s.fitting(gap))), None) or shelf.fitting(gap)
                if found is None:
                    source = next((s for s in [*shorter, shelf] if s.items), None)
                    if source is None:
                        break
                    n, d, s = source.items.pop()
                    found = (gap, d, s)
                    route(n - gap, d, s + gap)
                window.append((found[1], found[2], found[0]))
                gap -= found[0]
            windows += [window] if not gap else _powers(window, tiers[k] - gap)
    return windows


def _powers(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, rest = [], window[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, part = 1 << bit, []
            while room:
                doc, start, length = rest.pop()
                take = min(room, length)
                part.append((doc, start, take))
                if length > take:
                    rest.append((doc, start + take, length - take))
                room -= take
            out.append(part)
    return out


def deal(sizes: list[int], step: int) -> list[int]:
    """For each sequence (sizes in descending order) its step group: about the total over ``step`` groups, one at least, the
    next sequence always to the smallest. As sizes are powers of two, no two groups differ by more than the longest."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step)))]
    out = []
    for size in sizes:
        held, g = groups[0]
        heapreplace(groups, (held + size, g))
        out.append(g)
    return out


SCHEMA = pa.schema(
    [
        *[pa.field(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        pa.field("context", pa.int32()),
        pa.field("step_group", pa.int64()),
    ]
)


def _packer(file: str | None, tiers: tuple[int, ...], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(file)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        sequence = step = base
        docs: list[tuple[int, bytes]] = []
        tokens = 0

        def close(docs: list[tuple[int, bytes]]) -> pa.RecordBatch:
            nonlocal sequence, step
            windows = sorted(pack([len(b) // 4 for _, b in docs], tiers), key=lambda w: -sum(p[2] for p in w))
            cols: list[list] = [[] for _ in SCHEMA]
            ids, sizes = [], [sum(p[2] for p in w) for w in windows]
            groups = deal(sizes, STEP_TOKENS)
            for window, size, group in zip(windows, sizes, groups):
                offset = 0
                for d, s, n in window:
                    doc_id, raw = docs[d]
                    piece = raw[s * 4 : (s + n) * 4]
                    for c, v in zip(cols, (doc_id, s, n, zlib.crc32(piece), len(raw) // 4, sequence, offset, size, step + group)):
                        c.append(v)
                    if with_ids:
                        ids.append(piece)
                    offset += n
                sequence += 1
            step += max(groups) + 1
            arrays = [pa.array(c, f.type) for c, f in zip(cols, SCHEMA)]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.binary())] if with_ids else [])], [*SCHEMA.names, *(["ids"] if with_ids else [])])

        for texts, ids in slices(batches, "text", "doc_id", owner=OWNER):
            for doc_id, raw in zip(ids, tok.ids(texts)):
                docs.append((doc_id, raw + end))
                tokens += len(raw) // 4 + 1
            while tokens >= CHUNK_TOKENS + STEP_TOKENS:  # what stays behind is a step group at least
                k, size = 0, 0
                while size < CHUNK_TOKENS:
                    size += len(docs[k][1]) // 4
                    k += 1
                yield close(docs[:k])
                docs, tokens = docs[k:], tokens - size
        if docs:
            yield close(docs)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_file: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context,
    step_group (and ids, little-endian uint32 bytes, if ``with_ids``).

    Tokenizing and packing happen inside each input partition, in chunks of about a million tokens, with no shuffle: the
    partition number makes sequence_id unique, and a task that is run again gives the same pieces. Every sequence is full
    (its size, ``context``, is a power of two), so nothing is padded. Sequences of a chunk are dealt to step groups that differ
    by one sequence of the longest tier at most and hold 2/3 to 3/2 of STEP_TOKENS; a partition with less in all is one group. Null and empty texts are one piece of one id, the end. Rows that repeat an id are packed
    each; null ids are kept. An empty table gives an empty result. Other columns are ignored.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long"
    return cols.mapInArrow(_packer(tokenizer_file, tuple(tiers), with_ids), schema + (", ids binary" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
