"""Words and hashes of whole texts in numpy; one place for what several operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from xxhash import xxh3_64_intdigest, xxh3_128_digest

#: Characters of text that a Python worker holds at a time (a longer single text is held whole).
SLICE_BYTES = 2_000_000


def split(text: bytes) -> list[bytes]:
    """Maximal runs of characters other than U+0020 and U+0009 to U+000D: bytes.split() splits at exactly these."""
    return text.split()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def word_digests(words: list[bytes]) -> np.ndarray:
    """128-bit hashes, as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two arrays of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def crc_fold(doc_id: int, folds: int = 5) -> int:
    """crc32 of the id as decimal text, modulo ``folds``."""
    return zlib.crc32(str(doc_id).encode()) % folds


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes each that hold them all."""
    top = x.max(initial=0)
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def squeeze(x: np.ndarray, steps: bool = False) -> bytes:
    """Unsigned numbers as compressed byte planes; of ``steps`` (sorted numbers, or runs of such) the differences."""
    if steps:
        x = np.concatenate((x[:1], x[1:] - x[:-1]))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def loosen(data: bytes, width: int = 0, n: int = 0, steps: bool = False) -> np.ndarray:
    """What ``squeeze`` was given, told by the bytes of a number or by how many there are."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = width or (len(raw) // n if n else 1)
    x = np.ascontiguousarray(raw.reshape(width, -1).T).view(f"u{width}").ravel()
    return np.cumsum(x, dtype=x.dtype) if steps else x


def give_back() -> None:
    """Hands memory that is free back to the system where the C library can: workers outlive their tasks, and idle ones
    should not hold what a task once needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or None)


#: What a worker remembers from task to task, by its owner: of one operator at a time.
_kept: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """A dictionary that lives as long as a worker's tasks are of the same owner; what others remembered is dropped."""
    if owner not in _kept and _kept:
        _kept.clear()
        give_back()
    return _kept.setdefault(owner, {}) if owner else {}


def slices(batches: Iterator[pa.RecordBatch], text: str, *others: str, size: int = SLICE_BYTES, overhead: int = 1, owner: str = "") -> Iterator[tuple]:
    """(list of text bytes, list of values of each other column), by at most ``size`` bytes of text, where each row counts
    ``overhead`` bytes more; null text is b"". Free memory is given back at the end;
    what tasks of other owners remembered goes at the start."""
    memory(owner)
    held: list[list] = [[] for _ in range(1 + len(others))]
    n = 0
    for batch in batches:
        texts = batch.column(text).cast(pa.large_binary())
        rest = [batch.column(c).to_pylist() for c in others]
        for i in range(batch.num_rows):
            value = texts[i].as_py() or b""
            if n and n + len(value) + overhead - 1 > size:
                yield tuple(held)
                held, n = [[] for _ in range(1 + len(others))], 0
            held[0].append(value)
            for h, r in zip(held[1:], rest):
                h.append(r[i])
            n += len(value) + overhead
    if held[0]:
        yield tuple(held)
    held = []
    give_back()
