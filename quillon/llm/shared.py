"""Shared storage, code shipping and word splitting for the corpus operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import clean, filesystem, shared_dir, stored

__all__ = ["clean", "filesystem", "shared_dir", "stored"]

#: Words are runs of bytes other than space and \\x09-\\x0D; bytes.split() splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(), f"quillon_code_{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def sized(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) of ``docs``, which tasks' sizes follow."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("binary")))).first()
    return n, size or 0


def parts(batch, rows: int = 1000):
    """A batch in slices of so many rows, so that few texts are Python objects at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def tidy(work):
    """``work`` for a worker that lives on: what a task freed goes back to the system at its end."""

    def wrapped(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def utf8(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_RNG = np.random.default_rng(11)
#: A random number for each byte, and a base, of each half of a hash.
_BYTES = _RNG.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_GAP_BYTES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Powers of each base and of its inverse, modulo 2 ** 64; they grow with the longest stretch seen.
_POWERS: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2]
STRETCH = 1 << 20
#: Words of more bytes than this get a keyed cryptographic hash: polynomials modulo a power of two collide on some of them.
SHORT = 16


class LongWords(dict):
    """The two halves of a keyed 128-bit hash of a word, remembered for so many words."""

    MEMO = 100_000
    KEY = b"words of a corpus"

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > self.MEMO:
            self.clear()
        d = hashlib.blake2b(word, digest_size=16, key=self.KEY).digest()
        found = self[word] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
        return found


_LONG = LongWords()


def _powers(half: int, n: int) -> list[np.ndarray]:
    if len(_POWERS[half][0]) < n:
        made = []
        for base in (_BASES[half], pow(_BASES[half], -1, 2**64)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS[half] = made
    return _POWERS[half]


def word_hashes(text: bytes, halves: int = 1):
    """64-bit hashes of a text's words, in order; with ``halves`` = 2 two independent ones.

    The hash of a short word is a polynomial of random numbers for its bytes, taken as a difference of
    prefix sums and moved to the word's start by the inverse of the base; at up to ``SHORT`` bytes
    no two words are sure to collide, and two halves do so with a chance of 2 ** -98 at the worst. Longer
    words are hashed by a keyed cryptographic function. Long texts go in stretches that end between words.
    """
    parts, at = [], 0
    while len(text) - at > STRETCH:
        ends = [k for c in _GAP_BYTES if (k := text.rfind(c, at, at + STRETCH)) >= 0]
        ends = [max(ends)] if ends else [k for c in _GAP_BYTES if (k := text.find(c, at + STRETCH)) >= 0]
        stop = min(ends, default=len(text) - 1) + 1
        parts.append(_stretch_hashes(text[at:stop], halves))
        at = stop
    parts.append(_stretch_hashes(text[at:], halves))
    found = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts, strict=True)]
    return tuple(found) if halves > 1 else found[0]


def _stretch_hashes(text: bytes, halves: int) -> list[np.ndarray]:
    b = np.frombuffer(text, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    np.take(_GAPS, b, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = edge[0::2], edge[1::2]
    out = []
    for k in range(halves):
        up, down = _powers(k, len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[k][b] * up[: len(b)], out=sums[1:])
        out.append(mix64((sums[stop] - sums[start]) * down[start]))
    long = np.flatnonzero(stop - start > SHORT)
    if len(long):
        found = np.array([_LONG[text[s:e]] for s, e in zip(start[long].tolist(), stop[long].tolist(), strict=True)], np.uint64)
        for k in range(halves):
            out[k][long] = found[:, k]
    return out


def grams(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of the n-grams of word hashes ``h``, by start; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    b = np.uint64(base | 1)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * b + h[k : len(h) - n + 1 + k]
    return mix64(out)
