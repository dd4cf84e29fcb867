"""Vectorised byte and word hashing over batches of texts.

Rolling hashes are prefix sums of ``code * B**i`` modulo 2**64 (B odd, so its
powers have inverses): any span's hash is a difference of two prefix sums
times an inverse power.  Codes are random 64-bit values, and span hashes pass
a finalising mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MAX = U(0xFFFFFFFFFFFFFFFF)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, kept between calls up to four million."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 2**64)
        both = []
        for b in (base, inv):
            p = np.empty(size, dtype=U)
            p[0] = 1
            filled = 1
            while filled < size:  # p[i + filled] = p[i] * b**filled
                take = min(filled, size - filled)
                p[filled : filled + take] = p[:take] * U(pow(b, filled, 2**64))
                filled += take
            both.append(p)
        if n > 1 << 22:
            return both[0], both[1]
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(codes) + 1, dtype=U)
    out[0] = 0
    np.cumsum(codes * powers(base, len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed hash of codes[start:end] for arrays of starts and ends."""
    return mix((pre[end] - pre[start]) * powers(base, len(pre))[1][start] + (end - start).astype(U))


def grams(codes: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Mixed hash of each n consecutive codes."""
    if len(codes) < n:
        return np.empty(0, dtype=U)
    pre = prefix(codes, base)
    m = len(codes) - n + 1
    return mix((pre[n:] - pre[:m]) * powers(base, len(pre))[1][:m])


def batches(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) in runs of about ``max_bytes``; NULL is empty.

    Only a run's texts are copied out of the batch at a time.
    """
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    lo, size = 0, 0
    cuts = []
    for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
        size += n + 1
        if size >= max_bytes:
            cuts.append(i + 1)
            size = 0
    if not cuts or cuts[-1] < len(col):
        cuts.append(len(col))
    for hi in cuts:
        if hi > lo:
            yield lo, hi, [v or b"" for v in col.slice(lo, hi - lo).to_pylist()]
        lo = hi


class Words:
    """The words of a run of texts.

    ``hash``: 64-bit hash of each word; ``start``/``end``: its bytes in
    ``data``; ``first``: for each text the index of its first word, with one
    more entry for the end.
    """

    def __init__(self, texts: list[bytes], lower: bool, table: np.ndarray = IS_WORD):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            data = LOWER[data]
        self.data = data
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        flag = np.zeros(len(data) + 1, dtype=np.int8)
        flag[1:] = table[data]
        step = np.diff(flag)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        pre = prefix(CODES[data], BASES[0])
        self.hash = spans(pre, self.start, self.end, BASES[0])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(v) < w:
        return v[:0]
    m, size = v, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(v) - w + 1], m[w - size : w - size + len(v) - w + 1])
    return m


def anchors(gram: np.ndarray, inside: np.ndarray, w: int) -> np.ndarray:
    """For each window of w grams the index of its smallest gram, the first among equals.

    A window's choice depends only on its own content.  ``inside`` is False
    for grams that cross a text's end.
    """
    n = len(gram)
    if n < w:
        return np.empty(0, dtype=np.int64)
    bits = U(max(1, int(n - 1).bit_length()))
    packed = ((gram >> bits) << bits) | np.arange(n, dtype=U)
    packed[~inside] = MAX
    return (window_min(packed, w) & ((U(1) << bits) - U(1))).astype(np.int64)


class Often:
    """Salts for hashes that a task has met in unusually many documents, so that their rows can be dealt out.

    Counters are by the low bits of a hash; one is hot beyond ``least`` and ``factor`` times their mean.
    """

    CELLS = 1 << 18

    def __init__(self, salts: int, least: int = 64, factor: int = 16):
        self.salts, self.least, self.factor = salts, least, factor
        self.seen, self.total = np.zeros(self.CELLS, dtype=np.int64), 0

    def salt(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        """-1, or for hot ones a number below ``salts`` by the document ``k``."""
        cell = h & (self.CELLS - 1)
        self.seen += np.bincount(cell, minlength=self.CELLS)
        self.total += len(h)
        hot = self.seen[cell] > self.least + self.factor * self.total // self.CELLS
        return np.where(hot, (mix(k.astype(U)) % U(self.salts)).astype(np.int64), -1).astype(np.int32)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
