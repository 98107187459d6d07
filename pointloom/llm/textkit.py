"""Vectorised kernels over whole texts: word boundaries, 64-bit word hashes and shingle hashes.

Texts are handled as UTF-8 bytes in one flat buffer per batch, so every step is a numpy pass and no Python
code runs per word.  Null texts count as empty.  Working memory is a fixed multiple of ``PIECE`` bytes, plus
about 24 bytes a word of the batch, however long a single text is.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, and at least one whole text.
BATCH = 2 << 20
#: Bytes that rolling codes are made of at once.
PIECE = 1 << 20

_U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240229))
_PLACE_CODE = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_CHUNK_CODE = _SEED.integers(1, 1 << 63, 32, dtype=np.uint64) * _U(2) + _U(1)
#: Spans of more bytes are coded by a cryptographic hash, one by one.
_SHORT = 8 * len(_CHUNK_CODE)
#: The first so many bytes of eight, as a little-endian integer.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Rolling codes: a prime for sums without overflow, two bases, and their powers for PIECE bytes.
_PRIME = (1 << 31) - 1
_BASES = (1_331_572_613, 1_908_870_421)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(*spans: tuple[int, int]) -> np.ndarray:
    """True for bytes of words; spans are the inclusive ranges of separators."""
    out = np.ones(256, bool)
    for low, high in spans:
        out[low : high + 1] = False
    return out


#: Words are runs without white space.
BLANK = _table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters and digits and of everything outside ASCII, after lower-casing.
ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of the bytes of each span; two different spans have one code with a chance of 2 ** -64.

    Spans are taken eight bytes at a time, each step through a bijection that spreads all bits, so that no arithmetic
    pattern of the bytes cancels out; long spans go through a keyed cryptographic hash.
    """
    size = end - start
    out = size.astype(np.uint64) * _CHUNK_CODE[0]
    if not len(start):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    short = size <= _SHORT
    at = np.flatnonzero((size > 0) & short)
    j = 0
    while len(at):
        left = size[at] - 8 * j
        chunk = eight[start[at] + 8 * j] & _FIRST[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ chunk) * _CHUNK_CODE[j])
        at = at[left > 8]
        j += 1
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=b"words").digest(), "little")
    return mix(out)


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2 ** 62; the prime itself may stand for 0."""
    x = (x & _U(_PRIME)) + (x >> _U(31))
    return (x & _U(_PRIME)) + (x >> _U(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """For each base its powers, and those of its inverse, up to n."""
    if not _powers or len(_powers[0]) <= n:
        _powers.clear()
        for base in (*_BASES, *(pow(b, -1, _PRIME) for b in _BASES)):
            table = np.ones(1, np.uint64)
            while len(table) <= n:
                table = np.concatenate([table, _modulo(table * _U(pow(base, len(table), _PRIME)))])
            _powers.append(table)
    return _powers


class Rolling:
    """Codes of any spans of a buffer of PIECE symbols at most, bytes or 64-bit codes: two polynomials modulo a prime,
    so that two different spans of n symbols have one code with a chance of about (n / 2 ** 31) ** 2."""

    def __init__(self, buf: np.ndarray):
        assert len(buf) <= PIECE
        tables = _power_tables(PIECE)
        values = [buf.astype(np.uint64) + _U(1)] * 2 if buf.dtype.itemsize == 1 else [buf % _U(_PRIME), (buf >> _U(32)) + _U(1)]
        self.sums = []
        for power, value in zip(tables[:2], values, strict=True):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_modulo(_modulo(value) * power[: len(buf)]), out=sums[1:])
            self.sums.append(_modulo(sums))
        self.inverse = tables[2:]

    def code(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [_modulo(_modulo(sums[end] + _U(_PRIME) - sums[start]) * inverse[start]) % _U(_PRIME) for sums, inverse in zip(self.sums, self.inverse, strict=True)]
        return mix((parts[0] << _U(31)) | parts[1])


class Words:
    """Words of a batch of texts.

    buf: the texts with one separator byte after each; at: where each text starts in buf, and the end;
    start, end: byte range of each word; first: index of the first word of each text, and the number of words.
    """

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool = True):
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.buf = _LOWER[raw] if lower else raw
        inside = table[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit code of each word's bytes."""
        if self._hash is None:
            self._hash = codes(self.buf, self.start, self.end)
        return self._hash

    def runs(self, k: int) -> np.ndarray:
        """Code of the k words from each place on; wrong where they would leave the batch's words."""
        h, n = self.hash, len(self)
        out = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            out[: n - j] += h[j:] * _PLACE_CODE[j]
        return mix(out + _U(k))

    def run_fits(self, k: int) -> np.ndarray:
        """Whether k words from each place on lie in the text of that place."""
        return np.arange(len(self)) + k <= np.repeat(self.first[1:], self.counts)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def parts(sizes: np.ndarray, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes in all, one text at least."""
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def by_parts(
    batches: Iterator[pa.RecordBatch], text: str, work: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None], limit: int = BATCH
) -> Iterator[pa.RecordBatch]:
    """Calls work on slices of the batches that hold about limit bytes of the text column."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for lo, hi in parts(sizes, limit):
            piece = batch.slice(lo, hi - lo)
            out = work(piece, texts_of(column.slice(lo, hi - lo)))
            if out is not None and out.num_rows:
                yield out
    give_back()


def give_back() -> None:
    """Returns freed memory to the machine at the end of a task: workers live on, and the next task may need little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library keeps it
        ctypes.CDLL(None).malloc_trim(0)
