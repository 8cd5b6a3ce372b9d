"""Words, lines and n-grams of a batch of texts as flat numpy arrays.

A word is a run of bytes other than the ASCII blanks 0x20 and 0x09-0x0D.  The
arrays are computed on the UTF-8 bytes of an Arrow string column, a few
megabytes at a time, so memory is bounded by that figure or by one text,
whichever is larger.  Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_BLANK
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; those for giant texts aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size, made = 1 << max(20, int(n - 1).bit_length()), []
    for base in (_BASE, _BASE_INV):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size <= 1 << 22:
        _powers[:] = made
    return made[0], made[1]


def _ptr_sum(prefix: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return prefix[ptr[1:]] - prefix[ptr[:-1]]


class TextBlock:
    """Texts ``n`` with bytes ``data``, text boundaries ``text_ptr`` (n + 1), words ``[start, end)`` and the words of each text ``word_ptr`` (n + 1)."""

    def __init__(self, data: np.ndarray, text_ptr: np.ndarray, in_word: np.ndarray = _WORD):
        self.data, self.text_ptr, self.n = data, text_ptr.astype(np.int64), len(text_ptr) - 1
        size = len(data)
        word = in_word[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = self.text_ptr[(self.text_ptr > 0) & (self.text_ptr < size)]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.word_ptr = np.searchsorted(self.start, self.text_ptr)
        self._prefix: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_ptr)

    def lowered(self) -> TextBlock:
        """The same words with A-Z in lower case."""
        out = TextBlock.__new__(TextBlock)
        out.__dict__ |= self.__dict__
        out.data, out._prefix = _LOWER[self.data], None
        return out

    def letters(self) -> TextBlock:
        """The same texts in lower case, cut into runs of ASCII letters and digits and of bytes beyond ASCII."""
        return TextBlock(_LOWER[self.data], self.text_ptr, _LETTER)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        up, down = _power(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Per text, how many bytes the table of 256 booleans marks."""
        return _ptr_sum(np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int64))), self.text_ptr)

    def text_of(self, ptr: np.ndarray) -> np.ndarray:
        """The text of each element, given the elements of each text."""
        return np.repeat(np.arange(self.n), np.diff(ptr))


def ngrams(words: np.ndarray, word_ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words inside each text, and the windows of each text.  A window's number is its first word's number less ``(k - 1)`` for each text before that has windows."""
    n = np.maximum(np.diff(word_ptr) - (k - 1), 0)
    ptr = np.concatenate(([0], np.cumsum(n)))
    if not ptr[-1]:
        return np.zeros(0, np.uint64), ptr
    at = np.arange(ptr[-1]) + np.repeat(word_ptr[:-1] - ptr[:-1], n)
    out = words[at] * _STEP[0]
    for j in range(1, k):
        out += words[at + j] * _STEP[j]
    return mix(out), ptr


def shingles(words: np.ndarray, word_ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ngrams, but a text of 1 to k - 1 words has one shingle of all its words."""
    out, ptr = ngrams(words, word_ptr, k)
    n_words, n = np.diff(word_ptr), np.diff(ptr)
    short = np.flatnonzero((n_words > 0) & (n == 0))
    if not len(short):
        return out, ptr
    own = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        w = words[word_ptr[t] : word_ptr[t + 1]]
        own[i] = (w * _STEP[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    n[short] = 1
    new = np.concatenate(([0], np.cumsum(n)))
    return np.insert(out, ptr[short], mix(own)), new


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, row after the last, block) over a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    ptr = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + limit, "right")) - 1)
        yield i, j, TextBlock(raw[ptr[i] : ptr[j]], ptr[i : j + 1] - ptr[i])
        i = j


def crc_fold(ids: pa.Array | list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo mod; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in (ids.to_pylist() if hasattr(ids, "to_pylist") else ids)], np.int64)
