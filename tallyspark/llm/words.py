"""Words of Arrow text columns as 64-bit hashes, computed in numpy blocks of bounded size.

``blocks``      slices of a record batch that hold a few megabytes of text each
``word_hashes`` one hash per word of all texts of a block, and the word range of each text
``shingles``    the distinct shingles of each text as sorted 64-bit hashes
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK_BYTES), _powers(pow(_BASE, -1, 2**64), BLOCK_BYTES)


class Alphabet:
    """Which bytes separate words; A-Z count as a-z. Bytes of non-ASCII characters belong to words."""

    def __init__(self, separators: bytes):
        self.separates = np.zeros(256, bool)
        self.separates[list(separators)] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.codes = np.where(self.separates, np.uint64(0), _BYTE_CODES[lower])


SPACED = Alphabet(bytes([32, *range(9, 14)]))
ALNUM = Alphabet(bytes([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its texts; null is the empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or that field of the column ``row``."""
    at = batch.schema.get_field_index("row")
    return batch.column(at).field("text") if at >= 0 else batch.column(batch.schema.get_field_index("text"))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; a longer text makes a slice of its own."""
    for batch in batches:
        _, offsets = buffers(text_of(batch))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _cuts(data: np.ndarray, starts_text: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK_BYTES that end between words; a word longer than that stays whole."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + BLOCK_BYTES)
        while stop < n:
            free = np.flatnonzero(alphabet.separates[data[at:stop]] | starts_text[at:stop])
            if len(free) and free[-1] > 0:
                stop = at + int(free[-1])
                break
            stop = min(n, stop + BLOCK_BYTES)
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text its first word (n + 1 positions)."""
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    hashes, places = [], []
    for at, stop in _cuts(data, starts_text[:-1], alphabet):
        part = data[at:stop]
        inside = ~alphabet.separates[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | starts_text[at + 1 : stop]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        if len(part) <= BLOCK_BYTES:
            up, down = _UP[: len(part)], _DOWN
        else:
            up, down = _powers(_BASE, len(part)), _powers(pow(_BASE, -1, 2**64), len(part))
        hashes.append(mix(np.add.reduceat(alphabet.codes[part] * up, starts) * down[starts]))
        places.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets, "left")


def sequence_hash(words: np.ndarray) -> np.uint64:
    """One hash of a short word sequence, different for each length."""
    total = np.array([len(words) * 0x51ED270B], np.uint64)
    for w in words:
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + w)
    return total[0]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place; the last k - 1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words[i : i + n])
    return total


def shingles(column: pa.Array, k: int, alphabet: Alphabet = SPACED) -> list[np.ndarray]:
    """Per text its distinct k-word shingles, sorted; a text of fewer words has one, a text without words none."""
    data, offsets = buffers(column)
    words, first = word_hashes(data, offsets, alphabet)
    rolled = rolling(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(np.array([sequence_hash(words[a:b])] if b > a else [], np.uint64))
    return out
