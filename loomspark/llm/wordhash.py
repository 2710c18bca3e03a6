"""Vectorised word and shingle hashing over whole Arrow string columns.

Texts are hashed as one contiguous UTF-8 buffer per Arrow batch, eight bytes of
every word at a time. No Python loop runs over words, but for very long ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes 0x20 and 0x09 to 0x0D separate words.
SPACE_CLASS = np.zeros(256, dtype=bool)
SPACE_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII bytes other than digits and letters separate words; bytes from 0x80 belong to words.
PUNCT_CLASS = np.ones(256, dtype=bool)
PUNCT_CLASS[0x30:0x3A] = PUNCT_CLASS[0x41:0x5B] = PUNCT_CLASS[0x61:0x7B] = PUNCT_CLASS[0x80:] = False

#: The lowest 0 to 8 bytes of a 64-bit value; words of more bytes than _LONG are hashed one by one.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (n + 1 values)."""
    breaks = np.flatnonzero(np.frombuffer(data.tobytes().translate(separators.tobytes()), dtype=bool))
    # Texts and separators cut the bytes into segments in order, so sorted beginnings and sorted ends pair up.
    starts = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and the place among them of each one given."""
    n = len(hashes)
    bits = np.uint64(n.bit_length())
    packed = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()  # much faster than an argsort
    order = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    found = hashes[order]
    if n and (found[1:] < found[:-1]).any():  # different hashes whose upper bits agree
        return np.unique(hashes, return_inverse=True)
    new = np.ones(n, dtype=bool)
    new[1:] = found[1:] != found[:-1]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], place


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z read as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    low[: len(data)] = data + (((data - np.uint8(0x41)) < 26).view(np.uint8) << 5)  # much faster than np.take
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=low, strides=(1,))  # eight bytes from each place on
    sizes = ends - starts
    out = mix64(sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (eights[starts] & _MASKS[np.minimum(sizes, 8)]))
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more) and at < _LONG:
        part = eights[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)]
        out[more] = mix64(out[more] * np.uint64(0x9FB21C651E98DF25) + part)
        at += 8
        more = more[sizes[more] > at]
    for i in more:
        digest = hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, in order, and n + 1 offsets into them.

    A text of 1 to k - 1 words has its whole sequence as its one window; a text without words has none.
    """
    n_words = np.diff(first)
    n_windows = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_windows)])
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), bounds
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(min(k, len(hashes))):
        rolled[: len(hashes) - j] = rolled[: len(hashes) - j] * np.uint64(0x9FB21C651E98DF25) + hashes[j:]
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n_windows)
    out = rolled[at]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        value = np.uint64(int(n_words[i]))
        for h in hashes[first[i] : first[i + 1]]:
            value = value * np.uint64(0x9FB21C651E98DF25) + h
        out[bounds[i]] = value
    return mix64(out), bounds
