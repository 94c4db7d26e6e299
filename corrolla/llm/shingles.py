"""Word shingles as 64-bit values, computed for many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
#: The white space that separates words, and what stands for each byte in a word's value: A-Z as a-z.
_SPACE = np.isin(np.arange(256), [*b"\x20\t\n\x0b\f\r"])
_BYTE = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
#: Bytes of text whose words are valued at a time, but for a longer word.
PIECE = 1 << 18
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _M and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        inverse = pow(int(_M), -1, 1 << 64)
        for i, x in enumerate((int(_M), inverse)):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
    return _POWERS


def _piece_values(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and first bytes of the words in data (bytes); a word ends at white space or before a byte marked in first.

    A word's value is a polynomial of its bytes, from differences of running sums, so no word is handled by itself."""
    power, inverse = _powers(len(data) + 1)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & (np.r_[True, space[:-1]] | first))
    ends = np.flatnonzero(~space & np.r_[space[1:] | first[1:], True]) + 1
    sums = np.cumsum(np.r_[np.uint64(0), _BYTE[data] * power[: len(data)]])
    return mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)), begins


def words_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A value for each word [^\\x20\\x09-\\x0D]+ of the texts (strings without nulls), A-Z in lower case, one text after
    the other, and where each text's words start among them (one more than texts)."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    _, at, raw = texts.buffers()
    if not len(texts) or raw is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = np.frombuffer(raw, np.uint8)[at[0] : at[-1]], at - at[0]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    values, places, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(data):
        high, reach = min(len(data), low + PIECE), PIECE
        while high < len(data):  # to the end of a word
            cut = np.flatnonzero(_SPACE[data[low:high]])
            if len(cut):
                high = low + int(cut[-1]) + 1
                break
            reach *= 2
            high = min(len(data), low + reach)
        v, p = _piece_values(data[low:high], first[low:high])
        values.append(v)
        places.append(p + low)
        low = high
    return np.concatenate(values), np.searchsorted(np.concatenate(places), at)


def word_values(text: str) -> np.ndarray:
    return words_of_texts(pa.array([text], pa.large_string()))[0]


def shingles_of_texts(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_values of each text's words, one text after the other, and where each text's start (one more than texts)."""
    n = np.diff(starts)
    short = np.flatnonzero((n > 0) & (n < size))
    out = np.full(max(0, len(words) - size + 1), size, dtype=np.uint64)
    for i in range(size):
        out = out * _M + words[i : len(out) + i]
    out = mix(out)
    count = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(count)
    begins = ends - count
    place = np.arange(ends[-1] if len(n) else 0) - np.repeat(begins, count) + np.repeat(starts[:-1], count)
    own = out[np.minimum(place, len(out) - 1)] if len(out) else np.zeros(len(place), np.uint64)
    for i in short.tolist():
        own[begins[i]] = shingle_values(words[starts[i] : starts[i + 1]], size)[0]
    return own, np.concatenate([[0], ends]).astype(np.int64)


def shingle_values(words: np.ndarray, size: int) -> np.ndarray:
    """The value of each run of `size` words, in order; of all words as one run if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * _M + words[i : n - size + 1 + i]
    return mix(out)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
