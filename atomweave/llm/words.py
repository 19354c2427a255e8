"""Words of many texts at once: their places, hashes, shingles, and majority fingerprints."""

from __future__ import annotations

import re

import numpy as np

#: ASCII capitals become small letters.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: White space is U+0020 and U+0009 to U+000D.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The base of the words' hashes and its inverse modulo 2^64.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 2**64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes that are worked on in one go, but for longer texts.
TOGETHER = 1 << 18
#: The bits of a byte as the low bits of eight bytes.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[k]
    return x ^ (x >> np.uint64(29))


def range_hashes(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of every range of bytes the sum of (byte + 1) * BASE^place, places from 0."""
    if len(_POWERS[0]) <= len(text):
        n = max(len(text) + 1, 2 * TOGETHER)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, INVERSE)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(text)])])
    return (sums[ends] - sums[begins]) * _POWERS[1][begins]


class Words:
    """The words of texts (UTF-8), one after the other; ``blank`` tells which bytes, small letters already, are in no word.

    ``starts, stops`` are byte offsets in ``raw``, the texts joined by line breaks; ``at, behind`` those in ``plain``, all words in small
    letters with a blank behind each; ``h`` are hashes.  ``some`` are the texts that have a word, ``begins, ends`` their words.
    """

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK):
        self.raw = b"\n".join(texts)
        low = np.frombuffer(self.raw.translate(LOWER), np.uint8)
        blank = blank[low]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
        self.starts, self.stops = edge[::2], edge[1::2]
        keep = ~blank
        keep[self.stops[self.stops < len(low)]] = True
        plain = low[keep]
        size = self.stops - self.starts
        self.at = np.cumsum(size + 1) - size - 1
        self.behind = self.at + size
        self.h = range_hashes(plain, self.at, self.behind)
        plain[self.behind[self.behind < len(plain)]] = 32
        self.plain = plain.tobytes()
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.cumsum(lengths) - lengths
        bounds = np.searchsorted(self.starts, np.append(self.offset, len(self.raw) + 1))
        self.some = np.flatnonzero(np.diff(bounds))
        self.begins, self.ends = bounds[self.some], bounds[self.some + 1]

    def points(self):
        """A function from byte offsets in ``raw`` to numbers of code points before them."""
        if self.raw.isascii():
            return lambda p: p
        code = np.concatenate([[0], np.cumsum(np.frombuffer(self.raw, np.uint8) & 0xC0 != 0x80)])
        return lambda p: code[p]

    def shingles(self, k: int) -> np.ndarray:
        """A hash of the k words from every word on, of fewer at the end; those that run past a text's end mean nothing."""
        out, m = np.zeros(len(self.h), np.uint64), mixed(self.h, 4)
        for j in range(min(k, len(m))):
            out[: len(m) - j] += m[j:] * MIX[j]
        return out


def chunks(column, most: int = TOGETHER):
    """Stretches of a column of binary Arrow values with about ``most`` bytes each: (first row, values)."""
    i = 0
    while i < len(column):
        some, size = [], 0
        while i + len(some) < len(column) and size < most:
            some.append(column[i + len(some)].as_py())
            size += len(some[-1])
        yield i, some
        i += len(some)


def distinct(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once per group; groups are numbers in rising order."""
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[first], group[first]


def majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Fingerprints of groups of hashes (rows of 64-bit numbers; group g begins at ``begins[g]``): bits that over half of them have.

    Eight bits are counted at once in the bytes of a number, in stretches of up to 255 rows.
    """
    n = len(hashes)
    sizes = np.diff(np.append(begins, n))
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    stretch = np.repeat(begins - 255 * first, parts) + 255 * np.arange(parts.sum())
    counts = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(n, -1)], stretch, axis=0)
    total = np.add.reduceat(counts.view(np.uint8).reshape(len(stretch), -1), first, axis=0, dtype=np.int32)
    return np.packbits(total * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, split at ASCII white space; null has no words."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingle_set(text: str | None, k: int) -> frozenset[bytes]:
    """The words of every k-word shingle; those of the whole text if they are fewer."""
    w = words_of(text)
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
