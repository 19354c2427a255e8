"""Lossless WebP files of byte texts, many at a time: written with prefix codes, back-references and colour cache, and read in lockstep.

The prefix codes are not fitted to a text but made once by a rule, so that equal texts give equal files and many files share
their tables.  Files whose tables agree, with whatever encoder they were made, are decoded together, one symbol of each at a time.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from . import webp
from .webp import DISTANCES, HASH, LENGTHS, NEAR, Bits, Code, Out

#: Characters of running text, frequent ones first; a weight falls with the rank.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz,.\n-'0123456789"
#: Bits of the colour caches that the encoder chooses from (0: none).
CACHES = (0, 8)
#: The longest code the encoder uses: four of them fit a 64-bit window whatever the bit they begin at.
LONGEST = 13
#: So many files are read in lockstep at least; the rest of longer ones is read by itself.
FEWEST = 32
#: Longest copy.
LONGEST_COPY = 4096


def byte_weights() -> list[int]:
    """Expected frequencies: the listed characters by rank, capitals and other ASCII signs rarely, bytes of longer characters in between."""
    out = [2 if b < 128 else 12 for b in range(256)]
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[ord(c)] = 12
    for n, c in enumerate(FREQUENT):
        out[ord(c)] = max(16, 6000 // (n + 3))
    out[32] = 4000
    return out


@dataclass(frozen=True)
class Tables:
    """The five codes of a set, and the bits between a file's sizes and its pixels."""

    cache: int
    lengths: tuple
    codes: tuple
    head: int
    bits: int


@functools.lru_cache(maxsize=None)
def tables(cache: int) -> Tables:
    weights = byte_weights()
    total = sum(weights)
    out = Out()
    out.put(0, 1)
    out.put(cache > 0, 1)
    if cache:
        out.put(cache, 4)
    out.put(0, 1)
    lengths, codes = [], []
    size = (1 << cache) if cache else 0
    green = weights + [total // (60 + 20 * n) for n in range(LENGTHS)] + ([max(1, total // (5 * size))] * size if size else [])
    for counts in (green, weights, weights, weights, [1] * DISTANCES):
        x = webp.code_lengths(dict(enumerate(counts)), len(counts), LONGEST)
        webp.write_code(out, x)
        lengths.append(np.array(x, np.uint64))
        codes.append(np.array(webp.canonical(x), np.uint64))
    return Tables(cache, tuple(lengths), tuple(codes), out.acc, out.n)


def _previous(key: np.ndarray) -> np.ndarray:
    """The last earlier place with the same key, -1 if there is none."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra values and their bits of lengths or distance codes."""
    v = value - 1
    n = np.maximum(0, np.frexp(v.astype(float))[1] - 2)
    symbol = np.where(value < 5, v, 2 * n + 2 + (v >> n & 1))
    n = np.where(value < 5, 0, n)
    return symbol, (v & ((1 << n) - 1)).astype(np.uint64), n.astype(np.uint64)


@functools.lru_cache(maxsize=8)
def _near(width: int) -> np.ndarray:
    """Distance codes of the distances that the two-dimensional ones reach; 0 where none does."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        out[max(1, x + y * width)] = k + 1
    return out


def _copies(px: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pixels, lengths and distances of the stretches of three or more pixels that stand at one distance before."""
    before = _previous(owner << np.uint64(32) | px)
    distance = np.where(before >= 0, np.arange(len(px)) - before, 0)
    new = np.ones(len(px), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(px)))
    parts = -(-length // LONGEST_COPY)  # a long one in several
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + nth * LONGEST_COPY
    length = np.minimum(np.repeat(length, parts) - nth * LONGEST_COPY, LONGEST_COPY)
    some = (length >= 3) & (distance[first] > 0)
    return first[some], length[some], distance[first[some]]


def _fields(t: Tables, px: np.ndarray, owner: np.ndarray, first: np.ndarray, length: np.ndarray, distance: np.ndarray, width: np.ndarray):
    """Of every symbol: its first pixel, its bits, and how many."""
    channels = [(px >> np.uint64(s) & np.uint64(255)).astype(np.int64) for s in (8, 16, 0, 24)]  # green, red, blue, alpha
    bits = np.zeros(len(px), np.uint64)
    value = np.zeros(len(px), np.uint64)
    for code, size, c in zip(t.codes, t.lengths, channels, strict=False):
        value |= code[c] << bits
        bits += size[c]
    if t.cache:
        slot = (px * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - t.cache)
        last = _previous(owner << np.uint64(32) | slot)
        hit = np.flatnonzero((last >= 0) & (px[last] == px))
        symbol = 256 + LENGTHS + slot[hit].astype(np.int64)
        value[hit], bits[hit] = t.codes[0][symbol], t.lengths[0][symbol]
    keep = np.ones(len(px), bool)
    if len(first):
        inner = np.repeat(first, length - 1) + 1 + np.arange((length - 1).sum()) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1)
        keep[inner] = False
        known, wide = np.zeros(len(first), np.int64), width[owner[first].astype(np.int64)]
        for x in np.unique(wide).tolist():
            near, own = _near(x), wide == x
            known[own] = np.where(distance[own] < len(near), near[np.minimum(distance[own], len(near) - 1)], 0)
        a, ax, an = _prefixes(length)
        b, bx, bn = _prefixes(np.where(known > 0, known, distance + len(NEAR)))
        v, n = t.codes[0][256 + a], t.lengths[0][256 + a]
        for x, size in ((ax, an), (t.codes[4][b], t.lengths[4][b]), (bx, bn)):
            v = v | x << n
            n = n + size
        value[first], bits[first] = v, n
    at = np.flatnonzero(keep)
    return at, value[at], bits[at]


def encode_many(pictures: list[np.ndarray]) -> list[bytes]:
    """A file for every picture (height, width, 4); of the caches, and of codes of 8 bits, each takes what is smallest."""
    sizes = np.array([p.shape[0] * p.shape[1] for p in pictures])
    ends = np.cumsum(sizes)
    c = np.concatenate([p.reshape(-1, 4) for p in pictures]).astype(np.uint64)
    px = c[:, 3] << np.uint64(24) | c[:, 0] << np.uint64(16) | c[:, 1] << np.uint64(8) | c[:, 2]
    owner = np.repeat(np.arange(len(pictures)), sizes).astype(np.uint64)
    width = np.array([p.shape[1] for p in pictures])
    first, length, distance = _copies(px, owner)
    made, costs = [], []
    for cache in CACHES:
        t = tables(cache)
        at, value, bits = _fields(t, px, owner, first, length, distance, width)
        own = np.searchsorted(at, ends - sizes)
        made.append((t, at, value, bits, own))
        costs.append(np.add.reduceat(bits, own) + np.uint64(40 + t.bits))
    costs.append(np.array([40 + webp._HEAD.n + 32 * n for n in sizes], np.uint64))
    best = np.array(costs).argmin(0)
    out: list[bytes] = [b""] * len(pictures)
    for k, (t, at, value, bits, own) in enumerate(made):
        chosen = np.flatnonzero(best == k)
        if not len(chosen):
            continue
        behind = np.append(own[1:], len(at))
        counts = (behind - own)[chosen]
        rows = np.repeat(own[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        value, bits = value[rows], bits[rows]
        total = costs[k][chosen].astype(np.int64)
        words = total // 64 + 2
        base = np.cumsum(words) - words
        before = np.cumsum(bits) - bits
        begin = np.cumsum(counts) - counts
        pos = (before - np.repeat(before[begin], counts)).astype(np.int64) + 40 + t.bits + 64 * np.repeat(base, counts)
        shift = (pos & 63).astype(np.uint64)
        low, high = value << shift, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        word = pos >> 6
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        buffer = np.zeros(int(words.sum()) + 1, "<u8")
        buffer[word[starts]] |= np.bitwise_or.reduceat(low, starts)
        buffer[word[starts] + 1] |= np.bitwise_or.reduceat(high, starts)
        raw = buffer.view(np.uint8)
        head = np.frombuffer(t.head.to_bytes((t.bits + 7) // 8, "little"), np.uint8)
        for n, i in enumerate(chosen.tolist()):
            height, wide = pictures[i].shape[:2]
            a = 8 * int(base[n])
            raw[a : a + 5] = np.frombuffer(webp._header(wide, height).bytes(), np.uint8)
            raw[a + 5 : a + 5 + len(head)] |= head
            out[i] = webp._file(raw[a : a + (int(total[n]) + 7) // 8].tobytes())
    for i in np.flatnonzero(best == len(made)).tolist():
        out[i] = webp.encode_literal(pictures[i])
    return out


class Plain:
    """Tables of a file without transforms and code groups, ready for many lanes; found again by the bits they are written with."""

    def __init__(self, cache: int, group: list[Code], bits: int):
        self.cache, self.group, self.bits = cache, group, bits
        arrays = [(np.zeros(1, np.int32) + c.only, np.zeros(1, np.int32)) if c.only is not None else (c.symbol, c.size) for c in group]
        self.table = [a.astype(np.int64) << 4 | b for a, b in arrays]  # symbol and size of every window of bits
        self.mask = [len(a) - 1 for a, _ in arrays]
        self.wide = sum(c.most for c in group[:4]) <= 56


_KNOWN: dict[bytes, Plain | None] = {}


def _plain(stream: bytes) -> tuple[bytes, Plain] | None:
    """The tables of a stream that begins at its byte 5 with what follows the sizes, or None if it has transforms or code groups."""
    for key, p in _KNOWN.items():
        whole, rest = divmod(p.bits, 8)
        if stream[5 : 5 + whole] == key[:whole] and (not rest or (stream[5 + whole] ^ key[whole]) & ((1 << rest) - 1) == 0):
            return key, p
    bits = Bits(stream)
    bits.at = 40
    if bits.read(1):
        return None
    cache = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    group = [webp.read_code(bits, n) for n in (256 + LENGTHS + ((1 << cache) if cache else 0), 256, 256, 256, DISTANCES)]
    p = Plain(cache, group, bits.at - 40)
    if not p.wide:
        return None
    if len(_KNOWN) >= 16:
        _KNOWN.clear()
    key = stream[5 : 5 + (p.bits + 7) // 8]
    _KNOWN[key] = p
    return key, p


def _value(prefix: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a prefix symbol and its extra bits (the low ones of w) stand for, and how many bits these are."""
    n = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + (w & ((1 << n) - 1)) + 1), n


def _lockstep(streams: list[bytes], sizes: list[tuple[int, int]], p: Plain) -> list[np.ndarray]:
    """Packed pixels of streams with the same tables."""
    lengths = np.array([len(s) for s in streams])
    data = b"".join(streams) + bytes(16)
    view = np.ndarray((len(data) - 8,), "<i8", data, strides=(1,))  # the sign only reaches bits that are not looked at
    ends = np.cumsum([w * h for w, h in sizes])
    begins = ends - np.array([w * h for w, h in sizes])
    out = np.zeros(int(ends[-1]), np.uint32)
    lane = np.arange(len(streams))
    at = 8 * (np.cumsum(lengths) - lengths) + 40 + p.bits
    stop = 8 * np.cumsum(lengths)
    place, end = begins.copy(), ends
    cache = np.zeros((len(streams), 1 << p.cache), np.uint32) if p.cache else None
    down = np.uint32(32 - p.cache) if p.cache else None
    slot = lambda x: (x * np.uint32(HASH)) >> down
    (g, r, b, a, d), (gm, rm, bm, am, dm) = p.table, p.mask
    while len(lane) >= FEWEST:
        w = view[at >> 3] >> (at & 7)
        e = g[w & gm]
        n, s = e & 15, e >> 4
        lit = s < 256
        if lit.all():
            k, w1, n1, s1 = slice(None), w, n, s
        else:
            k = np.flatnonzero(lit)
            w1, n1, s1 = w[k], n[k], s[k]
        w1 = w1 >> n1
        x = r[w1 & rm]
        m = x & 15
        n1 = n1 + m
        w1 = w1 >> m
        y = b[w1 & bm]
        m = y & 15
        n1 = n1 + m
        w1 = w1 >> m
        z = a[w1 & am]
        px = ((z >> 4 << 24) | (x >> 4 << 16) | (s1 << 8) | (y >> 4)).astype(np.uint32)
        out[place[k]] = px
        if cache is not None:
            cache[lane[k], slot(px)] = px
        place[k] += 1
        at[k] += n1 + (z & 15)
        if not isinstance(k, slice):
            hit = np.flatnonzero(s >= 256 + LENGTHS)
            if len(hit):
                out[place[hit]] = cache[lane[hit], s[hit] - 256 - LENGTHS]
                place[hit] += 1
                at[hit] += n[hit]
            k = np.flatnonzero((s >= 256) & (s < 256 + LENGTHS))
            if len(k):
                length, extra = _value(s[k] - 256, w[k] >> n[k])
                at[k] += n[k] + extra
                w1 = view[at[k] >> 3] >> (at[k] & 7)
                e = d[w1 & dm]
                code, extra = _value(e >> 4, w1 >> (e & 15))
                at[k] += (e & 15) + extra
                for j, size, far in zip(k.tolist(), length.tolist(), code.tolist(), strict=True):
                    far = webp._distance(far, sizes[lane[j]][0])
                    x = int(place[j])
                    if far > x - begins[lane[j]] or x + size > end[j]:
                        raise ValueError("a reference leaves the image")
                    part = out[x - far : x - far + size] if far >= size else np.tile(out[x - far : x], -(-size // far))[:size]
                    out[x : x + size] = part
                    if cache is not None:
                        cache[lane[j], slot(part)] = part
                    place[j] = x + size
        if (at > stop[lane]).any():
            raise ValueError("the stream ends early")
        go = place < end
        if not go.all():
            lane, at, place, end = lane[go], at[go], place[go], end[go]
    for j in range(len(lane)):
        x, y = int(begins[lane[j]]), int(end[j])
        done = int(place[j]) - x
        _alone(data, int(at[j]), int(stop[lane[j]]), out[x:y], done, p, sizes[lane[j]][0], None if cache is None else cache[lane[j]].tolist())
    return [out[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _alone(data: bytes, at: int, stop: int, out: np.ndarray, done: int, p: Plain, width: int, cache: list[int] | None) -> None:
    """The rest of one stream, a symbol at a time."""
    px, total, down = out[:done].tolist(), len(out), 32 - p.cache
    (g, r, b, a, d), (gm, rm, bm, am, dm) = [[(e >> 4, e & 15) for e in t.tolist()] for t in p.table], p.mask
    base = at >> 3
    window, left, base = int.from_bytes(data[base : base + 512], "little") >> (at & 7), 4096 - (at & 7), base + 512
    while len(px) < total:
        if left < 128:
            window |= int.from_bytes(data[base : base + 512], "little") << left
            left, base = left + 4096, base + 512
        low = window & 0xFFFFFFFFFFFFFFFF
        s, n = g[low & gm]
        if s < 256:
            low >>= n
            x, m = r[low & rm]
            low >>= m
            y, k = b[low & bm]
            low >>= k
            z, q = a[low & am]
            n += m + k + q
            v = z << 24 | x << 16 | s << 8 | y
            px.append(v)
            if cache is not None:
                cache[(HASH * v & 0xFFFFFFFF) >> down] = v
        elif s >= 256 + LENGTHS:
            px.append(cache[s - 256 - LENGTHS])
        else:
            values = []
            for table, mask in ((None, 0), (d, dm)):
                if table is not None:
                    s, m = table[low >> n & mask]
                    n += m
                else:
                    s -= 256
                e = (s - 2) >> 1 if s >= 4 else 0
                values.append(s + 1 if s < 4 else ((2 + (s & 1)) << e) + (low >> n & ((1 << e) - 1)) + 1)
                n += e
                low = window & ((1 << 128) - 1)
            size, far = values[0], webp._distance(values[1], width)
            here = len(px)
            if far > here or here + size > total:
                raise ValueError("a reference leaves the image")
            part = px[here - far : here - far + size] if far >= size else (px[here - far :] * (size // far + 1))[:size]
            px.extend(part)
            if cache is not None:
                for v in part:
                    cache[(HASH * v & 0xFFFFFFFF) >> down] = v
        window >>= n
        left -= n
        at += n
        if at > stop:
            raise ValueError("the stream ends early")
    out[done:] = px[done:]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files; those with the same prefix codes and no transforms are read together."""
    out: list = [None] * len(files)
    groups: dict[bytes, tuple[Plain, list[int]]] = {}
    streams = []
    for i, f in enumerate(files):
        s = webp.stream_of(f)
        streams.append(s)
        found = _plain(s) if len(s) > 5 and s[0] == webp.SIGNATURE and not s[4] >> 5 else None
        if found is None or all(c.uniform for c in found[1].group[:4]) and max(found[1].group[0].used) < 256:
            out[i] = webp.decode(f)
        else:
            groups.setdefault(found[0], (found[1], []))[1].append(i)
    for p, rows in groups.values():
        sizes = []
        for i in rows:
            head = int.from_bytes(streams[i][1:5], "little")
            sizes.append(((head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1))
        for i, (w, h), px in zip(rows, sizes, _lockstep([streams[i] for i in rows], sizes, p), strict=True):
            c = np.stack([px >> np.uint32(k) & np.uint32(255) for k in (16, 8, 0, 24)], -1).astype(np.uint8)
            if not streams[i][4] >> 4 & 1:
                c[:, 3] = 255
            out[i] = c.reshape(h, w, 4)
    return out
