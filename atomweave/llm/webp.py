"""Lossless WebP (VP8L): a whole decoder, and an encoder for its features.

Pixels are uint8 arrays (height, width, 4) in the order red, green, blue, alpha.  The format is
that of the public WebP lossless bitstream specification.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, HASH, LENGTHS, DISTANCES = 0x2F, 0x1E35A7BD, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels in the order of their distance codes: nearer first, then the smaller |x|, the left of the two last.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return x


def _reversed(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def canonical(lengths) -> list[int]:
    """The codes of a canonical prefix code, bit-reversed as they stand in the stream."""
    code, out = 0, [0] * len(lengths)
    for n in range(1, max(lengths, default=0) + 1):
        code <<= 1
        for s, x in enumerate(lengths):
            if x == n:
                out[s] = _reversed(code, n)
                code += 1
    return out


class Code:
    """A prefix code: ``read`` gives the next symbol.  A code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used = [0]
        self.used, self.only = used, used[0] if len(used) == 1 else None
        self.lengths = lengths
        self.most = 0 if self.only is not None else max(lengths)
        if self.only is None:
            if sum(1 << (self.most - lengths[s]) for s in used) != 1 << self.most:
                raise ValueError("not a complete prefix code")
            self.symbol, self.size = np.zeros(1 << self.most, np.int32), np.zeros(1 << self.most, np.int32)
            for s, c in enumerate(canonical(lengths)):
                if lengths[s]:
                    self.symbol[c :: 1 << lengths[s]] = s
                    self.size[c :: 1 << lengths[s]] = lengths[s]
            self.symbols, self.sizes = self.symbol.tolist(), self.size.tolist()

    @property
    def uniform(self) -> bool:
        return self.only is not None or {self.lengths[s] for s in self.used} == {self.most}

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.peek(self.most)
        bits.read(self.sizes[at])
        return self.symbols[at]


_CODES: dict[tuple, Code] = {}


def _code(lengths: list[int]) -> Code:
    key = tuple(lengths)
    if key not in _CODES:
        if len(_CODES) > 64:
            _CODES.clear()
        _CODES[key] = Code(lengths)
    return _CODES[key]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _code(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code, left = _code(own), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            before, at = n or before, at + 1
            continue
        value, times = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + times > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = [value] * times
        at += times
    return _code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


REVERSED = np.array([_reversed(x, 8) for x in range(256)], np.uint8)


def _uniform_pixels(bits: Bits, group: list[Code], n: int) -> np.ndarray:
    """Literal pixels whose four codes have constant lengths, all at once."""
    sizes = [c.most for c in group[:4]]
    per = sum(sizes)
    begin, shift = bits.at >> 3, bits.at & 7
    bits.at += n * per
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    raw = np.frombuffer(bits.data, np.uint8)
    if sizes == [8, 8, 8, 8]:
        b = raw[begin : begin + 4 * n + 1]
        channels = ((b[:-1] >> shift) | (b[1:].astype(np.uint16) << (8 - shift))).astype(np.uint8).reshape(n, 4)
        channels = [c.symbol[channels[:, k]] for k, c in enumerate(group[:4])]
    else:
        flat = np.unpackbits(raw[begin : begin + (n * per + shift + 7) // 8], bitorder="little")[shift : shift + n * per].reshape(n, per)
        channels, at = [], 0
        for c, size in zip(group[:4], sizes, strict=True):
            index = flat[:, at : at + size].astype(np.int64) @ (1 << np.arange(size))
            channels.append(c.symbol[index] if size else np.full(n, c.only))
            at += size
    g, r, b, a = (x.astype(np.uint32) for x in channels)
    return a << 24 | r << 16 | g << 8 | b


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as packed ARGB; the main image may have a colour cache and several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_of = (read_pixels(bits, _up(width, block), _up(height, block), False) >> 8 & 0xFFFF).tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    alphabets = (256 + LENGTHS + len(cache), 256, 256, 256, DISTANCES)
    groups = [[read_code(bits, n) for n in alphabets] for _ in range(max(groups_of) + 1 if groups_of else 1)]
    total = width * height
    first = groups[0]
    if groups_of is None and not cache and max(first[0].used) < 256 and all(c.uniform for c in first[:4]):
        return _uniform_pixels(bits, first, total)
    out: list[int] = []
    wide, done = _up(width, block), 0

    def remember(n: int) -> None:
        for x in out[n:]:
            cache[(HASH * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x

    while len(out) < total:
        n = len(out)
        group = first if groups_of is None else groups[groups_of[(n // width >> block) * wide + (n % width >> block)]]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 256 + LENGTHS:
            length = _extra(bits, s - 256)
            back = _distance(_extra(bits, group[4].read(bits)), width)
            if back > n or n + length > total:
                raise ValueError("a reference leaves the image")
            if back >= length:
                out.extend(out[n - back : n - back + length])
            else:
                out.extend((out[n - back :] * (length // back + 1))[:length])
        else:
            remember(done)
            done = n
            out.append(cache[s - 256 - LENGTHS])
        if cache:
            remember(done)
            done = len(out)
    return np.array(out, np.uint32)


def _split(argb: np.ndarray) -> np.ndarray:
    """Packed pixels as int16 columns alpha, red, green, blue."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int16)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left, top, right, corner):
    """The value that a predictor mode expects, per channel, from the left, top, top-right and top-left pixels."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _half(_half(left, right), top)
        case 6:
            return _half(left, corner)
        case 7:
            return _half(left, top)
        case 8:
            return _half(corner, top)
        case 9:
            return _half(top, right)
        case 10:
            return _half(_half(left, corner), _half(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        case 12:
            return [_clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
        case 13:
            return [_clip(m + int((m - c) / 2)) for m, c in zip(_half(left, top), corner, strict=True)]
    return (255, 0, 0, 0)


def _predicted(pixels: list, i: int, width: int, modes, block: int, wide: int):
    """What pixel i is expected to be from those before it."""
    y, x = divmod(i, width)
    if not y:
        return pixels[i - 1] if x else (255, 0, 0, 0)
    if not x:
        return pixels[i - width]
    mode = modes[(y >> block) * wide + (x >> block)]
    return predict(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def _undo_predictor(argb: np.ndarray, width: int, modes: list[int], block: int) -> np.ndarray:
    wide, out = _up(width, block), []
    for i, rest in enumerate(_split(argb).tolist()):
        out.append([(r + p) & 255 for r, p in zip(rest, _predicted(out, i, width, modes, block, wide), strict=True)])
    return _join(np.array(out))


def _colour_deltas(argb: np.ndarray, width: int, elements: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    i = np.arange(len(argb))
    own = elements[(i // width >> block) * _up(width, block) + (i % width >> block)]
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int32)
    return signed(own >> 16 & 255), signed(own >> 8 & 255), signed(own & 255), signed


def _cross_colour(argb: np.ndarray, width: int, elements: np.ndarray, block: int, undo: bool) -> np.ndarray:
    red_blue, green_blue, green_red, signed = _colour_deltas(argb, width, elements, block)
    c, way = _split(argb).astype(np.int32), 1 if undo else -1
    green, red = signed(c[:, 2]), c[:, 1]
    new_red = (red + way * (green_red * green >> 5)) & 255
    blue = c[:, 3] + way * (green_blue * green >> 5) + way * (red_blue * signed(new_red if undo else red) >> 5)
    c[:, 1], c[:, 3] = new_red, blue & 255
    return _join(c)


def _green(argb: np.ndarray, way: int) -> np.ndarray:
    c = _split(argb)
    c[:, 1] += way * c[:, 2]
    c[:, 3] += way * c[:, 2]
    return _join(c)


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _unbundle(argb: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bits = _palette_bits(len(table))
    packed = (argb >> 8 & 255).reshape(height, -1)
    x = np.arange(width)
    index = packed[:, x >> bits] >> ((x & ((1 << bits) - 1)) * (8 >> bits)).astype(np.uint32) & ((1 << (8 >> bits)) - 1)
    return np.append(table, np.zeros(256, np.uint32))[index].ravel()


def stream_of(data: bytes) -> bytes:
    """The VP8L chunk of a file, in the plain or the extended container."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("not a lossless WebP file")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    bits = Bits(stream_of(data))
    if bits.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in steps):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            steps.append((kind, now, read_pixels(bits, _up(now, block), _up(height, block), False), block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _join(np.cumsum(_split(read_pixels(bits, n, 1, False)).astype(np.int64), 0))
            steps.append((kind, now, table, 0))
            now = _up(now, _palette_bits(n))
        else:
            steps.append((kind, now, None, 0))
    argb = read_pixels(bits, now, height, True)
    for kind, wide, own, block in reversed(steps):
        if kind == PREDICTOR:
            argb = _undo_predictor(argb, wide, (own >> 8 & 15).tolist(), block)
        elif kind == CROSS_COLOUR:
            argb = _cross_colour(argb, wide, own, block, True)
        elif kind == SUBTRACT_GREEN:
            argb = _green(argb, 1)
        else:
            argb = _unbundle(argb, wide, height, own)
    c = _split(argb).astype(np.uint8)
    out = np.stack([c[:, 1], c[:, 2], c[:, 3], c[:, 0] if alpha else np.full(len(c), 255, np.uint8)], -1)
    return out.reshape(height, width, 4)


# -- writing ------------------------------------------------------------------------------------


class Out:
    """Writes bits, least significant first."""

    def __init__(self):
        self.acc = self.n = 0

    def put(self, x: int, n: int) -> None:
        self.acc |= x << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.acc.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: dict[int, int], alphabet: int, most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; counts are levelled until they fit."""
    used = {s: c for s, c in counts.items() if c}
    lengths = [0] * alphabet
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    while True:
        heap = [(c, s, (s,)) for s, c in used.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            (a, s, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                depth[k] += 1
            heapq.heappush(heap, (a + b, s, x + y))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        used = {s: c // 2 + 1 for s, c in used.items()}


def write_code(out: Out, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(0, 1)
    runs, at = [], 0
    while at < len(lengths):
        n, times = lengths[at], 1
        while at + times < len(lengths) and lengths[at + times] == n:
            times += 1
        at += times
        if n:
            runs.append((n, 0, 0))
            times -= 1
        while times:
            if n and times >= 3:
                k = min(times, 6)
                runs.append((16, k - 3, 2))
            elif not n and times >= 11:
                k = min(times, 138)
                runs.append((18, k - 11, 7))
            elif not n and times >= 3:
                k = times
                runs.append((17, k - 3, 3))
            else:
                k = 1
                runs.append((n, 0, 0))
            times -= k
    counts: dict[int, int] = {}
    for s, *_ in runs:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 19, 7)
    out.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        out.put(own[s], 3)
    out.put(0, 1)
    codes, single = canonical(own), len(counts) == 1
    for s, extra, n in runs:
        out.put(codes[s], 0 if single else own[s])
        out.put(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and its bits for a length or distance code."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


@dataclass
class Plan:
    """What the encoder uses.  The default takes literals only."""

    references: bool = False
    cache_bits: int = 0
    group_block: int = 0
    steps: list = field(default_factory=list)  # (kind, values, block) in the order of application


def _symbols(argb: list[int], width: int, plan: Plan, main: bool):
    near = {}
    for k, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), k + 1)
    bits = plan.cache_bits if main else 0
    cache, seen, i, out = [0] * (1 << bits), {}, 0, []
    while i < len(argb):
        length = 0
        if plan.references and i + 3 <= len(argb):
            j = seen.get(tuple(argb[i : i + 3]))
            if j is not None:
                while length < 4096 and i + length < len(argb) and argb[j + length] == argb[i + length]:
                    length += 1
        h = (HASH * argb[i] & 0xFFFFFFFF) >> (32 - bits) if bits else 0
        if length:
            out.append(("copy", i, length, near.get(i - j, i - j + len(NEAR))))
        elif bits and cache[h] == argb[i]:
            out.append(("cache", i, h, 0))
        else:
            out.append(("pixel", i, argb[i], 0))
        for k in range(i, i + max(1, length)):
            if bits:
                cache[(HASH * argb[k] & 0xFFFFFFFF) >> (32 - bits)] = argb[k]
            seen[tuple(argb[k : k + 3])] = k
        i += max(1, length)
    return out


def write_pixels(out: Out, argb: np.ndarray, width: int, plan: Plan, main: bool) -> None:
    cache = plan.cache_bits if main else 0
    out.put(bool(cache), 1)
    if cache:
        out.put(cache, 4)
    height = len(argb) // width
    block, groups = (plan.group_block if main else 0), 1
    if main:
        out.put(bool(block), 1)
        if block:
            out.put(block - 2, 3)
            n = _up(width, block) * _up(height, block)
            groups = min(n, 3)
            write_pixels(out, (np.arange(n) % groups).astype(np.uint32) << 8 | np.uint32(0xFF000000), _up(width, block), Plan(), False)
    alphabets = (256 + LENGTHS + ((1 << cache) if cache else 0), 256, 256, 256, DISTANCES)
    of = lambda i: ((i // width >> block) * _up(width, block) + (i % width >> block)) % groups if block else 0
    symbols = _symbols(argb.tolist(), width, plan, main)
    words = []
    for kind, i, x, d in symbols:
        if kind == "pixel":
            words.append((of(i), [(0, x >> 8 & 255, 0, 0), (1, x >> 16 & 255, 0, 0), (2, x & 255, 0, 0), (3, x >> 24, 0, 0)]))
        elif kind == "cache":
            words.append((of(i), [(0, 256 + LENGTHS + x, 0, 0)]))
        else:
            (a, ae, an), (b, be, bn) = _prefix(x), _prefix(d)
            words.append((of(i), [(0, 256 + a, ae, an), (4, b, be, bn)]))
    counts = [[{} for _ in range(5)] for _ in range(groups)]
    for g, parts in words:
        for k, s, *_ in parts:
            counts[g][k][s] = counts[g][k].get(s, 0) + 1
    codes = []
    for g in range(groups):
        row = [code_lengths(counts[g][k], alphabets[k], 15) for k in range(5)]
        for lengths in row:
            write_code(out, lengths)
        codes.append([(x, canonical(x), sum(map(bool, x)) < 2) for x in row])
    for g, parts in words:
        for k, s, extra, n in parts:
            lengths, code, single = codes[g][k]
            out.put(code[s], 0 if single else lengths[s])
            out.put(extra, n)


def _file(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _header(width: int, height: int) -> Out:
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise ValueError("a side has 1 to 16384 pixels")
    out = Out()
    for x, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(x, n)
    return out


def encode(pixels: np.ndarray, plan: Plan | None = None) -> bytes:
    """A lossless file with the features of the plan: back-references, colour cache, groups of codes, transforms."""
    plan = plan or Plan()
    height, width = pixels.shape[:2]
    out = _header(width, height)
    argb = _join(pixels.reshape(-1, 4)[:, [3, 0, 1, 2]])
    for kind, values, block in plan.steps:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.put(block - 2, 3)
            own = np.resize(np.array(values, np.uint32), _up(width, block) * _up(height, block))
            stored = (own << 8 | np.uint32(0xFF000000)) if kind == PREDICTOR else own
            write_pixels(out, stored.astype(np.uint32), _up(width, block), Plan(), False)
            if kind == PREDICTOR:
                all_of, modes, wide = _split(argb).tolist(), own.tolist(), _up(width, block)
                argb = _join(np.array([[x - p for x, p in zip(c, _predicted(all_of, i, width, modes, block, wide), strict=True)] for i, c in enumerate(all_of)]))
            else:
                argb = _cross_colour(argb, width, own, block, False)
        elif kind == SUBTRACT_GREEN:
            argb = _green(argb, -1)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("over 256 colours")
            out.put(len(table) - 1, 8)
            write_pixels(out, _join(np.diff(_split(table), axis=0, prepend=0)), len(table), Plan(), False)
            bits = _palette_bits(len(table))
            wide = _up(width, bits)
            rows = np.zeros((height, wide << bits), np.uint32)
            rows[:, :width] = index.reshape(height, width)
            shift = (np.arange(1 << bits) * (8 >> bits)).astype(np.uint32)
            argb = ((rows.reshape(height, wide, 1 << bits) << shift).sum(-1).astype(np.uint32) << 8 | np.uint32(0xFF000000)).ravel()
            width = wide
    out.put(0, 1)
    write_pixels(out, argb, width, plan, True)
    return _file(out.bytes())


def _literal_head() -> Out:
    """The bits between the sizes and the pixels if every channel has the 256 codes of 8 bits."""
    out = Out()
    out.put(0, 3)
    for n in (256 + LENGTHS, 256, 256, 256):
        write_code(out, [8] * 256 + [0] * (n - 256))
    write_code(out, [0] * DISTANCES)
    return out


_HEAD = _literal_head()


def encode_literal(pixels: np.ndarray) -> bytes:
    """A lossless file of literal pixels with codes of 8 bits: as fast to write as to read, for data without pixel structure."""
    height, width = pixels.shape[:2]
    out = _header(width, height)
    out.put(_HEAD.acc, _HEAD.n)
    data = REVERSED[np.ascontiguousarray(pixels.reshape(-1, 4)[:, [1, 0, 2, 3]]).ravel()]
    head, shift = bytearray(out.bytes()), out.n & 7
    if not shift:
        return _file(bytes(head) + data.tobytes())
    wide = np.zeros(len(data) + 1, np.uint16)
    wide[:-1] = data.astype(np.uint16) << shift
    wide[1:] |= (data >> (8 - shift)).astype(np.uint16)
    body = (wide & 255).astype(np.uint8)
    head[-1] |= body[0]
    return _file(bytes(head) + body[1:].tobytes())
