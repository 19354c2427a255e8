"""SentencePiece encoding and decoding with a suffix array.

The distinct words of a batch lie end to end in one text.  Its suffixes are sorted by their first
characters (as many as the longest piece has), every piece of the vocabulary finds its range of
occurrences by binary search, and the occurrences are the edges of a lattice.  Sorted by the position
where they end, they are relaxed in that order: a prefix's best path ends with the edge whose piece follows
the path before it without a better merge across their border, which is what the model's pairwise
merging leaves.  Characters without a piece become byte pieces.

Words are cut before each run of the blank sign that follows another character, which is exact as long as no
piece holds a blank behind another character; a model with such pieces, or of another kind, is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_in, id_out
from .encoding import Ragged, _Numbers, slices

BLANK = "▁"
#: Words that one process remembers.
REMEMBERED = 700_000
FREE = np.int64(1 << 40)


def suffix_order(codes: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order of their next ``depth`` characters, and those characters packed into 64-bit words.

    ``codes`` holds numbers below 2^width, 0 for separators, at least one at the end.  No order is given
    to suffixes that agree in ``depth`` characters.
    """
    per = 63 // width
    words, first = [], np.zeros(len(codes), np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(depth + per, np.int64)])
    for j in range(per):
        first = first << width | padded[j : j + len(codes)]
    order = np.argsort(first, kind="stable")
    words.append(first[order])
    at = per
    while at < depth:
        rank = np.empty(len(codes), np.int64)
        new = np.concatenate([[0], np.cumsum(np.any([w[1:] != w[:-1] for w in words], axis=0))])
        rank[order] = new
        ahead = np.concatenate([first, np.zeros(at, np.int64)])[at : at + len(codes)]
        again = np.lexsort((ahead, rank))
        order = again
        words = [w[np.searchsorted(new, rank[order])] for w in words] + [ahead[order]]
        at += per
    return order, words


def ranges(words: list[np.ndarray], width: int, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every piece (rows of codes, padded with 0): the range of suffixes that begin with it."""
    per = 63 // width
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(words[0]), np.int64)
    for n, column in enumerate(words):
        chars = pieces[:, n * per : (n + 1) * per]
        value = np.zeros(len(pieces), np.int64)
        for j in range(per):
            value = value << width | (chars[:, j] if j < chars.shape[1] else 0)
        open_ = np.clip((n + 1) * per - sizes, 0, per) * width
        top = value | ((np.int64(1) << open_) - 1)
        active = sizes > n * per
        a, b = lo.copy(), hi.copy()
        for bound, side in ((value, 0), (top, 1)):
            x, y = np.where(active, lo, 0), np.where(active, hi, 0)
            while (x < y).any():
                mid = (x + y) >> 1
                probe = column[np.minimum(mid, len(column) - 1)]
                right = (x < y) & ((probe < bound) if side == 0 else (probe <= bound))
                y = np.where((x < y) & ~right, mid, y)
                x = np.where(right, mid + 1, x)
            if side == 0:
                a = np.where(active, x, a)
            else:
                b = np.where(active, x, b)
        lo, hi = a, b
    return lo, hi


class PieceModel:
    """The pieces of a SentencePiece BPE model as tables of characters, ranks and merge trees."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = self.sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(c == BLANK and i and name[i - 1] != BLANK for name in map(names.__getitem__, plain) for i, c in enumerate(name)):
            raise ValueError("a piece holds a blank behind another character")
        self.names, self.bytes_at = names, sp.piece_to_id("<0x00>")
        self.unknown, self.has_bytes = sp.unk_id(), sp.is_byte(sp.piece_to_id("<0x00>"))
        self.id_of = {names[i]: i for i in plain}
        score = {names[i]: sp.get_score(i) for i in plain}
        self.normalise = sp.normalize if hasattr(sp, "normalize") else sp.Normalize
        # which merge makes each piece, by merging its characters; pieces that do not come out whole are never used
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n + 1, -1, np.int64)
        order = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-score[names[i]], i))
        place = {names[i]: r for r, i in enumerate(order)}
        use = []
        for name in place:
            symbols, made = list(name), (None, None)
            while len(symbols) > 1:
                r, i = min(((place.get(a + b, FREE), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))))
                if r == FREE:
                    break
                made = (symbols[i], symbols[i + 1])
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            if len(symbols) == 1:
                i = self.id_of[name]
                self.rank[i] = place[name]
                use.append(i)
                self.left[i], self.right[i] = self.id_of.get(made[0], -1), self.id_of.get(made[1], -1)
        bad = [i for i in use if max(self.rank[self.left[i]], self.rank[self.right[i]]) >= self.rank[i]]
        if bad:
            raise ValueError("a piece is made of pieces with lower scores")
        self.use = np.array(sorted(use + [i for i in plain if len(names[i]) == 1]), np.int64)
        keys, ranks = [], []
        for name, r in place.items():
            for k in range(1, len(name)):
                a, b = self.id_of.get(name[:k]), self.id_of.get(name[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(r)
        by = np.argsort(keys)
        self.pair, self.pair_rank, self.n = np.array(keys, np.int64)[by], np.array(ranks, np.int64)[by], n
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.pair)] = True
        chars = sorted({c for i in self.use for c in names[i]})
        self.longest = max(len(names[i]) for i in self.use)
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)  # 0 separates, 1 is any other character
        self.sizes = np.array([len(names[i]) for i in self.use], np.int64)
        self.table = np.zeros((len(self.use), self.longest), np.int64)
        for row, i in enumerate(self.use):
            self.table[row, : len(names[i])] = self.char[[ord(c) for c in names[i]]]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, FREE if their concatenation is no piece; ids below 0 never merge."""
        key = a * self.n + b
        out = np.full(len(key), FREE)
        maybe = np.flatnonzero((a >= 0) & (b >= 0))
        maybe = maybe[self.seen[self._slot(key[maybe])]]
        at = np.minimum(np.searchsorted(self.pair, key[maybe]), len(self.pair) - 1)
        hit = self.pair[at] == key[maybe]
        out[maybe[hit]] = self.pair_rank[at[hit]]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece b behind piece a as it is.

        Going back in time, the later made of the two neighbours at the border falls apart; a pair that merges before
        either of them was made into something else shows that the border would not have lasted.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), FREE), np.full(len(a), FREE)
        while len(live):
            r = self.merge_rank(x, y)
            crossed = (r < until_x) & (r <= until_y) & (r < FREE)
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            stay = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, until_x, until_y, rx, ry = (v[stay] for v in (live, x, y, until_x, until_y, rx, ry))
            undo_x = rx > ry
            until_x, until_y = np.where(undo_x, rx, until_x), np.where(undo_x, until_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        codes = self.char[raw]
        codes[codes == 0] = 1
        codes[begin + sizes] = 0
        # few characters occur in a batch: pack those
        present = np.unique(np.concatenate([[0, 1], codes]))
        small = np.full(int(self.char.max()) + 2, -1, np.int64)
        small[present] = np.arange(len(present))
        packed = small[codes]
        width = max(2, int(len(present)).bit_length())
        piece_codes = small[self.table]
        fits = ((piece_codes >= 0) & ((self.table > 0) | (np.arange(self.longest) >= self.sizes[:, None]))).all(1)
        chosen, rows = self.use[fits], np.flatnonzero(fits)
        order, keys = suffix_order(packed, width, self.longest)
        lo, hi = ranges(keys, width, piece_codes[rows], self.sizes[rows])
        # edges: every occurrence of every piece, and single characters without a piece
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        start = order[at]
        piece, size = np.repeat(chosen, count), np.repeat(self.sizes[rows], count)
        odd = np.flatnonzero(codes == 1)
        start, piece, size = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), -1)]), np.concatenate([size, np.ones(len(odd), np.int64)])
        # sort by the position in the word where an edge ends, then relax position by position, all words at once
        owner_begin = np.repeat(begin, sizes + 1)
        ends = (start - owner_begin[start] + size).astype(np.int32)
        by = np.argsort(ends, kind="stable")
        start, piece, size, ends = start[by], piece[by], size[by], ends[by]
        last, length = np.full(len(raw) + 1, -2, np.int64), np.zeros(len(raw) + 1, np.int64)  # by position in the text: the piece that ends there
        steps = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1, [len(ends)]]) if len(ends) else np.array([0])
        for i, j in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            s, p, z = start[i:j], piece[i:j], size[i:j]
            first = s == owner_begin[s]
            before = last[s]  # -2 at the beginning of a word
            ok = first.copy()
            check = np.flatnonzero(~first)
            ok[check] = self.follows(before[check], p[check])
            last[s[ok] + z[ok]], length[s[ok] + z[ok]] = p[ok], z[ok]
        # walk back from the ends of the words
        pos, out_pos, out_piece, out_from = begin + sizes, [], [], []
        live = pos > begin
        base = begin
        while live.any():
            pos, base = pos[live], base[live]
            out_pos.append(pos)
            out_piece.append(last[pos])
            pos = pos - length[pos]
            out_from.append(pos)
            live = pos > base
        where, ids, came = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_pos, out_piece, out_from))
        by = np.argsort(where, kind="stable")
        where, ids, came = where[by], ids[by], came[by]
        word = np.searchsorted(begin, came, side="right") - 1
        # characters without a piece: their bytes
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            times = np.ones(len(ids), np.int64)
            spelled = [chr(int(raw[came[k]])).encode("utf-8", "surrogatepass") if self.has_bytes else b"?" for k in lost]
            times[lost] = [len(x) for x in spelled]
            word = np.repeat(word, times)
            ids = np.repeat(ids, times)
            spell = np.frombuffer(b"".join(spelled), np.uint8)
            ids[ids < 0] = spell.astype(np.int64) + self.bytes_at if self.has_bytes else self.unknown
        return ids.astype(np.uint32), np.bincount(word, minlength=len(words))


def cut_words(text: str) -> list[str]:
    """Words of a normalised text: each with the blanks before it."""
    parts = text.split(BLANK)
    out, blanks = [], 0
    if parts and parts[0]:
        out.append(parts[0])
    for p in parts[1:]:
        blanks += 1
        if p:
            out.append(BLANK * blanks + p)
            blanks = 0
    if blanks:
        out.append(BLANK * blanks)
    return out


class PieceEncoder:
    """``encode`` gives the ids that the library gives; ``decode`` the text."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = _Numbers(), Ragged()
        self.numbers.fresh = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self._forget()
        look, fresh = self.numbers.__getitem__, self.numbers.fresh
        found = []
        for t in texts:
            words = cut_words(self.model.normalise(t)) if t else []
            found.append(np.fromiter(map(look, words), np.int64, len(words)))
        if fresh:
            self.known.extend(*self.model.encode_words(fresh))
            fresh.clear()
        flat, sizes = self.known.take(np.concatenate(found) if found else np.empty(0, np.int64))
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, found)])]
        return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, byte pieces as UTF-8 (what is no UTF-8 as U+FFFD), blank signs as blanks, without the one in front."""
        if not hasattr(self, "spelled"):
            m = self.model
            self.spelled = [bytes([i - m.bytes_at]) if m.sp.is_byte(i) else b"" if m.sp.is_control(i) else m.names[i].replace(BLANK, " ").encode() for i in range(m.n)]
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_same, ids`` of every row, encoded and decoded again.

    ``decoded_same`` tells whether the ids spell the model's normal form of the text.  Null and empty texts have
    no pieces; of equally good ways to cut a text the library's is taken; very long texts are encoded whole; null ids and
    repeated rows pass through; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = held(("pieces", model), lambda: PieceEncoder(model))
        for b in batches:
            texts, rows = b["text"].tolist(), []
            for i, j in slices(texts):
                for doc, text, ids in zip(b["doc_id"].tolist()[i:j], texts[i:j], enc.encode(texts[i:j]), strict=True):
                    want = enc.model.normalise(text).replace(BLANK, " ").removeprefix(" ") if text else ""
                    row = (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), enc.decode(ids) == want)
                    rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "decoded_same"] + ["ids"] * keep_ids)

    rows = docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return id_out(rows.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_same boolean" + ", ids array<int>" * keep_ids))


def piece_texts(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids; a null array gives a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = held(("pieces", model), lambda: PieceEncoder(model))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if x is None else enc.decode(np.asarray(x)) for x in b["ids"]]})

    return id_out(encoded.select(id_in(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string"))
