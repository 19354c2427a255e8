"""Token counts by rank-synchronous merging of ragged arrays.

The batch's new pre-tokens lie end to end in one array of symbols with an array of sequence numbers.
In each round every sequence finds the lowest rank among its neighbouring pairs and applies that
pair at all its places at once (left to right where they overlap); a sequence without a mergeable
pair leaves with the count of symbols that survive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_in, id_out
from .encoding import Encoder, kind_of, slices

NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts the symbols that a byte-level BPE leaves of each pre-token; sequences come as id arrays of single bytes."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        key = a << 20 | b
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)[order]
        #: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = np.zeros(256, np.int32)
        for x in range(256):
            self.byte[x] = vocab[chr(x if x in shown else 256 + hidden.index(x))]

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def count(self, sequences: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = sizes.copy()
        symbols = self.byte[np.frombuffer(b"".join(sequences), np.uint8)].astype(np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        while len(symbols) > 1:
            same = owner[:-1] == owner[1:]
            rank, made = self._find(symbols[:-1] << 20 | symbols[1:])
            rank = np.where(same, rank, NONE)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            # the last place of a sequence has no pair of its own
            least = np.minimum.reduceat(np.append(rank, NONE), begins)
            lengths = np.diff(np.append(begins, len(symbols)))
            done = least == NONE
            out[owner[begins[done]]] = lengths[done]
            if done.all():
                return out
            target = np.repeat(least, lengths)[:-1]
            apply = (rank == target) & (rank != NONE)
            # overlapping places (a pair of equal symbols in a row): every other one, from the left
            at = np.flatnonzero(apply)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            symbols[at] = made[at]
            stay = ~np.repeat(done, lengths)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        out[owner] = 1
        return out


class TokenCounter:
    """Counts as the library's ``encode(text, add_special_tokens=False)`` has ids, special strings included."""

    def __init__(self, path: str, remembered: int = 1_000_000):
        self.enc = Encoder(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        if kind_of(spec) != "byte":
            raise ValueError("a byte-level BPE file is needed")
        self.merger, self.remembered, self.known = RankMerger(spec), remembered, {}
        self.find = self.enc.find

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known = {}
        known, parts, odd = self.known, [], []
        for n, t in enumerate(texts):
            t = t or ""
            if self.enc.plain(t):
                parts.append(self.find(t))
            else:
                parts.append([])
                odd.append(n)
        fresh = list({p for ps in parts for p in ps if p not in known})
        if fresh:
            known.update(zip(fresh, self.merger.count([p.encode() for p in fresh]).tolist(), strict=True))
        out = np.array([sum(map(known.__getitem__, ps)) for ps in parts], np.int64)
        for n in odd:
            out[n] = self._odd(texts[n])
        return out

    def _odd(self, text: str) -> int:
        """Special strings count one each; what lies between is cut by the library's own pre-tokenizer."""
        total, rest = 0, [text]
        for s in self.enc.special:
            pieces = [x for r in rest for x in r.split(s)]
            total += len(pieces) - len(rest)
            rest = pieces
        pre = self.enc.tok.pre_tokenizer
        raw = [r.encode("utf-8") for r in rest if r]
        cut = [r[i:j] for r, text in zip(raw, [r for r in rest if r], strict=True) for i, j in _byte_spans(text, pre)]
        return total + int(self.merger.count(cut).sum()) if cut else total


def _byte_spans(text: str, pre) -> list[tuple[int, int]]:
    at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8")) for c in text])]).tolist()
    return [(at[i], at[j]) for _, (i, j) in pre.pre_tokenize_str(text)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Null and empty texts count 0 bytes and 0 tokens; very long texts are counted whole; null ids, repeated rows and empty
    tables pass through; a text of exactly ``limit`` tokens is not over it; other columns are not read.  ``tokenizer`` is the path of a byte-level BPE JSON file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = held(("counts", tokenizer), lambda: TokenCounter(tokenizer))
        for b in batches:
            texts = b["text"].tolist()
            n = [counter.counts(texts[i:j]) for i, j in slices(texts)]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_in(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return id_out(rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
