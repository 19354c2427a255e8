"""Token ids from the ``tokenizers`` library, remembered per pre-token.

A byte-pair encoder treats every pre-token by itself, so a text's ids are those of its pre-tokens
in order.  Texts of plain Latin script are cut here by the file's own pattern and each new
pre-token goes through the library once; anything else (other scripts, odd white space, special
strings, another kind of file) goes through the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import held

#: The two pre-token patterns of the public byte-pair vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters, digits, punctuation, plain blanks: here Unicode versions, normal forms and lower case agree.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
#: Pre-tokens that one process remembers at most; beyond that it starts anew.
REMEMBERED = 600_000
#: Pre-tokens that the library gets in one call.
TOGETHER = 2000
#: The letters and digits of PLAIN, so that the standard library's faster patterns can cut it.
LETTER, DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes written out for PLAIN texts."""
    for name, chars in ((r"[^\s\p{L}\p{N}]", rf"[^\s{LETTER}{DIGIT}]"), (r"[\p{L}]", f"[{LETTER}]"), (r"[\p{N}]", f"[{DIGIT}]"), (r"\p{L}", f"[{LETTER}]"), (r"\p{N}", f"[{DIGIT}]")):
        pattern = pattern.replace(name, chars)
    return re.compile(pattern)


def kind_of(spec: dict) -> str:
    """``byte``, ``word`` or ``other``: which of the two patterns a tokenizer file uses."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("model", {}).get("type") != "BPE" or spec["model"].get("dropout"):
        return "other"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    parts = pre.get("pretokenizers", [])
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    lower_nfc = steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["content"] == " "
    split = len(parts) == 2 and parts[0].get("pattern", {}).get("Regex") == WORD_LEVEL and parts[0].get("invert") and parts[0]["behavior"] == "Removed"
    return "word" if split and lower_nfc and parts[1].get("use_regex") is False else "other"


class _Numbers(dict):
    """Numbers new strings as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Ragged:
    """Growing list of id lists in two arrays."""

    def __init__(self):
        self.values, self.starts, self.sizes, self.n, self.used = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(values)
        self.values, self.starts, self.sizes = self._room(self.values, used), self._room(self.starts, n), self._room(self.sizes, n)
        self.values[self.used : used], self.sizes[self.n : n] = values, sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists asked for, end to end, and their sizes."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.values[at], sizes


class Encoder:
    """``ids(texts)`` as ``encode(text, add_special_tokens=False)`` of the library gives them, without truncation or padding."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind_of(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.find = plain_pattern(WORD_LEVEL if self.kind == "word" else BYTE_LEVEL).findall
        vocab = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, n in vocab.items():
            self.bytes_of[n] = len(piece.removesuffix("</w>") if self.kind == "word" else piece)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = _Numbers(), Ragged()
        self.numbers.fresh = []

    def plain(self, text: str) -> bool:
        return self.kind != "other" and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens, end to end, and how many each has: many go in one call and byte lengths tell them apart."""
        calls = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        got = self.tok.encode_batch_fast(calls, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        want = np.cumsum([len(p.encode()) for p in parts])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), want, side="right")
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids per text; null counts as empty."""
        if len(self.numbers) > self.remembered:
            self._forget()
        look, fresh = self.numbers.__getitem__, self.numbers.fresh
        found, odd = [], []
        for n, text in enumerate(texts):
            text = text or ""
            if self.plain(text):
                parts = self.find(text.lower() if self.kind == "word" else text)
                found.append(np.fromiter(map(look, parts), np.int64, len(parts)))
            else:
                odd.append(n)
                found.append(np.empty(0, np.int64))
        if fresh:
            self.known.extend(*self._pre_tokens(fresh))
            fresh.clear()
        flat, sizes = self.known.take(np.concatenate(found) if found else np.empty(0, np.int64))
        per_piece = np.concatenate([[0], np.cumsum(sizes)])
        cuts = per_piece[np.cumsum([0, *map(len, found)])]
        out = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for n, ids in zip(odd, self.whole([texts[n] for n in odd]) if odd else [], strict=True):
            out[n] = ids
        return out


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per file and process."""
    return held(("ids", path, remembered), lambda: Encoder(path, remembered))


def slices(texts: list, most: int = 1 << 20):
    """Ranges of rows with about ``most`` characters, so that a batch of long texts stays small in memory."""
    begin = size = 0
    for n, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield begin, n + 1
            begin, size = n + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
