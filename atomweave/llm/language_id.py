"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed character n-grams (1 to 3, lower case, letters only with
single blanks between words), normalised to length 1; centroids come from spherical k-means within each language
on a bounded sample of labelled rows, document frequencies from all labelled rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out, staged
from .encoding import slices

BUCKETS = 1 << 13
#: Characters that ``\\w`` takes for parts of words though they are no letters: numbers of all kinds but decimal digits.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
NOT_WORD = re.compile(r"[\W\d_]+")
NOT_LETTER = re.compile(rf"[\W\d_{NUMBERS}]+")
#: Labelled languages that a model may have; more are refused, as their rates are sent to all executors.
MOST_LANGUAGES = 10_000


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-case text with one blank around each run of letters; empty without letters."""
    clean = NOT_WORD.sub(" ", text.lower())
    if not clean.replace(" ", "").isalpha():  # numbers are left, which few texts have
        clean = NOT_LETTER.sub(" ", text.lower())
    if not clean.strip():
        return np.empty(0, np.uint32)
    return np.frombuffer(f" {clean.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def counts_of(codes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's n-grams of 1, 2 and 3 code points occur."""
    a = codes * np.uint32(2654435761)
    b = a[:-1] * np.uint32(31) + a[1:] * np.uint32(7)
    c = b[:-1] * np.uint32(31) + a[2:] * np.uint32(13)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    grams = np.concatenate([a, b ^ (b >> np.uint32(15)), (c ^ (c >> np.uint32(13))) * np.uint32(2246822519)])
    return np.bincount(grams >> shift, minlength=buckets)


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray  # (centroids, buckets), of length 1
    langs: list[str]  # one per centroid
    floor: np.ndarray  # per centroid: the least cosine that does not count as too far

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt((v * v).sum(-1, keepdims=True))
        return v / np.where(norm, norm, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, too far from all centroids) per text; ``und`` without a letter."""
        codes = [codes_of(t) if t else np.empty(0, np.uint32) for t in texts]
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        cos = self.vector(np.array([counts_of(c, len(self.idf)) if len(c) else np.zeros(len(self.idf)) for c in codes])) @ self.vectors.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1)
        return [(self.langs[k], float(s), bool(s < self.floor[k])) if len(c) else ("und", 0.0, True) for c, k, s in zip(codes, best, score, strict=True)]


def document_frequencies(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; one partial vector per partition is added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b["text"]:
                c = codes_of(t) if t else ()
                if len(c):
                    total += counts_of(c, buckets) > 0
                    n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, buckets), "n": np.concatenate([[n], total])})

    rows = labelled.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets + 1, np.int64)
    for r in rows:
        out[r.bucket + 1] = r.n
    return out[1:], int(out[0])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(labelled: DataFrame, centroids: int = 4, sample_per_language: int = 400, reject_quantile: float = 0.001, buckets: int = BUCKETS) -> Centroids:
    """Learn from ``text, lang`` (nulls are left out).

    ``sample_per_language`` bounds the distinct texts of a language that the clustering sees (those of least hash; all of a
    language that has few, so none is lost); a text is too far
    if its best cosine is under nine tenths of the ``reject_quantile`` of that centroid's own sample.
    """
    labelled = labelled.where("text is not null and lang is not null")
    df, n = document_frequencies(labelled, buckets)
    idf = np.log((1 + n) / (1 + df)) + 1
    # by hash, about twice as many of each language as are needed, of its distinct texts: copies count once
    picked = labelled.select("lang", F.xxhash64("text").alias("h"), "text")
    shares = staged(picked.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "language-shares")
    if shares.count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    near = picked.join(F.broadcast(shares), "lang").where(F.expr(f"(cast(h as double) / 18446744073709551616d + 0.5) * n < {2 * sample_per_language}"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, h, text in zip(b["lang"], b["h"], b["text"], strict=True):
                c = codes_of(text)
                if len(c):
                    n = counts_of(c, buckets)
                    at = np.flatnonzero(n)
                    out.append((lang, h, at.astype("<i4").tobytes() + n[at].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "x"])

    once = near.mapInPandas(sparse, "lang string, h long, x binary").groupBy("lang", "h").agg(F.min("x").alias("x"))
    rows = [(r.lang, bytes(r.x)) for r in once.orderBy("lang", "h").collect()]  # bounded by languages, sample and buckets
    model = Centroids(idf, np.zeros((0, buckets)), [], np.zeros(0))
    vectors, langs, floors = [], [], []
    for lang in sorted({r[0] for r in rows}):
        found = [np.frombuffer(x, "<i4").reshape(2, -1) for k, x in rows if k == lang][:sample_per_language]
        if found:
            counts = np.zeros((len(found), buckets), np.int64)
            for n, (at, times) in enumerate(found):
                counts[n, at] = times
            x = model.vector(counts)
            c = spherical_kmeans(x, centroids)
            best = (x @ c.T).max(1)
            vectors.append(c)
            langs += [lang] * len(c)
            floors += [0.9 * float(np.quantile(best, reject_quantile))] * len(c)
    return Centroids(idf, np.concatenate(vectors) if vectors else np.zeros((0, buckets)), langs, np.array(floors))


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row.

    ``score`` is the cosine to the nearest centroid (0 to 1).  A text that is null or has no letter is
    ``und`` with score 0 (letters are what Unicode calls so: numbers like a half or a Roman numeral sign are none);
    ``rejected`` marks texts too far from all centroids, which keep the nearest language.  Of equal cosines the first
    centroid counts, languages in alphabetical order.  Very long texts are read whole; null ids and repeated rows pass
    through; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x centroids, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            got = [x for i, j in slices(texts, 1 << 20) for x in shared.value.predict(texts[i:j])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[2] for x in got]})

    rows = docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return id_out(rows.mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean"))
