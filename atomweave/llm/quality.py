"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds.
x holds the hashed words, word beginnings and endings of a text (present or not) and hashed bins of its make-up:
share of symbols, of letters, of distinct words and the like.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_held, trim


BUCKETS = 1 << 20
#: Bytes that are no signs: ASCII letters, digits and white space, and all that belongs to other characters.
NO_SIGN = bytes(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b).isspace())
#: The probability of the highest grade from which a text is kept.
TAIL = 0.7
ASCII = re.compile("[\x00-\x7f]+")
#: Words that one process remembers the bucket of.
REMEMBERED = 150_000


def count_signs(text: str) -> int:
    """Characters of the whole text that are neither letters, digits nor white space."""
    n = len(text.encode("utf-8", "surrogatepass").translate(None, NO_SIGN))
    return n if text.isascii() else n + sum(not (c.isalnum() or c.isspace()) for c in ASCII.sub("", text))


class Features:
    """Sorted distinct buckets of a text; of those with a weight only, if weights are given."""

    def __init__(self, buckets: int = BUCKETS, weights: np.ndarray | None = None):
        self.buckets, self.weights, self.known = buckets, weights, {}

    def bucket(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets

    def _of_word(self, w: str) -> tuple[int, ...]:
        bare = w.strip(".,;:!?\"'()[]") or w
        names = ["w" + bare, *(f"p{bare[:n]}" for n in (4, 5, 6, 7) if len(bare) > n)]
        if not w[-1].isalnum():
            names.append("t" + w[-3:])
        out = (self.bucket(x) for x in names)
        return tuple(b for b in out if self.weights is None or self.weights[b])

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        text = text or ""
        cased = text.split()
        words = text.lower().split()
        distinct = set(words)
        known, out = self.known, set()
        for w in distinct:
            b = known.get(w)
            if b is None:
                b = known[w] = self._of_word(w)
            if b:
                out.update(b)
        n = len(words)
        parts = {
            "size": n.bit_length(), "letters": 10 * sum(map(str.isalpha, words)) // (n + 1), "distinct": 10 * len(distinct) // (n + 1),
            "bars": 10 * words.count("|") // (n + 1), "capitals": 10 * sum(map(str.isupper, cased)) // (n + 1), "signs": 20 * count_signs(text) // (len(text) + 1),
        }
        out.update(self.bucket(f"#{k}={v}") for k, v in parts.items())
        return np.array(sorted(out), np.int64)


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def score(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... per text."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))


def fit_rows(xs: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = BUCKETS, least: float = 4.0, l1: float = 2e-4, rounds: int = 300, rate: float = 0.05) -> CumulativeLink:
    """Maximum likelihood by Adam on all rows at once, with soft thresholding of the weights.

    A bucket gets a weight only if, for some grade, the rows that have it lie above or below that grade
    by ``least`` standard deviations more often than all rows do; for the weights, each grade weighs the same in sum, rare ones at most
    five times their share.
    """
    seen = np.bincount(np.concatenate([np.empty(0, np.int32), *xs]), minlength=buckets)
    strong = np.zeros(buckets, bool)
    for k in range(1, n_grades):
        below = np.bincount(np.concatenate([np.empty(0, np.int32), *(x for x, g in zip(xs, grades, strict=True) if g < k)]), minlength=buckets)
        for part, share in ((below, (grades < k).mean()), (seen - below, (grades >= k).mean())):
            strong |= part - seen * share >= least * np.sqrt(seen * share + 1)
    column = np.flatnonzero(strong)
    place = np.full(buckets, -1)
    place[column] = np.arange(len(column))
    xs = [y[y >= 0] for y in (place[x] for x in xs)]  # columns in place of buckets
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    col = np.concatenate([np.empty(0, np.int64), *xs])
    n, k = len(xs), n_grades - 1
    share = np.bincount(grades, minlength=n_grades)
    cost = np.minimum(5.0, n / np.maximum(1, n_grades * share))[grades]
    w, t = np.zeros(len(column)), np.zeros(2 * n_grades)[:k]
    t[:] = [np.log((share[: j + 1].sum() + 1) / (share[j + 1 :].sum() + 1)) for j in range(k)]
    gaps = np.concatenate([[t[0]], np.log(np.maximum(0.05, np.diff(t)))])  # thresholds stay ordered: t0, t0 + e^g1, ...
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, 2 * rounds + 1):
        if step == rounds + 1:  # the weights stand; without the costs the thresholds come to fit the shares of the grades
            cost, m, v = np.ones(n), 0 * m, 0 * v
        t = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        s = np.bincount(row, w[col], n)
        upper = np.concatenate([np.ones((n, 1)), sig(s[:, None] - t), np.zeros((n, 1))], 1)  # P(grade >= j)
        i = np.arange(n)
        a, b = upper[i, grades], upper[i, grades + 1]
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        ds = cost * (da - db) / p / n
        dt = np.zeros(k)
        np.add.at(dt, grades[grades > 0] - 1, (-cost * da / p / n)[grades > 0])
        np.add.at(dt, grades[grades < k], (cost * db / p / n)[grades < k])
        dgap = np.concatenate([[dt.sum()], np.exp(gaps[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
        grad = -np.concatenate([np.bincount(col, ds[row], len(w)), dgap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        gaps = gaps - move[len(w) :]
        if step <= rounds:
            w = w - move[: len(w)]
            w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * rate * 10)
    weights = np.zeros(buckets)
    weights[column] = w
    return CumulativeLink(weights, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, grade``: 0 poor, 1 fair but toxic, 2 fair and clean.  Rows with a null label are left out."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return docs.select("doc_id", "text").join(rated, "doc_id").select("text", grade.alias("grade"), F.xxhash64("doc_id").alias("h"))


def fit(rows: DataFrame, n_grades: int = 3, sample: int = 6000, buckets: int = BUCKETS) -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows, those of least hash ``h``; features are made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features(buckets)
        for b in batches:
            yield pd.DataFrame({"grade": b["grade"], "x": [f(t).astype("<i4").tobytes() for t in b["text"]]})
        f = None
        release_held()

    n = rows.count()
    part = rows.where(F.expr(f"(cast(h as double) / 18446744073709551616d + 0.5) * {n} < {sample}")) if n > sample else rows
    once = part.groupBy("h").agg(F.min(F.struct("grade", "text")).alias("r"))
    got = once.select("r.text", F.col("r.grade").cast("int").alias("grade")).mapInPandas(run, "grade int, x binary").collect()  # at most about ``sample`` rows
    got = sorted((r.grade, bytes(r.x)) for r in got)
    if not got:
        return CumulativeLink(np.zeros(buckets), np.linspace(-40, -39, n_grades - 1))  # no ratings: every text is kept
    model = fit_rows([np.frombuffer(x, "<i4") for _, x in got], np.array([g for g, _ in got]), n_grades, buckets)
    got = None
    trim()  # the driver would hold what the fit took up for all stages that follow
    return model


def rating(model: CumulativeLink, spark):
    """A column function: a text's ``(expected_grade, tail_prob)``."""
    shared = spark.sparkContext.broadcast(model)  # one vector, whatever the input

    @F.pandas_udf("expected_grade double, tail_prob double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_held()
        m = shared.value
        f = Features(len(m.weights), m.weights)
        for texts in batches:
            tails = m.tails(np.array([m.score(f(t)) for t in texts], np.float64))
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail_prob": tails[:, -1]})
        f = None
        release_held()

    return run


def rate(docs: DataFrame, model: CumulativeLink, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_prob, keep`` of every row.

    ``tail_prob`` is the probability of the highest grade and ``keep`` tells whether it is at least ``tail``, the same for all
    models.  Null and empty texts are rated by their make-up alone; very long ones are read whole; null ids and repeated
    rows pass through, a tie with ``tail`` is kept, an empty table gives no rows; other columns are not read.
    """
    r = rating(model, docs.sparkSession)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), r.alias("r")).select("doc_id", "r.expected_grade", "r.tail_prob", (F.col("r.tail_prob") >= tail).alias("keep"))


def select_rated(docs: DataFrame, model: CumulativeLink, tail: float = TAIL, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ``tail_prob`` is at least ``tail``, with their own columns; see ``rate``."""
    r = rating(model, docs.sparkSession)(F.col(f"`{text_col}`").cast("string"))
    return docs.where(r.getField("tail_prob") >= tail)
