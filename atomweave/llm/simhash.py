"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A fingerprint has 64 bits.  Every bit position i gets a non-zero vector phi(i) of F_2^(r+1); the
mask of a non-zero vector v holds the positions with <phi(i), v> = 1.  Two fingerprints that differ
in at most r places span at most r dimensions, so some v is orthogonal to all of them and the two
agree under its mask: the 2^(r+1) - 1 tables miss no pair within the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, id_in, id_out, join_hot, likely_in, release_held, staged, unstage
from .words import MIX, Words, chunks, distinct, majority, mixed, shingle_set, words_of

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: A bucket with more fingerprints is dealt out again under the masks of the bits left free.
LARGE = 512
#: Of near_duplicates: word fingerprints, their radius, and the 64-bit parts of the long fingerprint of shingles.
PRINTS, RADIUS, SKETCH = 4, 4, 4
#: All pairs of a bucket of so many members are compared at once; in a larger one those of a spanning forest come first.
SMALL = 8
#: Shingles that members are compared by at a time.
STEP = 4096
#: A bucket that fills up to so many of ``LARGE`` takes fewer rows in blocks than dealt out again, which makes as many of each row.
AGAIN = (1 << RADIUS + 1) - 1
#: Shingles of a block of texts that are compared by whole sets; it has ``LARGE`` texts or so at most.
GRAMS = 1 << 18


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: len(words) - k].tolist()]
    return np.array([digest(text[i:j], 42) for i, j in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bit b is 1 if the hashes that have it weigh over half of all; no hashes: 0."""
    if not len(hashes):
        return 0
    rows = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = len(hashes) if weights is None else float(weights.sum())
    if len(hashes) < 128:
        bits = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        ones = (bits if weights is None else bits * weights[:, None]).sum(0)
    else:
        ones = np.concatenate([np.bincount(rows[:, j], weights, 256) @ BYTE_BITS for j in range(8)])
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def masks(radius: int, positions: list[int]) -> list[int]:
    """The covering masks of the given bit positions for a radius."""
    top = (1 << (radius + 1)) - 1
    phi = [1 + n % top for n in range(len(positions))]
    return [sum(1 << p for p, f in zip(positions, phi, strict=True) if (f & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the signed 64-bit fingerprint of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": _column(fingerprint(shingle_hashes(words_of(t), shingle)) for t in b["text"])})

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return id_out(rows.mapInPandas(run, "id long, fp long"), "id")


def _column(values) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


def _unsigned(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


def _within(radius: int):
    """Links that join all fingerprints of a collected bucket that are within the radius of each other, breadth first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, z = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for bucket in b["fps"]:
                bucket = np.asarray(bucket, np.int64)
                u, rest = _unsigned(bucket), np.arange(len(bucket))
                while len(rest):
                    todo, rest = [rest[0]], rest[1:]
                    while todo and len(rest):
                        i = todo.pop()
                        near = np.bitwise_count(u[rest] ^ u[i]) <= radius
                        if near.any():
                            a.append(np.full(near.sum(), bucket[i]))
                            z.append(bucket[rest[near]])
                            todo.extend(rest[near].tolist())
                            rest = rest[~near]
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(z)})

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that join all pairs within the radius.

    A bucket of over ``LARGE`` members is dealt out again under covering masks of the bits its own mask leaves free; what agrees
    under both masks differs in few free bits only, which bounds a second bucket by their number, whatever the input.
    """
    spark, every = fps.sparkSession, list(range(64))
    first = masks(radius, every)
    second = [(t, n, _signed(x)) for t, m in enumerate(first) for n, x in enumerate(masks(radius, [i for i in every if not m >> i & 1]))]
    tables = F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for n, m in enumerate(first)])
    dealt = staged(fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp"), "simhash-dealt")
    sizes = staged(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    members = F.collect_list("fp").alias("fps")
    out = dealt.join(sizes.where(F.col("n") <= LARGE), ["t", "k"], "left_semi").groupBy("t", "k").agg(members).select("fps")
    large = sizes.where(F.col("n") > LARGE)
    if not large.isEmpty():
        choices = spark.createDataFrame(second, "t int, t2 int, mask long")  # (2^(radius+1) - 1)^2 rows
        again = dealt.join(large, ["t", "k"], "left_semi").join(F.broadcast(choices), "t").withColumn("k2", F.col("fp").bitwiseAND(F.col("mask")))
        out = out.union(again.groupBy("t", "k", "t2", "k2").agg(members).where(F.size("fps") > 1).select("fps"))
    return out.mapInPandas(_within(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, fp, component)``.

    Equal fingerprints are one class whose representative is its smallest id; classes link at
    ``radius`` or fewer differing bits and ``component`` is the smallest id reachable.  Null and
    empty texts have fingerprint 0 and link like any other; rows with a null id keep a fingerprint
    and take the component of their class, or null if nothing else is in it; repeated rows stay.
    Other columns of ``docs`` are not read.
    """
    fps = staged(with_fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    classes = staged(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "simhash-classes")
    comp = components(links(classes.select("fp"), radius))
    grouped = staged(classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "rows", F.coalesce("component", "fp").alias("g")), "simhash-grouped")
    least = staged(grouped.groupBy("g").agg(F.min("first").alias("component"), F.count("*").alias("n")), "simhash-least")
    named = staged(join_hot(grouped.select("fp", "rows", "g"), least, "g", "n").select("fp", "component", "rows"), "simhash-named")
    unstage(classes, grouped, least)
    return join_hot(fps, named, "fp", "rows").select("id", "fp", "component")


def near_fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, f0.., s0..`` of every text with a word: fingerprints of the distinct words, and a long one of the distinct shingles."""
    names = [*(f"f{n}" for n in range(PRINTS)), *(f"s{n}" for n in range(SKETCH))]

    def prints(hashes: np.ndarray, group: np.ndarray, groups: int, n: int) -> np.ndarray:
        values, of = distinct(hashes, group)
        return majority(np.stack([mixed(values + np.uint64(k + 1) * MIX[2], k % 5) for k in range(n)], 1), np.searchsorted(of, np.arange(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for b in batches:
            ids, hashes, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
            for i, some in chunks(texts):
                w = Words(some)
                if not len(w.h):
                    continue
                count = w.ends - w.begins
                of = np.repeat(np.arange(len(count)), count)
                s = w.shingles(shingle)
                whole = np.arange(len(s)) + shingle <= np.repeat(w.ends, count)
                for t in np.flatnonzero(count < shingle).tolist():  # a shorter text is one shingle
                    x, y = w.begins[t], w.ends[t]
                    s[x], whole[x] = w.h[x:y].cumsum(dtype=np.uint64).sum(dtype=np.uint64), True
                found = np.concatenate([prints(w.h, of, len(count), PRINTS), prints(s[whole], of[whole], len(count), SKETCH)], 1).view(np.int64)
                at = i + w.some
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hashes[at]), *(pa.array(found[:, k]) for k in range(len(names)))], ["id", "h", *names])
        release_held()

    return _texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in ("id", "h", *names)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col).cast("string")
    return docs.where(text.isNotNull()).select(id_in(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sketch_limit(similarity: float, spread: float = 2.5) -> int:
    """Differing bits of the long fingerprints that shingle sets of the Jaccard similarity have at most, but for one pair in some 160 (30,000 for a spread of 4)."""
    bits, share = 64 * SKETCH, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + spread * math.sqrt(bits * share * (1 - share)))


def forest(of: np.ndarray, sketch: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Pairs worth comparing among members of different components: all within ``limit`` bits in a bucket of up to ``SMALL``, in a larger one
    those of a spanning forest of least differences, which joins whatever a chain of nearer pairs joins."""
    n, out = len(of), []
    bits = np.zeros((n, n), np.int32)
    for k in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[:, k, None] ^ sketch[None, :, k])
    bits[bits > limit] = 1 << 20
    bits[of[:, None] == of[None, :]] = -1
    if n <= SMALL:
        i, j = np.nonzero((bits >= 0) & (bits <= limit))
        return [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b]
    best, parent, todo = np.full(n, 1 << 20), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(todo, best, 1 << 21).argmin())
        if 0 <= best[i] <= limit:
            out.append((int(parent[i]), i))
        todo[i] = False
        nearer = todo & (bits[i] < best)
        best[nearer], parent[nearer] = bits[i][nearer], i
    return out


def _pairs(nodes: np.ndarray, of: np.ndarray, sketch: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(forest(of, sketch, limit), np.int64).reshape(-1, 2)
    return nodes[found].min(1), nodes[found].max(1)


def _frame(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    empty = [np.empty(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(empty + [x for x, _ in found]), "b": np.concatenate(empty + [y for _, y in found])})


def early_pairs(classes: DataFrame, limit: int) -> DataFrame:
    """``(a, b)``: part of the pairs worth comparing, found cheaply before all tables are looked at.

    Classes are sorted by two whole fingerprints and two masked ones, and stretches of up to ``LARGE`` that agree are
    worked on as they stream by.  Range partitions split a hot value, so nothing is collected.
    """
    n = max(2, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    m = masks(RADIUS, list(range(64)))
    chosen = [("f0", -1), ("f1", -1), ("f2", _signed(m[0])), ("f3", _signed(m[1]))]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f).bitwiseAND(F.lit(x)).alias("k")) for t, (f, x) in enumerate(chosen)])
    sketch = [f"s{k}" for k in range(SKETCH)]
    dealt = classes.select("node", *sketch, F.explode(tables).alias("x")).select("x.t", "x.k", "node", *sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, k, nodes = b["t"].to_numpy(), b["k"].to_numpy(), b["node"].to_numpy()
            s = _unsigned(b[sketch].to_numpy())
            edges = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]), [True]])) if len(b) else np.zeros(1, int)
            found = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for x in range(i, j, LARGE):
                    y = min(x + LARGE, j)
                    if y - x > 1:
                        found.append(_pairs(nodes[x:y], nodes[x:y], s[x:y], limit))
            yield _frame(found)

    order = ["t", "k", *sketch, "node"]
    return dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long").distinct()


def table_buckets(classes: DataFrame) -> DataFrame:
    """``k, many, whole, node, of, s0..``: the buckets of all covering tables of all fingerprints; ``of`` is the component a class is known to be
    in, ``many`` is true where a bucket may have over ``SMALL`` members, ``whole`` where it has over ``LARGE``.

    Buckets of one component need no comparison.  One of over ``AGAIN * LARGE`` members is dealt out again under covering masks of the bits
    its own leaves free, which parts no pair within the radius, and what still is larger into blocks by hash of which every two meet.
    """
    spark, every, sketch = classes.sparkSession, list(range(64)), [f"s{k}" for k in range(SKETCH)]
    first = masks(RADIUS, every)
    tables = [(f"f{f}", n, m) for f in range(PRINTS) for n, m in enumerate(first)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f).alias("f"), F.xxhash64(F.lit(t), F.col(f).bitwiseAND(F.lit(_signed(m)))).alias("k")) for t, (f, _, m) in enumerate(tables)])
    dealt = classes.select("node", "of", *sketch, F.explode(keys).alias("x")).select("node", "of", *sketch, "x.t", "x.f", "x.k")
    member = ["node", "of", *sketch]

    def mixed_sizes(rows: DataFrame, name: str) -> DataFrame:
        return staged(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("k", "n"), name)

    often = staged(dealt.select("k").groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "near-often")
    met = staged(likely_in(dealt, F.col("k"), often, F.col("k")).join(often, "k"), "near-met")
    out = met.where(F.col("n") <= AGAIN * LARGE).select("k", (F.col("n") > SMALL).alias("many"), (F.col("n") > LARGE).alias("whole"), *member)
    large = met.where(F.col("n") > AGAIN * LARGE).drop("n")
    apart = staged(large.groupBy("k").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("k"), "near-apart")
    if not apart.isEmpty():
        free = [(t, u, _signed(x)) for t, (_, _, m) in enumerate(tables) for u, x in enumerate(masks(RADIUS, [i for i in every if not m >> i & 1]))]
        choices = spark.createDataFrame(free, "t int, u int, mask long")  # PRINTS * (2^(RADIUS+1) - 1)^2 rows
        again = large.join(apart, "k").join(F.broadcast(choices), "t")
        again = staged(again.select(F.xxhash64("k", "u", F.col("f").bitwiseAND(F.col("mask"))).alias("k"), *member), "near-again")
        rest = mixed_sizes(again, "near-again-sizes")
        blocks = F.ceil(F.col("n") / (LARGE // 2)).cast("int")
        block = again.join(rest.where(F.col("n") > LARGE), "k").withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        block = block.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), *member)
        more = again.join(rest.where(F.col("n") <= LARGE), "k", "left_semi").select("k", *member).unionByName(block)
        out = out.unionByName(more.withColumns({"many": F.lit(True), "whole": F.lit(False)}))
    return out


def table_pairs(buckets: DataFrame, limit: int, wide: int) -> DataFrame:
    """``(a, b)``: pairs worth comparing of the buckets of up to ``LARGE``, as ``forest`` chooses them; small buckets have the limit ``wide``."""
    member = ["node", "of", *(f"s{k}" for k in range(SKETCH))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for bucket in b["bucket"]:
                rows = np.array([tuple(m[c] for c in member) for m in bucket], np.int64)
                found.append(_pairs(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64), wide if len(rows) <= SMALL else limit))
            yield _frame(found)

    apart = buckets.where("not whole").groupBy("k").agg(F.collect_list(F.struct(*member)).alias("bucket"), F.min("of").alias("low"), F.max("of").alias("high")).where("low < high")
    return apart.select("bucket").mapInPandas(run, "a long, b long").distinct()


def similar_members(of: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members of different components whose sets have that Jaccard similarity: of all of these as many as join the same."""
    n, size = len(of), np.array([len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1
    columns, rows = (np.cumsum(count > 1) - 1)[at[shared]], np.repeat(np.arange(n), size)[shared]
    order = np.argsort(columns, kind="stable")
    columns, rows, both = columns[order], rows[order], np.zeros((n, n))
    edges = np.searchsorted(columns, np.arange(0, (columns[-1] if len(columns) else 0) + STEP + 1, STEP))
    for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        m = np.zeros((n, STEP), np.float32)
        m[rows[i:j], columns[i:j] - k * STEP] = 1
        both += m @ m.T
    good = (both >= similarity * (size[:, None] + size[None, :] - both)) & (of[:, None] != of[None, :])
    out, of = [], of.copy()
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(good))), strict=True):
        if of[a] != of[b]:
            out.append((a, b))
            of[of == of[b]] = of[a]
    return out


def with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, weight, grams``: the hashes of the distinct shingles of every text, and how much of a block it takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grams = [np.unique(shingle_hashes(words_of(t), shingle)).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "weight": np.array([max(len(x), GRAMS // LARGE) for x in grams], np.int64), "grams": grams})

    return texts.mapInPandas(run, "node long, weight long, grams array<long>")


def groups_apart(buckets: DataFrame, late: DataFrame) -> DataFrame:
    """``node, of, g``: classes of buckets of over ``SMALL``, in groups that hold all that meets in a bucket and isn't in one component.

    ``late`` has ``was``, the component that the buckets know, and ``of``, the one of now.  A class is one row however many buckets it is in:
    which components meet is asked of the sets of components, and most buckets have the same ones.
    """
    many = buckets.where("many")
    met = many.groupBy("k").agg(F.array_sort(F.collect_set("of")).alias("all")).where(F.size("all") > 1).select("all").distinct()
    ends = met.select(F.col("all")[0].alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    now = late.select("was", "of").distinct()
    ends = ends.join(now.toDF("a", "of_a"), "a").join(now.toDF("b", "of_b"), "b")
    groups = components(ends, "of_a", "of_b").toDF("of", "g")
    return many.select("node").distinct().join(late.select("node", "of"), "node").join(groups, "of").select("node", "of", "g")


def set_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links within the groups ``node, of, g`` as ``similar_members`` finds them; no pair that isn't one becomes a row.

    A group is dealt into blocks of ``GRAMS`` shingles, and every two blocks meet in a task but those of its heaviest component: a text is
    sent as often as the others' blocks are, not as often as it is met in a bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for bucket in b["bucket"]:
                nodes = np.array([m["node"] for m in bucket], np.int64)
                links = similar_members(np.array([m["of"] for m in bucket], np.int64), [np.asarray(m["grams"], np.int64) for m in bucket], similarity)
                pairs = nodes[np.array(links, np.int64).reshape(-1, 2)]
                found.append((pairs.min(1), pairs.max(1)))
            yield _frame(found)

    weights = members.join(sets.select("node", "weight"), "node").groupBy("g", "of").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    blocks = lambda w: F.ceil(w / GRAMS).cast("int")
    sizes = weights.groupBy("g").agg(F.max_by("of", F.struct("w", "of")).alias("main"), blocks(F.max("w")).alias("mains"), blocks(F.sum("w") - F.max("w")).alias("rest"), F.sum("n").alias("n"))
    rows = join_hot(members, staged(sizes, "near-sizes"), "g", "n").join(sets, "node")
    h, main = F.xxhash64("node"), F.col("of") == F.col("main")
    own = F.when(main, F.pmod(h, "mains")).otherwise(F.col("mains") + F.pmod(h, "rest"))
    other = F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(0), F.col("mains") + F.col("rest") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    bucket = dealt.groupBy("g", F.least("own", "other"), F.greatest("own", "other")).agg(F.collect_list(F.struct("node", "of", "grams")).alias("bucket"), F.min("of").alias("low"), F.max("of").alias("high"))
    return bucket.where("low < high").select("bucket").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that a near copy stands for: ``id, h`` (hash of the text) and ``keep_id`` of every row that goes.

    Candidates agree within ``RADIUS`` bits in one of ``PRINTS`` fingerprints of their distinct words, which edits move little; the
    covering masks find all of them.  Those whose long fingerprints of shingles are near enough are compared by the exact Jaccard
    similarity of their sets of ``shingle``-word shingles, and linked from ``similarity`` on.  In large buckets a spanning forest is
    compared first; where more than one component is left, the sets of all members are compared inside the tasks, each text once with all
    others that its buckets lead to.  Of each component the row with the smallest (id, hash) stays.  Null texts and texts without a word take no part; a null id is the smallest; rows that repeat
    both id and text count as one; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    prints = [*(f"f{n}" for n in range(PRINTS)), *(f"s{n}" for n in range(SKETCH))]
    fps = staged(near_fingerprints(docs, shingle, id_col, text_col), "near-fps")
    classes = fps.groupBy(*prints).agg(F.min(F.struct("id", "h")).alias("first"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    limit = sketch_limit(similarity)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, of = [], {}
            for a, x, y in zip(b["a"], b["x"], b["y"], strict=True):
                if a not in of:
                    of = {a: shingle_set(x, shingle)}  # links of a hub come one after the other
                p, q = of[a], shingle_set(y, shingle)
                both = len(p & q)
                good.append(both >= similarity * (len(p) + len(q) - both))
            yield b.loc[np.array(good, bool), ["a", "b"]]

    def texts_of(nodes: DataFrame) -> DataFrame:
        who = staged(classes.select("node", "first.id", "first.h").join(nodes, "node", "left_semi"), "near-ends")
        at = F.xxhash64("id", "h")
        texts = likely_in(_texts(docs, id_col, text_col), at, who, at).join(who, ["id", "h"]).groupBy("node").agg(F.min("text").alias("text"))
        return staged(texts, "near-texts")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "near-pairs")
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return both.mapInPandas(compared, "a long, b long")

    early = components(similar(early_pairs(classes, limit)))
    known = staged(classes.join(early, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component"), "near-known")
    buckets = table_buckets(known)

    def joined(links: DataFrame, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the component that the links between classes give."""
        parent = rows.select("node", "of")
        ends = links.join(parent.toDF("a", "of_a"), "a").join(parent.toDF("b", "of_b"), "b").select("of_a", "of_b")
        comp = components(ends, "of_a", "of_b").withColumnRenamed("node", "of")
        return staged(rows.join(comp, "of", "left").withColumn("of", F.coalesce("component", "of")).drop("component"), name)

    late = joined(similar(table_pairs(buckets, limit, sketch_limit(similarity, 4))), known.withColumn("was", F.col("of")), "near-late")
    grouped, large = late.drop("was"), staged(groups_apart(buckets, late), "near-large")
    if not large.isEmpty():
        sets = staged(with_sets(texts_of(large.select("node")), shingle), "near-sets")
        grouped = joined(similar(set_pairs(large, sets, similarity)), grouped, "near-last")
    grouped = grouped.withColumnRenamed("of", "g")
    of_group = staged(grouped.groupBy("g").agg(F.min("first").alias("keep"), F.count("*").alias("n")), "near-keep")
    some = join_hot(grouped, of_group, "g", "n").select(*prints, "keep")
    gone = fps.join(some, prints).where(F.struct("id", "h") != F.col("keep")).select("id", "h", F.col("keep.id").alias("keep_id"))
    return gone.distinct()
