"""Substring deduplication by MinHash banding of paragraphs.

A repeated passage may begin anywhere in a line, so paragraphs are cut where the content says: of every ``window``
three-word grams in a row the one with the least hash begins a paragraph (the leftmost of equal ones).  Inside a repeated
passage the cuts are the same wherever it stands, and a passage of ``2 * window + 2`` words or more holds at least one
whole paragraph.  Equal paragraphs form one class; minimum hashes of five-word shingles give the bands, distinct
paragraphs that collide in a band are compared by exact Jaccard similarity on their words, and connected components of
what passes are the classes.  The first place of a class keeps its text, all others are removed; from the ends of a
removed stretch the words go on being compared, one by one, with those around the place that keeps it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, components, id_in, id_out, join_hot, likely_in, release_held, staged, unstage, unused
from .words import LOWER, MIX, WORD, Words, chunks, mixed, shingle_set

#: Paragraphs that one worker compares at a time; a larger bucket is dealt again, then cut into blocks of which every two meet.
LIMIT = 256
#: Words of a shingle, and the least that a paragraph is compared by: a shorter one takes the words behind it.
SHINGLE, LEAST = 5, 8
KEY = ["k1", "k2"]
PLACE = ["id", "h", "pos"]


def tune(similarity: float = 0.8, recall: float = 0.95, noise: float = 0.2) -> tuple[int, int]:
    """(bands, rows): fewest bands that find pairs of the similarity with the recall and pairs of 0.2 with at most the noise."""
    for bands in range(1, 200):
        for rows in range(8, 0, -1):
            hit = lambda j: 1 - (1 - j**rows) ** bands  # noqa: B023, E731
            if hit(similarity) >= recall and hit(0.2) <= noise:
                return bands, rows
    raise ValueError("no banding reaches the recall")


class Cutter:
    """The paragraphs of many texts at once."""

    def __init__(self, window: int = 24, bands: int = 3, rows: int = 2):
        self.window, self.bands, self.rows = window, bands, rows

    def cuts(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words begin a paragraph; texts are the ranges from ``begins`` to ``ends``."""
        first = np.zeros(len(h), bool)
        first[begins] = True
        grams, w = len(h) - 2, self.window
        if grams >= w:
            m = mixed(h, 0)
            g = mixed(m[:-2] + m[1:-1] * MIX[1] + m[2:] * MIX[2], 3)
            low = g >> np.uint64(32) << np.uint64(32) | np.arange(grams, dtype=np.uint64)  # a minimum tells its place
            size = 1
            while size < w:
                d = min(size, w - size)
                low = np.minimum(low[:-d], low[d:])
                size += d
            inside = np.repeat(ends, ends - begins)[: len(low)] - np.arange(len(low)) >= w + 2
            at = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first[at] = True
            again = np.flatnonzero(g[1:] == g[:-1]) + 1  # the same word over and over is no place to cut
            first[again] = False
            first[begins] = True
        return first

    def table(self, texts: list[bytes]) -> dict[str, np.ndarray | list] | None:
        """Columns of all paragraphs: the text's number, first word, first and last code point, words, key, bands, and the text compared."""
        w = Words(texts)
        if not len(w.h):
            return None
        cut = np.flatnonzero(self.cuts(w.h, w.begins, w.ends))
        end = np.append(cut[1:], len(w.h))
        own = np.searchsorted(w.begins, cut, side="right") - 1
        last = np.minimum(np.maximum(end, cut + LEAST), w.ends[own])
        shingle, m = np.append(w.shingles(SHINGLE), np.uint64(0)), mixed(w.h, 4)
        for s in np.flatnonzero(last - cut < SHINGLE).tolist():  # the last words of a text: fewer than a shingle
            shingle[cut[s]] = (m[cut[s] : last[s]] * MIX[: last[s] - cut[s]]).sum(dtype=np.uint64)
        ranges = np.stack([cut, np.maximum(cut + 1, last - SHINGLE + 1)], 1).ravel()
        point, text = w.points(), w.some[own]
        out: dict = {"text": text, "pos": cut - w.begins[own], "words": end - cut}
        out |= {"start": point(w.starts[cut]) - point(w.offset[text]), "stop": point(w.stops[end - 1]) - point(w.offset[text])}
        digests = [xxhash.xxh3_128_digest(w.plain[a:b]) for a, b in zip(w.at[cut].tolist(), w.behind[last - 1].tolist(), strict=True)]
        keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        out |= {"k1": keys[:, 0], "k2": keys[:, 1]}
        for b in range(self.bands):
            key = np.full(len(cut), b + 1, np.uint64)
            for r in range(self.rows):
                x = mixed(shingle + np.uint64((b * self.rows + r + 1) * int(MIX[1]) & (2**64 - 1)), r % 5)
                key = mixed(key + np.minimum.reduceat(x, ranges)[::2], 1)
            out[f"b{b + 1}"] = key.view(np.int64)
        # a byte of the word before and behind, 0 at the ends of a text: where it differs from another place's, the texts do
        byte = (mixed(w.h, 2) % np.uint64(255) + np.uint64(1)).astype(np.uint8).view(np.int8)
        out["before"] = np.where(cut > w.begins[own], byte[cut - 1], 0).astype(np.int8)
        out["behind"] = np.where(end < w.ends[own], byte[np.minimum(end, len(byte) - 1)], 0).astype(np.int8)
        out["sh"] = [w.raw[a:b] for a, b in zip(w.starts[cut].tolist(), w.stops[last - 1].tolist(), strict=True)]
        return out


def paragraph_table(docs: DataFrame, cutter: tuple[int, int, int], id_col: str, text_col: str) -> DataFrame:
    """``id, h, pos, start, stop, words, k1, k2, b1, b2, ..., before, behind, sh`` of every paragraph; ``h`` is the text's hash, ``sh`` what is compared."""
    bands = [f"b{n + 1}" for n in range(cutter[1])]
    fields = "id long, h long, pos int, start int, stop int, words int, k1 long, k2 long, " + "".join(f"{b} long, " for b in bands) + "before byte, behind byte, sh string"
    types = {"pos": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "words": pa.int32(), "before": pa.int8(), "behind": pa.int8(), "sh": pa.string()}
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        c = Cutter(*cutter)
        for b in batches:
            ids, hashes, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
            for i, some in chunks(texts):
                found = c.table(some)
                if found is not None:
                    at = i + found.pop("text")
                    found |= {"id": ids[at], "h": hashes[at]}
                    yield pa.RecordBatch.from_arrays([pa.array(found[n], types.get(n, pa.int64())) for n in names], names)
        c = None
        release_held()

    text = column(text_col).cast("string")
    return docs.where(text.isNotNull()).select(id_in(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, fields)


def shingles(text: str) -> frozenset[bytes]:
    return shingle_set(text, SHINGLE)


def prefix_size(n: int, similarity: float) -> int:
    """Sets of the similarity share one of so many rarest elements of n."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def spanning(sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """Links that join all pairs of sets of at least the similarity, none of them between sets below it.

    Sets are taken by size and meet through the rarest elements; those already joined are looked at only until one of them is similar.
    """
    count = Counter(e for s in sets for e in s)
    up, out = list(range(len(sets))), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    index: dict = {}
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x, n = sets[i], len(sets[i])
        prefix = sorted((e for e in x if count[e] > 1), key=lambda e: (count[e], e))[: max(0, prefix_size(n, similarity) - sum(count[e] == 1 for e in x))]
        for e in prefix:
            groups = index.setdefault(e, {})
            for g in list(groups):
                root = find(g)
                if root != g:  # joined with another since
                    groups.setdefault(root, []).extend(groups.pop(g))
            for g in list(groups):
                if find(g) != find(i):
                    for j in groups[g]:
                        y = sets[j]
                        if len(y) >= similarity * n and (both := len(x & y)) >= similarity * (n + len(y) - both):
                            out.append((j, i))
                            up[find(i)] = find(j)
                            break
        for e in prefix:
            index[e].setdefault(find(i), []).append(i)
    return out


def _linked(similarity: float):
    """Links within collected buckets of ``k1, k2, sh``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bucket in b["bucket"]:
                keys = [(m["k1"], m["k2"]) for m in bucket]
                out += [(*keys[i], *keys[j]) for i, j in spanning([shingles(m["sh"]) for m in bucket], similarity)]
            yield pd.DataFrame(out, columns=["a1", "a2", "b1", "b2"], dtype=np.int64)

    return run


def _sized(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members ``b, k1, k2, sh`` of buckets of up to ``LIMIT``, and those of larger ones with ``n``.

    Sizes are counted before anything is gathered; buckets of one are left out.  The last is their table.
    """
    sizes = staged(members.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"), name)
    small = members.join(sizes.where(F.col("n") <= LIMIT), "b", "left_semi")
    return small, members.join(sizes.where(F.col("n") > LIMIT), "b"), sizes


def _bucket_links(members: DataFrame, similarity: float) -> DataFrame:
    """``a1, a2, b1, b2``: links that join all pairs of a bucket of at least the similarity.

    A bucket of over ``LIMIT`` members is dealt again by the rarest shingles of each, which loses no similar pair; if many share even
    those, into blocks by hash of which every two meet.  No task holds more than about ``LIMIT`` members of a bucket.
    """
    small, large, sizes = _sized(members, "bucket-sizes")
    done = [sizes]
    if not large.isEmpty():

        @F.pandas_udf("array<long>")
        def hashes(texts: pd.Series) -> pd.Series:
            return pd.Series([np.array([xxhash.xxh64_intdigest(s, 2) for s in shingles(t)], np.uint64).view(np.int64) for t in texts])

        large = staged(large.withColumn("x", hashes("sh")), "bucket-large")
        parts = large.select("b", *KEY, F.size("x").alias("size"), F.explode("x").alias("e"))
        often = parts.groupBy("b", "e").agg(F.count("*").alias("times"))
        rarest = F.row_number().over(W.partitionBy("b", *KEY).orderBy("times", "e"))
        kept = parts.join(often, ["b", "e"]).withColumn("rank", rarest).where(F.col("rank") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)
        dealt = kept.where("times > 1").select("b", *KEY, "e").join(large.select("b", *KEY, "sh"), ["b", *KEY])
        dealt = staged(dealt.select(F.xxhash64("b", "e").alias("b"), *KEY, "sh"), "bucket-again")
        again, rest, sizes = _sized(dealt, "bucket-again-sizes")
        done += [large, dealt, sizes]
        blocks = F.ceil(F.col("n") / (LIMIT // 2)).cast("int")
        own = F.pmod(F.xxhash64(*KEY), blocks).cast("int")
        met = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        met = met.select(F.xxhash64("b", F.least("own", "other"), F.greatest("own", "other")).alias("b"), *KEY, "sh")
        small = small.unionByName(again).unionByName(met)
    buckets = small.groupBy("b").agg(F.collect_list(F.struct(*KEY, "sh")).alias("bucket")).select("bucket")
    links = staged(buckets.mapInPandas(_linked(similarity), "a1 long, a2 long, b1 long, b2 long").distinct(), "paragraph-links")
    unstage(*done)
    return links


def similar_classes(classes: DataFrame, table: DataFrame, bands: list[str], similarity: float) -> DataFrame:
    """``k1, k2, component`` of distinct paragraphs that are joined with others."""
    dealt = classes.select(F.explode(F.array(*bands)).alias("b"), *KEY).where("b is not null")
    shared = staged(dealt.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "bands-shared")
    met = staged(likely_in(dealt, F.col("b"), shared, F.col("b")).join(shared, "b"), "bands-met")
    needed = met.select(*KEY).distinct()
    texts = likely_in(table.select(*KEY, "sh"), F.col("k1"), needed, F.col("k1")).groupBy(*KEY).agg(F.min("sh").alias("sh"))
    members = staged(met.join(texts, KEY), "bands-members")
    unstage(shared, met)
    links = _bucket_links(members, similarity)
    unstage(members)
    ends = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(links.select("b1", "b2")).distinct()
    nodes = staged(ends.withColumn("node", F.monotonically_increasing_id()), "paragraph-nodes")
    edges = links.join(nodes.toDF("a1", "a2", "a"), ["a1", "a2"]).join(nodes.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    out = staged(nodes.join(components(edges), "node").select(*KEY, "component"), "paragraph-components")
    unstage(links, nodes)
    return out


def _runs(found) -> list[list]:
    """Stretches of adjacent paragraphs from those of one text in order: [first word, word behind, start, stop, first place, place behind the last]."""
    runs: list[list] = []
    for p in found:
        if runs and p["pos"] == runs[-1][1]:
            runs[-1][1], runs[-1][3], runs[-1][5] = p["pos"] + p["words"], p["stop"], p
        else:
            runs.append([p["pos"], p["pos"] + p["words"], p["start"], p["stop"], p, p])
    return runs


STRETCH = ["id", "h", "first", "pos", "end", "start", "stop", "l_more", "l_own", "l_id", "l_h", "l_at", "l_words", "l_behind", "r_more", "r_own", "r_id", "r_h", "r_at", "r_words"]
#: Words at the end of a changed paragraph by which its place in the other one is found, and words of the paragraph that are looked at for that.
ANCHOR, BACK = 3, 8
#: Words that are fetched at the end of a stretch at first, and words of the pieces that places are looked up by.
AHEAD, PIECE = 20, 64


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per stretch: what is removed, and for either end whether more words may be the same there (``l_more, r_more``).

    They are compared from ``l_own`` and ``r_own`` on with those at the places that keep the text: from the ends of the stretch, or, where its outermost
    paragraph is similar only, from ``BACK`` words within that paragraph (``l_words``, ``r_words`` within the kept one).  ``l_behind`` is where the first kept paragraph ends.
    """
    for b in batches:
        out = []
        for doc, h, found in zip(b["id"], b["h"], b["found"], strict=True):
            for pos, end, start, stop, left, right in _runs(found):
                behind = left["k_pos"] + left["k_words"]
                if left["same"]:
                    l_side = (left["before"] == left["k_before"] != 0, pos, left["k_id"], left["k_h"], left["k_pos"], 0, behind)
                else:
                    x, y = min(left["words"], BACK), min(left["k_words"], BACK)
                    l_side = (left["before"] != 0, pos + x, left["k_id"], left["k_h"], left["k_pos"] + y, y, behind)
                if right["same"]:
                    r_side = (right["behind"] == right["k_behind"] != 0, end, right["k_id"], right["k_h"], right["k_pos"] + right["k_words"], 0)
                else:
                    x, y = min(right["words"], BACK), min(right["k_words"], BACK)
                    r_side = (right["behind"] != 0, end - x, right["k_id"], right["k_h"], right["k_pos"] + right["k_words"] - y, y)
                out.append((doc, h, left["k_id"], pos, end, start, stop, *l_side, *r_side))
        yield pd.DataFrame(out, columns=STRETCH)


def _surroundings(reach: int):
    """``words, points`` of every place asked for: up to ``reach`` words from there on, to the left or right, and where they begin (left) or end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, points = [], []
            for key, found in zip(b["key"], b["found"], strict=True):
                w, x, left = [], [], key["left"]
                for p in sorted(found if found is not None else (), key=lambda p: -p["pos"] if left else p["pos"]):  # noqa: B023
                    if len(w) < reach:
                        some = list(islice(WORD.finditer(p["sh"]), p["words"]))
                        skip = key["at"] - p["pos"]
                        some = some[: max(0, skip)][::-1] if left else some[max(0, skip) :]
                        w += [m.group().encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass") for m in some]
                        x += [p["start"] + (m.start() if left else m.end()) for m in some]
                w, x = w[:reach], x[:reach]
                words.append(w)
                points.append(x)
            yield pd.DataFrame({"key": b["key"], "n": b["n"], "words": words, "points": points})

    return run


def common_words(own: list[str], size: int, other: list[str], other_size: int) -> tuple[int, bool]:
    """How many words go on to be the same behind the ends of two paragraphs, which the lists begin with, and whether they were so to the end of a list that the text may go on behind.

    Of paragraphs that aren't equal the one may end earlier: then the comparison begins where the last words of ``own`` stand in the other.
    """
    if size > len(own) or other_size > len(other):
        return 0, False
    last, at = own[max(0, size - ANCHOR) : size], other_size
    k = len(last)
    if other[at - k : at] != last:
        found = [e for e in range(k, len(other) + 1) if other[e - k : e] == last]
        at = min(found, key=lambda e: abs(e - size), default=at)
    n = 0
    while size + n < len(own) and at + n < len(other) and own[size + n] == other[at + n]:
        n += 1
    return n, size + n == len(own) >= AHEAD or at + n == len(other) >= AHEAD


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            side = {x["role"]: (x["words"].tolist(), x["points"]) for x in r.found}
            first, last = r.l_own - r.pos, r.end - r.r_own
            n, l_open = common_words(side[0][0], first, side[1][0], r.l_words) if r.l_more else (0, False)
            m, r_open = common_words(side[2][0], last, side[3][0], r.r_words) if r.r_more else (0, False)
            if (r.id, r.h) == (r.l_id, r.l_h):  # not over the place that keeps the text
                n = min(n, max(0, r.pos - r.l_behind))
            start = side[0][1][first + n - 1] if n else r.start
            stop = side[2][1][last + m - 1] if m else r.stop
            out.append((r.id, r.h, r.first, r.pos - n, r.end + m, start, stop, r.pos, r.end, l_open or r_open))
        yield pd.DataFrame(out, columns=[*STRETCH[:7], "own_pos", "own_end", "open"])


def extended(stretches: DataFrame, table: DataFrame, reach: int) -> DataFrame:
    """Stretches ``id, h, first, pos, end, start, stop`` (staged) with the words at their ends that are the same where the text is kept.

    Words are compared one by one, over the borders of paragraphs: ``AHEAD`` of them, and up to ``reach`` where these are all the same.  Near the
    ends of a passage cuts depend on what stands around it, but of every ``window`` grams inside it one begins a paragraph in all copies; so
    beyond a stretch less than two windows of words can be the same, and a paragraph has about a window of them.  A stretch does not grow over
    the place that keeps its text.  Places asked for by very many stretches are joined by broadcast.
    """
    few = stretches.where("l_more or r_more")
    done = stretches.where("not (l_more or r_more)").select(*STRETCH[:7])
    tables = []
    for words in (AHEAD, reach):
        grown = staged(_grown(few, table, words, tables), "stretches-grown")
        if words < reach:
            done = done.unionByName(grown.where("not open").select(*STRETCH[:7]))
            again = grown.where("open").select("id", "h", F.col("own_pos").alias("pos"), F.col("own_end").alias("end"))
            few = stretches.join(again, ["id", "h", "pos", "end"], "left_semi")
        tables.append(grown)
    out = staged(done.unionByName(grown.select(*STRETCH[:7])), "stretches-whole")
    unstage(*tables)
    return out


def _grown(stretches: DataFrame, table: DataFrame, reach: int, tables: list) -> DataFrame:
    """Stretches with what ``reach`` words at their ends have in common, and whether that is all of them; staged tables are added to ``tables``."""
    role = lambda n, i, h, at, left: F.struct(F.lit(n).alias("role"), F.struct(F.col(i).alias("id"), F.col(h).alias("h"), F.col(at).alias("at"), F.lit(left).alias("left")).alias("key"))
    roles = F.filter(F.array(role(0, "id", "h", "l_own", True), role(1, "l_id", "l_h", "l_at", True), role(2, "id", "h", "r_own", False), role(3, "r_id", "r_h", "r_at", False)), lambda x: F.when(x.role < 2, F.col("l_more")).otherwise(F.col("r_more")))
    asking = stretches.select(*STRETCH, F.explode(roles).alias("x")).select(*STRETCH, "x.role", "x.key")
    asked = staged(asking.groupBy("key").agg(F.count("*").alias("n")), "ends-asked")
    bucket = lambda c: F.floor(c / PIECE).cast("int")
    low = F.when(F.col("key.left"), F.col("key.at") - reach).otherwise(F.col("key.at"))
    there = asked.select("key", F.explode(F.sequence(F.greatest(bucket(low), F.lit(0)), F.greatest(bucket(low + reach - 1), F.lit(0)))).alias("bucket"))
    there = there.select(F.col("key.id").alias("id"), F.col("key.h").alias("h"), "bucket", "key")
    # a paragraph stands in the pieces of a text that it begins and ends in, and in the next ones inside it
    first, last = bucket(F.col("pos")), bucket(F.col("pos") + F.col("words") - 1)
    inside = F.array_distinct(F.array(first, F.least(first + 1, last), F.greatest(last - 1, first), last))
    rows = table.select("id", "h", F.explode(inside).alias("bucket"), "pos", "words", "start", "sh")
    place = F.xxhash64("id", "h", "bucket")
    near = likely_in(rows, place, there, place).join(there, ["id", "h", "bucket"])
    lower = F.when(F.col("key.left"), F.col("key.at") - reach).otherwise(F.col("key.at"))
    near = near.where((F.col("pos") < lower + reach) & (F.col("pos") + F.col("words") > lower)).groupBy("key").agg(F.collect_set(F.struct("pos", "words", "start", "sh")).alias("found"))
    seen = asked.join(near, "key", "left").mapInPandas(_surroundings(reach), "key struct<id:bigint,h:bigint,at:int,left:boolean>, n long, words array<string>, points array<int>")
    seen = staged(seen, "ends-seen")
    sides = join_hot(asking, seen, "key", "n").groupBy(*STRETCH).agg(F.collect_list(F.struct("role", "words", "points")).alias("found"))
    tables += [asked, seen]
    return sides.mapInPandas(_extended, "id long, h long, first long, pos int, end int, start int, stop int, own_pos int, own_end int, open boolean")


def duplicate_spans(docs: DataFrame, similarity: float = 0.8, least_words: int = 13, window: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of text that stand elsewhere already: ``id, h, spans`` for every text that has some.

    ``spans`` lists ``start, stop`` (code points), ``words`` and ``first``, the id whose text keeps the passage.
    The place with the smallest (id, hash of the text, position) keeps it.  Rows that repeat both id and
    text count as one document.  Of a passage of ``2 * window + 2`` words or more that stands elsewhere word for word (case and white
    space aside) all words are found; shorter and changed ones as far as a whole paragraph lies in them.  Stretches of
    fewer than ``least_words`` words stay.  Null and empty texts have none; a null id is a value like any other; very long texts are
    read whole; an empty table gives no rows; other columns are not read.
    """
    n_bands, rows = tune(similarity)
    table = staged(paragraph_table(docs, (window, n_bands, rows), id_col, text_col), "paragraphs")
    bands = [f"b{n + 1}" for n in range(n_bands)]
    every = table.select(F.explode(F.array(*bands)).alias("b"))
    often = staged(every.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "bands-often")
    # paragraphs that share a band with another; copies share all of theirs, so that any of a class's bands counts them
    place = F.struct("id", "h", "pos", "words", "before", "behind")
    hit = None
    for b in bands:
        own = likely_in(table.select(*KEY, "id", "h", "pos", "words", "before", "behind", F.col(b).alias("b")), F.col("b"), often, F.col("b"))
        own = own.select(*KEY, place.alias("place"), *[(F.col("b") if c == b else F.lit(None).cast("long")).alias(c) for c in bands])
        hit = own if hit is None else hit.unionByName(own)
    classes = hit.groupBy(*KEY).agg(F.min("place").alias("first"), (F.min("place") != F.max("place")).alias("again"), *[F.max(b).alias(b) for b in bands])
    classes = staged(classes, "paragraph-classes")
    unstage(often)
    comp = similar_classes(classes, table, bands, similarity)
    some = classes.where("again").union(likely_in(classes.where("not again"), F.col("k1"), comp, F.col("k1")))
    joined = staged(some.join(comp, KEY, "left").where("again or component is not null").select(*KEY, "first", "component"), "paragraph-joined")
    unstage(classes, comp)
    linked = joined.where("component is not null")
    least = staged(linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")), "paragraph-least")
    kept = join_hot(linked, least, "component", "n").select(*KEY, F.col("least").alias("keep"), (F.col("first") == F.col("least")).alias("same"))
    repeated = staged(kept.unionByName(joined.where("component is null").select(*KEY, F.col("first").alias("keep"), F.lit(True).alias("same"))), "paragraph-repeated")
    unstage(joined, least)
    copies = likely_in(table.select(*PLACE, "start", "stop", "words", "before", "behind", *KEY), F.col("k1"), repeated, F.col("k1")).join(repeated, KEY)
    again = copies.where(F.struct(*PLACE) != F.struct("keep.id", "keep.h", "keep.pos"))
    part = F.struct("pos", "start", "stop", "words", F.col("keep.id").alias("k_id"), F.col("keep.h").alias("k_h"), F.col("keep.pos").alias("k_pos"), F.col("keep.words").alias("k_words"), "same", "before", "behind", F.col("keep.before").alias("k_before"), F.col("keep.behind").alias("k_behind"))
    of_text = again.groupBy("id", "h").agg(F.sort_array(F.collect_set(part)).alias("found"))
    numbers = ", ".join(f"{c} {'long' if c in ('id', 'h', 'first') or c.endswith(('_id', '_h')) else 'boolean' if c.endswith('_more') else 'int'}" for c in STRETCH)
    stretches = staged(of_text.mapInPandas(_stretches, numbers), "stretches")
    unstage(repeated)
    grown = extended(stretches, table, 4 * window)
    unstage(table, stretches)
    whole = grown.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "end", "start", "stop", "first"))).alias("found"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, h, found in zip(b["id"], b["h"], b["found"], strict=True):
                runs: list[list] = []
                for p in found:
                    if runs and p["pos"] <= runs[-1][1]:
                        if p["end"] > runs[-1][1]:
                            runs[-1][1], runs[-1][3] = p["end"], p["stop"]
                    else:
                        runs.append([p["pos"], p["end"], p["start"], p["stop"], p["first"]])
                spans = [{"start": r[2], "stop": r[3], "words": r[1] - r[0], "first": r[4]} for r in runs if r[1] - r[0] >= least_words]
                if spans:
                    out.append((doc, h, spans))
            yield pd.DataFrame(out, columns=["id", "h", "spans"])

    return whole.mapInPandas(merge, "id long, h long, spans array<struct<start:int,stop:int,words:int,first:long>>")


def cut_spans(text: str, spans) -> str:
    """The text without the spans; what is left on both sides of one is joined by a single blank."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["stop"]
    out.append(text[at:])
    kept = [x.strip() for x in out]
    return " ".join(x for x in kept if x)


def remove_repeats(docs: DataFrame, similarity: float = 0.8, least_words: int = 13, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = "spans") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text_col``; its columns stay whatever their names, and ``spans_col`` (if not None) tells what went.

    A null or empty text stays as it is and has null spans; of a repeated row every one is cut alike; null ids are allowed; an
    empty table gives no rows.  A column of ``docs`` named like ``spans_col`` is an error.
    """
    if spans_col is not None and spans_col in docs.columns:
        raise ValueError(f"docs has a column {spans_col} already")
    i, h, at, own, spans = (unused(docs, f"__{x}") for x in ("found_id", "found_hash", "row_id", "row_hash", "found_spans"))
    found = duplicate_spans(docs, similarity, least_words, id_col=id_col, text_col=text_col).toDF(i, h, spans)

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_spans(t, s) for t, s in zip(text, spans, strict=True)])

    # else a filter on the text would cut it a second time, in workers of its own beside the others
    without = without.asNondeterministic()
    rows = docs.withColumns({at: id_in(id_col), own: F.xxhash64(column(text_col).cast("string"))})
    joined = rows.join(found, (F.col(at) == F.col(i)) & (F.col(own) == F.col(h)), "left")
    more = [] if spans_col is None else [F.col(spans).alias(spans_col)]
    return joined.select(*[without(column(text_col), F.col(spans)).alias(c) if c == text_col else column(c) for c in docs.columns], *more)


def substring_dedup(docs: DataFrame, similarity: float = 0.8, least_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_removed, words_removed, spans, first_docs``; see ``duplicate_spans``.

    ``spans`` are the removed stretches and ``first_docs`` the ids that keep them, in order of the stretches; both are null
    where nothing goes.  Repeated rows and null ids have a row each.
    """
    found = duplicate_spans(docs, similarity, least_words, id_col=id_col, text_col=text_col)
    rows = docs.select(id_in(id_col).alias("id"), F.xxhash64(column(text_col).cast("string")).alias("h"))
    out = rows.join(found, ["id", "h"], "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.expr("aggregate(spans.words, 0L, (a, w) -> a + w)"), F.lit(0)).alias("words_removed"),
        F.expr("transform(spans, s -> struct(s.start, s.stop))").alias("spans"),
        F.expr("transform(spans.first, x -> nullif(x, -9223372036854775808L))").alias("first_docs"),
    )
    return id_out(out)
