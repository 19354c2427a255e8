"""Best-fit packing of token sequences.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the bins are planned
on the histogram of lengths: large items (over a third of the capacity) go at most two to a bin, each
with the largest other large item that fits; then smaller ones, longest first, go to the
fullest bin with room.  Equal bins are planned together, which bounds the plan by the capacity
whatever the number of documents.  Pieces then find their place by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_in, id_out, staged
from .encoding import REMEMBERED, encoder, slices


def _match_large(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, their lengths): every large item with the largest other that fits beside it."""
    left = {n: c for n, c in counts.items() if c and n * 3 > capacity}
    order, out = sorted(left), []
    while order:
        a = order[-1]
        at = bisect_left(order, capacity - a + 1) - 1
        if at < 0:
            out.append((left[a], (a,)))
            order.pop()
            continue
        b = order[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            out.append((n, (a, b)))
            left[a] -= n
            left[b] -= n
        if a == b and left[a] == 1:  # the odd one looks among the smaller ones
            smaller = order[at - 1] if at else None
            out.append((1, (a,) if smaller is None else (a, smaller)))
            left[a] = 0
            if smaller is not None:
                left[smaller] -= 1
                if not left[smaller]:
                    order.remove(smaller)
        order = [n for n in order if left[n]] if left[a] == 0 or left[b] == 0 else order
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins for a histogram of lengths (1 to capacity): (number of bins, ((length, times), ...)) each.

    Small items go, longest first, into the bins with the least room that takes them; a bin takes as
    many of one length as fit, and a new bin opens only if none has room.
    """
    groups: list[list] = []
    rooms: list[tuple[int, int]] = []  # (room, group), sorted

    def put(n: int, items: tuple[tuple[int, int], ...], room: int) -> None:
        groups.append([n, items])
        insort(rooms, (room, len(groups) - 1))

    for n, lengths in _match_large(counts, capacity):
        put(n, tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)), capacity - sum(lengths))
    for length in sorted((n for n, c in counts.items() if c and n * 3 <= capacity), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, (length, -1))
            if at == len(rooms):
                fit = capacity // length
                if left >= fit:
                    put(left // fit, ((length, fit),), capacity - fit * length)
                    left %= fit
                if left:
                    put(1, ((length, left),), capacity - left * length)
                    left = 0
                break
            room, g = rooms.pop(at)
            n, items = groups[g]
            fit = room // length
            full = min(n, left // fit)
            if full < n:  # the rest of the group stays as it is, but for one bin that takes what is left
                rest = left - full * fit
                if full:
                    groups[g][0] = full
                    groups[g][1] = (*items, (length, fit))
                    insort(rooms, (room - fit * length, g))
                else:
                    groups[g][0] = 0
                if rest:
                    put(1, (*items, (length, rest)), room - rest * length)
                if n - full - bool(rest):
                    put(n - full - bool(rest), items, room)
                left = 0
            else:
                groups[g][1] = (*items, (length, fit))
                insort(rooms, (room - fit * length, g))
                left -= full * fit
    return [(n, items) for n, items in groups if n]


def places(bins: list) -> pd.DataFrame:
    """Where the items of each length go by rank: rows ``length, rank, sequence, times, offset``.

    From ``rank`` on, every bin in turn, beginning with ``sequence``, takes ``times`` of them from ``offset`` on.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, items in bins:
        offset = 0
        for length, times in items:
            rows.append((length, used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "times", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of every document's ids plus ``end_id``: ``doc_id, piece, start, length, ids_crc32, part, nth``.

    ``nth`` counts the pieces of equal length in the input partition ``part``.  ``remembered`` bounds the pre-tokens
    that a worker knows the ids of: more take memory, fewer take time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, remembered), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for b in batches:
            texts, ids = b["text"].tolist(), b["id"].tolist()
            rows = []
            for i, j in slices(texts):
                for doc, x in zip(ids[i:j], enc.ids(texts[i:j]), strict=True):
                    x = np.concatenate([x, end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(x), capacity)):
                        cut = x[start : start + capacity]
                        rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), part, seen[len(cut)]))
                        seen[len(cut)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            rows = texts = ids = b = None

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def assign(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``length, part, nth``.

    The driver sees the histogram of lengths only.  A piece's rank among equal lengths is its number
    in its partition plus the counts of the partitions before, so no length is gathered in one task.  These counts grow
    with the input; they are joined by a merge join, as a broadcast of them would have no bound.
    """
    spark = pieces.sparkSession
    counts = staged(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table})  # bounded by the capacity
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        key = t["length"] << 46 | t["rank"]
        for b in batches:
            rank = (b["nth"] + b["base"]).to_numpy(np.int64)
            length = b["length"].to_numpy(np.int64)
            at = np.searchsorted(key, length << 46 | rank, side="right") - 1
            step = rank - t["rank"][at]
            b["sequence_id"] = t["sequence"][at] + step // t["times"][at]
            b["offset"] = t["offset"][at] + step % t["times"][at] * length
            yield b.drop(columns=["part", "nth", "base"])

    return pieces.join(bases.hint("merge"), ["length", "part"]).select(*pieces.columns, "base").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece; only documents
    longer than the capacity are cut.  Null and empty texts have one piece of the end id; null ids
    and repeated rows are packed like any other; an empty table gives no rows.  Among pieces of equal length the
    place goes by input order.  A very long text is encoded whole, then cut.  Other columns of ``docs`` are not read.
    """
    return id_out(assign(staged(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, remembered), "pack-pieces"), capacity))
