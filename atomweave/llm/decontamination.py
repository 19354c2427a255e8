"""Benchmark decontamination: a set of normalised test windows, broadcast, against every window of the training texts.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in small letters.  A window is ``n`` words in a
row of a benchmark item; an item of fewer words is one window.  Windows of a text are looked up by a rolling hash, hits are
verified on their bytes, and the words inside them are counted, told as spans, or removed.  The texts are scanned
where they lie: nothing of them is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held, staged, unstage, unused
from .paragraphs import cut_spans
from .words import Words, chunks, mixed, range_hashes

#: Bytes in no word, after A-Z have become small letters.
BLANK = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Windows that one scan holds at most (some 60 MB a worker); more are looked up in several scans.
WINDOWS = 1 << 20
#: Windows of an item that travel as one row.
PIECE = 4096
#: Bits of the first look: a hash whose top bits no window has is no hit.
BITS = 22
FOUND = "struct<n_words:bigint,spans:array<struct<start:int,stop:int,first:int,words:int>>,items:array<string>>"


class Windows:
    """The windows of item pieces ``(item, text)``, looked up by hash and compared by bytes."""

    def __init__(self, pieces: list[tuple[str, bytes]], n: int):
        w = Words([t for _, t in pieces], BLANK)
        size = w.ends - w.begins
        k = np.minimum(n, size)
        count = size - k + 1
        piece = np.repeat(np.arange(len(size)), count)
        first = np.repeat(w.begins, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.plain, self.tables = w.plain, {}
        m = mixed(w.h, 4)
        names, of_name = np.unique(np.array([pieces[i][0] for i in w.some.tolist()], object), return_inverse=True)
        self.names = names.tolist()
        for width in np.unique(k).tolist():
            own = np.flatnonzero(k[piece] == width)
            a = first[own]
            h = range_hashes(m, a, a + width)
            order = np.argsort(h, kind="stable")
            h, a, item = h[order], a[order], of_name[piece[own][order]]
            start, stop = w.at[a], w.behind[a + width - 1]
            lead = np.arange(len(h))  # of windows with the same text the first
            for i in (np.flatnonzero(h[1:] == h[:-1]) + 1).tolist():
                j = i - 1
                while j >= 0 and h[j] == h[i]:
                    if self.plain[start[j] : stop[j]] == self.plain[start[i] : stop[i]]:
                        lead[i] = lead[j]
                        break
                    j -= 1
            leads, entry = np.unique(lead, return_inverse=True)
            pairs = np.unique(entry * len(names) + item)
            bits = np.zeros(1 << BITS, bool)
            bits[h >> np.uint64(64 - BITS)] = True
            self.tables[width] = (h[leads], start[leads], stop[leads], np.searchsorted(pairs // len(names), np.arange(len(leads) + 1)), pairs % len(names), bits)

    def hits(self, w: Words) -> list[tuple[int, int, list[int]]]:
        """``(word, word behind, numbers of items)`` of every occurrence of a window in the texts of ``w``."""
        out, m = [], mixed(w.h, 4)
        ends = np.repeat(w.ends, w.ends - w.begins)
        for width, (hashes, begin, end, of, items, bits) in self.tables.items():
            if len(m) < width:
                continue
            i = np.arange(len(m) - width + 1)
            h = range_hashes(m, i, i + width)
            i = np.flatnonzero(bits[h >> np.uint64(64 - BITS)] & (i + width <= ends[: len(i)]))
            e = np.searchsorted(hashes, h[i])
            for at, x, j in zip(i.tolist(), h[i].tolist(), e.tolist(), strict=True):
                while j < len(hashes) and hashes[j] == x:
                    if w.plain[w.at[at] : w.behind[at + width - 1]] == self.plain[begin[j] : end[j]]:
                        out.append((at, at + width, items[of[j] : of[j + 1]].tolist()))
                        break
                    j += 1
        return out


def scanned(texts: list[bytes], before: list[dict | None], windows: Windows) -> list[dict]:
    """What each text holds: ``n_words, spans, items``, together with what an earlier scan has found."""
    w = Words(texts, BLANK)
    n_words = np.zeros(len(texts), np.int64)
    n_words[w.some] = w.ends - w.begins
    out = [{"n_words": n, "spans": [], "items": []} for n in n_words.tolist()]
    begin = dict(zip(w.some.tolist(), w.begins.tolist(), strict=True))
    found: dict[int, tuple[list, set]] = {}
    for i, j, items in windows.hits(w):
        ranges, names = found.setdefault(int(w.some[np.searchsorted(w.begins, i, side="right") - 1]), ([], set()))
        ranges.append((i, j))
        names.update(map(windows.names.__getitem__, items))
    for t, b in enumerate(before):
        if b and b["spans"]:
            ranges, names = found.setdefault(t, ([], set()))
            ranges += [(begin[t] + s["first"], begin[t] + s["first"] + s["words"]) for s in b["spans"]]
            names.update(b["items"])
    point = w.points() if found else None
    for t, (ranges, names) in found.items():
        runs: list[list[int]] = []
        for i, j in sorted(ranges):
            if runs and i <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], j)
            else:
                runs.append([i, j])
        zero = point(w.offset[t])
        out[t]["spans"] = [{"start": int(point(w.starts[i]) - zero), "stop": int(point(w.stops[j - 1]) - zero), "first": i - begin[t], "words": j - i} for i, j in runs]
        out[t]["items"] = sorted(names)
    return out


def item_pieces(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, piece`` (normalised words, blank between) of the items that have words; a long item comes in pieces of ``PIECE`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, int]] = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = Words([text.encode("utf-8", "surrogatepass")], BLANK)
                for i in range(0, max(len(w.h) - n + 1, min(1, len(w.h))), PIECE):
                    j = min(i + PIECE + n - 1, len(w.h))
                    out.append((name, w.plain[w.at[i] : w.behind[j - 1]].decode("utf-8", "surrogatepass"), max(1, j - i - n + 1)))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "piece", "windows"), x, strict=True)) for x in out], pa.schema({"item": pa.string(), "piece": pa.string(), "windows": pa.int64()}))

    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return items.select(F.coalesce(column(id_col).cast("string"), F.lit("")), text).mapInArrow(run, "item string, piece string, windows long").distinct()


def _parts(pieces: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The pieces with the ``part`` they are in, none of over ``most`` windows (but one piece at least), and how many parts there are."""
    n = -(-2 * (pieces.agg(F.sum("windows")).first()[0] or 0) // most)
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(max(1, n))) if n > 1 else F.lit(0).cast("long"))
        if n <= 1 or dealt.groupBy("part").agg(F.sum("windows").alias("w"), F.count("*").alias("c")).where(f"w > {most} and c > 1").isEmpty():
            return dealt, max(1, n)
        n *= 2


def with_hits(docs: DataFrame, items: DataFrame, n: int = 10, name: str = "found", id_col: str = "item_id", text_col: str = "text", doc_text: str = "text", most: int = WINDOWS) -> DataFrame:
    """``docs`` with a column ``name``: ``n_words``, ``spans`` (``start, stop`` in code points, ``first`` word, ``words``) and ``items`` whose windows occur.

    At most ``most`` windows are broadcast for one scan; a larger benchmark is dealt into parts, and a scan per part adds to what those
    before have found.  A null text is an empty one; a text without words, and one shorter than every window, has no hits.  Rows that
    repeat an item count once; a null item id is the name ''; an item without words never occurs.  Repeated documents have
    a row each; empty tables on either side give no hits; other columns stay whatever their names (one named ``name`` is an error).
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name} already")
    pieces, count = _parts(staged(item_pieces(items, n, id_col, text_col), "benchmark-pieces"), most)
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(column(doc_text).cast("string"), F.lit("")).cast("binary")
    out, last = docs.withColumn(name, F.lit(None).cast(FOUND)), None
    for part in range(count):
        rows = pieces.where(F.col("part") == part).select("item", "piece").collect()  # bounded by ``most``
        shared = sc.broadcast(sorted((r.item, r.piece) for r in rows))
        out = out.withColumn(name, _scan(shared, n)(text, column(name)))
        if part < count - 1:
            out = staged(out, "benchmark-scan")
            if last is not None:
                unstage(last)
            last = out
    return out


def _scan(shared, n: int):
    key = uuid.uuid4().hex
    kind = pa.struct({"n_words": pa.int64(), "spans": pa.list_(pa.struct({x: pa.int32() for x in ("start", "stop", "first", "words")})), "items": pa.list_(pa.string())})

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = held(("windows", key), lambda: Windows([(i, p.encode("utf-8", "surrogatepass")) for i, p in shared.value], n))
        for texts, before in batches:
            out: list[dict] = []
            for i, some in chunks(texts):
                out += scanned(some, before.slice(i, len(some)).to_pylist(), windows)
            yield pa.array(out, kind)

    return scan


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_hit`` (words inside a hit), ``items`` and ``spans``; see ``with_hits``."""
    found = unused(docs, "__found")
    rows = with_hits(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), items, n, found, item_id, item_text)
    hit = F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return rows.select("doc_id", F.col(found)["n_words"].alias("n_words"), hit.alias("n_hit"), F.col(found)["items"].alias("items"), F.col(found)["spans"].alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, how: str = "spans", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without what a benchmark holds: ``spans`` cuts the hit words out, ``documents`` drops every document with a hit.

    Columns stay as they are; a null text stays null and is never dropped; see ``with_hits`` for other cases.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how has to be spans or documents")
    found = unused(docs, "__found")
    rows = with_hits(docs, items, n, found, item_id, item_text, text_col)
    if how == "documents":
        return rows.where(F.size(F.col(found)["spans"]) == 0).select(*[column(c) for c in docs.columns])

    @F.arrow_udf("string")
    def without(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t, s) if s else t for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return rows.select(*[without(column(c).cast("string"), F.col(found)["spans"]).alias(c) if c == text_col else column(c) for c in docs.columns])
