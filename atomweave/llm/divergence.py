"""Source divergence audit by joint histograms of counts.

How often each source of a language uses each common term gives a share p of whole numbers.  Two sources are compared
over all terms of their language, and f = abs(p - q) depends on the two counts alone: so per pair of sources the distinct
(count, count) combinations are tallied, f is evaluated once for each and multiplied by how many terms have it.  Cells
with a zero aren't joined but implied: terms of one source less those that both have, and what neither has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, release_held, staged

#: ASCII letters in small form and bytes beyond ASCII are parts of terms, all else is a blank.
TERMS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Counts that one worker gathers before it hands them on, and bytes of a text that are split at a time.
GATHERED, TOGETHER = 200_000, 1 << 22


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, i = text.translate(TERMS), 0
    while i < len(text):
        j = text.find(b" ", i + TOGETHER) if i + TOGETHER < len(text) else len(text)
        j = len(text) if j < 0 else j
        yield text[i:j].split()
        i = j


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term; a row with the term '' counts a group's documents."""
    kind = pa.schema({"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emptied() -> pa.RecordBatch:
            rows = [(lang, source, t, n[t], d) for (lang, source), (n, docs) in groups.items() for t, d in docs.items()]
            groups.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(f.type) if f.name == "term" else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen = {b""}
                for some in pieces(text):
                    n.update(some)
                    seen.update(some)
                docs.update(seen)
            if sum(len(docs) for _, docs in groups.values()) > GATHERED:
                yield emptied()
        yield emptied()

    own = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(own[0].alias("lang"), own[1].alias("source"), own[2].cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)), exact: in decimals where a long would run over."""
    below = total + smooth * terms
    wide = F.call_function("div", (count + smooth).cast("decimal(20,0)") * F.lit(scale).cast("decimal(11,0)"), below.cast("decimal(38,0)"))
    return 1 + F.when(count < 2**63 // scale - smooth, F.call_function("div", (count + smooth) * scale, below)).otherwise(wide)


def joint_counts(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, ga, gb, ca, cb, m``: how many terms of the language have ``ca`` in group ``ga`` and ``cb`` in ``gb``, for ga < gb.

    ``held`` has ``lang, term, g, c`` with c > 0, ``groups`` has ``lang, g, terms, kept``: terms of the language, and those the group has.
    Only terms that both have are joined; with the counts of each group alone they give the cells with a zero.
    """
    a, b = held.select("lang", "term", F.col("g").alias("ga"), F.col("c").alias("ca")), held.select("lang", "term", F.col("g").alias("gb"), F.col("c").alias("cb"))
    met = a.join(b, ["lang", "term"]).where("ga < gb").groupBy("lang", "ga", "gb", "ca", "cb").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    # a term that both have is none of those that only one has, and was taken off twice from those that neither has
    split = F.array(cell(F.col("ca"), F.col("cb"), F.col("m")), cell(F.col("ca"), zero, -F.col("m")), cell(zero, F.col("cb"), -F.col("m")), cell(zero, zero, F.col("m")))
    both = met.select("lang", "ga", "gb", F.explode(split).alias("x")).select("lang", "ga", "gb", "x.*")
    alone = held.groupBy("lang", "g", "c").agg(F.count("*").alias("m"))
    pairs = groups.select("lang", F.col("g").alias("ga"), "terms", F.col("kept").alias("ka")).join(groups.select("lang", F.col("g").alias("gb"), F.col("kept").alias("kb")), "lang").where("ga < gb")
    left = pairs.join(alone.withColumnRenamed("g", "ga"), ["lang", "ga"]).select("lang", "ga", "gb", F.col("c").alias("ca"), zero.alias("cb"), "m")
    right = pairs.join(alone.withColumnRenamed("g", "gb"), ["lang", "gb"]).select("lang", "ga", "gb", zero.alias("ca"), F.col("c").alias("cb"), "m")
    none = pairs.select("lang", "ga", "gb", zero.alias("ca"), zero.alias("cb"), (F.col("terms") - F.col("ka") - F.col("kb")).alias("m"))
    cells = both.union(left).union(right).union(none)
    return cells.groupBy("lang", "ga", "gb", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, scale: int = 10**9, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How far the sources of a language are apart, and by which terms: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters (A-Z as small ones) and of anything beyond ASCII; a language keeps those that at least
    ``least_docs`` of its documents have.  Part ``pair`` has every other source of the language with the sum of abs(p - q) over all
    its kept terms, all ranks; part ``term`` has the ``top`` terms by p - q > 0, q being the language's.  All numbers are whole; ties go by the bytes of
    the item.  Null text, language and source count as ''; rows that repeat count again; a group without a kept term has
    pairs all the same (value 0 if the language keeps none); a language with a single source has no pairs; an empty table gives no rows; other columns aren't read.
    """
    counts = staged(term_counts(docs, text_col, lang_col, source_col), "source-terms")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("total")).where(F.col("d") >= least_docs)
    numbered = counts.where("term = ''").select("lang", "source", F.row_number().over(W.partitionBy("lang").orderBy("source")).alias("g"))
    held = staged(counts.where("term <> ''").join(kept.select("lang", "term", "total"), ["lang", "term"]).join(numbered, ["lang", "source"]).select("lang", "term", "g", F.col("n").alias("c"), "total"), "source-kept")
    own = held.groupBy("lang", "g").agg(F.sum("c").alias("n"), F.count("*").alias("kept"))
    terms = held.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    groups = numbered.join(own, ["lang", "g"], "left").join(terms, "lang", "left").fillna(0, ["n", "kept", "terms", "all"])
    groups = staged(groups, "source-groups")
    p = lambda count, total: share(F.col(count), F.col(total), F.col("terms"), smooth, scale)

    sides = groups.select("lang", F.col("g").alias("ga"), F.col("source").alias("a"), F.col("n").alias("na"), "terms").join(groups.select("lang", F.col("g").alias("gb"), F.col("source").alias("b"), F.col("n").alias("nb")), "lang")
    sides = sides.where("ga < gb")
    cells = joint_counts(held.select("lang", "term", "g", "c"), groups).join(sides.select("lang", "ga", "gb", "na", "nb", "terms"), ["lang", "ga", "gb"])
    summed = cells.groupBy("lang", "ga", "gb").agg(F.sum(F.abs(p("ca", "na") - p("cb", "nb")) * F.col("m")).alias("value"))
    valued = sides.join(summed, ["lang", "ga", "gb"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    way = lambda s, i: F.struct(F.col(s).alias("source"), F.col(i).alias("item"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = valued.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pair = pair.withColumn("rank", F.row_number().over(ranked))

    of = held.join(groups.select("lang", "g", "source", "n", "terms", "all"), ["lang", "g"])
    term = of.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p("c", "n") - p("total", "all")).alias("value")).where("value > 0")
    term = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair.unionByName(term)
