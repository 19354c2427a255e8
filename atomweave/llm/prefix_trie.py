"""The trie of conversation prefixes by partition refinement.

All conversations begin in one class, that of the root.  In a round every active class goes on along the turns that all its
members share (a unary chain), up to the first turn where they differ or some end; there it is split by that turn.
Classes of one member retire: what is left of their conversation is a unary chain.  Nodes, ends and splits of each round are
written in the shared folder; at last the sums over subtrees are folded back from the last round to the first.

A node is known by its depth and its smallest member.  Turns are compared by 120 bits of the SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, fresh_path, join_hot, staged, unstage

#: Ids of so wide a range are put into one text before a node's digest is made of them.
RANGE = 10_000
NOTHING = hashlib.sha256(b"").hexdigest()


def ranked_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, d, k1, k2, points`` (staged): turns of every conversation numbered from 1; ``k1, k2`` stand for role and text.

    Order is by turn, null first; equal turns by their digest.  Null roles and texts are empty.  Rows without a conversation are
    left out.  Numbers come from sorted ranges of all turns and sums over ranges, so that a long conversation isn't one task's.
    """
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = turns.where(column(conv_col).isNotNull()).select(column(conv_col).cast("long").alias("conv"), column(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("points"))
    rows = rows.select("conv", "turn", part(1).alias("k1"), part(16).alias("k2"), "points")
    order = ["conv", "turn", "k1", "k2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    dealt = staged(dealt.drop("turn"), "turns-sorted")
    runs = dealt.groupBy("conv", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = dealt.join(runs.select("conv", "part", (before - F.col("low") + 1).alias("shift")), ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("d"), "k1", "k2", "points")
    out = staged(out, "turns-ranked")
    unstage(dealt)
    return out


def lengths(ranked: DataFrame) -> DataFrame:
    """``conv, len`` of every conversation."""
    return ranked.groupBy("conv").agg(F.count("*").alias("len"))


def with_heads(ranked: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations of which the first ``head`` turns (a column of ``conv``) are those of conversation ``base``.

    All of the base's turns are taken if they are fewer, none if there is no such conversation; then a conversation's own turns
    follow but for its first ``head``.
    """
    size = staged(lengths(ranked), "turns-lengths")
    own = size.select("conv", "len", base.cast("long").alias("base"), head.cast("long").alias("head"))
    own = own.join(size.select(F.col("conv").alias("base"), F.col("len").alias("base_len")), "base", "left")
    own = own.withColumn("taken", F.least("head", F.coalesce("base_len", F.lit(0).cast("long"))))
    own = staged(own.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("len")), "turns-heads")
    rest = ranked.join(own, "conv").where("d > head").select("conv", (F.col("d") - F.col("head") + F.col("taken")).alias("d"), "k1", "k2", "points")
    most = own.agg(F.max("taken")).first()[0] or 0
    heads = own.where("taken > 0").select("conv", "base", "taken").join(ranked.where(F.col("d") <= most).withColumnRenamed("conv", "base"), "base").where("d <= taken")
    return rest.unionByName(heads.select("conv", "d", "k1", "k2", "points")), own.select("conv", "len")


@dataclass
class Trie:
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved.  ``ends``: conv_id, node, depth."""

    nodes: DataFrame
    ends: DataFrame


class _Table:
    """A table in the shared folder that rounds add to."""

    def __init__(self, spark, name: str):
        self.spark, self.path, self.schema = spark, fresh_path(spark, name), None

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def prefix_trie(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of sequences ``conv, d, k1, k2, points`` (d from 1 on, without gaps) of the ``members`` ``conv, len``.

    ``saved`` is the sum over a node's subtree, its top included, of (members - 1) times the points of the node's turn.  Members of
    length 0 end at the root; sequences that are equal end at one node; without members there is no node at all.
    """
    spark = turns.sparkSession
    chains, tails, segments, ends = (_Table(spark, f"trie-{x}") for x in ("chains", "tails", "segments", "ends"))
    first = members.agg(F.min("conv").alias("cls"), F.count("*").alias("n"))
    root = F.lit(0).cast("long").alias
    active = staged(turns.join(members, "conv").crossJoin(F.broadcast(first.select("cls"))), "trie-active")  # a single value
    here = staged(members.crossJoin(F.broadcast(first.select("cls"))), "trie-members")
    classes = staged(first.where("n > 0").select("cls", root("birth"), "n", F.lit(None).cast("long").alias("parent"), root("parent_birth"), root("points")), "trie-classes")
    rounds, splits = 0, []
    while not classes.isEmpty():
        same = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))
        depths = active.groupBy("cls", "d").agg(F.count("*").alias("with"), same.alias("same"), F.max("points").alias("points"))
        depths = staged(depths.join(classes.select("cls", "n"), "cls").withColumn("shared", F.col("same") & (F.col("with") == F.col("n"))), "trie-depths")
        found = depths.groupBy("cls").agg(F.min(F.when(~F.col("shared"), F.col("d"))).alias("split"), F.max("d").alias("deepest"))
        found = classes.join(found, "cls", "left").withColumn("end", F.coalesce(F.col("split") - 1, "deepest", "birth"))
        found = staged(found, "trie-found")
        chain = depths.join(found.select("cls", "birth", "end"), "cls").where("d <= end").select("cls", "birth", "d", "n", "points")
        chains.add(found.select("cls", "birth", F.col("birth").alias("d"), "n", "points").unionByName(chain))
        ended = join_hot(here, found.select("cls", "n", "end"), "cls", "n").where("len <= end")
        ends.add(ended.select(F.col("conv").alias("conv_id"), F.col("cls").alias("node"), F.col("len").alias("depth")))
        # the members that go on, by the turn at which their class is split
        at = join_hot(active, found.where("split is not null").select("cls", "split", "n", F.col("birth").alias("parent_birth")), "cls", "n").where("d = split")
        at = at.select(F.struct("cls", "k1", "k2").alias("key"), "conv", "len", "split", "parent_birth", "points")
        at = staged(at, "trie-at")
        parts = staged(at.groupBy("key").agg(F.min("conv").alias("next"), F.count("*").alias("n"), F.max("points").alias("points"), F.max("split").alias("birth"), F.max("parent_birth").alias("parent_birth")), "trie-parts")
        split = parts.groupBy(F.col("key.cls").alias("cls")).agg(F.count("*").alias("children"), F.count_if(F.col("n") == 1).alias("alone"))
        seg = found.join(split, "cls", "left").fillna(0, ["children", "alone"])
        own = depths.join(found.select("cls", "end"), "cls").where("d <= end").groupBy("cls").agg(F.sum((F.col("n") - 1) * F.col("points")).alias("chain"))
        seg = seg.join(own, "cls", "left").withColumn("saved", F.coalesce("chain", F.lit(0)) + (F.col("n") - 1) * F.col("points"))
        segments.add(seg.select("cls", "birth", "end", "parent", "parent_birth", "children", "alone", "saved", F.lit(rounds).alias("round")))
        moved = staged(join_hot(at.select("key", "conv", "len"), parts.select("key", "next", "n", "birth"), "key", "n").select("conv", "len", F.col("key.cls").alias("parent"), "next", "n", "birth"), "trie-moved")
        rest = active.drop("len", "cls").join(moved, "conv")
        tails.add(rest.where("n = 1 and d >= birth").select("conv", "d", F.when(F.col("d") == F.col("birth"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), (F.col("d") < F.col("len")).alias("more")))
        ends.add(moved.where("n = 1").select(F.col("conv").alias("conv_id"), F.col("conv").alias("node"), F.col("len").alias("depth")))
        before = (active, here, classes, depths, found, at, parts, moved)
        active = staged(rest.where("n > 1 and d > birth").select("conv", "d", "k1", "k2", "points", "len", F.col("next").alias("cls")), "trie-active")
        here = staged(moved.where("n > 1").select("conv", "len", F.col("next").alias("cls")), "trie-members")
        classes = staged(parts.where("n > 1").select(F.col("next").alias("cls"), "birth", "n", F.col("key.cls").alias("parent"), "parent_birth", "points"), "trie-classes")
        unstage(*before)
        rounds += 1
    if not rounds:
        empty = spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long")
        return Trie(empty, spark.createDataFrame([], "conv_id long, node long, depth long"))
    return Trie(_nodes(chains.read(), tails.read(), segments.read(), rounds), ends.read())


def _nodes(chains: DataFrame, tails: DataFrame, segments: DataFrame, rounds: int) -> DataFrame:
    """Fold back: from the last round to the first every segment hands its leaves and savings to the one it branches from."""
    folded, below = _Table(chains.sparkSession, "trie-folded"), None
    for k in reversed(range(rounds)):
        s = segments.where(F.col("round") == k)
        s = s.join(below, ["cls", "birth"], "left").fillna(0, ["leaves", "below"]) if below is not None else s.withColumns({"leaves": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
        s = s.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("alone") + F.col("leaves")))
        s = staged(s.select("cls", "birth", "end", "parent", "parent_birth", "children", "leaves", "below", "saved"), "trie-fold")
        folded.add(s.select("cls", "birth", "end", "parent", "children", "leaves", "below"))
        below = s.groupBy(F.col("parent").alias("cls"), F.col("parent_birth").alias("birth")).agg(F.sum("leaves").alias("leaves"), F.sum(F.col("below") + F.col("saved")).alias("below"))
    onward = W.partitionBy("cls", "birth").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, W.currentRow)
    live = chains.withColumn("saved", F.sum((F.col("n") - 1) * F.col("points")).over(onward)).join(folded.read(), ["cls", "birth"])
    live = live.select(
        F.col("cls").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("birth"), F.col("parent")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("end"), 1).otherwise(F.col("children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("below")).alias("saved"),
    )
    one = F.lit(1).cast("long")
    alone = tails.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), F.col("more").cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    return live.unionByName(alone)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, digest``: the SHA-256 of each node's ends, their ids in decimal, ascending, with commas between.

    Ids are put together by ranges first; a node's ranges then stream through its digest one after the other.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for b in batches:
            out = []
            for node, depth, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (node, depth) != last:
                    if last:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (node, depth), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _rows(out)
        yield _rows([(*last, digest.hexdigest())] if last else [])

    rows = ranges.repartition("node", "depth").sortWithinPartitions("node", "depth", "range").select("node", "depth", "ids")
    return rows.mapInArrow(run, "conv_id long, depth long, digest string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.schema({"conv_id": pa.int64(), "depth": pa.int64(), "digest": pa.string()})
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)
