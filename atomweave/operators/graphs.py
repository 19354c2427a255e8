"""Graphs within frames: components, levels of reachability, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

FRAME = ["traj", "frame"]


#: Atoms in a row whose links one task contracts, and links it looks at together.
BLOCK, TOGETHER = 4096, 200_000


def contracted(links: DataFrame) -> DataFrame:
    """``traj, frame, hi, lo`` with the same components as the links given, most of them stars already.

    Links are dealt by frame and blocks of atoms; a task joins what it sees, ``TOGETHER`` links at a time, and hands on a link from each
    atom to the smallest one it has found.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def find(x):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        def emptied() -> pd.DataFrame:
            out = [(*x[:2], x[2], find(x)[2]) for x in list(up)]
            up.clear()
            return pd.DataFrame([r for r in out if r[2] != r[3]], columns=[*FRAME, "hi", "lo"])

        for b in batches:
            for traj, frame, hi, lo in zip(b["traj"], b["frame"].tolist(), b["hi"].tolist(), b["lo"].tolist(), strict=True):
                p, q = find((traj, frame, hi)), find((traj, frame, lo))
                up.setdefault((traj, frame, hi), (traj, frame, hi))
                up.setdefault((traj, frame, lo), (traj, frame, lo))
                if p != q:
                    up[max(p, q)] = min(p, q)
            if len(up) > TOGETHER:
                yield emptied()
        yield emptied()

    dealt = links.select(*FRAME, "hi", "lo").repartition(*FRAME, F.floor(F.col("lo") / BLOCK))
    return dealt.mapInPandas(run, "traj string, frame long, hi long, lo long")


def links_sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*FRAME, "hi", "lo").cast("decimal(38,0)"))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``traj, frame, atom, comp`` of undirected edges ``src, dst``; ``comp`` is the smallest atom of the component.

    Within frames, tasks first contract the links they see; then large-star and small-star steps alternate until the links no longer
    change; both are aggregations and joins, so that no frame has to fit a worker.
    """
    e = edges.where("src <> dst").select(*FRAME, F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    e = staged(contracted(e).distinct(), "star")
    now, seen = links_sum(e), None
    while now != seen and now[0]:
        both = e.toDF(*FRAME, "u", "v").union(e.select(*FRAME, "lo", "hi"))
        least = both.groupBy(*FRAME, "u").agg(F.min("v").alias("m")).select(*FRAME, "u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(least, [*FRAME, "u"]).select(*FRAME, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        own = large.groupBy(*FRAME, "u").agg(F.min("v").alias("m"))
        small = large.join(own, [*FRAME, "u"]).where("v <> m").select(*FRAME, F.col("v").alias("hi"), F.col("m").alias("lo"))
        e = staged(small.union(own.toDF(*FRAME, "hi", "lo")).distinct(), "small-star")
        seen, now = now, links_sum(e)
    own = nodes.select(*FRAME, "atom")
    return own.join(e.toDF(*FRAME, "atom", "comp"), [*FRAME, "atom"], "left").withColumn("comp", F.coalesce("comp", "atom"))


def closure(edges: DataFrame) -> DataFrame:
    """``traj, frame, src, dst``: all pairs of which the one reaches the other along directed edges, the edges included.

    Paths are put together from paths of up to the same length, so that a chain of n edges takes about log2(n) rounds.
    """
    e = staged(edges.select(*FRAME, "src", "dst").distinct(), "paths")
    n = e.count()
    while True:
        on = e.select(*FRAME, F.col("src").alias("dst"), F.col("dst").alias("end"))
        e = staged(e.join(on, [*FRAME, "dst"]).select(*FRAME, "src", F.col("end").alias("dst")).where("src <> dst").union(e).distinct(), "paths")
        before, n = n, e.count()
        if n == before:
            return e


def reach_levels(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes first reached at each distance below ``depth``: ``traj, frame, seed, node, level``, breadth first by joins.

    The edges and every level are written once, so that a level is planned from the one before only.
    """
    step = staged(edges.select(*FRAME, F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "reach-steps")
    front = starts.select(*FRAME, F.col("node").alias("seed"), "node").distinct().withColumn("level", F.lit(0))
    seen = front = staged(front, "reach-level")
    for level in range(1, depth):
        ahead = front.join(step, [*FRAME, "node"]).select(*FRAME, "seed", F.col("next").alias("node")).distinct()
        front = staged(ahead.join(seen.select(*FRAME, "seed", "node"), [*FRAME, "seed", "node"], "left_anti").withColumn("level", F.lit(level)), "reach-level")
        seen = seen.union(front)
    return seen


def percolation(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """``depth, mean``: molecules at distance depth - 1 from a starting molecule, on average; depth 1 is the start itself."""
    levels = reach_levels(starts, edges, depth)
    n = levels.groupBy("level").agg(F.count("*").alias("n"))
    total = levels.where("level = 0").agg(F.count("*").alias("total"))
    spine = starts.sparkSession.range(depth).select(F.col("id").cast("int").alias("level"))
    mean = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return spine.join(n, "level", "left").join(F.broadcast(total)).select((F.col("level") + 1).alias("depth"), mean.alias("mean"))


def clusters(nodes: DataFrame, edges: DataFrame, group: str = "label", comp: DataFrame | None = None) -> DataFrame:
    """One row per cluster and frame: ``traj, frame, comp, composition, size, instance``.

    The composition counts the members of each group, groups in order of their names; the instance is a digest of the members.
    """
    named = nodes.select(*FRAME, "atom", F.col(group).alias("grp")).join(components(nodes, edges) if comp is None else comp, [*FRAME, "atom"])
    n = named.groupBy(*FRAME, "comp", "grp").agg(F.count("*").alias("n"), F.collect_list("atom").alias("atoms"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "n"))), lambda s: F.concat_ws("-", s.grp, s.n.cast("string"))), "_")
    ids = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("atoms"))), lambda a: a.cast("string")), ",")
    return n.groupBy(*FRAME, "comp").agg(text.alias("composition"), F.sum("n").alias("size"), F.md5(ids.cast("binary")).alias("instance"))


def occurrences(cluster: DataFrame, frames, by=("composition",)) -> DataFrame:
    """``*by, occurrences, mean, std`` per frame, frames without the kind counting 0; ``frames`` is their number, or a one-row table of it."""
    per = cluster.groupBy(*FRAME, *by).agg(F.count("*").alias("n"))
    sums = per.groupBy(*by).agg(F.sum("n").alias("occurrences"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    sums = sums.withColumn("frames", F.lit(frames)) if isinstance(frames, int) else sums.crossJoin(F.broadcast(frames))  # one row
    total, t = F.col("occurrences"), F.col("frames")
    var = F.when(t > 1, (F.col("squares") - total * total / t) / F.nullif(t - 1, F.lit(0))).otherwise(0.0)
    return sums.select(*by, "occurrences", (total / t).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def _stats(share: Column, frames: Column) -> tuple[Column, Column]:
    mean = F.sum(share) / frames
    var = (F.sum(share * share) - frames * mean * mean) / F.nullif(frames - 1, F.lit(0))
    return mean, F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))


def populations(members: DataFrame, by="composition") -> DataFrame:
    """Share of each group's atoms that lie in clusters of a kind: ``*by, grp, mean, std`` over frames that have the group.

    ``members`` has a row per atom: ``traj, frame, grp`` and the kind of its cluster.
    """
    by = [by] if isinstance(by, str) else list(by)
    n = members.groupBy(*FRAME, "grp", *by).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*FRAME, "grp")))
    frames = members.groupBy("grp").agg(F.count_distinct(*FRAME).alias("frames"))
    rows = share.join(frames, "grp")
    mean, std = _stats(F.col("share"), F.first("frames"))
    return rows.groupBy(*by, "grp").agg(mean.alias("mean"), std.alias("std"))


def cutoff_edges(pairs: DataFrame, cutoffs: dict[tuple[str, str], float], group: str = "label") -> DataFrame:
    """Pairs of different groups within the cutoff of their groups (symmetric): ``traj, frame, src, dst``."""
    rules = [(F.least(f"a_{group}", f"b_{group}") == min(k)) & (F.greatest(f"a_{group}", f"b_{group}") == max(k)) & (F.col("d2") <= c * c) for k, c in cutoffs.items()]
    return pairs.where(reduce(lambda p, q: p | q, rules, F.lit(False))).select(*FRAME, F.col("a_atom").alias("src"), F.col("b_atom").alias("dst"))
