"""Periodic range join and nearest-neighbour join by cell lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, box_columns, length_of, squared
from .staging import staged

#: With so few cells per axis a cell list prunes nothing: frames are joined whole.
FEW = 4


def sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """All columns but the keys get the side's prefix."""
    return df.select(*keys, *[F.col(c).alias(f"{side}{c}") for c in df.columns if c not in keys])


def pairs_within(ref: DataFrame, obs: DataFrame, r, box, keys=("traj", "frame"), a: str = "a_", b: str = "b_", least=0) -> DataFrame:
    """Pairs of a frame whose nearest images are at least ``least`` and at most ``r`` apart; ``d2`` is the squared distance.

    Columns of ``ref`` and ``obs`` get the prefixes.  A pair comes once, also beyond half the box; a point pairs
    with itself if it is on both sides.  ``box`` has three lengths, or the names of columns of both tables that hold those of each
    frame.  In boxes of ``FEW`` or more cells of size r per axis each point of
    ``ref`` meets its own and the 26 neighbouring cells only, by an equi-join on frame and cell.
    """
    own = box_columns(box)
    if not own and min(box) <= 0:
        raise ValueError("a periodic box needs positive lengths")
    keys = list(keys)
    p, q = sided(ref, a, keys), sided(obs, b, keys)
    point = [f"{a}{c}" for c in ("atom", *AXES) if c in ref.columns]
    p = p.repartition(max(2, int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, *point)  # pairs are made where the points of ref are
    if own:
        size = lambda s, k: F.greatest(F.floor(length_of(box, AXES[k], s) / r), F.lit(1))
    else:
        m = [max(1, int(length // r)) for length in box]
        size = lambda s, k: F.lit(m[k])
    if own or max(m) >= FEW:
        cell = lambda s, k: F.least(F.floor(F.col(f"{s}{AXES[k]}") * size(s, k) / length_of(box, AXES[k], s)), size(s, k) - 1).cast("int")
        near = lambda k: F.array_distinct(F.array(*[F.pmod(cell(a, k) + o, size(a, k).cast("int")) for o in (-1, 0, 1)]))
        p = p.withColumn("_cx", F.explode(near(0))).withColumn("_cy", F.explode(near(1))).withColumn("_cz", F.explode(near(2)))
        q = q.withColumns({"_cx": cell(b, 0), "_cy": cell(b, 1), "_cz": cell(b, 2)})
        both = p.join(q, [*keys, "_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")
    else:
        both = p.join(q, keys)
    return both.withColumn("d2", squared(a, b, box)).where((F.col("d2") <= r * r) & (F.col("d2") >= least * least))


def nearest(ref: DataFrame, obs: DataFrame, k: int, box, radius, apart=None, keys=("traj", "frame"), a: str = "a_", b: str = "b_") -> DataFrame:
    """The k nearest points of ``obs`` for every point of ``ref``: pairs with ``d2`` and ``rank`` from 1; ties go to the smaller atom.

    Points that find k within ``radius`` are done; the others look within twice that, and so on, so that only points with few others
    around them look far.  Each step's finds and what is left are written once.  ``apart`` is a condition on the pair (default: different atoms).  Points with fewer than k partners get what there is.
    All joins are sort-merge joins: Spark estimates points by the size of compressed files, without what ``explode`` makes of them, and
    would broadcast millions of rows through the driver.
    """
    keys = list(keys)
    apart = F.col(f"{a}atom") != F.col(f"{b}atom") if apart is None else apart
    own = [*keys, f"{a}atom"]
    order = W.partitionBy(*own).orderBy("d2", f"{b}atom")
    names = box_columns(box)
    if names:  # the largest box of all frames
        widest = ref.agg(*[F.max(n) for n in names]).first()
        box_ = [widest[names.index(v)] or 0 if isinstance(v, str) else v for v in box]
    else:
        box_ = box
    far = math.ceil(math.sqrt(sum((x / 2) ** 2 for x in box_))) + 1
    out, left, r, obs = None, ref, min(radius, far), obs.hint("merge")
    while True:
        found = pairs_within(left, obs, r, box, keys, a, b).where(apart).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if r < far:
            found = staged(found.withColumn("_of", F.max("rank").over(W.partitionBy(*own))), "nearest")
            full = found.where(F.col("rank") == k).select(*keys, F.col(f"{a}atom").alias("atom")).hint("merge")
            left = staged(left.join(full, [*keys, "atom"], "left_anti").select(*ref.columns), "nearest-left")
            found = found.where(F.col("_of") == k).drop("_of")  # no join, so that parts of the union are plain scans
        out = found if out is None else out.unionByName(found)
        if r >= far or left.isEmpty():
            return out
        r = min(2 * r, far)


#: Pairs that one step of a block's comparison holds, and the edge in angstrom that blocks have at least.
PAIRS, EDGE = 1 << 20, 8.0


def _block_weights(high: float, n: int, unit: float, moving: bool, box):
    """Adds the pairs of joined blocks to a histogram: a row ``bin, own, next`` per bin and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, later = np.zeros(n), np.zeros(n)
        most = int(high * unit) if unit > 1 else high

        for b in batches:
            sides = [[(c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(b.schema.get_field_index(f"{s}_{k}")) for k in AXES)] for s in "ab"]
            lengths = [b.column(b.schema.get_field_index(f"l{k}")).to_numpy() for k in AXES] if moving else None
            for row in range(b.num_rows):
                p, q = ([v[o[row] : o[row + 1]] for o, v in side] for side in sides)
                step = max(1, PAIRS // max(1, len(q[0])))
                for i in range(0, len(p[0]), step):
                    d2 = 0
                    for k in range(3):
                        length = lengths[k][row] if moving else box[k]
                        d = q[k][None, :] - p[k][i : i + step, None]
                        d = d - (length * np.rint(d / length)).astype(d.dtype)
                        d2 = d2 + d * d
                    u = np.sqrt(d2[(d2 > 0) & (d2 <= most * most)].astype(float)) / unit / (high / n)
                    low = np.floor(u)
                    own += np.bincount(low.astype(np.int64), 1.0 - (u - low), minlength=n + 1)[:n]
                    later += np.bincount(low.astype(np.int64), u - low, minlength=n + 1)[:n]
        full = np.flatnonzero((own > 0) | (later > 0))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(own[full]), pa.array(later[full])], ["bin", "own", "next"])

    return run


def distance_weights(ref: DataFrame, obs: DataFrame, high: float, n: int, box, unit: float = 1.0, keys=("traj", "frame")) -> DataFrame:
    """``bin, weight``: the linear histogram on [0, ``high``] of the distances of all pairs of a frame, in ``n`` bins; pairs at distance 0 are left out.

    Points of a cell are a block of arrays, blocks of neighbouring cells meet by an equi-join, and a task adds their pairs to its bins at
    once: no pair is ever a row.  Cells are as wide as the distance, ``EDGE`` at least; with fewer than ``FEW`` per axis a frame is one block.
    ``ref``, ``obs`` and ``box`` are as in ``pairs_within``.
    """
    keys, moving = list(keys), box_columns(box)
    if moving and len(moving) < 3:
        raise ValueError("all three lengths have to be columns, or none")
    edge = max(high, EDGE) * unit
    if moving:
        size = lambda k: F.greatest(F.floor(length_of(box, k) / edge), F.lit(1)).cast("int")
    else:
        if min(box) <= 0:
            raise ValueError("a periodic box needs positive lengths")
        m = {k: int(length_of(box, k) // edge) for k in AXES}
        m = {k: v if v >= FEW else 1 for k, v in m.items()}
        size = lambda k: F.lit(m[k])
    cell = lambda k: F.least(F.floor(F.col(k) * size(k) / length_of(box, k)), size(k) - 1).cast("int")
    near = lambda k: F.array_distinct(F.array(*[F.pmod(cell(k) + o, size(k)) for o in (-1, 0, 1)]))
    at = [*keys, "_cx", "_cy", "_cz"]
    p, q = ref, obs.withColumns({f"_c{k}": cell(k) for k in AXES})
    for k in AXES:
        p = p.withColumn(f"_c{k}", F.explode(near(k)))
    gather = lambda df, s, more=(): df.groupBy(*at).agg(*[F.collect_list(k).alias(f"{s}_{k}") for k in AXES], *more)
    own = [F.first(length_of(box, k)).cast("double").alias(f"l{k}") for k in AXES] if moving else []
    met = gather(p, "a", own).join(gather(q, "b"), at).drop(*at)
    sums = met.mapInArrow(_block_weights(high, n, unit, bool(moving), None if moving else tuple(box)), "bin int, own double, next double")
    parts = F.array(F.struct("bin", F.col("own").alias("w")), F.struct((F.col("bin") + 1).alias("bin"), F.col("next").alias("w")))
    return sums.select(F.explode(parts).alias("p")).select("p.bin", "p.w").where(F.col("bin") < n).groupBy("bin").agg(F.sum("w").alias("weight"))
