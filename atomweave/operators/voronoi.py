"""Periodic power diagrams (radical Voronoi cells) of a slab, tile by tile.

The plane of a frame is cut into tiles; a group is one tile with the points around it, periodic images included, up to a
ghost width.  A cell is cut by the bisectors of the points seen, and it is whole if nothing farther away can cut it: with R its
largest distance from its point and r its radius, points beyond R + sqrt(R^2 + max(0, r_max^2 - r^2)) can't.  Cells for which that
reaches over what the tile sees are made anew with twice the ghost width, at last with the whole plane.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import length_of
from ..sources import elements as el
from .staging import staged
from .topology import FRAME

#: Points that a tile has on average, where no number of tiles is given.
PER_TILE = 256
CELLS = "traj string, frame long, atom long, sym string, mol long, area double, perimeter double, neighbours array<long>, sides array<double>, outline array<array<double>>"


def without_overlaps(x: np.ndarray, radius: np.ndarray, least: float, box=None) -> np.ndarray:
    """Which points stay: in order, of two within ``least`` the one with the larger radius, the earlier if they are equal; ``box`` if it is periodic."""
    keep: list[int] = []
    for i in range(len(x)):
        d = x[keep] - x[i] if keep else np.empty((0, 2))
        if box is not None:
            d -= np.array(box) * np.rint(d / np.array(box))
        close = [keep[k] for k in np.flatnonzero((d * d).sum(1) < least * least)]
        if all(radius[j] < radius[i] for j in close):
            keep = [k for k in keep if k not in close] + [i]
    return np.array(sorted(keep), int)


def close_groups(x: np.ndarray, least: float) -> np.ndarray:
    """For every point the smallest number of its group: points joined by steps of less than ``least``."""
    up = np.arange(len(x))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    order = np.argsort(x[:, 0], kind="stable")
    ahead = np.searchsorted(x[order, 0], x[order, 0] + least)
    for a, b in enumerate(ahead.tolist()):
        near = order[a + 1 : b]
        for j in near[((x[near] - x[order[a]]) ** 2).sum(1) < least * least].tolist():
            p, q = find(int(order[a])), find(j)
            up[max(p, q)] = min(p, q)
    return np.array([find(i) for i in range(len(x))], int)


def cell(i: int, x: np.ndarray, radius: np.ndarray, box, widest: float) -> tuple[np.ndarray, list[int], float]:
    """The polygon of point i among the points seen, the point behind each edge (i itself where none cuts), and the distance from which on no point can cut it.

    It begins as a rectangle of the box's size: a cell never reaches beyond the bisectors with its own images.
    """
    w, h = box
    poly = x[i] + np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    owner = [i] * 4
    d = x - x[i]
    far = (d * d).sum(1)
    more = max(0.0, widest * widest - radius[i] ** 2)

    def beyond() -> float:
        reach = ((poly - x[i]) ** 2).sum(1).max()
        return math.sqrt(reach) + math.sqrt(reach + more)

    limit = beyond()
    for j in np.argsort(far, kind="stable"):
        if far[j] <= 1e-18:
            continue
        if far[j] > limit * limit * (1 + 1e-12):
            break
        offset = (far[j] + radius[i] ** 2 - radius[j] ** 2) / 2
        side = (poly - x[i]) @ d[j] - offset
        if (side <= 0).all():
            continue
        new, own = [], []
        for k in range(len(poly)):
            a, b, p, q = side[k], side[(k + 1) % len(poly)], poly[k], poly[(k + 1) % len(poly)]
            if a <= 0:
                new.append(p)
                own.append(owner[k])
            if (a <= 0) != (b <= 0):
                new.append(p + (q - p) * (a / (a - b)))
                own.append(int(j) if a <= 0 else owner[k])
        poly, owner = np.array(new).reshape(-1, 2), own
        if len(poly) < 3:
            return np.empty((0, 2)), [], limit  # what has cut it away is near enough; more cuts change nothing
        limit = beyond()
    return poly, owner, limit


def _sides(poly: np.ndarray) -> list[float]:
    """Lengths of the edges, each behind the neighbour at the same place."""
    return np.sqrt(((np.roll(poly, -1, 0) - poly) ** 2).sum(1)).tolist() if len(poly) >= 3 else []


def area_and_rim(poly: np.ndarray) -> tuple[float, float]:
    if len(poly) < 3:
        return 0.0, 0.0
    after = np.roll(poly, -1, 0)
    return float(abs((poly[:, 0] * after[:, 1] - after[:, 0] * poly[:, 1]).sum()) / 2), float(np.sqrt(((after - poly) ** 2).sum(1)).sum())


def tile_cells(pdf: pd.DataFrame, counts, ghost: float, least: float, widest: float) -> pd.DataFrame:
    """Cells of the tile's own points that are asked for; ``area`` is null where the points seen don't settle a cell.

    Thinning goes by groups of close points; a group that the rim of what is seen may have cut is undecided, and so are the cells near it.
    """
    pdf = pdf.sort_values(["atom", "x", "y"]).reset_index(drop=True)
    plane = (float(pdf["w"][0]), float(pdf["h"][0]))
    x, r = pdf[["x", "y"]].to_numpy(float), pdf["radius"].to_numpy(float)
    size = np.array(plane) / np.array(counts)
    low = size * np.array([pdf["tx"][0], pdf["ty"][0]]) - ghost
    high = low + size + 2 * ghost
    whole = ghost >= max(plane)
    if whole:  # every point is seen
        base = np.unique(pdf["atom"].to_numpy(), return_index=True)[1]
        stays = np.isin(pdf["atom"].to_numpy(), pdf["atom"].to_numpy()[base[without_overlaps(x[base] % np.array(plane), r[base], least, plane)]])
        sure = np.ones(len(x), bool)
    else:
        group = close_groups(x, least)
        rim = np.minimum(x - low, high - x).min(1) <= least
        sure = ~np.isin(group, group[rim])
        stays = np.ones(len(x), bool)
        for g in np.unique(group[np.flatnonzero(np.bincount(group, minlength=len(x))[group] > 1)]):
            of = np.flatnonzero(group == g)
            stays[of] = False
            stays[of[without_overlaps(x[of], r[of], least)]] = True
    used = np.flatnonzero(sure & stays)
    place = {int(j): k for k, j in enumerate(used)}
    open_ = x[~sure]
    atoms, rows = pdf["atom"].to_numpy(), []
    for i in np.flatnonzero(pdf["todo"].to_numpy(bool) & (stays | ~sure)).tolist():
        head = (pdf["traj"][0], pdf["frame"][0], int(atoms[i]), pdf["sym"][i], pdf["mol"][i])
        if not sure[i]:
            rows.append((*head, None, None, None, None, None))
            continue
        poly, owner, limit = cell(place[i], x[used], r[used], plane, widest)
        seen = np.inf if whole else min((x[i] - low).min(), (high - x[i]).min(), np.sqrt(((open_ - x[i]) ** 2).sum(1)).min() if len(open_) else np.inf)
        if limit > seen:
            rows.append((*head, None, None, None, None, None))
            continue
        area, rim_ = area_and_rim(poly)
        rows.append((*head, area, rim_, [int(atoms[used[j]]) for j in owner], _sides(poly), poly.tolist()))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in CELLS.split(", ")])


def _of_tile(*how):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_cells(pdf, *how)

    return run


def voronoi_cells(atoms: DataFrame, box, low: float, high: float, least: float = 0.8, unit: float = 1.0, tiles: tuple[int, int] | None = None) -> DataFrame:
    """``traj, frame, atom, sym, mol, area, perimeter, neighbours, sides, outline`` of the atoms with z from low to high.

    Cells are power cells in the plane with van der Waals radii; atoms closer than ``least`` are thinned first.  ``tiles`` is how many
    tiles the plane has each way, else as many as give ``PER_TILE`` points each where a frame has the most.  The result doesn't depend on it.
    ``box`` has lengths, or names of columns with each frame's.
    """
    radii = F.create_map(*[F.lit(v) for r in el.rows() for v in (r[0], float(r[2] or 0.0))])
    length = {k: (length_of(box, k) if isinstance(length_of(box, k), Column) else F.lit(length_of(box, k))) / float(unit) for k in "xy"}
    near = [F.pmod(F.col(k) / float(unit), length[k]).alias(k) for k in "xy"]
    slab = atoms.where(F.col("z").between(low, high)).select(*FRAME, "atom", "sym", "mol", *near, length["x"].alias("w"), length["y"].alias("h"), F.coalesce(radii[F.col("sym")], F.lit(0.0)).alias("radius"))
    slab = staged(slab, "voronoi-points")
    most = slab.groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("radius").alias("r"), F.max("w").alias("w"), F.max("h").alias("h")).agg(*[F.max(c) for c in ("n", "r", "w", "h")]).first()  # four numbers
    n, widest, plane = most[0] or 0, most[1] or 0.0, (most[2] or 1.0, most[3] or 1.0)
    if tiles is None:
        side = math.sqrt(PER_TILE * plane[0] * plane[1] / max(1, n))
        tiles = tuple(max(1, int(length / side)) for length in plane)
    ghost = max(plane) if max(tiles) == 1 else min(max(plane), 4 * math.sqrt(plane[0] * plane[1] / max(1, n)) + 2 * least)
    sides = [(k, F.col(c) / m, m, F.col(c)) for k, c, m in zip("xy", "wh", tiles, strict=True)]
    own = [F.least(F.floor(F.col(k) / step), F.lit(m - 1)).cast("int") for k, step, m, _ in sides]
    out, todo = None, None
    while True:
        rows = slab.withColumn("todo", F.lit(True)) if todo is None else slab.join(todo.withColumn("todo", F.lit(True)), [*FRAME, "atom"], "left").fillna(False, ["todo"])
        rows = rows.withColumns({"ox": own[0], "oy": own[1]})
        spread = rows
        for k, step, m, whole in sides:
            reach = F.sequence(F.floor((F.col(k) - ghost) / step).cast("int"), F.floor((F.col(k) + ghost) / step).cast("int"))
            spread = spread.withColumn("_k", F.explode(reach)).withColumns({f"t{k}": F.pmod("_k", F.lit(m)), k: F.col(k) - F.floor(F.col("_k") / m) * whole, "todo": F.col("todo") & (F.col("_k") == F.col(f"o{k}"))}).drop("_k")
        if todo is not None:  # only tiles with open cells
            spread = spread.join(rows.where("todo").select(*FRAME, F.col("ox").alias("tx"), F.col("oy").alias("ty")).distinct(), [*FRAME, "tx", "ty"])

        found = spread.drop("ox", "oy").groupBy(*FRAME, "tx", "ty").applyInPandas(_of_tile(tiles, ghost, least, widest), CELLS)
        if ghost >= max(plane):
            return found if out is None else out.unionByName(found)
        found = staged(found, "voronoi-cells")
        out = found.where("area is not null") if out is None else out.unionByName(found.where("area is not null"))
        todo = found.where("area is null").select(*FRAME, "atom")
        if todo.isEmpty():
            return out
        ghost = min(2 * ghost, max(plane))


def domain_areas(cells: DataFrame, by: str = "sym") -> DataFrame:
    """``traj, frame, by, area, compactness``: area of each kind and 4 pi A / P^2 of its cells' mean."""
    quotient = F.lit(4 * np.pi) * F.col("area") / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0))
    return cells.groupBy(*FRAME, by).agg(F.sum("area").alias("area"), F.avg(quotient).alias("compactness"))


def same_kind_edges(cells: DataFrame, by: str = "sym") -> DataFrame:
    """Neighbouring cells of one kind: ``traj, frame, src, dst``."""
    e = cells.select(*FRAME, F.col("atom").alias("src"), F.col(by).alias("k1"), F.explode(F.array_distinct("neighbours")).alias("dst")).where("src <> dst")
    return e.join(cells.select(*FRAME, F.col("atom").alias("dst"), F.col(by).alias("k2")), [*FRAME, "dst"]).where("k1 = k2").select(*FRAME, "src", "dst")


def running_areas(cells: DataFrame, by: str = "sym") -> DataFrame:
    """``traj, frame, by, area``: mean area of each kind over the frames so far; frames without the kind count 0."""
    every = cells.select(*FRAME).distinct().withColumn("nth", F.row_number().over(W.partitionBy("traj").orderBy("frame")))
    kinds = cells.select("traj", by).distinct()
    own = cells.groupBy(*FRAME, by).agg(F.sum("area").alias("own"))
    so_far = W.partitionBy("traj", by).orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    rows = every.join(kinds, "traj").join(own, [*FRAME, by], "left")
    return rows.select(*FRAME, by, (F.sum(F.coalesce("own", F.lit(0.0))).over(so_far) / F.col("nth")).alias("area"))


def compactness(cells: DataFrame, sets: DataFrame, by: str = "kind") -> DataFrame:
    """``traj, frame, by, comp, q``: 4 pi A / P^2 of each kind's sets of cells ``traj, frame, atom, comp``; sides between cells of one set are no rim."""
    own = cells.join(sets, [*FRAME, "atom"])
    side = own.select(*FRAME, by, "comp", "atom", F.explode(F.arrays_zip("neighbours", "sides")).alias("s")).select(*FRAME, by, "comp", "atom", F.col("s.neighbours").alias("other"), "s.sides")
    there = own.select(*FRAME, F.col("atom").alias("other"), F.col("comp").alias("c"), F.col(by).alias("k"))
    rim = side.join(there, [*FRAME, "other"], "left").where(F.col("c").isNull() | (F.col("c") != F.col("comp")) | (F.col("k") != F.col(by)))
    rim = rim.groupBy(*FRAME, by, "comp").agg(F.sum("sides").alias("rim"))
    area = own.groupBy(*FRAME, by, "comp").agg(F.sum("area").alias("area"))
    return area.join(rim, [*FRAME, by, "comp"]).where("rim > 0").select(*FRAME, by, "comp", (F.lit(4 * np.pi) * F.col("area") / (F.col("rim") * F.col("rim"))).alias("q"))
