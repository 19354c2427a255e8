"""The analyses: from atoms and parameters to one table each.

Atoms have ``traj, frame, atom, sym, label, mol, x, y, z``; ``unit`` is the number of coordinate units in an angstrom.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, angle, any_label, box_columns, delta
from ..operators.cells import distance_weights, nearest, pairs_within
from ..operators.histograms import Bins, dense, linear, simple, simple2, to_total
from ..operators.topology import FRAME, centres_of_mass


def frame_set(first: int, last: int, start: int = 1, nframes: int = -1, stride: int = 1, strict: bool = False) -> list[int]:
    """Frames that are processed, of first..last: from the start-th on, every stride-th.

    A positive ``nframes`` that is no multiple of the stride runs to the end, unless ``strict``; 0 gives none.
    """
    frames = list(range(first + start - 1, last + 1, stride))
    if nframes == 0:
        return []
    if nframes > 0 and (strict or nframes % stride == 0):
        return frames[: math.ceil(nframes / stride)]
    return frames


def window_frames(atoms: DataFrame, start: int = 1, nframes: int = -1, stride: int = 1, strict: bool = False) -> DataFrame:
    """The atoms of the processed frames, as a predicate on the frame number that a scan can take."""
    keep = (F.col("frame") >= start - 1) & ((F.col("frame") - (start - 1)) % stride == 0)
    if nframes == 0:
        keep = F.lit(False)
    elif nframes > 0 and (strict or nframes % stride == 0):
        keep = keep & (F.col("frame") < start - 1 + math.ceil(nframes / stride) * stride)
    return atoms.where(keep)


def select(atoms: DataFrame, patterns) -> DataFrame:
    """Atoms that fit label patterns, or a choice of compounds and labels; of several choices together, an atom as often as it is chosen."""
    if hasattr(patterns, "of"):
        return patterns.of(atoms)
    if isinstance(patterns, list) and patterns and hasattr(patterns[0], "of"):
        return reduce(DataFrame.unionByName, [c.of(atoms) for c in patterns])
    return atoms.where(any_label(F.col("label"), patterns))


def per_frame(ref: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: ``frames, n_ref, n_obs``, mean selection sizes over frames that have both."""
    n = ref.groupBy(*FRAME).agg(F.count("*").alias("r")).join(obs.groupBy(*FRAME).agg(F.count("*").alias("o")), FRAME)
    return n.agg(F.count("*").alias("frames"), F.avg("r").alias("n_ref"), F.avg("o").alias("n_obs"))


def one_box(atoms: DataFrame, box) -> tuple:
    """The box as three numbers: where frames have their own, that of the first frame there is."""
    names = box_columns(box)
    if not names:
        return tuple(box)
    first = atoms.agg(F.min_by(F.struct(*names), F.struct(*FRAME)).alias("b")).first().b  # three numbers
    return tuple(first[v] if isinstance(v, str) else v for v in box) if first else (1.0, 1.0, 1.0)


def rdf(atoms: DataFrame, ref: str, obs: str, box, rmax: float = 10.0, bins: int = 500, unit: float = 1.0, whole=None) -> DataFrame:
    """Radial distribution: ``bin, r, g, n``; pairs at distance 0 do not count, pairs within a molecule do.

    Where frames have boxes of their own, distances are taken in these, and the volume is that of the box ``whole`` (default: the first frame's).
    """
    parts = rdf_parts(atoms, ref, obs, box, rmax, bins, unit)
    return rdf_of(parts, math.prod(whole or one_box(atoms, box)) / unit**3, rmax, bins)


def rdf_parts(atoms: DataFrame, ref: str, obs: str, box, rmax: float = 10.0, bins: int = 500, unit: float = 1.0) -> DataFrame:
    """``part, bin, value``: what a stretch of frames adds to a radial distribution: weights, frames that have both selections, and their sizes."""
    if rmax < 0.1 or bins < 1:
        raise ValueError("rmax is at least 0.1 and there is at least one bin")
    a, b = select(atoms, ref), select(atoms, obs)
    need = [*FRAME, *AXES, *box_columns(box)]
    pairs = distance_weights(a.select(*need), b.select(*need), rmax, bins, box, unit)
    n = a.groupBy(*FRAME).agg(F.count("*").alias("r")).join(b.groupBy(*FRAME).agg(F.count("*").alias("o")), FRAME)
    sizes = n.agg(F.count("*").cast("double").alias("frames"), F.sum("r").cast("double").alias("ref"), F.sum("o").cast("double").alias("obs"))
    sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.lit(0).alias("bin"), F.coalesce(c, F.lit(0.0)).alias("value")) for c in sizes.columns])).alias("x")).select("x.*")
    return pairs.select(F.lit("pairs").alias("part"), "bin", F.col("weight").alias("value")).unionByName(sizes)


def rdf_of(parts: DataFrame, volume: float, rmax: float = 10.0, bins: int = 500) -> DataFrame:
    """The radial distribution of summed parts."""
    spec = Bins(0.0, rmax, bins)
    of = lambda name: F.sum(F.when(F.col("part") == name, F.col("value")))
    sizes = parts.agg(of("frames").alias("frames"), (of("ref") / F.nullif(of("frames"), F.lit(0.0))).alias("n_ref"), (of("obs") / F.nullif(of("frames"), F.lit(0.0))).alias("n_obs"))
    hist = dense(parts.where("part = 'pairs'").select("bin", F.col("value").alias("weight")), spec, "weight")
    edge = F.col("bin") * spec.width
    shell = F.lit(4 / 3 * math.pi) * (F.pow(edge + spec.width, F.lit(3)) - F.pow(edge, F.lit(3)))
    g = F.col("weight") / (shell * F.col("n_ref") * F.col("n_obs") * F.col("frames") / volume)
    out = hist.join(F.broadcast(sizes)).withColumns({"shell": shell, "g": F.coalesce(g, F.lit(0.0))})  # one row
    run = W.partitionBy().orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # as many rows as bins
    return out.select("bin", spec.centre(F.col("bin")).alias("r"), "g", (F.col("n_obs") / volume * F.sum(F.col("g") * F.col("shell")).over(run)).alias("n"))


def sine_weighted(hist: DataFrame, field: str, spec: Bins) -> DataFrame:
    """Divided by the sine of the bin's centre and scaled to 100 per bin in sum: ``bin, angle, value``."""
    centre = spec.centre(F.col("bin"))
    w = hist.select("bin", centre.alias("angle"), (F.col(field) / F.sin(F.radians(centre))).alias("value"))
    return to_total(w, "value", 100.0 * spec.n)


def molecule_vectors(atoms: DataFrame, ends: dict[str, tuple[str, str]], box, v1_cut=0, v2_cut=0, shared: bool = False) -> DataFrame:
    """All pairs of different molecules of a frame with two vectors each.

    ``ends`` gives for ``b1, t1, b2, t2`` (base and tip of both vectors) the molecule (``r`` or ``o``) and the
    label pattern.  A cutoff bounds a vector's length, 0 is none; ``shared`` asks that tip 1 and base 2 be one atom.
    """
    mols = atoms.select(*FRAME, "mol").distinct()
    rows = mols.select(*FRAME, F.col("mol").alias("r_mol")).join(mols.select(*FRAME, F.col("mol").alias("o_mol")), FRAME).where("r_mol <> o_mol")
    for name, (source, pattern) in ends.items():
        own = select(atoms, pattern).select(*FRAME, F.col("mol").alias(f"{source}_mol"), F.col("atom").alias(f"{name}_atom"), *[F.col(k).alias(f"{name}_{k}") for k in [*AXES, *box_columns(box)]])
        rows = rows.join(own, [*FRAME, f"{source}_mol"])
    if shared:
        rows = rows.where("t1_atom = b2_atom")
    for v, cut in (("1", v1_cut), ("2", v2_cut)):
        d = [delta(f"b{v}_", f"t{v}_", k, box) for k in AXES]
        rows = rows.withColumns({f"v{v}{k}": c for k, c in zip(AXES, d, strict=True)})
        if cut:
            rows = rows.where(F.expr(f"v{v}x * v{v}x + v{v}y * v{v}y + v{v}z * v{v}z") <= cut * cut)
    return rows


def vector_angle(rows: DataFrame) -> DataFrame:
    return rows.withColumn("angle", angle([F.col(f"v1{k}") for k in AXES], [F.col(f"v2{k}") for k in AXES])).where("angle is not null")


def adf(atoms: DataFrame, ends: dict, box, bins: int = 180, v1_cut=0, v2_cut=0, shared: bool = False) -> DataFrame:
    """Angle between two vectors of a pair of molecules: ``bin, angle, value``."""
    spec = Bins(0.0, 180.0, bins)
    return sine_weighted(simple(vector_angle(molecule_vectors(atoms, ends, box, v1_cut, v2_cut, shared)).drop("bin"), "angle", spec), "count", spec)


def triplets(atoms: DataFrame, centre: str, first: str, second: str, box, cut1, cut2, different: bool = True) -> DataFrame:
    """Ordered pairs of neighbours of every centre: columns ``v1x.., v2x..`` and the atoms' numbers; cuts are (least, most)."""
    c = select(atoms, centre)
    out = None
    for n, (pattern, (least, most)) in enumerate(((first, cut1), (second, cut2)), 1):
        p = pairs_within(c, select(atoms, pattern), most, box, least=least)
        p = p.select(*FRAME, F.col("a_atom").alias("centre"), F.col("b_atom").alias(f"n{n}"), F.col("b_mol").alias(f"m{n}"), *[delta("a_", "b_", k, box).alias(f"v{n}{k}") for k in AXES])
        out = p if out is None else out.join(p, [*FRAME, "centre"])
    out = out.where("n1 <> n2")
    return out.where("m1 <> m2") if different else out


def adf3b(atoms: DataFrame, centre: str, first: str, second: str, box, cut1=(0.0, 3.5), cut2=(0.0, 3.5), different: bool = True, bins: int = 180) -> DataFrame:
    """Neighbour, centre, neighbour angle: ``bin, angle, value``; a neighbour that coincides with the centre gives no angle."""
    return adf3b_of(adf3b_parts(atoms, centre, first, second, box, cut1, cut2, different, bins), bins)


def adf3b_parts(atoms: DataFrame, centre: str, first: str, second: str, box, cut1=(0.0, 3.5), cut2=(0.0, 3.5), different: bool = True, bins: int = 180) -> DataFrame:
    """``part, bin, value``: the weights of a stretch of frames."""
    rows = vector_angle(triplets(atoms, centre, first, second, box, cut1, cut2, different))
    return linear(rows.select("angle"), "angle", Bins(0.0, 180.0, bins)).select(F.lit("angles").alias("part"), "bin", F.col("weight").alias("value"))


def adf3b_of(parts: DataFrame, bins: int = 180) -> DataFrame:
    return sine_weighted(parts.select("bin", F.col("value").alias("weight")), "weight", Bins(0.0, 180.0, bins))


def density(atoms: DataFrame, kinds: DataFrame, box, axis: str = "z", step: float = 0.1, unit: float = 1.0, whole=None) -> DataFrame:
    """Mean number of molecules per bin of the centre of mass along an axis: ``rep, bin, r, value``; ``kinds`` has ``traj, frame, mol, rep``.

    Bins go over the length of the box ``whole`` (default: the first frame's) where frames have boxes of their own.
    """
    length = (whole or one_box(atoms, box))[AXES.index(axis)] / unit
    n = math.ceil(length / step)
    spec = Bins(0.0, n * step, n)
    frames = atoms.select(*FRAME).distinct().agg(F.count("*").alias("frames"))
    com = centres_of_mass(atoms, box, unit).join(kinds, [*FRAME, "mol"])
    hist = linear(com.select("rep", F.col(f"c{axis}").alias("v")), "v", spec, by=("rep",))
    return hist.join(F.broadcast(frames)).select("rep", "bin", spec.centre(F.col("bin")).alias("r"), (F.col("weight") / F.col("frames")).alias("value"))


def ncount(atoms: DataFrame, ref: str, obs: str, box, cutoff=3.5, same_molecule: bool = False) -> DataFrame:
    """Distribution of the number of neighbours: ``n, occurrences, p``, from 0."""
    return ncount_of(ncount_parts(atoms, ref, obs, box, cutoff, same_molecule))


def ncount_parts(atoms: DataFrame, ref: str, obs: str, box, cutoff=3.5, same_molecule: bool = False) -> DataFrame:
    """``part, bin, value``: how many reference atoms of a stretch of frames have each number of neighbours."""
    a, b = select(atoms, ref), select(atoms, obs)
    pairs = pairs_within(a, b, cutoff, box).where("a_atom <> b_atom")
    if not same_molecule:
        pairs = pairs.where("a_mol <> b_mol")
    n = pairs.groupBy(*FRAME, F.col("a_atom").alias("atom")).agg(F.count("*").alias("n"))
    counts = a.select(*FRAME, "atom").join(n, [*FRAME, "atom"], "left").groupBy(F.coalesce("n", F.lit(0)).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.lit("neighbours").alias("part"), "bin", "value")


def ncount_of(parts: DataFrame) -> DataFrame:
    total = F.sum("value").over(W.partitionBy())  # as many rows as neighbour counts
    return parts.select(F.col("bin").cast("long").alias("n"), F.col("value").cast("long").alias("occurrences"), (F.col("value") / total).alias("p"))


def tetrahedral(atoms: DataFrame, ref: str, obs: str, box, radius, cutoff=None) -> DataFrame:
    """``traj, frame, atom, q, s`` of every reference atom with four neighbours; ``s`` is null if they are at distance 0."""
    a, b = select(atoms, ref), select(atoms, obs)
    if cutoff is None:
        near = nearest(a, b, 4, box, radius)
    else:
        rank = W.partitionBy(*FRAME, "a_atom").orderBy("d2", "b_atom")
        near = pairs_within(a, b, cutoff, box).where("a_atom <> b_atom").withColumn("rank", F.row_number().over(rank)).where("rank <= 4")
    v = near.select(*FRAME, F.col("a_atom").alias("atom"), "rank", F.sqrt(F.col("d2").cast("double")).alias("d"), *[delta("a_", "b_", k, box).cast("double").alias(k) for k in AXES])
    # four rows an atom at most, gathered once: no join that Spark could broadcast
    n = [F.get("near", F.lit(k)) for k in range(4)]
    four = v.groupBy(*FRAME, "atom").agg(F.sort_array(F.collect_list(F.struct("rank", "d", *AXES))).alias("near")).where((F.size("near") == 4) & (n[0]["d"] > 0))
    cosine = [reduce(add, [p[k] * q[k] for k in AXES]) / p["d"] / q["d"] + F.lit(1 / 3) for p, q in combinations(n, 2)]
    four = four.withColumns({"q": 1 - F.lit(3 / 8) * reduce(add, [c * c for c in cosine]), "m": reduce(add, [p["d"] for p in n]) / 4})
    s = 1 - F.lit(1 / 3) * reduce(add, [(p["d"] - F.col("m")) * (p["d"] - F.col("m")) for p in n]) / (4 * F.col("m") * F.col("m"))
    return four.select(*FRAME, "atom", "q", F.when(F.col("m") > 1e-8, s).alias("s"))


def top(orders: DataFrame, field: str, bins: int) -> DataFrame:
    """Distribution of an order parameter on [0, 1], 100 in sum: ``bin, center, p``."""
    spec = Bins(0.0, 1.0, bins)
    return to_total(linear(orders, field, spec), "weight", 100.0).select("bin", spec.centre(F.col("bin")).alias("center"), F.col("weight").alias("p"))


def cdf(atoms: DataFrame, centre: str, first: str, second: str, box, cut1, cut2, distance: Bins, angles: Bins, unit: float = 1.0) -> DataFrame:
    """Combined distribution of the distance to the first neighbour and the angle with the second, of the same triplet.

    ``bin1, bin2, c1, c2, value``: counts over the shell of the distance and the sine of the angle.
    """
    rows = vector_angle(triplets(atoms, centre, first, second, box, cut1, cut2))
    rows = rows.withColumn("d", F.sqrt(F.expr("v1x * v1x + v1y * v1y + v1z * v1z").cast("double")) / unit)
    hist = simple2(rows, "d", "angle", distance, angles)
    edge = F.lit(distance.low) + F.col("bin1") * distance.width
    shell = F.lit(4 / 3 * math.pi) * (F.pow(edge + distance.width, F.lit(3)) - F.pow(edge, F.lit(3)))
    c2 = angles.centre(F.col("bin2"))
    return hist.select("bin1", "bin2", distance.centre(F.col("bin1")).alias("c1"), c2.alias("c2"), (F.col("count") / shell / F.sin(F.radians(c2))).alias("value"))
