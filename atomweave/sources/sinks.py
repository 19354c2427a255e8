"""Results of the analyses as text files with the names and layouts that users of such programs expect.

A finished analysis has as many rows as bins or lags, which are collected; whatever grows with the trajectory (kinds of clusters and
their curves, areas by frame, the log of charges, coordinates) is sorted by Spark and streamed to the file partition by partition.
File names, headers and number formats are fixed values.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.histograms import Bins
from .drawings import svg


def table_text(headers: list[str], rows: Iterable) -> Iterable[str]:
    """First column left, the others right, six decimals."""
    yield "# " + f"{headers[0]:<12}" + " ".join(f"{h:>12}" for h in headers[1:])
    for r in rows:
        yield f"{r[0]:<12.6f}" + "".join(f" {v:>12.6f}" for v in r[1:])


def _write(path: str, lines: Iterable[str], mode: str = "w") -> str:
    with open(path, mode, encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)
    return path


def _labels(text) -> str:
    return "_".join(x.strip().replace(" ", "") for x in text.split(",") if x.strip())


def _filled(rows: list, bins: Bins, *values: str) -> list[tuple]:
    """A row per bin, zeros where there was nothing."""
    known = {r["bin"]: r for r in rows}
    return [(bins.low + (n + 0.5) * bins.width, *(known[n][v] if n in known else 0.0 for v in values)) for n in range(bins.n)]


def rdf(out: dict, q, folder: str, box) -> list[str]:
    rows = out["rdf"].orderBy("bin").collect()
    name = f"rdf_{_labels(q.ref_labels)}_{_labels(q.obs_labels)}.dat"
    return [_write(f"{folder}/{name}", table_text(["r/Å", "g(r)", "N(r)"], ((r.r, r.g, r.n) for r in rows)))]


def adf(out: dict, q, folder: str, box) -> list[str]:
    rows = _filled(out["adf"].collect(), Bins(0.0, 180.0, q.bins), "value")
    return [_write(f"{folder}/adf.dat", table_text(["bin_0", "count"], rows))]


def adf3b(out: dict, q, folder: str, box) -> list[str]:
    rows = _filled(out["adf3b"].collect(), Bins(0.0, 180.0, q.bins), "value")
    return [_write(f"{folder}/adf_threebody.dat", table_text(["Angle (deg)", "ADF"], rows))]


def density(out: dict, q, folder: str, box) -> list[str]:
    """One column per compound, in order of the keys."""
    rows = out["density"].collect()
    kinds = sorted({(r.comp_key, r.rep) for r in rows})
    length = box["xyz".index(q.axis)]
    n = -(-length // q.step)
    spec = Bins(0.0, n * q.step, int(n))
    columns = [{r.bin: r.value for r in rows if (r.comp_key, r.rep) == k} for k in kinds]
    body = ((spec.low + (b + 0.5) * spec.width, *(c.get(b, 0.0) for c in columns)) for b in range(spec.n))
    return [_write(f"{folder}/density.dat", table_text(["r/Å", *(rep for _, rep in kinds)], body))]


def percolation(out: dict, q, folder: str, box) -> list[str]:
    rows = out["percolation"].orderBy("depth").collect()
    return [_write(f"{folder}/percolation_depths.dat", ["# Depth    AverageReachableMolecules", *(f"{r.depth} {r['mean'] or 0.0:.6f}" for r in rows)])]


def _groups(rows: Iterable, key: Callable) -> Iterable[tuple]:
    """Rows that come one after the other with the same key, together."""
    return ((k, list(own)) for k, own in groupby(rows, key))


def _population_lines(df: DataFrame, by: list[str], head: str, width: int, every: bool = False) -> Iterable[str]:
    """A line per kind with the mean and deviation of each atom label (the labels are the user's); kinds come by falling sum of means, or in their order.

    With ``every`` the kinds are whole numbers, and those that are missing have lines of zeros.
    """
    atoms = [r.atom_label for r in df.select("atom_label").distinct().orderBy("atom_label").collect()]
    yield head + "".join(f"{f'I({a})':>15}{f'std(I({a}))':>15}" for a in atoms)
    total = df.withColumn("_total", F.sum("mean").over(W.partitionBy(*by)))
    rows = total.orderBy(*by) if every else total.orderBy(F.desc("_total"), *by)

    def line(kind, known: dict) -> str:
        cells = [known.get(a) for a in atoms]
        return f"{kind:<{width}}" + "".join("{:>15.10f}{:>15.10f}".format(*((c["mean"], c["std"]) if c is not None else (0.0, 0.0))) for c in cells)

    nth = 1
    for kind, own in _groups(rows.toLocalIterator(), lambda r: tuple(r[c] for c in by)):
        while every and nth < kind[0]:
            yield line(nth, {})
            nth += 1
        yield line(kind[0], {r.atom_label: r for r in own})
        nth += 1


def clusters(out: dict, q, folder: str, box) -> list[str]:
    """Occurrences by falling number, populations by falling sum, sizes from 1, a curve for every kind, and coordinates."""
    rows = out["cluster_occurrences"].orderBy(F.desc("occurrences"), "composition", "graph_id").toLocalIterator()
    head = f"{'Cluster':<30} {'Occurrences':>12} {'GraphID':<32} {'mean_per_frame':>16} {'std_per_frame':>16}"
    lines = (f"{r.composition:<30} {r.occurrences:>12d} {r.graph_id:<32} {r['mean']:>16.6f} {r['std']:>16.6f}" for r in rows)
    files = [_write(f"{folder}/cluster_occurrences.dat", chain([head], lines))]
    files.append(_write(f"{folder}/cluster_populations.dat", _population_lines(out["cluster_populations"], ["composition", "graph_id"], f"{'Cluster':<30}", 30)))
    files.append(_write(f"{folder}/cluster_size.dat", _population_lines(out["cluster_size"], ["size"], f"{'Cluster Size':<15}", 15, every=True)))
    if "cacf" in out:
        curves = out["cacf"].orderBy("composition", "graph_id", "tau").toLocalIterator()
        for (c, g), own in _groups(curves, lambda r: (r.composition, r.graph_id)):
            files.append(_write(f"{folder}/cacf_{c}_{g}.dat", ["tau CACF", *(f"{r.tau} {r.c:.12f}" for r in own)]))
    if "cluster_nodes" in out:
        files += cluster_drawings(out, folder)
    if "cluster_xyz" in out:
        files += cluster_xyz(out["cluster_xyz"], f"{folder}/xyz")
    return files


def cluster_drawings(out: dict, folder: str) -> list[str]:
    """One drawing for each of the first kinds."""
    nodes, edges, files = {}, {}, []
    for r in out["cluster_nodes"].orderBy("rank", "atom").collect():
        nodes.setdefault((r["rank"], r.composition), []).append(r)
    for r in out["cluster_edges"].collect():
        edges.setdefault(r["rank"], []).append((r.src, r.dst))
    for (rank, composition), own in nodes.items():
        at = {r.atom: n for n, r in enumerate(own)}
        text = svg([r.grp for r in own], [r.sym for r in own], [(at[a], at[b]) for a, b in edges.get(rank, [])])
        files.append(_write(f"{folder}/graph{rank}_{composition}.svg", text.splitlines()))
    return files


def compound_drawings(system, folder: str) -> list[str]:
    """The first molecule of each compound, ``compound<number>.svg``."""
    files = []
    members = system.topology.members
    first = members.groupBy("comp").agg({"mol": "min"}).withColumnRenamed("min(mol)", "mol")
    atoms: dict = {}
    for r in members.join(first, ["comp", "mol"]).select("comp", "mol", "atom", "sym", "label").orderBy("comp", "atom").collect():
        atoms.setdefault(r.comp, []).append(r)
    bonds = system.topology.bonds.join(first, "mol").select("comp", "a", "b").collect()
    for comp, own in atoms.items():
        at = {r.atom: n for n, r in enumerate(own)}
        text = svg([r.label for r in own], [r.sym for r in own], [(at[b.a], at[b.b]) for b in bonds if b.comp == comp])
        files.append(_write(f"{folder}/compound{comp}.svg", text.splitlines()))
    return files


def cluster_xyz(rows: DataFrame, folder: str) -> list[str]:
    """A file per composition and graph; clusters follow each other in order of frames."""
    os.makedirs(folder, exist_ok=True)
    files, own, now = [], [], None

    def put() -> None:
        if own:
            path = f"{folder}/{own[0].composition}_{own[0].graph_id}.xyz"
            _write(path, [str(len(own)), "Generated by cluster analysis", *(f"{r.sym} {r.x:.6f} {r.y:.6f} {r.z:.6f}" for r in own)], "a" if path in files else "w")
            if path not in files:
                files.append(path)

    for r in rows.orderBy("traj", "frame", "comp", "n").toLocalIterator():
        key = (r.traj, r.frame, r.comp)
        if key != now:
            put()
            own, now = [], key
        own.append(r)
    put()
    return files


def dacf(out: dict, q, folder: str, box) -> list[str]:
    rows = out["dacf"].orderBy("tau").collect()
    return [_write(f"{folder}/dacf.dat", ["tau/ps DACF", *(f"{r.t_ps:.6f} {r.c:.12f}" for r in rows)])]


def top(out: dict, q, folder: str, box) -> list[str]:
    rows, files = out["top"].collect(), []
    for kind, name, head, n in (("q", "tetrahedral_q.dat", ["q", "P(q)"], q.q_bins), ("S", "tetrahedral_s.dat", ["S", "P(S)"], q.s_bins)):
        own = [r for r in rows if r.kind == kind]
        if own:
            files.append(_write(f"{folder}/{name}", table_text(head, _filled(own, Bins(0.0, 1.0, n), "p"))))
    return files


def pccf(out: dict, q, folder: str, box) -> list[str]:
    rows, files = out["pt_chains"].orderBy("gap", "n").collect(), []
    for gap in [int(g) for g in q.gaps.split(",") if g.strip().isdigit()]:
        own = [r for r in rows if r.gap == gap]
        total = own[0].total if own else 0
        files.append(_write(f"{folder}/proton_chains_gap{gap}.dat", [f"# Total number of chains: {total}", "# n   C(n)", *(f"{r.n} {r.c:.6f}" for r in own if r.c > 0)]))
    return files


def charges(out: dict, q, folder: str, box) -> list[str]:
    def moves() -> Iterable[str]:
        yield "# cid  frame  mol  sign"
        now = None
        for r in out["charge_track"].orderBy("traj", "cid", "frame").toLocalIterator():
            if (r.traj, r.cid) != now:
                now = (r.traj, r.cid)
                yield f"# Charge ID {r.cid}"
            yield f"{r.cid:<6} {r.frame:<6} {r.mol:<6} {r.sign:+d}"

    rows = out["charge_msd"].orderBy("tau").collect()
    msd = ["# t(Δframes)  MSD(+1)  MSD(-1)", *(f"{r.tau:<4} {r.msd_pos:.6f} {r.msd_neg:.6f}" for r in rows)]
    return [_write(f"{folder}/charge_trajectories.dat", moves()), _write(f"{folder}/charge_msd.dat", msd)]


def ncount(out: dict, q, folder: str, box) -> list[str]:
    known = {r.n: r.p for r in out["ncount"].collect()}
    body = [f"{n:3d}  {known.get(n, 0.0):.6f}" for n in range(max(known, default=-1) + 1)]
    return [_write(f"{folder}/ncount.dat", [f"# P(n)   cutoff = {q.cutoff:.2f} Å", "#  n   P(n)", *body])]


def cdf(out: dict, q, folder: str, box) -> list[str]:
    """All bins of both axes, zeros where there was nothing."""
    known = {(r.bin1, r.bin2): r.value for r in out["cdf"].collect()}
    one, two = Bins(q.distance_min, q.distance_max, q.distance_bins), Bins(0.0, 180.0, q.angle_bins)
    rows = ((one.low + (a + 0.5) * one.width, two.low + (b + 0.5) * two.width, known.get((a, b), 0.0)) for a in range(one.n) for b in range(two.n))
    return [_write(f"{folder}/cdf.dat", table_text(["bin_0", "bin_1", "count"], rows))]


#: The titles of the distribution files.
DISTRIBUTIONS = {
    "voronoi_area_distributions": "Atomic Voronoi cell area distributions",
    "voronoi_molecular_distributions": "Molecular Voronoi area distributions",
    "voronoi_cluster_distributions": "Cluster Voronoi area distributions",
    "voronoi_cluster_compactness": "Compactness ratio (isoperimetric quotient) distributions per compound",
    "voronoi_global_compactness": "Global compactness ratio distributions per compound (entire compound shape per frame)",
}


def voronoi(out: dict, q, folder: str, box) -> list[str]:
    kinds = [r.kind for r in out["voronoi_areas"].select("kind").distinct().orderBy("kind").collect()]  # of compounds
    by_frame = _groups(out["voronoi_areas"].orderBy("traj", "frame").toLocalIterator(), lambda r: (r.traj, r.frame))
    lines = (f"{frame + 1} " + " ".join(f"{own.get(k, 0.0):.4f}" for k in kinds) for (_, frame), own in ((key, {r.kind: r.area for r in rows}) for key, rows in by_frame))
    files = [_write(f"{folder}/voronoi_areas.dat", chain(["# Frame " + " ".join(kinds)], lines))]
    top_ = int(-(-(box[0] * box[1]) // 100) * 100)
    for name, title in DISTRIBUTIONS.items():
        spec = Bins(0.0, 1.0, q.compactness_bins) if name.endswith("compactness") else Bins(0.0, float(top_), q.bins or 2 * top_)
        own = out[name].collect()
        kinds = sorted({r.kind for r in own})
        known = {(r.kind, r.bin): r.p for r in own}
        body = (f"{spec.low + (b + 0.5) * spec.width:.4f} " + " ".join(f"{known.get((k, b), 0.0):.6f}" for k in kinds) for b in range(spec.n))
        files.append(_write(f"{folder}/{name}.dat", [f"# {title}", "# Columns: Bin_Center " + " ".join(kinds), *body]))
    own = out["voronoi_cluster_counts"].collect()
    kinds, known = sorted({r.kind for r in own}), {(r.kind, r.n): r.pct for r in own}
    mean = [sum(n * v for (k, n), v in known.items() if k == kind) / 100 for kind in kinds]
    lines = ["# Cluster count histogram per compound (percentage of frames)", "Count" + "".join(f"{k:>8}" for k in kinds), "# Avg  " + "".join(f"{m:8.2f}" for m in mean)]
    lines += [f"{n:<4}" + "".join(f"{known.get((k, n), 0.0):8.2f}" for k in kinds) for n in range(1, max((n for _, n in known), default=0) + 1)]
    return [*files, _write(f"{folder}/voronoi_cluster_counts.dat", lines)]


SINKS = {
    "rdf": rdf, "adf": adf, "adf3b": adf3b, "dens": density, "percolation": percolation, "cluster": clusters, "dacf": dacf, "top": top,
    "pccf": pccf, "cmsd": charges, "ncount": ncount, "cdf": cdf, "voro2d": voronoi,
}


def compound_lines(system) -> Iterable[str]:
    """The compounds and, for each, the matrix of its mean bond lengths by labels."""
    kinds = system.compounds
    yield from (f"Compound {c.comp}: {c.formula}, Number: {c.n_members}" for c in kinds)
    lengths = {(r.comp, r.a_label, r.b_label): r.length / system.unit for r in system.topology.bond_lengths().collect()}
    names: dict = {}
    for r in system.topology.members.select("comp", "label").distinct().collect():  # labels of kinds, not of molecules
        names.setdefault(r.comp, []).append(r.label)
    for c in kinds:
        labels = sorted(names[c.comp], key=lambda x: (x.rstrip("0123456789"), int("0" + x.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))))
        yield f"\nCompound {c.comp} Bond Length Matrix:"
        yield "     " + " ".join(f"{x:>8}" for x in labels)
        for a in labels:
            cells = [lengths.get((c.comp, min(a, b), max(a, b))) for b in labels]
            yield f"{a:>5} " + " ".join(f"{'-  ' if v is None else f'{v:.4f}':>8}" for v in cells)
