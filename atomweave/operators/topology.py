"""Bonds, molecules, compounds and labels from distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, box_columns, length_of
from ..sources import elements as el
from .cells import pairs_within
from .graphs import FRAME, closure, components
from .staging import staged


def candidate_edges(atoms: DataFrame, box, unit: float = 1.0, excluded: Iterable[str] = el.EXCLUDED, forbidden: DataFrame | None = None, search: float = el.SEARCH_SCALE, bond: float = el.BOND_SCALE) -> DataFrame:
    """Directed edges ``src -> dst`` with ``d2``: dst lies in the search radius of src and the pair is close enough for a bond.

    The search radius belongs to the source, so an edge may have one direction only.  ``unit`` is the number
    of coordinate units in an angstrom; ``forbidden`` has unordered pairs ``a, b`` of atoms that never bond.
    """
    known = el.elements(atoms.sparkSession).select("sym", "r_vdw", "r_cov")  # some 120 rows
    rows = atoms.where(~F.col("sym").isin(list(excluded))).select(*FRAME, "atom", "sym", *AXES, *box_columns(box)).join(F.broadcast(known), "sym", "left")
    rows = rows.withColumns({"r_vdw": F.coalesce("r_vdw", F.lit(0.0)), "r_cov": F.coalesce("r_cov", F.lit(0.0))})
    widest = float(rows.agg(F.max("r_vdw")).first()[0] or 0.0) * search * unit  # one number: the radius that cells need
    if widest <= 0:
        widest = unit
    near = pairs_within(rows, rows, int(widest) + 1 if unit > 1 else widest, box, FRAME)
    d2 = F.col("d2").cast("double")
    reach, length = F.col("a_r_vdw") * search * unit, (F.col("a_r_cov") + F.col("b_r_cov")) * bond * unit
    edges = near.where((F.col("a_atom") != F.col("b_atom")) & (d2 > 0) & (d2 < length * length) & (d2 <= reach * reach))
    out = edges.select(*FRAME, F.col("a_atom").alias("src"), F.col("b_atom").alias("dst"), F.col("a_sym").alias("src_sym"), F.col("b_sym").alias("dst_sym"), "d2")
    if forbidden is not None:
        pairs = forbidden.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
        out = out.join(pairs, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left_anti")
    return out


def seeds(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``traj, frame, atom, seed``: the smallest atom that reaches each along directed edges.

    Atoms joined both ways reach each other, so these pairs are contracted to components first.  What is left is the few edges of
    one direction between components; their closure is made by doubling paths, and each component takes the smallest that reaches it.
    """
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    ways = staged(edges.groupBy(*FRAME, pair.alias("p")).agg(F.count_if(F.col("src") < F.col("dst")).alias("up"), F.count_if(F.col("src") > F.col("dst")).alias("down")).select(*FRAME, "p.a", "p.b", "up", "down"), "ways")
    both = ways.where("up > 0 and down > 0").select(*FRAME, F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(atoms, both)
    single = ways.where("(up > 0) <> (down > 0)")
    if single.isEmpty():
        return comp.withColumnRenamed("comp", "seed")
    comp = staged(comp, "mutual")
    single = single.select(*FRAME, F.when(F.col("up") > 0, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("up") > 0, F.col("b")).otherwise(F.col("a")).alias("dst"))
    end = lambda c: comp.select(*FRAME, F.col("atom").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = single.join(end("src"), [*FRAME, "src"]).join(end("dst"), [*FRAME, "dst"]).select(*FRAME, F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")).where("src <> dst")
    least = closure(between).groupBy(*FRAME, F.col("dst").alias("comp")).agg(F.min("src").alias("least"))
    return comp.join(least, [*FRAME, "comp"], "left").select(*FRAME, "atom", F.least("comp", F.coalesce("least", "comp")).alias("seed"))


def molecules(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``traj, frame, atom, sym, seed, mol``: molecules are numbered from 0 by their seeds."""
    num = W.partitionBy(*FRAME).orderBy("seed")
    return atoms.select(*FRAME, "atom", "sym").join(seeds(atoms, edges), [*FRAME, "atom"]).withColumn("mol", F.dense_rank().over(num) - 1)


def bonds(edges: DataFrame, mols: DataFrame) -> DataFrame:
    """Unordered pairs ``a < b`` of one molecule with an edge in either direction: ``traj, frame, mol, a, b, a_sym, b_sym, d2``."""
    fwd = F.col("src") < F.col("dst")
    pairs = edges.select(*FRAME, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(fwd, F.col("src_sym")).otherwise(F.col("dst_sym")).alias("a_sym"), F.when(fwd, F.col("dst_sym")).otherwise(F.col("src_sym")).alias("b_sym"), "d2").distinct()
    own = mols.select(*FRAME, "atom", "mol")
    return pairs.join(own.withColumnRenamed("atom", "a"), [*FRAME, "a"]).join(own.select(*FRAME, F.col("atom").alias("b"), F.col("mol").alias("_m")), [*FRAME, "b"]).where("mol = _m").drop("_m")


def formulas(mols: DataFrame) -> DataFrame:
    """``traj, frame, mol, formula, n_atoms``: elements in alphabetical order, a count of 1 left out."""
    n = mols.groupBy(*FRAME, "mol", "sym").agg(F.count("*").alias("n"))
    part = F.struct("sym", F.concat("sym", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise("")).alias("p"))
    return n.groupBy(*FRAME, "mol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s.p), "").alias("formula"), F.sum("n").alias("n_atoms"))


def bond_types(bond: DataFrame) -> DataFrame:
    """``traj, frame, mol, types``: sorted element pairs of a molecule's bonds, with repeats."""
    pair = F.concat_ws("-", F.least("a_sym", "b_sym"), F.greatest("a_sym", "b_sym"))
    return bond.groupBy(*FRAME, "mol").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("types"))


def graph_hashes(mols: DataFrame, bond: DataFrame, rounds: int = 3, element: bool = True) -> DataFrame:
    """``traj, frame, mol, hash``: refinement of atom labels by those of the neighbours, then one digest per molecule."""
    both = bond.select(*FRAME, F.col("a").alias("atom"), F.col("b").alias("nbr")).union(bond.select(*FRAME, "b", "a"))
    start = F.col("sym") if element else F.lit("")  # then the first round tells atoms apart by their degree
    now = mols.select(*FRAME, "mol", "atom", start.alias("lab"))
    for _ in range(rounds):
        near = both.join(now.select(*FRAME, F.col("atom").alias("nbr"), F.col("lab").alias("nl")), [*FRAME, "nbr"]).groupBy(*FRAME, "atom").agg(F.array_join(F.array_sort(F.collect_list("nl")), ",").alias("ns"))
        now = now.join(near, [*FRAME, "atom"], "left").select(*FRAME, "mol", "atom", F.md5(F.concat("lab", F.lit("|"), F.coalesce("ns", F.lit(""))).cast("binary")).alias("lab"))
    return now.groupBy(*FRAME, "mol").agg(F.md5(F.array_join(F.array_sort(F.collect_list("lab")), ",").cast("binary")).alias("hash"))


def classified(mols: DataFrame, bond: DataFrame) -> DataFrame:
    """``traj, frame, mol, formula, n_atoms, types, hash`` of every molecule."""
    every = formulas(mols).join(bond_types(bond), [*FRAME, "mol"], "left").join(graph_hashes(mols, bond), [*FRAME, "mol"])
    return every.withColumn("types", F.coalesce("types", F.lit("")))


def compounds(mols: DataFrame, bond: DataFrame) -> DataFrame:
    """``traj, frame, comp, formula, types, hash, n_members``, numbered from 0 in order of formula, bond types and hash."""
    kinds = classified(mols, bond).groupBy(*FRAME, "formula", "types", "hash").agg(F.count("*").alias("n_members"))
    return kinds.withColumn("comp", (F.row_number().over(W.partitionBy(*FRAME).orderBy("formula", "types", "hash")) - 1).cast("int"))


def bond_lengths(bond: DataFrame) -> DataFrame:
    """Root mean square length by pair of elements: ``pair, length, n``."""
    pair = F.concat_ws("-", F.least("a_sym", "b_sym"), F.greatest("a_sym", "b_sym"))
    return bond.groupBy(pair.alias("pair")).agg(F.sqrt(F.avg("d2")).alias("length"), F.count("*").alias("n"))


NUMBER = {s: z for s, *_, z in el.rows() if z}


def extended_connectivity(syms: list[str], near: list[list[int]]) -> list[str]:
    """Labels of a molecule's atoms: element plus rank in falling extended connectivity, ties by the earlier atom.

    Connectivity begins at 10 Z + degree and becomes 5 times itself plus the neighbours' until all differ or
    the number of different values no longer changes.
    """
    ec = [10 * NUMBER.get(s, 0) + len(n) for s, n in zip(syms, near, strict=True)]
    kinds = len(set(ec))
    while kinds < len(ec):
        ec = [5 * x + sum(ec[j] for j in n) for x, n in zip(ec, near, strict=True)]
        before, kinds = kinds, len(set(ec))
        if kinds == before:
            break
    rank: dict[str, int] = {}
    labels = [""] * len(ec)
    for i in sorted(range(len(ec)), key=lambda i: -ec[i]):
        rank[syms[i]] = rank.get(syms[i], 0) + 1
        labels[i] = f"{syms[i]}{rank[syms[i]]}"
    return labels


def connectivity_labels(mols: DataFrame, bond: DataFrame) -> DataFrame:
    """``traj, frame, mol, atom, label`` by ``extended_connectivity``, one molecule at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                place = {a["atom"]: i for i, a in enumerate(r.atoms)}
                near: list[list[int]] = [[] for _ in place]
                for e in r.bonds if r.bonds is not None else ():
                    near[place[e["a"]]].append(place[e["b"]])
                    near[place[e["b"]]].append(place[e["a"]])
                labels = extended_connectivity([a["sym"] for a in r.atoms], near)
                out += [(r.traj, r.frame, r.mol, a, x) for a, x in zip(place, labels, strict=True)]
            yield pd.DataFrame(out, columns=["traj", "frame", "mol", "atom", "label"])

    atoms = mols.groupBy(*FRAME, "mol").agg(F.sort_array(F.collect_list(F.struct("atom", "sym"))).alias("atoms"))
    edges = bond.groupBy(*FRAME, "mol").agg(F.collect_list(F.struct("a", "b")).alias("bonds"))
    rows = atoms.join(edges, [*FRAME, "mol"], "left").select(*FRAME, "mol", "atoms", "bonds")
    return rows.mapInPandas(run, "traj string, frame long, mol long, atom long, label string")


def centres_of_mass(atoms: DataFrame, box, unit: float = 1.0, mol: str = "mol") -> DataFrame:
    """``traj, frame, mol, cx, cy, cz``: mass-weighted, each atom taken at its image within half a box of the molecule's first atom."""
    mass = el.elements(atoms.sparkSession).select("sym", "mass")
    first = W.partitionBy(*FRAME, mol).orderBy("atom")
    rows = atoms.join(F.broadcast(mass), "sym")
    out = []
    for k in AXES:
        d, length = F.col(k) - F.first(k).over(first), length_of(box, k)
        rows = rows.withColumn(f"_{k}", F.col(k) - F.when(d > length / 2, length).when(d < -length / 2, -length).otherwise(0))
        whole = F.first(length) / unit if box_columns(box) else F.lit(length / unit)
        out.append(F.pmod(F.sum(F.col("mass") * F.col(f"_{k}")) / F.sum("mass") / unit, whole).alias(f"c{k}"))
    return rows.groupBy(*FRAME, mol).agg(*out)
