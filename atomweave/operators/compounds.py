"""Topology as a whole: molecules, their compounds and labels, static or per frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import topology
from .staging import staged
from .topology import FRAME, extended_connectivity


@dataclass
class Topology:
    """``members`` has ``traj, frame, atom, sym, mol, comp, key, formula, label``; compounds are numbered from 1 in order of their keys."""

    members: DataFrame
    bonds: DataFrame

    def compounds(self) -> DataFrame:
        """``traj, frame, comp, key, formula, n_members``."""
        return self.members.groupBy(*FRAME, "comp", "key", "formula").agg(F.count_distinct("mol").alias("n_members"))

    def bond_lengths(self) -> DataFrame:
        """``traj, frame, comp, a_label, b_label, length``: root mean square over all members of a compound."""
        own = self.members.select(*FRAME, "comp", "atom", "label")
        a, b = own.toDF(*FRAME, "comp", "a", "la"), own.select(*FRAME, F.col("atom").alias("b"), F.col("label").alias("lb"))
        rows = self.bonds.join(a, [*FRAME, "a"]).join(b, [*FRAME, "b"])
        return rows.groupBy(*FRAME, "comp", F.least("la", "lb").alias("a_label"), F.greatest("la", "lb").alias("b_label")).agg(F.sqrt(F.avg("d2")).alias("length"))

    def broken(self, breaks: Iterable[tuple[int, str, str]]) -> DataFrame:
        """``a, b``: the atoms of two labels in every member of a compound, as pairs that may not bond."""
        out = None
        for comp, first, second in breaks:
            own = self.members.where(F.col("comp") == comp).select(*FRAME, "mol", "label", "atom")
            a = own.where(F.col("label") == first).select(*FRAME, "mol", F.col("atom").alias("a"))
            pairs = a.join(own.where(F.col("label") == second).select(*FRAME, "mol", F.col("atom").alias("b")), [*FRAME, "mol"]).select("a", "b")
            out = pairs if out is None else out.union(pairs)
        if out is None:
            raise ValueError("no bond to break")
        return out.distinct()


def matching(t_syms: list[str], t_near: list[list[int]], syms: list[str], near: list[list[int]]) -> list[int] | None:
    """For every atom its counterpart in the template, so that elements and bonds agree; the first found, or None.

    Atoms are compared after refinement by their neighbours' kinds, and assigned one after another along bonds.
    """
    if sorted(t_syms) != sorted(syms):
        return None
    kinds = [list(t_syms), list(syms)]
    for _ in range(len(syms)):
        fine = [[(k[i], tuple(sorted(k[j] for j in n[i]))) for i in range(len(k))] for k, n in zip(kinds, (t_near, near), strict=True)]
        names = {x: str(c) for c, x in enumerate(sorted(set(fine[0]) | set(fine[1])))}
        new = [[names[x] for x in f] for f in fine]
        if sorted(new[0]) != sorted(new[1]):
            return None
        done = len(set(new[0])) == len(set(kinds[0]))
        kinds = new
        if done:
            break
    order, seen = [], set()
    for s in range(len(syms)):  # every atom after one it is bonded to, where there is one
        todo = [s] if s not in seen else []
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                order.append(i)
                todo.extend(sorted(near[i], reverse=True))
    to: dict[int, int] = {}
    used: set[int] = set()
    bonded, t_bonded = [set(n) for n in near], [set(n) for n in t_near]

    def fits(i: int, c: int) -> bool:
        return c not in used and kinds[0][c] == kinds[1][i] and all((j in bonded[i]) == (to[j] in t_bonded[c]) for j in to)

    choices = [iter(range(len(syms)))]
    while choices:
        i = order[len(choices) - 1]
        if i in to:
            used.discard(to.pop(i))
        c = next((c for c in choices[-1] if fits(i, c)), None)
        if c is None:
            choices.pop()
            continue
        to[i] = c
        used.add(c)
        if len(to) == len(syms):
            return [to[k] for k in range(len(syms))]
        choices.append(iter(range(len(syms))))
    return None


def _neighbours(atoms: list[int], bonds) -> list[list[int]]:
    place = {a: i for i, a in enumerate(atoms)}
    near: list[list[int]] = [[] for _ in atoms]
    for b in bonds if bonds is not None else ():
        near[place[b["a"]]].append(place[b["b"]])
        near[place[b["b"]]].append(place[b["a"]])
    return near


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            atoms, syms = [a["atom"] for a in r.atoms], [a["sym"] for a in r.atoms]
            near = _neighbours(atoms, r.bonds)
            labels = extended_connectivity(syms, near)
            if r.t_mol != r.mol:
                t_syms = [a["sym"] for a in r.t_atoms]
                t_near = _neighbours([a["atom"] for a in r.t_atoms], r.t_bonds)
                to = matching(t_syms, t_near, syms, near)
                if to is not None:
                    own = extended_connectivity(t_syms, t_near)
                    labels = [own[k] for k in to]
            out += [(r.traj, r.frame, a, x) for a, x in zip(atoms, labels, strict=True)]
        yield pd.DataFrame(out, columns=["traj", "frame", "atom", "label"])


def compound_labels(mols: DataFrame, bond: DataFrame) -> DataFrame:
    """``traj, frame, atom, label``: the labels of a compound's first molecule, carried to the others by matching their bonds.

    ``mols`` has ``traj, frame, mol, comp, atom, sym``.  One molecule and its template are worked on at a time.
    """
    atoms = mols.groupBy(*FRAME, "comp", "mol").agg(F.sort_array(F.collect_list(F.struct("atom", "sym"))).alias("atoms"))
    rows = atoms.join(bond.groupBy(*FRAME, "mol").agg(F.collect_list(F.struct("a", "b")).alias("bonds")), [*FRAME, "mol"], "left")
    first = rows.groupBy(*FRAME, "comp").agg(F.min_by(F.struct("mol", "atoms", "bonds"), "mol").alias("t"))
    both = rows.join(first, [*FRAME, "comp"]).select("traj", "frame", "mol", "atoms", "bonds", F.col("t.mol").alias("t_mol"), F.col("t.atoms").alias("t_atoms"), F.col("t.bonds").alias("t_bonds"))
    return both.mapInPandas(_labelled, "traj string, frame long, atom long, label string")


def recognise(atoms: DataFrame, box, config: EngineConfig | None = None, forbidden: DataFrame | None = None, unit: float = 1.0) -> Topology:
    """Molecules, compounds and labels of every frame by itself."""
    c = config or EngineConfig()
    edges = staged(topology.candidate_edges(atoms, box, unit, c.excluded, forbidden, c.search, c.bond), "edges")
    mols = staged(topology.molecules(atoms, edges), "molecules")
    bond = staged(topology.bonds(edges, mols), "bonds")
    kinds = topology.classified(mols, bond)
    order = W.partitionBy(*FRAME).orderBy("formula", "types", "hash")
    kinds = kinds.select(*FRAME, "mol", "formula", F.dense_rank().over(order).alias("comp"), F.concat_ws("|", "formula", "types", "hash").alias("key"))
    named = mols.join(kinds, [*FRAME, "mol"])
    members = named.join(compound_labels(named, bond), [*FRAME, "atom"]).select(*FRAME, "atom", "sym", "mol", "comp", "key", "formula", "label")
    return Topology(members, bond)


def static(topo: Topology, atoms: DataFrame) -> DataFrame:
    """Atoms of all frames with the molecules, compounds and labels of the one frame that ``topo`` is of."""
    return atoms.join(topo.members.select("traj", "atom", "mol", "comp", "key", "formula", "label"), ["traj", "atom"])


def dynamic(topo: Topology, atoms: DataFrame) -> DataFrame:
    """Atoms with the topology of their own frame."""
    return atoms.join(topo.members.select(*FRAME, "atom", "mol", "comp", "key", "formula", "label"), [*FRAME, "atom"])
