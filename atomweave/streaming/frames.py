"""Analyses over streams of frames."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.histograms import Bins, simple_bin
from ..operators.transfers import Carriers


def streaming_histogram(values: DataFrame, value: str, bins: Bins) -> DataFrame:
    """``bin, count`` of a stream; run it in complete or update mode."""
    return values.withColumn("bin", simple_bin(F.col(value), bins)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))


def streaming_transfers(assigned: DataFrame, dwell: int = 2) -> DataFrame:
    """Transfer events of a stream of ``traj, frame, proton, acceptor``: last holder and its stay are kept per proton.

    Frames have to come in order within a proton across batches; within a batch they are sorted.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder, stay = state.get if state.exists else (None, 0)
        out = []
        for b in [pd.concat(list(batches))]:
            for frame, acceptor in b.sort_values("frame")[["frame", "acceptor"]].itertuples(index=False):
                if holder is None or acceptor == holder:
                    holder, stay = acceptor, stay + 1
                    continue
                if stay >= dwell:
                    out.append((key[0], frame, key[1], holder, acceptor))
                holder, stay = acceptor, 1
        state.update((int(holder), int(stay)))
        yield pd.DataFrame(out, columns=["traj", "frame", "proton", "donor", "acceptor"])

    return assigned.groupBy("traj", "proton").applyInPandasWithState(run, "traj string, frame long, proton long, donor long, acceptor long", "holder long, stay int", "append", "NoTimeout")


def streaming_products(presence: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``keys, tau, n``: of a stream of ``keys, t`` (whole numbers or texts), how often a key was there tau steps before as well.

    The last ``depth`` steps of each key are kept.  Sums of ``n`` by ``tau`` are the products of the batch form; steps have to come in
    order across batches, within a batch they are sorted.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        n = dict.fromkeys(range(depth), 0)
        for t in sorted({int(t) for b in batches for t in b["t"]}):
            recent = [u for u in recent if t - u < depth and u != t] + [t]
            for u in recent:
                n[t - u] += 1
        state.update((recent,))
        rows = [(*key, tau, k) for tau, k in n.items() if k]
        yield pd.DataFrame(rows, columns=[*keys, "tau", "n"])

    types = {f.name: f.dataType.simpleString() for f in presence.schema}
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", tau int, n long"
    return presence.groupBy(*keys).applyInPandasWithState(run, out, "recent array<long>", "append", "NoTimeout")


def streaming_charges(assigned: DataFrame, neutral: int) -> DataFrame:
    """``traj, frame, cid, mol, sign`` wherever a carrier is made or moves, from a stream of ``traj, frame, proton, acceptor_mol``.

    The first frame sets the charges: bound protons less the neutral number.  A molecule that held none then has as many negative carriers as that number;
    they come with its first proton, as the stream knows of it from then on.  Frames have to be whole and in order across batches.  The state of a trajectory is its carriers and the last holder of each proton.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carriers, last, seen = pickle.loads(state.get[0]) if state.exists else (None, {}, {})
        rows, out = pd.concat(list(batches)).sort_values(["frame", "proton"]), []
        for frame, own in rows.groupby("frame"):
            holder = dict(zip(own["proton"].tolist(), own["acceptor_mol"].tolist(), strict=True))
            if carriers is None:
                bound = pd.Series(list(holder.values())).value_counts()
                carriers = Carriers({int(m): int(n) - neutral for m, n in bound.items()})
            else:
                for proton, mol in holder.items():
                    if last.get(proton, mol) != mol:
                        if mol not in carriers.charge:
                            carriers.charge[mol] = -neutral
                            for _ in range(neutral):
                                carriers.make(mol, -1)
                        carriers.hop(last[proton], mol)
            last |= holder
            now = dict(carriers.holder)
            out += [(key[0], frame, c, m, carriers.sign[c]) for c, m in sorted(now.items()) if seen.get(c) != m]
            seen = now
        state.update((pickle.dumps((carriers, last, seen)),))
        yield pd.DataFrame(out, columns=["traj", "frame", "cid", "mol", "sign"])

    return assigned.groupBy("traj").applyInPandasWithState(run, "traj string, frame long, cid int, mol long, sign int", "carriers binary", "append", "NoTimeout")
