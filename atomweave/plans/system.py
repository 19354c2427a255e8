"""A trajectory with its topology: what the analyses work on."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.geometry import any_label
from ..operators import compounds as cp
from ..operators.staging import staged
from ..operators.topology import FRAME
from .analyses import one_box


@dataclass(frozen=True)
class Chosen:
    """Atoms of some compounds whose label fits one of the patterns."""

    keys: tuple[str, ...]
    labels: tuple[str, ...]

    def of(self, atoms: DataFrame) -> DataFrame:
        return atoms.where(self.fits())

    def fits(self) -> Column:
        return F.col("key").isin(list(self.keys)) & any_label(F.col("label"), list(self.labels))


def processed_frames(present: list[tuple[int, bool]], start: int = 1, nframes: int = -1, stride: int = 1) -> list[int]:
    """The frames that are worked on, of ``(frame, present)`` in order.

    A frame without what is asked for is passed by one step of its own, which counts as read; every other one is followed by
    a step of ``stride``.  Reading ends when exactly ``nframes`` have been read, or at the end.
    """
    out, i, left = [], start - 1, nframes
    while i < len(present) and left != 0:
        frame, ok = present[i]
        step = stride if ok else 1
        if ok:
            out.append(frame)
        i, left = i + step, left - step
    return out


@dataclass
class System:
    """Atoms ``traj, frame, atom, sym, x, y, z`` in a periodic box, and the topology of one frame for all of them.

    With ``own_boxes`` every frame has a box of its own, in the columns ``lx, ly, lz`` of the atoms; ``box`` is then that of the topology's
    frame, which volumes and axes go by.
    """

    atoms: DataFrame
    box: tuple
    config: EngineConfig = field(default_factory=EngineConfig)
    unit: float = 1.0
    topology_frame: int = 0
    forbidden: DataFrame | None = None
    own_boxes: bool = False

    @property
    def lengths(self) -> tuple:
        """What distances go by: the box, or the columns that have each frame's."""
        return ("lx", "ly", "lz") if self.own_boxes else self.box

    def __post_init__(self):
        if min(self.box) <= 0:
            raise ValueError("a periodic box needs positive lengths")

    @cached_property
    def topology(self) -> cp.Topology:
        """That of the chosen frame; its tables are written once."""
        found = cp.recognise(self.atoms.where(F.col("frame") == self.topology_frame), self.lengths, self.config, self.forbidden, self.unit)
        return cp.Topology(staged(found.members, "members"), staged(found.bonds, "bonds"))

    @cached_property
    def compounds(self) -> list:
        """Rows ``comp, key, formula, n_members`` in order; kinds of molecules, not molecules."""
        return self.topology.compounds().select("comp", "key", "formula", "n_members").orderBy("comp").collect()

    def without_bonds(self, breaks: Iterable[tuple[int, str, str]]) -> System:
        """Recognised anew with the bonds between two labels of a compound forbidden in all its members; earlier ones stay forbidden."""
        more = self.topology.broken(breaks)
        forbidden = staged(more if self.forbidden is None else more.union(self.forbidden).distinct(), "forbidden")
        return System(self.atoms, self.box, self.config, self.unit, self.topology_frame, forbidden, self.own_boxes)

    def at_frame(self, frame: int) -> System:
        """With the topology of another frame."""
        box = one_box(self.atoms.where(F.col("frame") == frame), self.lengths)
        return System(self.atoms, box, self.config, self.unit, frame, self.forbidden, self.own_boxes)

    def choose(self, compounds, labels) -> Chosen:
        """Compounds by their numbers from 1, as listed in ``compounds``; labels as a list or with commas."""
        numbers = [compounds] if isinstance(compounds, int) else list(compounds)
        keys = []
        for n in numbers:
            if not 1 <= n <= len(self.compounds):
                raise ValueError(f"there is no compound {n}")
            keys.append(self.compounds[n - 1].key)
        patterns = labels.split(",") if isinstance(labels, str) else labels
        return Chosen(tuple(keys), tuple(p.strip() for p in patterns if p.strip()))

    def table(self, start: int = 1, nframes: int = -1, stride: int = 1, update: bool = False, needed: Iterable[Chosen] = (), together: bool = True) -> DataFrame:
        """Atoms of the processed frames with ``mol, comp, key, formula, label``.

        With ``update`` the topology is that of each frame, and frames that lack one of the ``needed`` choices' compounds (all of them,
        without ``together``) are passed over; else it is that of the topology frame, in all frames.
        """
        if not update:
            frames = [(r.frame, True) for r in self.atoms.select("frame").distinct().orderBy("frame").collect()]  # frame numbers
            return cp.static(self.topology, self._of_frames(self.atoms, processed_frames(frames, start, nframes, stride)))
        named = staged(cp.dynamic(cp.recognise(self.atoms, self.lengths, self.config, self.forbidden, self.unit), self.atoms), "dynamic")
        flags = [F.max(F.col("key").isin(list(c.keys))) for c in needed]
        ok = F.lit(True)
        for n, f in enumerate(flags):
            ok = f if n == 0 else (ok & f if together else ok | f)
        frames = [(r.frame, r.ok) for r in named.groupBy("frame").agg(ok.alias("ok") if flags else F.lit(True).alias("ok")).orderBy("frame").collect()]
        return self._of_frames(named, processed_frames(frames, start, nframes, stride))

    @staticmethod
    def _of_frames(atoms: DataFrame, frames: list[int]) -> DataFrame:
        chosen = atoms.sparkSession.createDataFrame([(f,) for f in frames], "frame long")
        return atoms.join(chosen, "frame", "left_semi")


__all__ = ["FRAME", "Chosen", "System", "processed_frames"]
