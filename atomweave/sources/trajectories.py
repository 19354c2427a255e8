"""Trajectory files, XYZ and LAMMPS dumps, read by ranges of bytes in parallel; and plain text sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = {".xyz": "xyz", ".lmp": "lammps", ".lammpstrj": "lammps"}
SCHEMA = "traj string, frame long, atom long, sym string, x double, y double, z double, lx double, ly double, lz double, timestep long"


def format_of(path: str) -> str:
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"unknown trajectory format: {path}")
    return kind


def _wrap(v: float, length: float) -> float:
    if not length:
        return v
    w = v % length
    return 0.0 if w >= length else w


def xyz_frame(lines: list[str], box) -> Iterator[tuple]:
    for n, line in enumerate(lines):
        t = line.split()
        if len(t) < 4:
            raise ValueError(f"an atom line needs four columns: {line!r}")
        yield (n, t[0].capitalize(), *[_wrap(float(v), length) for v, length in zip(t[1:4], box, strict=True)])


def dump_frame(columns: list[str], lines: list[str], box) -> Iterator[tuple]:
    names = ("xu", "yu", "zu") if {"xu", "yu", "zu"} <= set(columns) else ("x", "y", "z")
    if not set(names) <= set(columns):
        raise ValueError("the dump has neither unwrapped nor plain coordinates")
    if "element" not in columns:
        raise KeyError("element")
    at = [columns.index(c) for c in ("element", *names)]
    for n, line in enumerate(lines):
        t = line.split()
        yield (n, t[at[0]].capitalize(), *[_wrap(float(t[i]), length) for i, length in zip(at[1:], box, strict=True)])


def _read(f, kind: str, box):
    """The next frame: (timestep, box, atoms), or None at the end of what can be read."""
    if kind == "xyz":
        head = f.readline().decode()
        try:
            n = int(head)
        except ValueError:
            return None
        f.readline()
        return None, box, ("xyz", [f.readline().decode() for _ in range(n)])
    step = n = bounds = None
    while True:
        line = f.readline().decode()
        if not line.strip():
            return None
        if line.startswith("ITEM: TIMESTEP"):
            step = int(f.readline())
        elif line.startswith("ITEM: NUMBER OF ATOMS"):
            n = int(f.readline())
        elif line.startswith("ITEM: BOX BOUNDS"):
            bounds = []
            for _ in range(3):
                low, high = map(float, f.readline().split()[:2])
                bounds.append(high - low)
        elif line.startswith("ITEM: ATOMS"):
            return step, bounds, (line.split()[2:], [f.readline().decode() for _ in range(n)])


#: Bytes of a file that one task looks through.
RANGE = 64 << 20


def _open(path: str):
    """A file for reading, on a local or mounted folder or in a store that Arrow knows by its URI; and its size."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
    return fs.open_input_file(at), fs.get_file_info(at).size


class Lines:
    """Lines of a file from any byte on."""

    def __init__(self, path: str):
        self.raw, self.size = _open(path)
        self.buffer, self.at, self.here, self.last = b"", 0, 0, b""

    def seek(self, at: int) -> None:
        self.raw.seek(at)
        self.buffer, self.here, self.at = b"", 0, at

    def tell(self) -> int:
        return self.at

    def readline(self) -> bytes:
        end = self.buffer.find(b"\n", self.here)
        while end < 0:
            more = self.raw.read(1 << 20)
            if not more:
                end = len(self.buffer) - 1
                break
            self.buffer, self.here = self.buffer[self.here :] + more, 0
            end = self.buffer.find(b"\n")
        out = self.buffer[self.here : end + 1]
        self.here, self.at, self.last = end + 1, self.at + len(out), out
        return out

    def before(self, at: int) -> int | None:
        """Where the line before the one at ``at`` begins; None at the file's beginning."""
        back = 4096
        while at:
            self.seek(max(0, at - back))
            part = self.raw.read(at - self.at)
            cut = part.rfind(b"\n", 0, len(part) - 1)
            if cut >= 0 or at <= back:
                return max(0, at - back) + cut + 1
            back *= 16
        return None

    def close(self) -> None:
        self.raw.close()


def _is_head(f: Lines, at: int) -> int | None:
    """Where an XYZ frame that begins at ``at`` ends, or None if none does: a number of atoms, a comment, so many atoms, and another number or the end."""
    f.seek(at)
    try:
        n = int(f.readline())
    except ValueError:
        return None
    f.readline()
    for _ in range(n):
        if len(f.readline().split()) < 4:
            return None
    end = f.tell()
    last = f.readline()
    return end if not last.strip() or last.strip().lstrip(b"+-").isdigit() else None


def first_frame(f: Lines, kind: str, begin: int) -> int:
    """The first byte of the first frame that begins at ``begin`` or later; the file's size if there is none."""
    if not begin:
        return 0
    f.seek(begin - 1)
    f.readline()
    at = f.tell()
    while at < f.size:
        if kind == "xyz":
            end = _is_head(f, at)
            if end is not None:  # unless it is the comment of a frame that begins a line before
                before = f.before(at)
                other = _is_head(f, before) if before is not None else None
                return at if other is None else other
            f.seek(at)
            f.readline()
        elif f.readline().startswith(b"ITEM: TIMESTEP"):
            return at
        at = f.tell()
    return f.size


def frames_from(path: str, kind: str, box, begin: int, end: int) -> Iterator[tuple | None]:
    """The frames that begin in a range of bytes, each as ``_read`` gives it; None last if what follows them is no frame."""
    for _, got in frames_at(path, kind, box, begin, end):
        yield got


def complete_until(path: str, kind: str) -> int:
    """The byte behind the last whole frame of a file that may still be written to; found from its end, without reading what is before."""
    f = Lines(path)
    back = 1 << 20
    try:
        while True:
            at, end, whole = first_frame(f, kind, max(0, f.size - back)), 0, False
            while at < f.size:
                f.seek(at)
                if _read(f, kind, (0.0, 0.0, 0.0)) is None or f.last[-1:] != b"\n":
                    break
                at, whole = f.tell(), True
            end = at
            if whole or back >= f.size:
                return end if whole else 0
            back *= 4
    finally:
        f.close()


def frames_at(path: str, kind: str, box, begin: int, end: int) -> Iterator[tuple[int, tuple | None]]:
    """As ``frames_from``, with the byte at which each frame begins."""
    f = Lines(path)
    try:
        at = first_frame(f, kind, begin)
        while at < min(end, f.size):
            f.seek(at)
            got = _read(f, kind, box)
            yield at, got
            if got is None:
                return
            at = f.tell()
            if end <= at < f.size:  # what follows the last frame of the range
                line = f.readline().strip()
                if not line or kind == "xyz" and not line.lstrip(b"+-").isdigit():
                    yield at, None
    finally:
        f.close()


def frame_table(name: str, frame: int, got: tuple) -> pd.DataFrame:
    """The rows of ``SCHEMA`` of a frame as ``_read`` gives it."""
    step, own, (columns, lines) = got
    atoms = xyz_frame(lines, own) if columns == "xyz" else dump_frame(columns, lines, own)
    out = pd.DataFrame(list(atoms), columns=["atom", "sym", "x", "y", "z"])
    out.insert(0, "traj", name)
    out.insert(1, "frame", frame)
    out[["lx", "ly", "lz"]] = [float(v) for v in own]
    out["timestep"] = pd.array([step] * len(out), dtype="Int64")
    return out


@dataclass
class Trajectory:
    """Atoms of a file, the number of its frames, the box of the first one, and whether others have other boxes (``lx, ly, lz`` of the atoms)."""

    atoms: DataFrame
    frames: int
    box: tuple[float, float, float]
    own_boxes: bool


def read_trajectory(spark: SparkSession, path: str, box=(0.0, 0.0, 0.0), kind: str | None = None, size: int = RANGE) -> DataFrame:
    """The atoms of ``open_trajectory``."""
    return open_trajectory(spark, path, box, kind, size).atoms


def open_trajectory(spark: SparkSession, path: str, box=(0.0, 0.0, 0.0), kind: str | None = None, size: int = RANGE) -> Trajectory:
    """A trajectory file on storage that all executors reach; XYZ needs the box's lengths, dumps bring theirs.

    Ranges of ``size`` bytes are the tasks.  A first pass counts the frames that begin in each, which numbers them, and tells the range
    of their boxes; the driver sees one row per range.  Reading ends at the first line that is no frame's.
    """
    kind, box = kind or format_of(path), [float(v) for v in box]
    f, total = _open(path)
    f.close()
    ranges = [(n, begin, min(begin + size, total)) for n, begin in enumerate(range(0, total, size))]
    names = "n long, begin long, stop long"
    table = spark.createDataFrame(ranges, names).repartition(max(1, len(ranges)), "n")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                k, over, boxes = 0, False, []
                for got in frames_from(path, kind, box, r.begin, r.stop):
                    k, over = k + (got is not None), got is None
                    if got is not None:
                        own = [float(v) for v in got[1]]
                        boxes = boxes or [own, own, own]
                        boxes = [boxes[0], [min(p) for p in zip(boxes[1], own, strict=True)], [max(p) for p in zip(boxes[2], own, strict=True)]]
                out.append((r.n, k, over, boxes))
            yield pd.DataFrame(out, columns=["n", "frames", "over", "boxes"])

    counts = sorted(table.mapInPandas(count, "n long, frames long, over boolean, boxes array<array<double>>").collect(), key=lambda c: c.n)
    first, rows, seen = 0, [], []
    for (n, begin, stop), c in zip(ranges, counts, strict=True):
        rows.append((n, begin, stop, first))
        first += c.frames
        seen += c.boxes
        if c.over:
            break
    name = os.path.basename(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                for k, got in enumerate(frames_from(path, kind, box, r.begin, r.stop)):
                    if got is not None:
                        yield frame_table(name, r.first + k, got)

    atoms = spark.createDataFrame(rows, names + ", first long").repartition(max(1, len(rows)), "n").mapInPandas(read, SCHEMA)
    return Trajectory(atoms, first, tuple(seen[0]) if seen else tuple(box), any(b != seen[0] for b in seen))


def write_dat(df: DataFrame, path: str, headers: list[str], decimals: int = 6) -> None:
    """A finished analysis, which has at most a few thousand rows, as a table of text: first column left, the others right."""
    rows = df.collect()
    with open(path, "w") as f:
        f.write("# " + " ".join(f"{h:>12}" for h in headers) + "\n")
        for r in rows:
            cells = [f"{v:.{decimals}f}" if isinstance(v, float) else str(v) for v in r]
            f.write(f"{cells[0]:<12}" + "".join(f" {c:>12}" for c in cells[1:]) + "\n")


def write_xyz(atoms: DataFrame, path: str) -> None:
    """Atoms of one cluster or frame as XYZ, in order of atom, centred on their mean."""
    rows = sorted(atoms.select("atom", "sym", "x", "y", "z").collect())
    mid = [sum(r[k] for r in rows) / max(1, len(rows)) for k in (2, 3, 4)]
    with open(path, "a") as f:
        f.write(f"{len(rows)}\n\n")
        for r in rows:
            f.write(f"{r.sym} " + " ".join(f"{r[k] - mid[k - 2]:.6f}" for k in (2, 3, 4)) + "\n")
