"""Command line: ``python -m atomweave.cli TRAJECTORY [-i INPUT] [-l LOG] [-o FOLDER]``.

The input file is a JSON object, or recorded answers: lines that begin with ``#`` are the questions, every other line is an answer,
a blank one takes the default.  Without a file the questions are asked.  All questions and answers go to the log, which can
be given as the input again.  Questions come in this order: the box (XYZ files), the frame of the topology, the bonds to break
(``compound label label``, commas between them), whether the compounds are drawn, the analysis, and its parameters.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession

from .config import EngineConfig
from .plans import jobs
from .plans.system import System
from .sources.sinks import SINKS, compound_drawings, compound_lines
from .sources.trajectories import format_of, open_trajectory


class Answers:
    """Answers by name or in order, asked for where there are none; what was answered is logged."""

    def __init__(self, path: str | None, log: str | None, ask: Callable[[str], str] = input):
        self.named, self.lines, self.ask = {}, None, ask
        self.log = open(log, "w", buffering=1, encoding="utf-8") if log else None  # noqa: SIM115
        if path:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            if text.lstrip().startswith("{"):
                self.named = json.loads(text)
                self.lines = []
            else:
                self.lines = [x for x in text.splitlines() if not x.startswith("#")]

    def get(self, name: str, default=None, check: Callable = lambda v: v):
        """The checked answer: a value from JSON, else text; the default if it is blank.  What is wrong is asked for again, unless it comes from a file."""
        while True:
            if name in self.named:
                value = self.named[name]
            elif self.named:
                value = ""
            elif self.lines is not None:
                value = self.lines.pop(0).strip() if self.lines else ""
            else:
                value = self.ask(f"{name} [{default}] ").strip()
            try:
                if value == "" and default is None:
                    raise ValueError(f"{name} needs an answer")
                out = check(default if value == "" else value)
                break
            except ValueError as wrong:
                if self.lines is not None:
                    raise
                print(wrong)
        if self.log:
            self.log.write(f"# {name} [{default}]\n{value if isinstance(value, str) else json.dumps(value)}\n")
        return out

    def close(self) -> None:
        if self.log:
            self.log.close()


def _lengths(value) -> list[float]:
    out = [float(x) for x in (value.split(",") if isinstance(value, str) else value)]
    if len(out) != 3 or min(out) <= 0:
        raise ValueError("a box has three positive lengths")
    return out


def _breaks(value) -> list[tuple[int, str, str]]:
    if value == "none":
        return []
    parts = [x.split() for x in value.split(",")] if isinstance(value, str) else value
    if any(len(x) != 3 for x in parts):
        raise ValueError("a bond is given by a compound and two labels")
    return [(int(c), a, b) for c, a, b in parts]


def _within(choices) -> Callable:
    def check(value):
        if value not in choices:
            raise ValueError(f"no {value}; there are {', '.join(map(str, choices))}")
        return value

    return check


def _typed(value, default):
    """Text as a value of the default's type."""
    if not isinstance(value, str) or isinstance(default, str):
        return value
    if isinstance(default, bool):
        if value.lower() not in ("y", "n", "yes", "no", "true", "false"):
            raise ValueError(f"yes or no, not {value!r}")
        return value.lower() in ("y", "yes", "true")
    return json.loads(value) if isinstance(default, (list, dict)) else type(default)(value)


def parameters(a: jobs.Analysis, answers: Answers) -> dict:
    given = answers.named.get("parameters")
    if given is not None:
        return given
    out = {}
    for f in fields(a.parameters):
        default = f.default if f.default is not MISSING else f.default_factory()
        out[f.name] = answers.get(f.name, json.dumps(default) if isinstance(default, (list, dict)) else default, lambda v, f=f, d=default: jobs.checked(f, _typed(v, d)))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input) -> list[str]:
    """Run one analysis of a trajectory file; returns the files that were written."""
    parser = argparse.ArgumentParser(description="Analyses of particle trajectories on Spark.")
    parser.add_argument("trajectory")
    parser.add_argument("-i", "--input", help="JSON object or recorded answers")
    parser.add_argument("-l", "--log", default="input.log", help="where the answers are recorded")
    parser.add_argument("-c", "--config", help="JSON file of the bond search's settings")
    parser.add_argument("-o", "--out", default=".", help="folder of the results")
    args = parser.parse_args(argv)
    kind = format_of(args.trajectory)
    spark = spark or SparkSession.builder.appName("atomweave").getOrCreate()
    answers = Answers(args.input, args.log, ask)
    try:
        box = answers.get("box", check=_lengths) if kind == "xyz" else [0.0, 0.0, 0.0]
        found = open_trajectory(spark, args.trajectory, box, kind)
        if not found.frames:
            raise ValueError("the trajectory has no frame")
        own = ["lx", "ly", "lz"] if found.own_boxes else []
        frame = answers.get("topology_frame", 0, lambda v: _within(range(found.frames))(int(v)))
        atoms = found.atoms.select("traj", "frame", "atom", "sym", "x", "y", "z", *own)
        system = System(atoms, found.box, EngineConfig.load(args.config), own_boxes=found.own_boxes).at_frame(frame)
        box = list(system.box)
        breaks = answers.get("break_bonds", "none", _breaks)
        if breaks:
            system = system.without_bonds(breaks)
        print("\n".join(compound_lines(system)))
        os.makedirs(args.out, exist_ok=True)
        if answers.get("draw_compounds", "no", lambda v: _typed(v, False)):
            print("\n".join(f"wrote {f}" for f in compound_drawings(system, args.out)))
        print("\n".join(f"{a.name}: {a.title}" for a in jobs.REGISTRY.values()))
        name = answers.get("analysis", check=_within(jobs.REGISTRY))
        a = jobs.REGISTRY[name]
        q = a.parameters.of(parameters(a, answers))
        files = SINKS[name](a.run(system, q), q, args.out, box)
        print("\n".join(f"wrote {f}" for f in files))
        return files
    finally:
        answers.close()


if __name__ == "__main__":
    main()
