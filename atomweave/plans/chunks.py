"""Analyses by stretches of frames: what is done stays done, whenever a run is stopped.

A stretch is a unit of work; what it adds to the result is a small table ``part, bin, value``, written to a folder when it is whole.  Sums of these
tables are the result of the frames done.  A later run on the same folder goes on with the stretches that are missing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analyses, jobs
from .system import System

PART = "part string, bin int, value double"


@dataclass
class Progress:
    done: int
    of: int


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def in_chunks(atoms: DataFrame, parts: Callable[[DataFrame], DataFrame], folder: str, key: dict, frames: int = 1000, stop: Callable[[Progress], bool] = lambda p: False) -> tuple[DataFrame, Progress]:
    """``part, bin, value`` summed over the stretches of ``frames`` frames that are done, and how many these are.

    ``stop`` is asked before each stretch, with the progress so far, and ends the run if it is true; so does an interrupt from the keyboard, which
    gives up the stretch at hand.  ``key`` says what is computed: a folder with another key is an error.
    """
    spark = atoms.sparkSession
    low, high = atoms.agg(F.min("frame"), F.max("frame")).first()
    if low is None:
        raise ValueError("there is no frame")
    note = json.dumps(key | {"frames": frames, "low": low}, sort_keys=True, default=str)
    fs, at = _file(spark, f"{folder}/key")
    if fs.exists(at):
        if spark.read.text(f"{folder}/key").first()[0] != note:
            raise ValueError(f"{folder} has parts of something else")
    else:
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{folder}/key")
    n = math.ceil((high - low + 1) / frames)
    there = lambda k: fs.exists(_file(spark, f"{folder}/chunk={k}/_SUCCESS")[1])
    done = [k for k in range(n) if there(k)]
    try:
        for k in [k for k in range(n) if k not in set(done)]:
            if stop(Progress(len(done), n)):
                break
            first = low + k * frames
            own = parts(atoms.where((F.col("frame") >= first) & (F.col("frame") < first + frames)))
            own.coalesce(1).write.mode("overwrite").parquet(f"{folder}/chunk={k}")
            done.append(k)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
    rows = spark.read.schema(PART).parquet(*[f"{folder}/chunk={k}" for k in done]) if done else spark.createDataFrame([], PART)
    return rows.groupBy("part", "bin").agg(F.sum("value").alias("value")), Progress(len(done), n)


def _rdf(s: System, q, run):
    atoms, a, b = q.table(s)
    parts, state = run(atoms, lambda x: analyses.rdf_parts(x, a, b, s.lengths, q.rmax, q.bins, s.unit))
    return {"rdf": analyses.rdf_of(parts, math.prod(s.box) / s.unit**3, q.rmax, q.bins)}, state


def _adf3b(s: System, q, run):
    atoms, c, cuts = q.parts(s)
    parts, state = run(atoms, lambda x: analyses.adf3b_parts(x, *c, s.lengths, *cuts, q.different_molecules, q.bins))
    return {"adf3b": analyses.adf3b_of(parts, q.bins)}, state


def _ncount(s: System, q, run):
    a, obs = s.choose(q.ref_compound, q.ref_labels), [s.choose(n, x) for n, x in zip(q.obs_compounds, q.obs_labels, strict=True)]
    atoms = s.table(**q.frames(), needed=(a, *obs))
    parts, state = run(atoms, lambda x: analyses.ncount_parts(x, a, obs, s.lengths, jobs._scaled(s, q.cutoff), not q.exclude_same_molecule))
    return {"ncount": analyses.ncount_of(parts)}, state


#: Analyses whose results are sums over frames.
CHUNKED = {"rdf": _rdf, "adf3b": _adf3b, "ncount": _ncount}


def run(name: str, system: System, folder: str, given: dict | None = None, frames: int = 1000, stop: Callable[[Progress], bool] = lambda p: False) -> tuple[dict[str, DataFrame], Progress]:
    """The result tables of an analysis, as of ``jobs.run``, over the stretches that are done in ``folder``, and the progress."""
    if name not in CHUNKED:
        raise ValueError(f"{name} can't be run in stretches; {', '.join(CHUNKED)} can")
    q = jobs.REGISTRY[name].parameters.of(given or {})
    key = {"analysis": name, "parameters": vars(q), "box": list(system.box), "topology": system.topology_frame}
    return CHUNKED[name](system, q, lambda atoms, parts: in_chunks(atoms, parts, folder, key, frames, stop))
