"""Time correlation of sparse 0/1 series, runs, and displacements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.geometry import AXES, length_of, nearest_image


def _lags(df: DataFrame, depth: int) -> DataFrame:
    return df.sparkSession.range(depth).select(F.col("id").cast("int").alias("tau"))


#: Steps that origins are taken from in one go, at least; with so many rows or more a series is transformed.
STEPS, DENSE = 4096, 256


def _blocks(rows: DataFrame, keys: list[str], depth: int, values: list[str]) -> DataFrame:
    """``*keys, points``: the steps of each series in order, in blocks with the ``depth`` steps behind them, so that no group grows with the series.

    A point has ``t``, the values, and ``own``, whether its block is the one it belongs to.
    """
    size = max(STEPS, 4 * depth)
    block = F.floor(F.col("t") / size).cast("long")
    behind = F.col("t") - block * size < depth
    place = F.explode(F.when(behind, F.array(block, block - 1)).otherwise(F.array(block)))
    dealt = rows.withColumn("_own", block).withColumn("_block", place)
    return dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("t", (F.col("_own") == F.col("_block")).alias("own"), *values))).alias("points"))


def _correlated(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Sums of a[t] * b[t + tau] for tau below ``depth``."""
    n = 1 << (len(a) + min(depth, len(a)) - 1).bit_length()
    out = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)[: min(depth, len(a))]
    return np.pad(out, (0, depth - len(out)))


def lag_sums(t: np.ndarray, own: np.ndarray, x: np.ndarray | None, depth: int) -> tuple[np.ndarray, np.ndarray | None]:
    """For tau below ``depth`` the number of pairs of steps tau apart, the first of them own, and the sum of their squared displacements.

    ``t`` rises; ``x`` has a row per step.  Long series without many holes go through transforms, others by shifting.
    """
    if len(t) >= DENSE and t[-1] - t[0] < 8 * len(t):
        at = (t - t[0]).astype(np.int64)
        here, there = np.zeros(int(at[-1]) + 1), np.zeros(int(at[-1]) + 1)
        here[at], there[at] = own, 1.0
        n = np.rint(_correlated(here, there, depth)).astype(np.int64)
        if x is None:
            return n, None
        x = x - x.mean(0)
        square = np.zeros(len(here))
        square[at] = (x * x).sum(1)
        total = _correlated(here * square, there, depth) + _correlated(here, square, depth)
        for k in range(x.shape[1]):
            v = np.zeros(len(here))
            v[at] = x[:, k]
            total -= 2 * _correlated(here * v, v, depth)
        return n, np.where(n > 0, np.maximum(total, 0.0), 0.0)
    n, total = np.zeros(depth, np.int64), None if x is None else np.zeros(depth)
    for j in range(len(t)):
        tau = t[j:] - t[: len(t) - j]
        use = (tau < depth) & own[: len(t) - j]
        if not (tau < depth).any():
            break
        n += np.bincount(tau[use], minlength=depth)
        if x is not None:
            d = x[j:][use] - x[: len(t) - j][use]
            total += np.bincount(tau[use], (d * d).sum(1), minlength=depth)
    return n, total


def _lag_table(rows: DataFrame, keys: list[str], depth: int, values: list[str], by: list[str]) -> DataFrame:
    """``*by, tau, n, total`` of all series, each task handing on a row per lag."""
    blocks = _blocks(rows, keys, depth, values).select(*by, "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) or [()] * b.num_rows
            points = b.column(len(by))
            ends, flat = points.offsets.to_numpy(), points.values
            t, own = flat.field("t").to_numpy(), flat.field("own").to_numpy(zero_copy_only=False)
            x = np.stack([flat.field(v).to_numpy().astype(float) for v in values], 1) if values else None
            for name, i, j in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n, total = lag_sums(t[i:j], own[i:j], None if x is None else x[i:j], depth)
                old = sums.setdefault(name, [np.zeros(depth, np.int64), np.zeros(depth)])
                old[0] += n
                if total is not None:
                    old[1] += total
        out = [(*name, int(tau), int(n[tau]), float(total[tau])) for name, (n, total) in sums.items() for tau in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    fields = StructType([*(blocks.schema[c] for c in by), StructField("tau", IntegerType()), StructField("n", LongType()), StructField("total", DoubleType())])
    arrow = to_arrow_schema(fields)
    return blocks.mapInArrow(run, fields).groupBy(*by, "tau").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def products(presence: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``tau, n``: how often a key is present both at t and at t + tau.  ``presence`` has distinct ``keys, t``."""
    n = _lag_table(presence.select(*keys, F.col("t").cast("long").alias("t")), keys, depth, [], [])
    return _lags(presence, depth).join(n, "tau", "left").select("tau", F.coalesce("n", F.lit(0)).alias("n"))


def intermittent(presence: DataFrame, keys: list[str], frames: int, series: float, depth: int, corrected: bool = False) -> DataFrame:
    """``tau, c``: mean product over ``series`` series and all origins, less the squared mean if corrected, over its value at 0."""
    depth = min(depth, frames)
    c = products(presence, keys, depth).withColumn("c", F.col("n") / (F.lit(float(series)) * (F.lit(frames) - F.col("tau"))))
    if corrected:
        mean = F.max(F.when(F.col("tau") == 0, F.col("n"))).over(W.partitionBy()) / F.lit(float(series) * frames)
        c = c.withColumn("c", F.col("c") - mean * mean)
    zero = F.max(F.when(F.col("tau") == 0, F.col("c"))).over(W.partitionBy())  # depth rows
    return c.select("tau", F.when(zero != 0, F.col("c") / zero).otherwise(F.col("c")).alias("c"))


def runs(presence: DataFrame, keys: list[str]) -> DataFrame:
    """Unbroken runs: ``keys, start, length``."""
    island = F.col("t") - F.row_number().over(W.partitionBy(*keys).orderBy("t"))
    return presence.select(*keys, "t", island.alias("_i")).groupBy(*keys, "_i").agg(F.min("t").alias("start"), F.count("*").alias("length")).drop("_i")


def continuous(presence: DataFrame, keys: list[str], frames: int, depth: int) -> DataFrame:
    """``tau, c``: a run of length l gives l - tau at every tau below l; over the value at 0."""
    depth = min(depth, frames)
    lengths = runs(presence, keys).groupBy("length").agg(F.count("*").alias("runs"))  # at most one row per length
    n = lengths.select("length", "runs", F.explode(F.sequence(F.lit(0), F.least(F.col("length"), F.lit(depth)).cast("int") - 1)).alias("tau")).groupBy("tau").agg(F.sum(F.col("runs") * (F.col("length") - F.col("tau"))).alias("n"))
    c = _lags(presence, depth).join(n, "tau", "left").select("tau", F.coalesce("n", F.lit(0)).cast("double").alias("c"))
    zero = F.max(F.when(F.col("tau") == 0, F.col("c"))).over(W.partitionBy())
    return c.select("tau", F.when(zero != 0, F.col("c") / zero).otherwise(F.col("c")).alias("c"))


def unwrapped(points: DataFrame, keys: list[str], box, time: str = "frame") -> DataFrame:
    """Coordinates followed through the box walls: running sums of nearest-image steps (in the box of the later frame) from the first place."""
    w = W.partitionBy(*keys).orderBy(time)
    rows = points
    for k in AXES:
        rows = rows.withColumn(f"_{k}", F.coalesce(nearest_image(F.col(k) - F.lag(k).over(w), length_of(box, k)), F.col(k)))
    return rows.select(*keys, time, *[F.sum(f"_{k}").over(w.rowsBetween(W.unboundedPreceding, 0)).alias(k) for k in AXES])


def mean_squared_displacement(paths: DataFrame, keys: list[str], depth: int, time: str = "frame", by=()) -> DataFrame:
    """``*by, tau, msd``, tau from 1 below ``depth``, over all keys and origins together."""
    by = list(by)
    rows = paths.select(*keys, *[b for b in by if b not in keys], F.col(time).cast("long").alias("t"), *AXES)
    sums = _lag_table(rows, [*keys, *[b for b in by if b not in keys]], depth, list(AXES), by)
    return sums.where("tau > 0").select(*by, "tau", (F.col("total") / F.col("n")).alias("msd"))
