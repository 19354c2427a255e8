"""Histograms as aggregations over bins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """Uniform bins of [low, high]."""

    low: float
    high: float
    n: int

    def __post_init__(self):
        if self.n < 1 or not self.high > self.low:
            raise ValueError("at least one bin of positive width is needed")

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.n

    def centre(self, bin_col: Column) -> Column:
        return F.lit(self.low) + (bin_col + 0.5) * F.lit(self.width)

    def place(self, v: Column) -> Column:
        return (v - F.lit(self.low)) / F.lit(self.width)


def simple_bin(v: Column, bins: Bins) -> Column:
    """Half-open bins, the last one closed; null outside and for NaN."""
    inside = (v >= bins.low) & (v <= bins.high) & ~F.isnan(v.cast("double"))
    return F.when(inside, F.least(F.floor(bins.place(v)).cast("int"), F.lit(bins.n - 1)))


def simple(df: DataFrame, value: str, bins: Bins, by=()) -> DataFrame:
    """``*by, bin, count``; empty bins are absent."""
    return df.withColumn("bin", simple_bin(F.col(value), bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("count"))


def linear(df: DataFrame, value: str, bins: Bins, by=()) -> DataFrame:
    """``*by, bin, weight``: a value's weight is shared by the bin it lies in and the next, by its distance from their left edges.

    A share that falls outside is lost, so the highest edge itself counts nowhere and a value less than
    a width below the lowest edge leaks into the first bin.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, bins.place(v).alias("_u")).where((F.col("_u") > -1) & (F.col("_u") < bins.n))
    lo = F.floor("_u").cast("int")
    sums = rows.groupBy(*by, lo.alias("_lo")).agg(F.sum(F.lit(1.0) - (F.col("_u") - F.floor("_u"))).alias("_own"), F.sum(F.col("_u") - F.floor("_u")).alias("_next"))  # a row per bin
    parts = F.array(F.struct(F.col("_lo").alias("bin"), F.col("_own").alias("w")), F.struct((F.col("_lo") + 1).alias("bin"), F.col("_next").alias("w")))
    out = sums.select(*by, F.explode(parts).alias("p")).select(*by, "p.bin", "p.w")
    return out.where((F.col("bin") >= 0) & (F.col("bin") < bins.n)).groupBy(*by, "bin").agg(F.sum("w").alias("weight"))


def simple2(df: DataFrame, first: str, second: str, one: Bins, two: Bins) -> DataFrame:
    """``bin1, bin2, count``."""
    rows = df.select(simple_bin(F.col(first), one).alias("bin1"), simple_bin(F.col(second), two).alias("bin2"))
    return rows.where("bin1 is not null and bin2 is not null").groupBy("bin1", "bin2").agg(F.count("*").alias("count"))


def dense(hist: DataFrame, bins: Bins, field: str) -> DataFrame:
    """All bins, with 0 where there was nothing."""
    spine = hist.sparkSession.range(bins.n).select(F.col("id").cast("int").alias("bin"))
    return spine.join(hist, "bin", "left").select("bin", F.coalesce(F.col(field).cast("double"), F.lit(0.0)).alias(field))


def to_total(hist: DataFrame, field: str, total: float = 1.0, by=()) -> DataFrame:
    """Scaled to a sum; an empty histogram stays as it is."""
    s = F.sum(field).over(W.partitionBy(*by))
    return hist.withColumn(field, F.when(s > 0, F.col(field) * F.lit(float(total)) / s).otherwise(F.col(field)))


def to_volume(hist: DataFrame, field: str, widths: list[float], box_volume: float = 1.0) -> DataFrame:
    return hist.withColumn(field, F.col(field) / F.lit(math.prod(widths) * box_volume))
