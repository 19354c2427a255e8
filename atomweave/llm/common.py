"""Helpers shared by the operators: staged tables, connected components, bounded vocabularies."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, at = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)]


def removed(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    The shuffle files of the write go as soon as the table is whole.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = fresh_path(spark, name), df.sparkSession.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        fs, at = _hadoop(t.sparkSession, t._staged_at)
        fs.delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given as pairs of longs.

    Returns ``(node, component)`` for every node that has a link to another node; ``component`` is
    the smallest node reachable.  Large-star and small-star steps alternate until the links no
    longer change; each step is two aggregations with map-side partial results and joins whose
    skewed side Spark may split, so a hub never has to fit one task.  Loops and nulls are ignored.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e, seen = staged(e, "links"), None
    while True:
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        before, e = e, staged(small.union(own.select("u", "m")).distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        unstage(before, large)
        if now == seen or not now[0]:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())




#: Stands for a null id on the way through pandas, where a null would turn the whole column into floats.
NULL_ID = -(2**63)


def id_in(name: str) -> Column:
    """The id as a long, ``NULL_ID`` for null.  An id that is no whole number is an error, not a null."""
    c = column(name)
    wrong = F.raise_error(F.lit(f"{name} has to hold whole numbers")).cast("long")
    return F.when(c.isNull(), F.lit(NULL_ID)).otherwise(F.coalesce(c.try_cast("long"), wrong))


def id_out(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(NULL_ID)))


#: Bits of a membership filter: 8 MB at most, whatever the input.  2000 rows of 4 KB bitmaps and what a broadcast keeps with each just fit into
#: 8 MB; of 2048 rows they don't, and as its memory doubles when it is full, driver and executors would hold 16 MB for every filter.
FILTER_BITS = 2000 << 15


def likely_in(df: DataFrame, key: Column, members: DataFrame, member: Column) -> DataFrame:
    """The rows of ``df`` whose key may be among the members' keys; all that are, and few others.

    A bitmap of hashed keys is broadcast, whose size is bounded by ``FILTER_BITS``; with far more members than
    bits it lets everything pass.  It only saves shuffling: a join on the key itself has to follow (an inner one with distinct
    keys: a semi-join would be pushed below the filter).
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS)) + 1
    m = members.select(slot(member).alias("_x"))
    bits = m.groupBy(F.bitmap_bucket_number("_x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits"))
    rows = df.withColumn("_x", slot(key)).withColumn("_bucket", F.bitmap_bucket_number("_x"))
    at = F.bitmap_bit_position("_x")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("_byte >> cast(bitmap_bit_position(_x) % 8 as int) & 1") == 1
    return rows.join(F.broadcast(bits), "_bucket").withColumn("_byte", byte).where(hit).select(*df.columns)


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``weight`` how many rows have it.

    Keys of over one in ``share`` of all rows, at most ``share`` of them, are joined by broadcast, so that no task
    gets a hot key whole; the others by shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * share > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) * share <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


_HELD: dict = {}


def held(name: tuple, make):
    """What a Python worker remembers from task to task for one operator; another operator's goes first, so that caches don't add up."""
    if name not in _HELD:
        release_held()
        _HELD[name] = make()
        trim()
    return _HELD[name]


def release_held() -> None:
    """Give memory back: what is remembered, and what the allocators keep for later."""
    _HELD.clear()
    trim()


def trim() -> None:
    """Give back what the allocators keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Batches for Python hold 4 MB at most (but one row at least), so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark
