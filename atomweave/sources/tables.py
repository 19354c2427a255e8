"""Trajectories made of the driver's tables: integer coordinates in millionths of an angstrom, box 20 angstrom.

Whole numbers make every distance comparison exact in any engine.  Columns: ``traj, frame, atom, sym, label,
mol, x, y, z``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Box length and atoms per frame of the adapters.
L, ATOMS, FRAMES = 20_000_000, 500, 21
BOX = (L, L, L)


def _named(df: DataFrame) -> DataFrame:
    """Labels O1..C3 and molecules of three atoms, by number."""
    sym = F.when(F.col("kind") < 3, "O").when(F.col("kind") < 9, "H").otherwise("C")
    out = df.withColumn("sym", sym).withColumn("label", F.concat("sym", (F.col("atom") % 3 + 1).cast("string"))).withColumn("mol", F.expr("atom div 3"))
    return out.select("traj", "frame", "atom", "sym", "label", "mol", "x", "y", "z")


def vec_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is an atom and 21 triples of its components are its places in 21 frames of 500 atoms."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("kind"), "embedding")
    v = v.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))
    at = lambda k: F.pmod(F.round(F.get("embedding", F.col("t") * 3 + k).cast("double") * 4e7).cast("long"), F.lit(L))
    rows = v.select(F.lit("vec").alias("traj"), (F.expr(f"vec_id div {ATOMS}") * FRAMES + F.col("t")).cast("long").alias("frame"), (F.col("vec_id") % ATOMS).alias("atom"), "kind", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return _named(rows)


def vec_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same atoms as a random walk: one trajectory per 500 vectors, steps of half an angstrom, wrapped."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("kind"), "embedding")
    v = v.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))

    def at(k: int):
        steps = F.expr(f"aggregate(slice(transform(embedding, (e, i) -> if(i % 3 = {k} and i < 63, cast(round(cast(e as double) * if(i < 3, 4e7D, 4e6D)) as bigint), 0L)), 1, 3 * t + 3), 0L, (a, e) -> a + e)")
        return F.pmod(steps, F.lit(L))

    rows = v.select(F.concat(F.lit("w"), F.expr(f"vec_id div {ATOMS}").cast("string")).alias("traj"), F.col("t").cast("long").alias("frame"), (F.col("vec_id") % ATOMS).alias("atom"), "kind", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return _named(rows)


def li_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as atoms: 100 order keys are a frame; atoms are numbered by their columns' order."""
    from pyspark.sql import Window as W

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    li = li.withColumn("frame", F.expr("l_orderkey div 100"))
    num = W.partitionBy("frame").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 3).otherwise(9)
    n = lambda c: F.col(c).cast("long")
    rows = li.select(
        F.lit("li").alias("traj"), "frame", (F.row_number().over(num) - 1).cast("long").alias("atom"), kind.alias("kind"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 7919 % L).alias("x"),
        ((n("l_partkey") * 1299709 + n("l_linenumber") * 15485863) % L).alias("y"),
        ((n("l_suppkey") * 179424673 + n("l_quantity") * 32452843) % L).alias("z"),
    )
    return _named(rows)


_NAMED_SQL = "sym || cast(atom % 3 + 1 as varchar) as label, atom // 3 as mol, x, y, z"
_SYM_SQL = "case when kind < 3 then 'O' when kind < 9 then 'H' else 'C' end as sym"


def _axis(k: int) -> str:
    return f"((cast(round(cast(embedding[3*t+{k + 1}] as double)*4e7) as bigint) % {L}) + {L}) % {L}"


def _walked(k: int) -> str:
    s = f"list_sum(list_transform(range(0, t+1), lambda i: cast(round(cast(embedding[3*i+{k + 1}] as double) * case when i = 0 then 4e7 else 4e6 end) as bigint)))"
    return f"cast((({s} % {L}) + {L}) % {L} as bigint)"


#: The same adapters in DuckDB SQL, to begin a query with.
SQL = {
    "vec_atoms": f"""vec_atoms as materialized (select traj, frame, atom, sym, {_NAMED_SQL} from (select *, {_SYM_SQL} from (
 select 'vec' as traj, (vec_id // {ATOMS}) * {FRAMES} + t as frame, vec_id % {ATOMS} as atom, label as kind, {_axis(0)} as x, {_axis(1)} as y, {_axis(2)} as z
 from (select *, unnest(range({FRAMES})) as t from embeddings))))""",
    "vec_walk": f"""vec_walk as materialized (select traj, frame, atom, sym, {_NAMED_SQL} from (select *, {_SYM_SQL} from (
 select 'w' || cast(vec_id // {ATOMS} as varchar) as traj, cast(t as bigint) as frame, vec_id % {ATOMS} as atom, label as kind, {_walked(0)} as x, {_walked(1)} as y, {_walked(2)} as z
 from (select *, unnest(range({FRAMES})) as t from embeddings))))""",
    "li_atoms": f"""li_atoms as materialized (select traj, frame, atom, sym, {_NAMED_SQL} from (select *, {_SYM_SQL} from (
 select 'li' as traj, l_orderkey // 100 as frame, row_number() over (partition by l_orderkey // 100 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) - 1 as atom,
 case l_returnflag when 'A' then 0 when 'N' then 3 else 9 end as kind, cast(round(l_extendedprice*100) as bigint) * 7919 % {L} as x,
 (l_partkey*1299709 + l_linenumber*15485863) % {L} as y, (l_suppkey*179424673 + cast(l_quantity as bigint)*32452843) % {L} as z from lineitem)))""",
}
