"""Queries of the trajectory engine over the driver's tables, and the same in DuckDB SQL.

Coordinates are whole millionths of an angstrom, so that all distance decisions are exact on both sides;
floating results are rounded to six places.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.geometry import AXES, label_is, wrap
from .operators import graphs, series, topology, transfers, voronoi
from .operators.cells import nearest, pairs_within
from .operators.histograms import Bins, linear, simple, simple2, to_total, to_volume
from .operators.staging import staged
from .plans import analyses
from .sources.tables import BOX, SQL, L, li_atoms, vec_atoms, vec_walk

U = 1_000_000
FRAME = ["traj", "frame"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, table: str = "vec_atoms"):
    """Registers a query; its SQL begins with the adapter's common table expression."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = f"with recursive {SQL[table]}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
            ORACLE_SQL[f.__name__] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)  # floats, not decimals
        return f

    return add


def r6(c):
    return F.round(c, 6)


def mic(a: str, b: str, axis: str) -> str:
    d = f"({b}.{axis} - {a}.{axis})"
    return f"({d} - {L} * cast(round_even({d} / {L}, 0) as bigint))"


D2 = " + ".join(f"{mic('a', 'b', k)} * {mic('a', 'b', k)}" for k in AXES)


def near(r: float, left: str = "true", right: str = "true", table: str = "vec_atoms", name: str = "pairs", least: float = 0) -> str:
    """A common table expression of pairs within r angstrom."""
    return f"""{name} as materialized (select * from (select a.traj, a.frame, a.atom as a_atom, b.atom as b_atom, a.sym as a_sym, b.sym as b_sym, a.label as a_label, b.label as b_label, a.mol as a_mol, b.mol as b_mol,
 {mic('a', 'b', 'x')} as dx, {mic('a', 'b', 'y')} as dy, {mic('a', 'b', 'z')} as dz, {D2} as d2
 from {table} a join {table} b on a.traj = b.traj and a.frame = b.frame where {left} and {right}) where d2 <= {int(r * U) ** 2} and d2 >= {int(least * U) ** 2})"""


O_A, O_B, H_A, H_B = "a.sym = 'O'", "b.sym = 'O'", "a.sym = 'H'", "b.sym = 'H'"


def linear_sql(source: str, value: str, low: float, high: float, n: int, by: str = "") -> str:
    w = (high - low) / n
    return f"""select {by} bin, sum(w) as weight from (
 select {by} cast(floor(u) as integer) as bin, 1.0 - (u - floor(u)) as w from (select {by} ({value} - {low!r}) / {w!r} as u from {source})
 union all select {by} cast(floor(u) as integer) + 1, u - floor(u) from (select {by} ({value} - {low!r}) / {w!r} as u from {source})
) where bin >= 0 and bin < {n} group by {by} bin"""


def o(df: DataFrame) -> DataFrame:
    return df.where("sym = 'O'")


def h(df: DataFrame) -> DataFrame:
    return df.where("sym = 'H'")


def within(df: DataFrame, left: str, right: str, r: float) -> DataFrame:
    return pairs_within(df.where(f"sym in ({left})"), df.where(f"sym in ({right})"), int(r * U), BOX)


# -- scans, predicates, projections ---------------------------------------------------------------


@query(f"select traj, frame, atom, sym, ((x * 3) % {L} + {L}) % {L} as x, ((y - 30000000) % {L} + {L}) % {L} as y, z from vec_atoms")
def wrap_coords(spark, sf):
    return vec_atoms(spark, sf).select("traj", "frame", "atom", "sym", wrap(F.col("x") * 3, L).alias("x"), wrap(F.col("y") - 30_000_000, L).alias("y"), "z")


@query("select frame, count(*) as n, sum(x) as sx from vec_atoms where frame >= 2 and (frame - 2) % 3 = 0 and frame < 14 group by frame")
def frame_window(spark, sf):
    return analyses.window_frames(vec_atoms(spark, sf), start=3, nframes=12, stride=3).groupBy("frame").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


@query("select label, frame, count(*) as n from vec_atoms where label = 'O1' group by label, frame")
def label_exact(spark, sf):
    return vec_atoms(spark, sf).where(label_is(F.col("label"), "O1")).groupBy("label", "frame").agg(F.count("*").alias("n"))


@query("select label, count(*) as n from vec_atoms where label like 'H%' or label like 'C%' group by label")
def label_prefix(spark, sf):
    return analyses.select(vec_atoms(spark, sf), "H, C").groupBy("label").agg(F.count("*").alias("n"))


# -- joins ----------------------------------------------------------------------------------------


@query(f", {near(1.5, O_A, H_B, 'li_atoms')} select frame, count(*) as n, sum(d2) as s from pairs group by frame", "li_atoms")
def pairs_within_radius(spark, sf):
    return within(li_atoms(spark, sf), "'O'", "'H'", 1.5).groupBy("frame").agg(F.count("*").alias("n"), F.sum("d2").alias("s"))


@query(f", {near(9.0, O_A, O_B)} select frame, a_atom, b_atom, round(sqrt(cast(d2 as double)) / {U}, 6) as d from pairs where d2 > 0")
def min_image_dist(spark, sf):
    p = within(vec_atoms(spark, sf), "'O'", "'O'", 9.0).where("d2 > 0")
    return p.select("frame", "a_atom", "b_atom", r6(F.sqrt(F.col("d2").cast("double")) / U).alias("d"))


@query(f", {near(2.0, O_A)} select frame, a_atom, count(*) as n from pairs where a_atom <> b_atom group by frame, a_atom")
def self_excluded(spark, sf):
    return within(vec_atoms(spark, sf), "'O'", "'O','H','C'", 2.0).where("a_atom <> b_atom").groupBy("frame", "a_atom").agg(F.count("*").alias("n"))


@query(f", {near(2.0, O_A)} select frame, a_mol, count(*) as n from pairs where a_mol <> b_mol group by frame, a_mol")
def same_mol_excluded(spark, sf):
    return within(vec_atoms(spark, sf), "'O'", "'O','H','C'", 2.0).where("a_mol <> b_mol").groupBy("frame", "a_mol").agg(F.count("*").alias("n"))


_NEAREST4 = f""", ranked as (select *, row_number() over (partition by frame, a_atom order by d2, b_atom) as rank from pairs where a_atom <> b_atom)
 select frame, a_atom, b_atom, rank, d2 from ranked where rank <= 4"""


@query(f", {near(18.0, O_A)}{_NEAREST4}")
def nearest4(spark, sf):
    a = vec_atoms(spark, sf)
    return nearest(o(a), a, 4, BOX, int(2.5 * U)).select("frame", "a_atom", "b_atom", F.col("rank").cast("long").alias("rank"), "d2")


@query(f", {near(1.2, H_A, O_B)} select frame, a_atom as proton, arg_min(b_atom, {{'d': d2, 'b': b_atom}}) as acceptor, min(d2) as d2 from pairs group by frame, a_atom")
def nearest1_cutoff(spark, sf):
    a = vec_atoms(spark, sf)
    return transfers.assign_within(h(a), o(a), int(1.2 * U), BOX).select("frame", "proton", "acceptor", "d2")


@query(f", {near(18.0, H_A, O_B)} select frame, a_atom as proton, arg_min(b_atom, {{'d': d2, 'b': b_atom}}) as acceptor, min(d2) as d2 from pairs group by frame, a_atom")
def nearest1_fallback(spark, sf):
    a = vec_atoms(spark, sf)
    return transfers.assign_always(h(a), o(a), int(1.2 * U), BOX).select("frame", "proton", "acceptor", "d2")


ENDS = {"b1": ("r", "O1"), "t1": ("r", "H2"), "b2": ("o", "O1"), "t2": ("o", "H2")}
_V = """vec as (select b.frame, b.mol, {x} as vx, {y} as vy, {z} as vz from vec_atoms a join vec_atoms b on a.traj = b.traj and a.frame = b.frame and a.mol = b.mol where a.label = 'O1' and b.label = 'H2'),
 vv as (select p.frame, p.mol as r_mol, q.mol as o_mol, cast(p.vx*q.vx + p.vy*q.vy + p.vz*q.vz as double) as uv, cast(p.vx*p.vx + p.vy*p.vy + p.vz*p.vz as double) as uu, cast(q.vx*q.vx + q.vy*q.vy + q.vz*q.vz as double) as ww
 from vec p join vec q on p.frame = q.frame and p.mol <> q.mol),
 angles as (select *, degrees(acos(greatest(least(uv / sqrt(uu) / sqrt(ww), 1.0), -1.0))) as angle from vv where uu > 0 and ww > 0)""".format(**{k: mic("a", "b", k) for k in AXES})


@query(f", {_V} select frame, r_mol, o_mol, round(angle, 6) as angle from angles")
def mol_cross_vectors(spark, sf):
    rows = analyses.vector_angle(analyses.molecule_vectors(vec_atoms(spark, sf), ENDS, BOX))
    return rows.select("frame", "r_mol", "o_mol", r6(F.col("angle")).alias("angle"))


# -- histograms -----------------------------------------------------------------------------------


@query("select sym, least(cast(floor(x / 400000.0) as integer), 49) as bin, count(*) as count from li_atoms where x between 0 and 20000000 group by all", "li_atoms")
def hist_simple(spark, sf):
    return simple(li_atoms(spark, sf), "x", Bins(0.0, 2e7, 50), by=("sym",))


@query(f"select bin, round(weight, 6) as weight from ({linear_sql('li_atoms', 'cast(y as double)', 1e6, 1.83e7, 43)})", "li_atoms")
def hist_linear(spark, sf):
    return linear(li_atoms(spark, sf), "y", Bins(1e6, 1.83e7, 43)).select("bin", r6(F.col("weight")).alias("weight"))


@query("select cast(floor(x / 2000000.0) as integer) as bin1, cast(floor(y / 1000000.0) as integer) as bin2, count(*) as count from vec_atoms group by all")
def hist2d(spark, sf):
    return simple2(vec_atoms(spark, sf), "x", "y", Bins(0.0, 2e7, 10), Bins(0.0, 2e7, 20))


@query("select bin, round(100.0 * n / sum(n) over (), 6) as count from (select cast(floor(z / 500000.0) as integer) as bin, count(*) as n from li_atoms group by 1)", "li_atoms")
def hist_norm_total(spark, sf):
    return to_total(simple(li_atoms(spark, sf), "z", Bins(0.0, 2e7, 40)), "count", 100.0).select("bin", r6(F.col("count")).alias("count"))


@query("select bin, round(n / (500000.0 * 8.0), 6) as count from (select cast(floor(z / 500000.0) as integer) as bin, count(*) as n from li_atoms group by 1)", "li_atoms")
def hist_norm_volume(spark, sf):
    return to_volume(simple(li_atoms(spark, sf), "z", Bins(0.0, 2e7, 40)), "count", [500000.0], 8.0).select("bin", r6(F.col("count")).alias("count"))


# -- distributions --------------------------------------------------------------------------------

_RDF_W = 10.0 / 500
_RDF = f""", {near(10.0, O_A, H_B)}, hist as ({linear_sql('(select sqrt(cast(d2 as double)) / 1000000 as d from pairs where d2 > 0)', 'd', 0.0, 10.0, 500)}),
 sizes as (select count(*) as frames, avg(r) as n_ref, avg(o) as n_obs from (select frame, count(*) filter (sym = 'O') as r, count(*) filter (sym = 'H') as o from vec_atoms group by frame) where r > 0 and o > 0),
 full_hist as (select cast(range as integer) as bin, coalesce(weight, 0.0) as weight, {4 / 3 * math.pi!r} * (pow(range * {_RDF_W!r} + {_RDF_W!r}, 3) - pow(range * {_RDF_W!r}, 3)) as shell from range(500) left join hist on bin = range),
 gg as (select bin, shell, n_obs, weight / (shell * n_ref * n_obs * frames / 8000.0) as g from full_hist, sizes)"""


@query(f"{_RDF} select bin, round(0.0 + (bin + 0.5) * {_RDF_W!r}, 6) as r, round(g, 6) as g, round(n_obs / 8000.0 * sum(g * shell) over (order by bin), 6) as n from gg")
def rdf(spark, sf):
    return analyses.rdf(vec_atoms(spark, sf), "O", "H", BOX, unit=U).select("bin", r6(F.col("r")).alias("r"), r6(F.col("g")).alias("g"), r6(F.col("n")).alias("n"))


_BOXED = f"boxed as materialized (select *, {L} + (frame % 3) * 3000000 as lx, {L} + (frame % 2) * 5000000 as ly, {L} + (frame % 5) * 1000000 as lz from vec_atoms)"
_OWN = {k: f"((b.{k} - a.{k}) - a.l{k} * cast(round_even((b.{k} - a.{k}) / cast(a.l{k} as double), 0) as bigint))" for k in AXES}


@query(f""", {_BOXED}, pairs as (select * from (select a.frame, {' + '.join(f'{d} * {d}' for d in _OWN.values())} as d2 from boxed a join boxed b on a.frame = b.frame where {O_A} and {H_B}) where d2 <= {int(10 * U) ** 2}),
 hist as ({linear_sql('(select sqrt(cast(d2 as double)) / 1000000 as d from pairs where d2 > 0)', 'd', 0.0, 10.0, 500)}),
 sizes as (select count(*) as frames, avg(r) as n_ref, avg(o) as n_obs from (select frame, count(*) filter (sym = 'O') as r, count(*) filter (sym = 'H') as o from vec_atoms group by frame) where r > 0 and o > 0),
 full_hist as (select cast(range as integer) as bin, coalesce(weight, 0.0) as weight, {4 / 3 * math.pi!r} * (pow(range * {_RDF_W!r} + {_RDF_W!r}, 3) - pow(range * {_RDF_W!r}, 3)) as shell from range(500) left join hist on bin = range),
 gg as (select bin, shell, n_obs, weight / (shell * n_ref * n_obs * frames / 8000.0) as g from full_hist, sizes)
 select bin, round(0.0 + (bin + 0.5) * {_RDF_W!r}, 6) as r, round(g, 6) as g, round(n_obs / 8000.0 * sum(g * shell) over (order by bin), 6) as n from gg""")
def rdf_boxes(spark, sf):
    """Frames with boxes of their own: distances in these, the volume is the first frame's."""
    wide = lambda k, m, step: (F.lit(L) + F.col("frame") % m * step).alias(k)
    a = vec_atoms(spark, sf).select("*", wide("lx", 3, 3_000_000), wide("ly", 2, 5_000_000), wide("lz", 5, 1_000_000))
    return analyses.rdf(a, "O", "H", ("lx", "ly", "lz"), unit=U).select("bin", r6(F.col("r")).alias("r"), r6(F.col("g")).alias("g"), r6(F.col("n")).alias("n"))


@query(f"{_RDF} select bin, round(n_obs / 8000.0 * sum(g * shell) over (order by bin), 6) as n from gg")
def rdf_integral(spark, sf):
    return analyses.rdf(vec_atoms(spark, sf), "O", "H", BOX, unit=U).select("bin", r6(F.col("n")).alias("n"))


def sine_sql(hist: str, field: str) -> str:
    return f"""select bin, round(angle, 6) as angle, round(v * 18000.0 / sum(v) over (), 6) as value from (select bin, 0.0 + (bin + 0.5) * 1.0 as angle, {field} / sin(radians(0.0 + (bin + 0.5) * 1.0)) as v from ({hist}))"""


def _angle_cols(df):
    return df.select("bin", r6(F.col("angle")).alias("angle"), r6(F.col("value")).alias("value"))


@query(f", {_V} " + sine_sql("select least(cast(floor(angle) as integer), 179) as bin, count(*) as n from angles group by 1", "n"))
def adf(spark, sf):
    return _angle_cols(analyses.adf(vec_atoms(spark, sf), ENDS, BOX))


_TRI = f""", {near(2.0, O_A, H_B)}, tri as (select p.frame, p.a_atom, p.b_atom as n1, q.b_atom as n2, cast(p.dx*q.dx + p.dy*q.dy + p.dz*q.dz as double) as uv, cast(p.d2 as double) as uu, cast(q.d2 as double) as ww
 from pairs p join pairs q on p.frame = q.frame and p.a_atom = q.a_atom and p.b_atom <> q.b_atom and p.b_mol <> q.b_mol where p.d2 > 0 and q.d2 > 0),
 angles as (select *, degrees(acos(greatest(least(uv / sqrt(uu) / sqrt(ww), 1.0), -1.0))) as angle from tri)"""


@query(f"{_TRI} " + sine_sql(linear_sql("angles", "angle", 0.0, 180.0, 180), "weight"))
def adf3b(spark, sf):
    return _angle_cols(analyses.adf3b(vec_atoms(spark, sf), "O", "H", "H", BOX, (0, int(2.0 * U)), (0, int(2.0 * U))))


_SHELL = f"({4 / 3 * math.pi!r} * (pow(0.0 + bin1 * 0.1 + 0.1, 3) - pow(0.0 + bin1 * 0.1, 3)))"


@query(f"""{_TRI}, hist as (select bin1, bin2, count(*) as n from (select least(cast(floor((sqrt(uu) / 1000000 - 0.0) / 0.1) as integer), 19) as bin1, least(cast(floor((angle - 0.0) / 10.0) as integer), 17) as bin2 from angles) group by 1, 2)
 select bin1, bin2, round(0.0 + (bin1 + 0.5) * 0.1, 6) as c1, round(0.0 + (bin2 + 0.5) * 10.0, 6) as c2, round(n / {_SHELL} / sin(radians(0.0 + (bin2 + 0.5) * 10.0)), 6) as value from hist""")
def cdf(spark, sf):
    d = analyses.cdf(vec_atoms(spark, sf), "O", "H", "H", BOX, (0, int(2.0 * U)), (0, int(2.0 * U)), Bins(0.0, 2.0, 20), Bins(0.0, 180.0, 18), U)
    return d.select("bin1", "bin2", *[r6(F.col(c)).alias(c) for c in ("c1", "c2", "value")])


MASS_SQL = "case sym when 'O' then 15.999 when 'H' then 1.008 else 12.011 end"
_COM_AXIS = ", ".join(
    f"(({k}s % 20.0) + 20.0) % 20.0 as c{k}" for k in AXES
)
_COM = ", com as (select traj, frame, mol, " + _COM_AXIS + " from (select traj, frame, mol, " + ", ".join(f"sum(m * s{k}) / sum(m) / 1000000 as {k}s" for k in AXES) + f""" from (
 select *, cast({MASS_SQL} as double) as m, """ + ", ".join(f"{k} - case when {k} - {k}0 > {L // 2} then {L} when {k} - {k}0 < -{L // 2} then -{L} else 0 end as s{k}" for k in AXES) + """ from (
 select *, """ + ", ".join(f"first_value({k}) over (partition by traj, frame, mol order by atom) as {k}0" for k in AXES) + " from vec_atoms)) group by traj, frame, mol))"  # fmt: skip


@query(f"{_COM} select frame, mol, round(cx, 7) as cx, round(cy, 7) as cy, round(cz, 7) as cz from com")
def mol_com(spark, sf):
    c = topology.centres_of_mass(vec_atoms(spark, sf), BOX, U)
    return c.select("frame", "mol", *[F.round(f"c{k}", 7).alias(f"c{k}") for k in AXES])


@query(f"{_COM}, named as (select com.*, case when mol % 2 = 0 then 'even' else 'odd' end as rep from com), hist as ({linear_sql('named', 'cz', 0.0, 20.0, 200, 'rep,')}) select rep, bin, round(0.0 + (bin + 0.5) * 0.1, 6) as r, round(weight / (select count(distinct frame) from vec_atoms), 6) as value from hist")
def density(spark, sf):
    a = vec_atoms(spark, sf)
    kinds = a.select(*FRAME, "mol").distinct().withColumn("rep", F.when(F.col("mol") % 2 == 0, "even").otherwise("odd"))
    return analyses.density(a, kinds, BOX, unit=U).select("rep", "bin", r6(F.col("r")).alias("r"), r6(F.col("value")).alias("value"))


@query(f""", {near(3.5, O_A)}, n as (select frame, a_atom as atom, count(*) as n from pairs where a_atom <> b_atom and a_mol <> b_mol group by 1, 2),
 c as (select coalesce(n.n, 0) as n, count(*) as occurrences from (select frame, atom from vec_atoms where sym = 'O') left join n using (frame, atom) group by 1)
 select n, occurrences, round(occurrences / sum(occurrences) over (), 6) as p from c""")
def ncount(spark, sf):
    return analyses.ncount(vec_atoms(spark, sf), "O", "O,H,C", BOX, int(3.5 * U)).select("n", "occurrences", r6(F.col("p")).alias("p"))


_ORDER = f""", {near(18.0, O_A)}, four as (select * from (select frame, a_atom, dx, dy, dz, sqrt(cast(d2 as double)) as d, row_number() over (partition by frame, a_atom order by d2, b_atom) as rank from pairs where a_atom <> b_atom) where rank <= 4),
 q as (select p.frame, p.a_atom, 1 - 0.375 * sum(pow(cast(p.dx*q.dx + p.dy*q.dy + p.dz*q.dz as double) / p.d / q.d + {1 / 3!r}, 2)) as v from four p join four q on p.frame = q.frame and p.a_atom = q.a_atom and p.rank < q.rank group by 1, 2),
 s as (select frame, a_atom, 1 - {1 / 3!r} * sum((d - m) * (d - m)) / (4 * any_value(m) * any_value(m)) as v from (select *, avg(d) over (partition by frame, a_atom) as m from four) group by 1, 2)"""


def top_sql(field: str, bins: int) -> str:
    return f"{_ORDER} select bin, round(0.0 + (bin + 0.5) * {1.0 / bins!r}, 6) as center, round(weight * 100.0 / sum(weight) over (), 4) as p from ({linear_sql(field, 'v', 0.0, 1.0, bins)})"


def _orders(spark, sf):
    return analyses.tetrahedral(vec_atoms(spark, sf), "O", "O,H,C", BOX, int(2.5 * U))


@query(top_sql("q", 100))
def top_q(spark, sf):
    return analyses.top(_orders(spark, sf), "q", 100).select("bin", r6(F.col("center")).alias("center"), F.round("p", 4).alias("p"))


@query(top_sql("s", 200))
def top_s(spark, sf):
    return analyses.top(_orders(spark, sf), "s", 200).select("bin", r6(F.col("center")).alias("center"), F.round("p", 4).alias("p"))


# -- topology -------------------------------------------------------------------------------------


def _radius(prefix: str, oxygen: float, hydrogen: float, carbon: float) -> str:
    return f"cast(case {prefix}_sym when 'O' then {oxygen} when 'H' then {hydrogen} else {carbon} end as double)"


def _case(prefix: str, column: str) -> str:
    return _radius(prefix, 1.52, 1.10, 1.70) if column == "v" else _radius(prefix, 0.66, 0.32, 0.75)


_TOPO = f""", {near(1.98)}, edges as materialized (select frame, a_atom as src, b_atom as dst, a_sym, b_sym, d2 from pairs where a_atom <> b_atom and d2 > 0
 and cast(d2 as double) < pow(({_case('a', 'c')} + {_case('b', 'c')}) * 1.4 * 1000000, 2) and cast(d2 as double) <= pow({_case('a', 'v')} * 1.164 * 1000000, 2)),
 reach(frame, seed, v) as (select frame, atom, atom from vec_atoms union select reach.frame, reach.seed, edges.dst from reach join edges on edges.frame = reach.frame and edges.src = reach.v),
 mols as materialized (select frame, atom, sym, seed, dense_rank() over (partition by frame order by seed) - 1 as mol from (select frame, v as atom, min(seed) as seed from reach group by 1, 2) join (select frame, atom, sym from vec_atoms) using (frame, atom)),
 bond as materialized (select distinct e.frame, m.mol, least(src, dst) as a, greatest(src, dst) as b, case when src < dst then a_sym else b_sym end as a_sym, case when src < dst then b_sym else a_sym end as b_sym, d2
  from edges e join mols m on m.frame = e.frame and m.atom = src join mols n on n.frame = e.frame and n.atom = dst where m.mol = n.mol)"""


_EDGES = _TOPO[: _TOPO.index(",\n reach(")]


@query(f"{_EDGES} select frame, src, dst, d2 from edges where a_sym <> 'C' and b_sym <> 'C'")
def exclude_elements(spark, sf):
    return topology.candidate_edges(vec_atoms(spark, sf), BOX, U, excluded=("C",)).select("frame", "src", "dst", "d2")


@query(f"{_EDGES} select frame, src, dst, d2 from edges where (src + dst) % 7 <> 0")
def forbid_pairs(spark, sf):
    a = vec_atoms(spark, sf)
    forbidden = topology.candidate_edges(a, BOX, U).where("(src + dst) % 7 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return topology.candidate_edges(a, BOX, U, forbidden=forbidden).select("frame", "src", "dst", "d2")


def _topology(spark, sf):
    a = vec_atoms(spark, sf)
    edges = staged(topology.candidate_edges(a, BOX, U), "edges")
    mols = topology.molecules(a, edges)
    return a, edges, mols, topology.bonds(edges, mols)


@query(f"{_TOPO} select frame, mol, a, b, d2 from bond")
def bonds(spark, sf):
    return _topology(spark, sf)[3].select("frame", F.col("mol").cast("long").alias("mol"), "a", "b", "d2")


@query(f"{_TOPO} select frame, atom, seed, mol from mols")
def molecules(spark, sf):
    return _topology(spark, sf)[2].select("frame", "atom", "seed", F.col("mol").cast("long").alias("mol"))


_FORMULA = """, formula as (select frame, mol, string_agg(sym || case when n > 1 then cast(n as varchar) else '' end, '' order by sym) as formula, cast(sum(n) as bigint) as n_atoms from (select frame, mol, sym, count(*) as n from mols group by 1, 2, 3) group by 1, 2)"""


@query(f"{_TOPO}{_FORMULA} select frame, mol, formula, n_atoms from formula")
def formulas(spark, sf):
    return topology.formulas(_topology(spark, sf)[2]).select("frame", F.col("mol").cast("long").alias("mol"), "formula", "n_atoms")


def wl_sql(start: str = "sym") -> str:
    out = f", both_ways as (select frame, a as atom, b as nbr from bond union all select frame, b, a from bond), lab0 as (select frame, mol, atom, {start} as lab from mols)"
    for k in range(3):
        out += f""", lab{k + 1} as (select l.frame, l.mol, l.atom, md5(l.lab || '|' || coalesce(string_agg(n.lab, ',' order by n.lab), '')) as lab from lab{k} l left join both_ways w on w.frame = l.frame and w.atom = l.atom left join lab{k} n on n.frame = w.frame and n.atom = w.nbr group by l.frame, l.mol, l.atom, l.lab)"""
    return out + ", hashes as (select frame, mol, md5(string_agg(lab, ',' order by lab)) as hash from lab3 group by 1, 2)"


@query(f"{_TOPO}{wl_sql()} select frame, mol, hash from hashes")
def wl_hash(spark, sf):
    _, _, mols, bond = _topology(spark, sf)
    return topology.graph_hashes(mols, bond).select("frame", F.col("mol").cast("long").alias("mol"), "hash")


@query(f"""{_TOPO}{_FORMULA}{wl_sql()}, types as (select frame, mol, string_agg(least(a_sym, b_sym) || '-' || greatest(a_sym, b_sym), ',' order by least(a_sym, b_sym) || '-' || greatest(a_sym, b_sym)) as types from bond group by 1, 2)
 select frame, row_number() over (partition by frame order by formula, types, hash) - 1 as comp, formula, types, hash, n_members from (select frame, formula, coalesce(types, '') as types, hash, count(*) as n_members from formula join hashes using (frame, mol) left join types using (frame, mol) group by 1, 2, 3, 4)""")
def compounds(spark, sf):
    _, _, mols, bond = _topology(spark, sf)
    return topology.compounds(mols, bond).select("frame", F.col("comp").cast("long").alias("comp"), "formula", "types", "hash", "n_members")


@query(f"{_TOPO} select least(a_sym, b_sym) || '-' || greatest(a_sym, b_sym) as pair, round(sqrt(avg(d2)) / 1000000, 6) as length, count(*) as n from bond group by 1")
def bond_lengths_rms(spark, sf):
    return topology.bond_lengths(_topology(spark, sf)[3]).select("pair", r6(F.col("length") / U).alias("length"), "n")


@query()
def ec_labels(spark, sf):
    _, _, mols, bond = _topology(spark, sf)
    return topology.connectivity_labels(mols, bond)


# -- graphs ---------------------------------------------------------------------------------------


def _percolation_sql(edge: str) -> str:
    return f""", {near(1.0, O_A, H_B)}, edge as (select distinct frame, src, dst from ({edge})), starts as (select distinct frame, mol as seed from vec_atoms where sym = 'O'),
 walk(frame, seed, node, level) as (select frame, seed, seed, 0 from starts union select w.frame, w.seed, e.dst, w.level + 1 from walk w join edge e on e.frame = w.frame and e.src = w.node where w.level < 4),
 lev as (select level, count(*) as n from (select frame, seed, node, min(level) as level from walk group by 1, 2, 3) group by 1)
 select cast(range as integer) + 1 as depth, round(coalesce(n, 0) / (select count(*) from starts), 6) as mean from range(5) left join lev on level = range"""


def _hydrogen_bonds(spark, sf):
    a = vec_atoms(spark, sf)
    p = within(a, "'O'", "'H'", 1.0).where("a_mol <> b_mol").select(*FRAME, F.col("a_mol").alias("acceptor"), F.col("b_mol").alias("donor"))
    return o(a).select(*FRAME, F.col("mol").alias("node")), p


@query(_percolation_sql("select frame, a_mol as src, b_mol as dst from pairs where a_mol <> b_mol union all select frame, b_mol, a_mol from pairs where a_mol <> b_mol"))
def percolation_undirected(spark, sf):
    starts, p = _hydrogen_bonds(spark, sf)
    edges = p.select(*FRAME, F.col("acceptor").alias("src"), F.col("donor").alias("dst"))
    return graphs.percolation(starts, edges.union(edges.select(*FRAME, "dst", "src"))).select("depth", r6(F.col("mean")).alias("mean"))


@query(_percolation_sql("select frame, b_mol as src, a_mol as dst from pairs where a_mol <> b_mol"))
def percolation_alternating(spark, sf):
    starts, p = _hydrogen_bonds(spark, sf)
    return graphs.percolation(starts, p.select(*FRAME, F.col("donor").alias("src"), F.col("acceptor").alias("dst"))).select("depth", r6(F.col("mean")).alias("mean"))


def _clusters_sql(table: str) -> str:
    return f""", {near(0.8, O_A, H_B, table)}, edge as (select traj, frame, a_atom as src, b_atom as dst from pairs union select traj, frame, b_atom, a_atom from pairs), nodes as (select traj, frame, atom, sym from {table} where sym in ('O', 'H')),
 reach(traj, frame, seed, v) as (select traj, frame, atom, atom from nodes union select r.traj, r.frame, r.seed, e.dst from reach r join edge e on e.traj = r.traj and e.frame = r.frame and e.src = r.v),
 comp as materialized (select traj, frame, v as atom, min(seed) as comp from reach group by 1, 2, 3), member as (select traj, frame, comp, sym as grp, atom from comp join nodes using (traj, frame, atom)),
 cl as materialized (select traj, frame, comp, string_agg(grp || '-' || cast(n as varchar), '_' order by grp) as composition, cast(sum(n) as bigint) as size from (select traj, frame, comp, grp, count(*) as n from member group by all) group by 1, 2, 3),
 inst as materialized (select traj, frame, comp, md5(string_agg(cast(atom as varchar), ',' order by atom)) as instance from member group by 1, 2, 3)"""


def _clusters(atoms):
    nodes = atoms.where("sym in ('O', 'H')")
    edges = graphs.cutoff_edges(within(atoms, "'O'", "'H'", 0.8), {("H", "O"): int(0.8 * U)}, "sym")
    return nodes, edges, graphs.clusters(nodes, edges, "sym")


@query(f"{_clusters_sql('vec_atoms')} select frame, comp, composition, size, instance from cl join inst using (traj, frame, comp)")
def clusters(spark, sf):
    return _clusters(vec_atoms(spark, sf))[2].select("frame", "comp", "composition", "size", "instance")


def _n_frames(df):
    """One row: the number of frames."""
    return df.agg(F.count_distinct(*FRAME).alias("frames"))


@query(f"""{_clusters_sql('vec_atoms')}, per as (select frame, composition, count(*) as n from cl group by 1, 2), t as (select count(distinct frame) as t from vec_atoms)
 select composition, cast(sum(n) as bigint) as occurrences, round(sum(n) / any_value(t), 6) as mean, round(sqrt(greatest((sum(n * n) - cast(sum(n) as double) * sum(n) / any_value(t)) / (any_value(t) - 1), 0.0)), 6) as std from per, t group by 1""")
def cluster_hist(spark, sf):
    a = vec_atoms(spark, sf)
    return graphs.occurrences(_clusters(a)[2], _n_frames(a)).select("composition", "occurrences", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


def _population_sql(by: str) -> str:
    return f"""{_clusters_sql('vec_atoms')}, k as (select frame, grp, {by}, count(*) as n from member join cl using (traj, frame, comp) group by 1, 2, 3), share as (select *, n / sum(n) over (partition by frame, grp) as s from k), t as (select grp, count(distinct frame) as t from member group by 1)
 select {by}, grp, round(sum(s) / any_value(t), 6) as mean, round(sqrt(greatest((sum(s * s) - any_value(t) * pow(sum(s) / any_value(t), 2)) / (any_value(t) - 1), 0.0)), 6) as std from share join t using (grp) group by 1, 2"""


def _members(spark, sf):
    nodes, edges, cl = _clusters(vec_atoms(spark, sf))
    comp = graphs.components(nodes, edges)
    return nodes.select(*FRAME, "atom", F.col("sym").alias("grp")).join(comp, [*FRAME, "atom"]).join(cl, [*FRAME, "comp"])


@query(_population_sql("composition"))
def cluster_populations(spark, sf):
    return graphs.populations(_members(spark, sf)).select("composition", "grp", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(_population_sql("size"))
def cluster_sizes(spark, sf):
    return graphs.populations(_members(spark, sf), "size").select("size", "grp", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


# -- time -----------------------------------------------------------------------------------------

T = 21


@query(f"""{_clusters_sql('vec_walk')}, p as (select distinct traj, instance, frame as t from cl join inst using (traj, frame, comp) where size > 1), n_inst as (select count(*) as k from (select distinct traj, instance from p)),
 pr as (select b.t - a.t as tau, count(*) as n from p a join p b on a.traj = b.traj and a.instance = b.instance and b.t >= a.t group by 1), c as (select cast(range as integer) as tau, coalesce(n, 0) / (k * (21.0 - range)) as c from n_inst, range(10) left join pr on tau = range)
 select tau, round(c / (select c from c where tau = 0), 6) as c from c""", "vec_walk")
def cacf(spark, sf):
    p = _clusters(vec_walk(spark, sf))[2].where("size > 1").select("traj", "instance", F.col("frame").alias("t")).distinct()
    n = p.select("traj", "instance").distinct().count()
    return series.intermittent(p, ["traj", "instance"], T, max(1, n), 10).select("tau", r6(F.col("c")).alias("c"))


_DIMER = f", {near(1.5, O_A, H_B, 'vec_walk')}, p as materialized (select traj, a_atom, b_atom, frame as t from pairs), series as (select sum(r * o) as s from (select count(*) filter (sym = 'O') as r, count(*) filter (sym = 'H') as o from vec_walk where frame = 0 group by traj))"
_PRODUCTS = ", pr as (select b.t - a.t as tau, count(*) as n from p a join p b on a.traj = b.traj and a.a_atom = b.a_atom and a.b_atom = b.b_atom and b.t >= a.t group by 1)"


def _dimers(spark, sf):
    a = vec_walk(spark, sf)
    p = within(a, "'O'", "'H'", 1.5).select("traj", "a_atom", "b_atom", F.col("frame").alias("t"))
    n = a.where("frame = 0").groupBy("traj").agg((F.count_if(F.col("sym") == "O") * F.count_if(F.col("sym") == "H")).alias("s")).agg(F.sum("s")).first()[0]
    return p, float(n)


_KEYS = ["traj", "a_atom", "b_atom"]


@query(f"{_DIMER}{_PRODUCTS}, c as (select cast(range as integer) as tau, coalesce(n, 0) / (s * (21.0 - range)) as c from series, range(15) left join pr on tau = range) select tau, round(tau * 0.5 / 1000, 6) as t_ps, round(c / (select c from c where tau = 0), 6) as c from c", "vec_walk")
def dacf_intermittent(spark, sf):
    p, n = _dimers(spark, sf)
    return series.intermittent(p, _KEYS, T, n, 15).select("tau", r6(F.col("tau") * 0.5 / 1000).alias("t_ps"), r6(F.col("c")).alias("c"))


@query(f"{_DIMER}{_PRODUCTS}, c as (select cast(range as integer) as tau, coalesce(n, 0) / (s * (21.0 - range)) - pow((select n from pr where tau = 0) / (s * 21.0), 2) as c from series, range(15) left join pr on tau = range) select tau, round(c / (select c from c where tau = 0), 6) as c from c", "vec_walk")
def dacf_corrected(spark, sf):
    p, n = _dimers(spark, sf)
    return series.intermittent(p, _KEYS, T, n, 15, corrected=True).select("tau", r6(F.col("c")).alias("c"))


@query(f"""{_DIMER}, rl as (select count(*) as l from (select *, t - row_number() over (partition by traj, a_atom, b_atom order by t) as i from p) group by traj, a_atom, b_atom, i), c as (select cast(range as integer) as tau, coalesce(sum(l - range), 0) as c from range(15) left join rl on l > range group by range)
 select tau, round(c / (select c from c where tau = 0), 6) as c from c""", "vec_walk")
def dacf_continuous(spark, sf):
    p, _ = _dimers(spark, sf)
    return series.continuous(p, _KEYS, T, 15).select("tau", r6(F.col("c")).alias("c"))


_ASSIGN = f", {near(1.5, H_A, O_B, 'vec_walk')}, assigned as (select traj, frame, a_atom as proton, arg_min(b_atom, {{'d': d2, 'b': b_atom}}) as acceptor from pairs group by 1, 2, 3)"


def _assigned(spark, sf):
    a = vec_walk(spark, sf)
    return transfers.assign_within(h(a), o(a), int(1.5 * U), BOX)


@query(f"{_ASSIGN} select traj, frame, proton, acceptor from assigned", "vec_walk")
def pt_assign(spark, sf):
    return _assigned(spark, sf).select("traj", "frame", "proton", "acceptor")


_EVENTS = f"""{_ASSIGN}, marked as (select *, case when acceptor <> lag(acceptor) over w then 1 else 0 end as ch from assigned window w as (partition by traj, proton order by frame)),
 numbered as (select *, sum(ch) over (partition by traj, proton order by frame) as run from marked), stay as (select traj, proton, run, min(frame) as frame, count(*) as n, any_value(acceptor) as h from numbered group by 1, 2, 3),
 events as materialized (select traj, frame, proton, donor, acceptor from (select traj, frame, proton, lag(h) over w as donor, h as acceptor, lag(n) over w as n from stay window w as (partition by traj, proton order by run)) where donor is not null and n >= 2)"""
_SQUASH = f"""{_EVENTS}, nth as materialized (select *, row_number() over (partition by traj, proton order by frame) as i from events),
 pile(traj, proton, i, s) as (select traj, proton, 1, [{{'f': frame, 'd': donor, 'a': acceptor}}] from nth where i = 1
  union all select p.traj, p.proton, p.i + 1, case when len(p.s) > 0 and p.s[-1].a = n.donor and p.s[-1].d = n.acceptor and n.frame - p.s[-1].f <= 10 then p.s[:len(p.s) - 1] else list_append(p.s, {{'f': n.frame, 'd': n.donor, 'a': n.acceptor}}) end
  from pile p join nth n on n.traj = p.traj and n.proton = p.proton and n.i = p.i + 1),
 squashed as materialized (select traj, proton, unnest(s) as e from (select traj, proton, arg_max(s, i) as s from pile group by 1, 2))"""


@query(f"{_EVENTS} select traj, frame, proton, donor, acceptor from events", "vec_walk")
def pt_events(spark, sf):
    return transfers.transfer_events(_assigned(spark, sf))


@query(f"{_SQUASH} select traj, e.f as frame, proton, e.d as donor, e.a as acceptor from squashed", "vec_walk")
def pt_squash(spark, sf):
    return transfers.squash(transfers.transfer_events(_assigned(spark, sf)), 10)


@query(f"""{_SQUASH}, link as materialized (select traj, e.f as f, e.d as d, e.a as a, row_number() over (order by traj, e.f, e.d, e.a, proton) as id from squashed),
 walk(id, traj, since, now, seen, n) as (select id, traj, f, a, [d, a], 1 from link
  union all select id, traj, m.f, m.a, list_append(seen, m.a), n + 1 from (
   select w.id, w.traj, w.seen, w.n, min({{'f': l.f, 'a': l.a}}) as m from walk w join link l on l.traj = w.traj and l.d = w.now and l.f > w.since and l.f <= w.since + 100 and not list_contains(w.seen, l.a)
   where w.n < 20 group by w.id, w.traj, w.seen, w.n)),
 ends as (select id, max(n) as n from walk group by 1)
 select cast(n as integer) as n, round(count(*) / any_value(t), 6) as c, any_value(t) as total from ends, (select count(*) as t from link) group by n""", "vec_walk")
def pt_chains(spark, sf):
    found = transfers.chains(transfers.squash(transfers.transfer_events(_assigned(spark, sf)), 10), 100)
    return found.select("n", r6(F.col("c")).alias("c"), "total")


_ALWAYS = f", {near(18.0, H_A, O_B, 'vec_walk')}, assigned as (select traj, frame, a_atom as proton, arg_min(b_atom, {{'d': d2, 'b': b_atom}}) as acceptor, arg_min(b_mol, {{'d': d2, 'b': b_atom}}) as acceptor_mol from pairs group by 1, 2, 3)"


def _held(spark, sf):
    a = vec_walk(spark, sf)
    return a, transfers.assign_always(h(a), o(a), int(1.5 * U), BOX)


@query(f"{_ALWAYS} select traj, frame, proton, acceptor, acceptor_mol from assigned", "vec_walk")
def charge_assign(spark, sf):
    return _held(spark, sf)[1].select("traj", "frame", "proton", "acceptor", "acceptor_mol")


@query(f"{_ALWAYS}, n as (select traj, acceptor_mol as mol, count(*) as n from assigned where frame = 0 group by 1, 2) select traj, mol, cast(coalesce(n, 0) - 2 as integer) as charge from (select distinct traj, mol from vec_walk where sym = 'O' and frame = 0) left join n using (traj, mol)", "vec_walk")
def charge_init(spark, sf):
    a, held = _held(spark, sf)
    return transfers.initial_charges(held, o(a), 2)


@query()
def charge_track(spark, sf):
    a, held = _held(spark, sf)
    return transfers.charge_track(held, o(a), 2)


@query()
def charge_msd(spark, sf):
    a, held = _held(spark, sf)
    paths = transfers.charge_paths(transfers.charge_track(held, o(a), 2), transfers.holder_centres(o(a), BOX), BOX)
    return series.mean_squared_displacement(paths, ["traj", "cid"], T, by=("sign",)).select("sign", "tau", (F.col("msd") / (U * U)).alias("msd"))


_UNWRAP = ", ".join(f"{k} - lag({k}) over w - {L} * cast(round_even(({k} - lag({k}) over w) / {L}, 0) as bigint) as d{k}" for k in AXES)


@query(f""", steps as (select traj, atom, frame, x, y, z, {_UNWRAP} from vec_walk window w as (partition by traj, atom order by frame)), path as materialized (select traj, atom, frame, """ + ", ".join(f"cast(sum(coalesce(d{k}, {k})) over (partition by traj, atom order by frame) as bigint) as {k}" for k in AXES) + f""" from steps)
 select cast(b.frame - a.frame as integer) as tau, round(avg(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) / 1e12, 5) as msd from path a join path b on a.traj = b.traj and a.atom = b.atom and b.frame > a.frame and b.frame - a.frame < {T} group by 1""", "vec_walk")
def unwrap_msd(spark, sf):
    paths = series.unwrapped(vec_walk(spark, sf), ["traj", "atom"], BOX)
    return series.mean_squared_displacement(paths, ["traj", "atom"], T).select("tau", F.round(F.col("msd") / 1e12, 5).alias("msd"))


# -- slab -----------------------------------------------------------------------------------------


@query()
def voronoi_areas(spark, sf):
    cells = voronoi.voronoi_cells(vec_atoms(spark, sf), BOX, 0, 4 * U, unit=U)
    return voronoi.domain_areas(cells)


@query(f"select traj, frame, {(L // U) ** 2}.0 as area from vec_atoms where z between 0 and {4 * U} group by traj, frame")
def voronoi_plane(spark, sf):
    """The cells of a frame fill the plane."""
    cells = voronoi.voronoi_cells(vec_atoms(spark, sf), BOX, 0, 4 * U, unit=U)
    return cells.groupBy(*FRAME).agg(r6(F.sum("area")).alias("area"))


__all__ = ["ORACLE_SQL", "QUERIES"]
