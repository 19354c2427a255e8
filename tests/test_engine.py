"""Golden cases worked out by hand, and differential tests against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave import queries
from atomweave.functions.geometry import label_is
from atomweave.operators import cells, graphs, series, topology, transfers, voronoi
from atomweave.operators.cells import distance_weights, nearest, pairs_within
from atomweave.operators.histograms import Bins, linear, simple
from atomweave.plans import analyses
from atomweave.sources.tables import vec_atoms
from atomweave.sources import elements, trajectories
from atomweave.sources.trajectories import format_of, read_trajectory, write_dat

BOX = (10.0, 10.0, 10.0)


def atoms(spark, rows, frame=0):
    full = [("t", r[5] if len(r) > 5 else frame, n, r[0], f"{r[0]}1", r[4] if len(r) > 4 else n, *map(float, r[1:4])) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, "traj string, frame long, atom long, sym string, label string, mol long, x double, y double, z double")


def test_rdf_of_one_pair(spark):
    rows = analyses.rdf(atoms(spark, [("O", 1, 1, 1), ("H", 2, 1, 1)]), "O", "H", BOX).collect()
    full = [r for r in rows if r.g > 0]
    assert [r.bin for r in full] == [50] and full[0].r == pytest.approx(1.01)
    assert full[0].g == pytest.approx(1000 / (4 / 3 * math.pi * (1.02**3 - 1)), rel=1e-6)
    assert all(r.n == pytest.approx(1.0) for r in rows if r.bin >= 50)


def test_image_distance(spark):
    a = atoms(spark, [("O", 0.2, 5, 5), ("H", 9.8, 5, 5)])
    d = pairs_within(a.where("sym = 'O'"), a.where("sym = 'H'"), 1.0, BOX).first()
    assert math.sqrt(d.d2) == pytest.approx(0.4)


@pytest.mark.parametrize("query", ["nearest4", "nearest1_fallback", "top_q", "top_s"])
def test_nearest_broadcasts_no_points(spark, monkeypatch, query):
    plans, kept = [], cells.staged
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (cells, transfers):
        monkeypatch.setattr(module, "staged", lambda df, name: (plan(df), kept(df, name))[1])
    plan(queries.QUERIES[query](spark, "/root/testdata/sf0.001"))
    assert len(plans) > 2 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_order_parameters_gather_neighbours_once(spark, tmp_path, monkeypatch):
    near = nearest(*[vec_atoms(spark, "/root/testdata/sf0.001").where(f"frame = 0 and sym = '{e}'") for e in "OH"], 4, (20_000_000,) * 3, 5_000_000)
    near.write.parquet(f"{tmp_path}/near")
    monkeypatch.setattr(analyses, "nearest", lambda *a: spark.read.parquet(f"{tmp_path}/near"))
    orders = analyses.tetrahedral(vec_atoms(spark, "/root/testdata/sf0.001"), "O", "H", (20_000_000,) * 3, 0)
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert orders.count() == near.select("frame", "a_atom").distinct().count() > 0


@pytest.mark.parametrize("length", [1.5, 2.5, 3.5, 6.0])
def test_cells_equal_brute_force(spark, length):
    rnd = random.Random(int(length * 10))
    box = (length, length * 1.3, length * 2)
    rows = [("O" if rnd.random() < 0.5 else "H", *[rnd.random() * b for b in box]) for _ in range(60)]
    a = atoms(spark, rows)
    got = {(r.a_atom, r.b_atom) for r in pairs_within(a, a, 1.0, box).collect()}
    x = np.array([r[1:4] for r in rows])
    d = x[:, None] - x[None]
    d -= np.array(box) * np.rint(d / np.array(box))
    want = set(zip(*[v.tolist() for v in np.nonzero((d * d).sum(-1) <= 1.0)], strict=True))
    assert got == want
    four = {}
    for r in nearest(a, a, 4, box, 0.5).collect():
        four.setdefault(r.a_atom, {})[r["rank"]] = r.d2
    for i in range(len(x)):
        want4 = sorted((d[i] ** 2).sum(-1)[np.arange(len(x)) != i])[:4]
        assert [four[i][k] for k in (1, 2, 3, 4)] == pytest.approx(want4)


@pytest.mark.parametrize("length", [3.0, 40.0])
def test_blocks_of_points_equal_pairs(spark, length):
    rnd = random.Random(int(length))
    box = (length, length * 1.3, length * 1.1)
    rows = [("O" if rnd.random() < 0.4 else "H", *[rnd.random() * b for b in box]) for _ in range(300)]
    a = atoms(spark, rows)
    o, h, spec = a.where("sym = 'O'"), a.where("sym = 'H'"), Bins(0.0, 4.0, 37)
    want = {r.bin: r.weight for r in linear(pairs_within(o, h, 4.0, box).where("d2 > 0").select(F.sqrt("d2").alias("d")), "d", spec).collect()}
    boxed = [x.withColumns({f"l{k}": F.lit(v) for k, v in zip("xyz", box, strict=True)}) for x in (o, h)]
    for p, q, b in ((o, h, box), (*boxed, ("lx", "ly", "lz"))):
        assert {r.bin: r.weight for r in distance_weights(p, q, 4.0, 37, b).collect()} == pytest.approx(want)


def test_displacements_and_products_equal_plain_sums(spark):
    rnd = random.Random(4)
    rows, want, n = [], {}, {}
    for key, length, hole in (("a", 9000, 0.0), ("b", 400, 0.3), ("c", 50, 0.9), ("d", 1, 0.0)):
        at, path = np.zeros(3), {}
        for t in range(length):
            at = at + np.array([rnd.gauss(0, 1) for _ in range(3)])
            if rnd.random() >= hole:
                path[t] = at
        rows += [(key, t, *map(float, x)) for t, x in path.items()]
        for tau in range(12):
            d = [((path[t + tau] - x) ** 2).sum() for t, x in path.items() if t + tau in path]
            want[tau], n[tau] = want.get(tau, 0) + sum(d), n.get(tau, 0) + len(d)
    df = spark.createDataFrame(rows, "k string, frame long, x double, y double, z double")
    got = {r.tau: r.msd for r in series.mean_squared_displacement(df, ["k"], 12).collect()}
    assert got == pytest.approx({tau: want[tau] / n[tau] for tau in range(1, 12)}, rel=1e-9)
    assert {r.tau: r.n for r in series.products(df.select("k", F.col("frame").alias("t")), ["k"], 12).collect()} == n


def test_water_and_asymmetric_bond(spark):
    a = atoms(spark, [("O", 5, 5, 5), ("H", 5.96, 5, 5), ("H", 4.76, 5.93, 5)])
    edges = topology.candidate_edges(a, BOX)
    mols = topology.molecules(a, edges)
    bond = topology.bonds(edges, mols)
    assert [r.formula for r in topology.formulas(mols).collect()] == ["H2O"] and bond.count() == 2
    assert sorted(r.label for r in topology.connectivity_labels(mols, bond).collect()) == ["H1", "H2", "O1"]
    for rows, n in (([("O", 5, 5, 5), ("H", 6.33, 5, 5)], 1), ([("H", 6.33, 5, 5), ("O", 5, 5, 5)], 2), ([("Na", 5, 5, 5), ("O", 6, 5, 5)], 2)):
        b = atoms(spark, rows)
        assert topology.molecules(b, topology.candidate_edges(b, BOX)).select("mol").distinct().count() == n


def test_histograms(spark):
    v = spark.createDataFrame([(0.25,), (0.5,), (1.0,), (float("nan"),), (-3.0,)], "v double")
    spec = Bins(0.0, 1.0, 2)
    assert {r.bin: r.weight for r in linear(v, "v", spec).collect()} == {0: 0.5, 1: 1.5}
    assert {r.bin: r["count"] for r in simple(v, "v", spec).collect()} == {0: 1, 1: 2}
    with pytest.raises(ValueError):
        Bins(0.0, 0.0, 1)


@pytest.mark.parametrize(("near", "q", "s"), [([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)], 0.5, 1.0), ([(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)], 1.0, 1.0)])
def test_tetrahedral_order(spark, near, q, s):
    a = atoms(spark, [("O", 5, 5, 5), *[("H", 5 + x, 5 + y, 5 + z) for x, y, z in near]])
    r = analyses.tetrahedral(a, "O", "H", BOX, 2.0).first()
    assert (r.q, r.s) == (pytest.approx(q), pytest.approx(s))


def test_percolation_of_a_path(spark):
    e = spark.createDataFrame([("t", 0, i, j) for i, j in ((0, 1), (1, 2), (2, 3))], "traj string, frame long, src long, dst long")
    starts = spark.createDataFrame([("t", 0, i) for i in range(4)], "traj string, frame long, node long")
    both = e.union(e.select("traj", "frame", "dst", "src"))
    assert [r["mean"] for r in graphs.percolation(starts, both).orderBy("depth").collect()] == [1.0, 1.5, 1.0, 0.5, 0.0]


def test_correlations(spark):
    p = spark.createDataFrame([(1, t) for t in (0, 1, 3)], "k long, t long")
    c = lambda df: [r.c for r in df.orderBy("tau").collect()]
    assert c(series.intermittent(p, ["k"], 4, 1, 4)) == pytest.approx([1, 4 / 9, 2 / 3, 4 / 3])
    assert c(series.intermittent(p, ["k"], 4, 1, 4, corrected=True)) == pytest.approx([1, -11 / 9, -1 / 3, 7 / 3])
    assert c(series.continuous(p, ["k"], 4, 4)) == pytest.approx([1, 1 / 3, 0, 0])


def _assigned(spark, holders):
    return spark.createDataFrame([("t", f, 0, a) for f, a in enumerate(holders) if a is not None], "traj string, frame long, proton long, acceptor long")


def test_transfers(spark):
    ev = transfers.transfer_events(_assigned(spark, [1, 1, 2, 2, 3, 3]))
    assert [(r.frame, r.donor, r.acceptor) for r in ev.orderBy("frame").collect()] == [(2, 1, 2), (4, 2, 3)]
    assert {r.n: r.c for r in transfers.chains(ev).collect()} == {1: 0.5, 2: 0.5}
    back = transfers.transfer_events(_assigned(spark, [1, 1, 2, 2, 1, 1]))
    assert back.count() == 2 and transfers.squash(back).count() == 0
    gap = transfers.transfer_events(_assigned(spark, [1, 1, None, None, 2, 2]))
    assert [(r.frame, r.acceptor) for r in gap.collect()] == [(4, 2)]


def test_charge_rules():
    c = transfers.Carriers({0: 1, 1: 0, 2: -1})
    c.hop(0, 1)
    assert c.holder == {0: 1, 1: 2} and c.charge == {0: 0, 1: 1, 2: -1}
    c.hop(1, 2)
    assert c.holder == {} and sum(c.charge.values()) == 0
    c.hop(0, 1)
    assert sorted(c.sign[k] * (m + 1) for k, m in c.holder.items()) == [-1, 2]


def test_charge_displacement_shows_one_frame_later(spark):
    track = spark.createDataFrame([("t", 0, 0, 0, 1), ("t", 1, 0, 1, 1), ("t", 2, 0, 1, 1)], "traj string, frame long, cid int, mol long, sign int")
    centres = spark.createDataFrame([("t", f, m, 1.0 + 2.4 * m, 1.0, 1.0) for f in range(3) for m in (0, 1)], "traj string, frame long, mol long, x double, y double, z double")
    msd = series.mean_squared_displacement(transfers.charge_paths(track, centres, BOX), ["traj", "cid"], 3, by=("sign",))
    assert {r.tau: r.msd for r in msd.collect()} == {1: pytest.approx(2.88), 2: pytest.approx(5.76)}


def test_populations(spark):
    rows = [("t", 0, "H", "1-O-1_2-H-2")] * 2 + [("t", 1, "H", "1-O-1_2-H-1"), ("t", 1, "H", "2-H-1")]
    got = graphs.populations(spark.createDataFrame(rows, "traj string, frame long, grp string, composition string")).collect()
    assert {r.composition: (round(r["mean"], 4), round(r["std"], 4)) for r in got} == {"1-O-1_2-H-2": (0.5, 0.7071), "1-O-1_2-H-1": (0.25, 0.3536), "2-H-1": (0.25, 0.3536)}


def test_frames_and_labels(spark):
    assert analyses.frame_set(0, 11, nframes=6, stride=2) == [0, 2, 4]
    assert analyses.frame_set(0, 11, nframes=5, stride=2) == [0, 2, 4, 6, 8, 10]
    names = spark.createDataFrame([("C1",), ("Cl1",), ("C10",)], "l string")
    assert names.where(label_is(F.col("l"), "C")).count() == 3 and names.where(label_is(F.col("l"), "C1")).count() == 1


def test_coinciding_neighbour_gives_no_angle(spark):
    a = atoms(spark, [("O", 5, 5, 5), ("H", 5, 5, 5), ("H", 6, 5, 5)])
    assert analyses.adf3b(a, "O", "H", "H", BOX).count() == 0


def test_elements():
    t = {r[0]: r for r in elements.rows()}
    assert len(t) == 120 and t["O"][1:] == (15.999, 1.52, 0.66, 8) and t["Og"][4] == 118
    assert sum(r[1] is not None for r in t.values()) == 86 and sum(r[2] is not None for r in t.values()) == 105


def test_voronoi_areas_fill_the_plane(spark):
    rnd = random.Random(5)
    a = atoms(spark, [(rnd.choice("OHC"), rnd.random() * 10, rnd.random() * 10, 1.0) for _ in range(40)])
    assert voronoi.voronoi_cells(a, BOX, 0.0, 2.0).agg(F.sum("area")).first()[0] == pytest.approx(100.0, rel=1e-9)


def _plane(spark, n, length, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("OHC"), rnd.random() * length, rnd.random() * length, 1.0) for _ in range(n)]
    return rows, atoms(spark, rows), (length, length, 10.0)


def test_voronoi_cells_do_not_depend_on_tiles(spark):
    _, a, box = _plane(spark, 300, 22.0, 6)
    whole = {r.atom: r for r in voronoi.voronoi_cells(a, box, 0.0, 2.0, tiles=(1, 1)).collect()}
    assert len(whole) < 300 and sum(r.area for r in whole.values()) == pytest.approx(22.0**2, rel=1e-9)
    for tiles in ((4, 4), (7, 3)):
        got = voronoi.voronoi_cells(a, box, 0.0, 2.0, tiles=tiles).collect()
        assert sorted(r.atom for r in got) == sorted(whole)
        for r in got:
            assert r.area == pytest.approx(whole[r.atom].area, rel=1e-9) and r.perimeter == pytest.approx(whole[r.atom].perimeter, rel=1e-9)
            assert sorted(r.neighbours) == sorted(whole[r.atom].neighbours)


def test_voronoi_areas_equal_a_fine_grid(spark):
    rows, a, box = _plane(spark, 60, 9.0, 7)
    cells = {r.atom: r for r in voronoi.voronoi_cells(a, box, 0.0, 2.0, tiles=(3, 3)).collect()}
    radius = {r[0]: r[2] for r in elements.rows()}
    own = sorted(cells)
    x, r = np.array([rows[i][1:3] for i in own]), np.array([radius[rows[i][0]] for i in own])
    step = 9.0 / 900
    at = (np.arange(900) + 0.5) * step
    best, who = np.full((900, 900), np.inf), np.zeros((900, 900), int)
    for k in range(len(own)):
        dx, dy = (at - x[k][n] - 9.0 * np.rint((at - x[k][n]) / 9.0) for n in (0, 1))
        power = (dx * dx)[:, None] + (dy * dy)[None] - r[k] ** 2
        best, who = np.minimum(best, power), np.where(power < best, k, who)
    counted = np.bincount(who.ravel(), minlength=len(own)) * step * step
    for k, i in enumerate(own):
        assert abs(counted[k] - cells[i].area) <= 2 * step * cells[i].perimeter + 1e-3


def test_byte_ranges_give_the_same_frames(tmp_path):
    rnd = random.Random(8)
    line = lambda: f"{rnd.choice(['O', 'H'])} " + " ".join(f"{rnd.random():.{rnd.randint(1, 9)}f}" for _ in range(3)) + "\n"
    frames = []
    for n in (3, 1, 4, 4, 2, 1, 5, 3):
        comment = rnd.choice([f"{n - 1}\n", f"{n}\n", "\n", "a comment of 3 words\n", "1\n"])
        frames.append(f"{n}\n{comment}" + "".join(line() for _ in range(n)))
    head = "ITEM: TIMESTEP\n{}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 9\n0 9\n0 9\nITEM: ATOMS element x y z\n"
    dumps = [head.format(t) + line() + line() for t in range(6)]
    for kind, parts in (("xyz", frames), ("lammps", dumps)):
        for tail in ("", "\n" + parts[0]):  # what follows a blank line does not count
            path = tmp_path / f"a.{kind}"
            path.write_text("".join(parts) + tail)
            size = path.stat().st_size
            whole = [g for g in trajectories.frames_from(str(path), kind, BOX, 0, size)]
            assert sum(g is not None for g in whole) == len(parts) and (whole[-1] is None) == bool(tail)
            for step in (1, 7, 40, 111, 1000):
                got = []
                for a in range(0, size, step):
                    got += trajectories.frames_from(str(path), kind, BOX, a, min(a + step, size))
                    if got and got[-1] is None:
                        break
                assert [g for g in got if g is not None] == [g for g in whole if g is not None]


def test_files(spark, tmp_path):
    xyz = tmp_path / "a.xyz"
    xyz.write_text("2\nc\no 11 1 1\nCL 2 -1 1 9\n2\nc\nO 1 1 1\nCl 2 2 2\n")
    rows = read_trajectory(spark, str(xyz), BOX).orderBy("frame", "atom").collect()
    assert [(r.frame, r.sym, r.x, r.y) for r in rows][:2] == [(0, "O", 1.0, 1.0), (0, "Cl", 2.0, 9.0)] and len(rows) == 4
    dump = tmp_path / "b.lammpstrj"
    one = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS x y z xu yu zu element\n1 1 1 12 2 2 h\n"
    dump.write_text(one.format(t=5) + one.format(t=6))
    got = read_trajectory(spark, str(dump)).orderBy("frame").collect()
    assert [(r.timestep, r.sym, r.x, r.lx) for r in got] == [(5, "H", 2.0, 10.0), (6, "H", 2.0, 10.0)]
    with pytest.raises(ValueError):
        format_of("a.pdb")
    write_dat(spark.createDataFrame([(0.5, 1.0)], "a double, b double"), str(tmp_path / "o.dat"), ["r", "g"])
    assert (tmp_path / "o.dat").read_text().splitlines()[1].split() == ["0.500000", "1.000000"]


def test_streaming_transfers(spark, tmp_path):
    from atomweave.streaming.frames import streaming_transfers

    batch = _assigned(spark, [1, 1, 2, 2, 3, 3])
    batch.write.parquet(str(tmp_path / "in"))
    q = streaming_transfers(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tr").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.frame, r.donor, r.acceptor) for r in spark.table("tr").collect()) == [(2, 1, 2), (4, 2, 3)]


def _stream(spark, tmp_path, batches, make, name):
    """Feed the batches one after the other and return all rows."""
    for n, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = make(spark.readStream.schema(batches[0].schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_streaming_products(spark, tmp_path):
    from atomweave.streaming.frames import streaming_products

    p = spark.createDataFrame([(1, t) for t in (0, 1, 3)] + [(2, t) for t in (1, 2)], "k long, t long")
    rows = _stream(spark, tmp_path, [p.where("t < 2"), p.where("t >= 2")], lambda s: streaming_products(s, ["k"], 4), "products")
    got = {}
    for r in rows:
        got[r.tau] = got.get(r.tau, 0) + r.n
    assert got == {r.tau: r.n for r in series.products(p, ["k"], 4).collect()}


def test_streaming_charges(spark, tmp_path):
    from atomweave.streaming.frames import streaming_charges

    holders = {0: [0, 0, 0, 1, 1], 1: [0, 0, 1, 1, 1], 2: [0, 0, 1, 1, 0]}  # a spare proton moves from molecule 0 to 1, then another one back
    a = spark.createDataFrame([("t", f, p, m) for f, own in holders.items() for p, m in enumerate(own)], "traj string, frame long, proton long, acceptor_mol long")
    rows = _stream(spark, tmp_path, [a.where("frame < 2"), a.where("frame >= 2")], lambda s: streaming_charges(s, 2), "charges")
    assert sorted((r.frame, r.cid, r.mol, r.sign) for r in rows) == [(0, 0, 0, 1), (1, 0, 1, 1), (2, 0, 0, 1)]


def test_streaming_charges_of_a_molecule_without_protons(spark, tmp_path):
    from atomweave.streaming.frames import streaming_charges

    a = spark.createDataFrame([("t", f, p, m) for f, own in enumerate([[0, 0, 0], [0, 0, 5]]) for p, m in enumerate(own)], "traj string, frame long, proton long, acceptor_mol long")
    rows = _stream(spark, tmp_path, [a], lambda s: streaming_charges(s, 2), "late")
    # the molecule has two negative carriers; the spare proton ends one of them together with the positive one
    assert sorted((r.frame, r.cid, r.mol, r.sign) for r in rows) == [(0, 0, 0, 1), (1, 2, 5, -1)]


@pytest.mark.parametrize("kind", ["xyz", "lammpstrj"])
def test_a_growing_file_is_a_stream_of_whole_frames(spark, tmp_path, kind):
    from atomweave.streaming.source import register

    register(spark)
    rnd = random.Random(2)
    line = lambda: "O " + " ".join(f"{rnd.random() * 5:.4f}" for _ in range(3)) + "\n"
    if kind == "xyz":
        frames = [f"3\nframe {t}\n" + line() + line() + line() for t in range(6)]
    else:
        head = "ITEM: TIMESTEP\n{}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 9\n0 9\n0 {}\nITEM: ATOMS element x y z\n"
        frames = [head.format(t, 9 + t) + line() + line() for t in range(6)]
    path, out = tmp_path / f"a.{kind}", tmp_path / "out"
    written = 0
    for k, cut in ((2, 0.6), (2, 0.0), (4, 0.3), (6, 0.0)):  # frames that are whole, and how much of the next one is there
        text = "".join(frames[:k]) + (frames[k][: int(len(frames[k]) * cut)] if k < len(frames) else "")
        if written < len(text):
            with open(path, "a") as f:
                f.write(text[written:])
            written = len(text)
        stream = spark.readStream.format("trajectory").option("path", str(path)).option("box", "9,9,9").option("range", 150).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out)).awaitTermination()
        got = spark.read.parquet(str(out))
        assert got.select("frame").distinct().count() == k
    want = read_trajectory(spark, str(path), (9.0, 9.0, 9.0)).drop("frame").collect()
    assert sorted(map(str, got.drop("frame").collect())) == sorted(map(str, want)) and len(want) == sum(1 for _ in want)


def test_charge_carriers_by_groups_equal_one_sequence(spark):
    """Molecules that exchange no protons are worked on apart, and carriers have the numbers that one pass over all hops gives them."""
    rnd = random.Random(12)
    rows, holders, want = [], [], []
    for traj in ("a", "b"):
        holder = {p: rnd.randrange(12) for p in range(30)}
        hops, first = [], dict(holder)
        for f in range(12):
            for p in range(30):
                if f and rnd.random() < 0.15:
                    to = holder[p] // 4 * 4 + rnd.randrange(4)  # three groups of four molecules
                    if to != holder[p]:
                        hops.append((f, p, holder[p], to))
                        holder[p] = to
                rows.append((traj, f, p, holder[p]))
            holders += [(traj, f, m) for m in range(13)]
        state = transfers.Carriers({m: sum(v == m for v in first.values()) - 2 for m in range(13)})
        for f in range(12):
            for _, _, d, a in (h for h in hops if h[0] == f):
                state.hop(d, a)
            want += [(traj, f, c, m, state.sign[c]) for c, m in state.holder.items()]
    assigned = spark.createDataFrame(rows, "traj string, frame long, proton long, acceptor_mol long")
    mols = spark.createDataFrame(holders, "traj string, frame long, mol long")
    got = transfers.charge_track(assigned, mols, 2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
