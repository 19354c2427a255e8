"""Whole analyses: from files through the registry to result files; topology, parameters, settings."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from atomweave.cli import main
from atomweave.config import EngineConfig
from atomweave.operators import compounds as cp
from atomweave.operators import topology
from atomweave.operators.compounds import matching
from atomweave.plans import jobs
from atomweave.plans.system import System, processed_frames
from atomweave.sources.sinks import SINKS, compound_lines

L = 12.0


def waters(seed, n=6, frames=4):
    """Frames of water molecules that wobble, on a grid so that they stay apart."""
    rnd = random.Random(seed)
    spots = rnd.sample(list(itertools.product(range(3), repeat=3)), n)
    out = []
    for _ in range(frames):
        rows = []
        for s in spots:
            c = [4 * k + 1.0 + 0.1 * rnd.random() for k in s]
            for sym, d in (("O", (0, 0, 0)), ("H", (0.96, 0, 0)), ("H", (-0.24, 0.93, 0))):
                rows.append((sym, *[(x + y) % L for x, y in zip(c, d, strict=True)]))
        out.append(rows)
    return out


def xyz(path, frames):
    path.write_text("".join(f"{len(rows)}\nc\n" + "".join(f"{s} {x} {y} {z}\n" for s, x, y, z in rows) for rows in frames))
    return str(path)


def dump(path, frames):
    head = "ITEM: TIMESTEP\n{}\nITEM: NUMBER OF ATOMS\n{}\nITEM: BOX BOUNDS pp pp pp\n0 12\n0 12\n0 12\nITEM: ATOMS element x y z\n"
    path.write_text("".join(head.format(t, len(rows)) + "".join(f"{s} {x} {y} {z}\n" for s, x, y, z in rows) for t, rows in enumerate(frames)))
    return str(path)


def system(spark, frames, **more):
    rows = [("t", f, n, r[0], *map(float, r[1:])) for f, own in enumerate(frames) for n, r in enumerate(own)]
    atoms = spark.createDataFrame(rows, "traj string, frame long, atom long, sym string, x double, y double, z double")
    return System(atoms, (L, L, L), **more)


SMALL = {
    "rdf": {"bins": 50, "rmax": 5.0}, "adf": {}, "adf3b": {"different_molecules": False}, "dens": {"step": 1.0}, "percolation": {"cutoff": 4.0},
    "cluster": {"compounds": [1, 1], "labels": ["O", "H"], "cutoffs": {"1-2": 3.2}, "errors": True, "cacf_depth": 3, "coordinates": "whole", "drawings": True},
    "dacf": {"cutoff": 4.0, "depth": 3}, "top": {"s_bins": 50, "obs_compounds": [1, 1], "obs_labels": ["O", "H"]}, "pccf": {"gaps": "10,20,x"}, "cmsd": {"max_lag": 3, "neutral": 1, "label_cutoffs": {"O": 1.3}},
    "ncount": {}, "cdf": {"different_molecules": False, "distance_bins": 4, "angle_bins": 4, "distance_max": 4.0}, "voro2d": {"low": 0.0, "high": 12.0, "bins": 10, "compactness_bins": 5},
}


@pytest.fixture(scope="module")
def water(spark):
    return system(spark, waters(1, frames=3))


@pytest.mark.parametrize("name", list(jobs.REGISTRY))
def test_every_analysis_writes_its_files(water, tmp_path, name):
    q = jobs.REGISTRY[name].parameters.of(SMALL[name])
    files = SINKS[name](jobs.REGISTRY[name].run(water, q), q, str(tmp_path), water.box)
    assert files
    for f in files:
        text = open(f, encoding="utf-8").read()
        assert len(text.splitlines()) >= 2 and "nan" not in text.lower()


def test_a_dump_with_named_answers(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"analysis": "rdf", "draw_compounds": "y", "parameters": SMALL["rdf"]}))
    files = main([dump(tmp_path / "a.lmp", waters(1, frames=2)), "-i", str(tmp_path / "in.json"), "-l", str(tmp_path / "log"), "-o", str(tmp_path / "out")], spark)
    assert [f.rsplit("/", 1)[1] for f in files] == ["rdf_O_H.dat"] and len(open(files[0], encoding="utf-8").read().splitlines()) == 51
    drawn = (tmp_path / "out" / "compound1.svg").read_text()
    assert drawn.count("<circle") == 3 and drawn.count("<line") == 2 and ">O1<" in drawn


def test_every_frame_of_a_dump_has_its_own_box(spark, tmp_path):
    head = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 {b}\n0 {b}\n0 {b}\nITEM: ATOMS element x y z\nO 0.5 1 1\nH 9.7 1 1\n"
    (tmp_path / "a.lammpstrj").write_text("".join(head.format(t=t, b=b) for t, b in enumerate((10, 20))))
    answers = {"analysis": "rdf", "parameters": {"ref_compound": 1, "ref_labels": "O", "obs_compound": 1, "obs_labels": "H", "rmax": 10.0, "bins": 100}}
    (tmp_path / "in.json").write_text(json.dumps(answers))
    main([str(tmp_path / "a.lammpstrj"), "-i", str(tmp_path / "in.json"), "-l", str(tmp_path / "log"), "-o", str(tmp_path / "out")], spark)
    rows = [list(map(float, x.split())) for x in next((tmp_path / "out").glob("*.dat")).read_text().splitlines() if x[0] != "#"]
    seen = [r[0] for r in rows if r[1] > 0]
    assert any(abs(r - 0.8) < 0.11 for r in seen) and any(abs(r - 9.2) < 0.11 for r in seen) and len(seen) <= 4


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from atomweave.operators import graphs

    order = random.Random(1).sample(range(1, 1000), 999)
    chain = [0, *order]
    a = spark.createDataFrame([("t", 0, k) for k in range(1000)], "traj string, frame long, atom long")
    rounds, kept = [], graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df, name: (rounds.append(name), kept(df, name))[1])
    one = spark.createDataFrame([("t", 0, p, q) for p, q in zip(chain, chain[1:], strict=False)], "traj string, frame long, src long, dst long")
    assert {r.seed for r in topology.seeds(a, one).collect()} == {0} and rounds.count("paths") <= 12
    rounds.clear()
    both = one.union(one.select("traj", "frame", "dst", "src"))
    assert {r.seed for r in topology.seeds(a, both).collect()} == {0} and rounds.count("small-star") <= 12


def test_recorded_answers_give_the_same_again(spark, tmp_path):
    path, asked = xyz(tmp_path / "a.xyz", waters(2, frames=2)), []
    given = {"box": "12,12,12", "analysis": "ncount", "cutoff": "2.0", "exclude_same_molecule": "n"}

    wrong = {"box": "12,12", "analysis": "nothing", "cutoff": "-1", "topology_frame": "9", "exclude_same_molecule": "perhaps"}  # asked for again

    def ask(question):
        name = question.split(" [")[0]
        if name in wrong:
            return wrong.pop(name)
        asked.append(name)
        return given.get(asked[-1], "")

    one = main([path, "-l", str(tmp_path / "log"), "-o", str(tmp_path / "one")], spark, ask)
    two = main([path, "-i", str(tmp_path / "log"), "-l", str(tmp_path / "log2"), "-o", str(tmp_path / "two")], spark)
    lines = open(one[0], encoding="utf-8").read().splitlines()
    assert lines == ["# P(n)   cutoff = 2.00 Å", "#  n   P(n)", "  0  0.000000", "  1  0.000000", "  2  1.000000"]
    assert open(two[0], encoding="utf-8").read().splitlines() == lines and asked[:5] == ["box", "topology_frame", "break_bonds", "draw_compounds", "analysis"]
    assert (tmp_path / "log").read_text() == (tmp_path / "log2").read_text()


def test_golden_files(spark, tmp_path):
    s = system(spark, [[("O", 1, 1, 1), ("H", 2, 1, 1)]])
    assert [c.formula for c in s.compounds] == ["HO"]
    assert list(compound_lines(s)) == ["Compound 1: HO, Number: 1", "\nCompound 1 Bond Length Matrix:", "           H1       O1", "   H1      -     1.0000", "   O1   1.0000      -  "]
    q = jobs.REGISTRY["rdf"].parameters.of({"rmax": 4.0, "bins": 4})
    text = open(SINKS["rdf"](jobs.REGISTRY["rdf"].run(s, q), q, str(tmp_path), s.box)[0], encoding="utf-8").read().splitlines()
    g = 12**3 / (4 / 3 * math.pi * (2**3 - 1))
    assert text == ["# r/Å                 g(r)         N(r)", "0.500000         0.000000     0.000000", f"1.500000     {g:>12.6f}     1.000000", "2.500000         0.000000     1.000000", "3.500000         0.000000     1.000000"]


def test_static_and_dynamic_topology(spark):
    apart = waters(3, n=2, frames=3)
    o, h, k = apart[1][0], apart[1][1], apart[1][2]
    apart[1][1] = (h[0], (h[1] + 1.5) % L, h[2], h[3])  # in frame 1 a proton leaves its molecule
    s = system(spark, apart)
    assert [(c.comp, c.formula, c.n_members) for c in s.compounds] == [(1, "H2O", 2)]
    assert s.table().groupBy("frame").agg(F.count_distinct("mol").alias("n")).orderBy("frame").collect() == [(f, 2) for f in range(3)]
    other = s.at_frame(1)
    assert sorted(c.formula for c in other.compounds) == ["H", "H2O", "HO"]
    chosen = s.choose(1, "O")
    both = s.table(update=True, needed=[chosen])
    assert both.groupBy("frame").agg(F.count_distinct("mol").alias("n")).orderBy("frame").collect() == [(0, 2), (1, 3), (2, 2)]
    broken = s.without_bonds([(1, "O1", "H1")])
    assert sorted((c.formula, c.n_members) for c in broken.compounds) == [("H", 2), ("HO", 2)]
    with pytest.raises(ValueError):
        s.choose(0, "O")
    assert o and k


def test_frames_without_the_compound_are_passed_over():
    yes = [(f, f not in (2, 5)) for f in range(9)]
    assert processed_frames(yes) == [0, 1, 3, 4, 6, 7, 8]
    assert processed_frames(yes, stride=2) == [0, 3, 6, 8]
    assert processed_frames([(f, True) for f in range(12)], nframes=6, stride=2) == [0, 2, 4]
    assert processed_frames([(f, True) for f in range(12)], nframes=5, stride=2) == [0, 2, 4, 6, 8, 10]
    assert processed_frames(yes, nframes=0) == [] and processed_frames(yes, start=20) == []


def test_labels_of_a_compound_follow_its_first_molecule(spark):
    rnd = random.Random(5)
    base = [("C", 0, 0, 0), ("O", 1.2, 0, 0), ("H", -0.6, 0.9, 0), ("C", -0.7, -1.3, 0), ("H", -1.75, -1.2, 0), ("H", -0.3, -1.9, 0.8), ("H", -0.3, -1.9, -0.8)]
    rows = []
    for spot in ((3, 3, 3), (9, 3, 3), (3, 9, 9)):
        own = list(base)
        rnd.shuffle(own)
        rows += [(s, *[x + y for x, y in zip(p, spot, strict=True)]) for s, *p in own]
    s = system(spark, [rows])
    assert [(c.formula, c.n_members) for c in s.compounds] == [("C2H4O", 3)]
    lengths = s.topology.bond_lengths().collect()
    carbonyl = {(r.a_label, r.b_label) for r in lengths if "O1" in (r.a_label, r.b_label)}
    assert len(carbonyl) == 1 and len(lengths) == 6  # every label pair is one bond of the compound: labels agree in all members
    for _ in range(50):
        n = rnd.randint(2, 9)
        syms = [rnd.choice("CHO") for _ in range(n)]
        near = [[] for _ in range(n)]
        for i in range(1, n):
            for j in {rnd.randrange(i) for _ in range(rnd.randint(1, 2))}:
                near[i].append(j)
                near[j].append(i)
        to = list(range(n))
        rnd.shuffle(to)
        moved, near2 = [syms[to.index(k)] for k in range(n)], [[to[j] for j in near[to.index(k)]] for k in range(n)]
        got = matching(syms, near, moved, near2)
        assert got is not None and all(syms[got[k]] == moved[k] and {got[j] for j in near2[k]} == set(near[got[k]]) for k in range(n))
    assert matching(["C", "H"], [[1], [0]], ["C", "C"], [[1], [0]]) is None and matching(["C", "C", "C"], [[1], [0, 2], [1]], ["C", "C", "C"], [[1, 2], [0, 2], [0, 1]]) is None


def test_reach_equals_sequential_absorption(spark):
    rnd = random.Random(3)
    atoms, edges, want = [], [], {}
    for f in range(30):
        n = rnd.randint(1, 12)
        e = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 16))]
        atoms += [("t", f, k) for k in range(n)]
        edges += [("t", f, a, b) for a, b in e]
        least = list(range(n))
        for _ in range(n):
            for a, b in e:
                least[b] = min(least[b], least[a])
        want |= {(f, k): least[k] for k in range(n)}
    a = spark.createDataFrame(atoms, "traj string, frame long, atom long")
    e = spark.createDataFrame(edges, "traj string, frame long, src long, dst long")
    assert {(r.frame, r.atom): r.seed for r in topology.seeds(a, e).collect()} == want


def test_parameters_and_settings(tmp_path):
    of = jobs.REGISTRY["rdf"].parameters.of
    assert of({"bins": "20"}).bins == 20 and of({}).rmax == 10.0
    for wrong in ({"bins": 0}, {"rmax": "x"}, {"nothing": 1}, {"start_frame": 0}, {"update_compounds": "maybe"}):
        with pytest.raises(ValueError):
            of(wrong)
    with pytest.raises(ValueError):
        jobs.REGISTRY["pccf"].parameters.of({"update_compounds": True})
    with pytest.raises(ValueError):
        jobs.REGISTRY["dens"].parameters.of({"axis": "w"})
    (tmp_path / "c.json").write_text('{"EXCLUDED_ELEMENTS": ["O"], "BOND_DISTANCE_SCALE": 1.5}')
    c = EngineConfig.load(str(tmp_path / "c.json"))
    assert c.excluded == ("O",) and c.bond == 1.5 and c.search == EngineConfig().search
    (tmp_path / "d.json").write_text('{"SCALE": 1}')
    with pytest.raises(ValueError):
        EngineConfig.load(str(tmp_path / "d.json"))
    assert cp.Topology


@pytest.mark.parametrize("name", ["rdf", "adf3b", "ncount"])
def test_a_stopped_run_keeps_what_is_done_and_goes_on(spark, water, tmp_path, name):
    from atomweave.plans import chunks

    seen = []

    def stop(progress):
        seen.append((progress.done, progress.of))
        return progress.done == 1

    half, state = chunks.run(name, water, str(tmp_path / "parts"), SMALL[name], 1, stop)
    assert (state.done, state.of) == (1, 3) and seen == [(0, 3), (1, 3)]
    one = jobs.run(name, water, SMALL[name] | {"nframes": 1})
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(half[name]) == rounded(one[name])
    whole, state = chunks.run(name, water, str(tmp_path / "parts"), SMALL[name], 1)
    assert (state.done, state.of) == (3, 3) and rounded(whole[name]) == rounded(jobs.run(name, water, SMALL[name])[name])
    with pytest.raises(ValueError):
        chunks.run(name, water, str(tmp_path / "parts"), SMALL[name], 2)
