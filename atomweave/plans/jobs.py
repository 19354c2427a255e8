"""The registry of analyses: typed parameters with defaults and checks, and what each returns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, box_columns
from ..operators import graphs, series, topology, transfers, voronoi
from ..operators.cells import pairs_within
from ..operators.histograms import Bins, simple
from ..operators.staging import staged
from . import analyses
from .system import FRAME, System

REGISTRY: dict[str, Analysis] = {}


@dataclass(frozen=True)
class Analysis:
    """A protocol of two parts: parameters, and a function from system and parameters to named result tables."""

    name: str
    title: str
    parameters: type
    run: Callable[[System, object], dict[str, DataFrame]]


def p(default, least=None, choices=None):
    meta = {"least": least, "choices": choices}
    return field(default_factory=lambda: default, metadata=meta) if isinstance(default, (list, dict)) else field(default=default, metadata=meta)


def checked(f, v):
    """The value of a parameter's field in its type, if it is allowed."""
    kind = f.type if isinstance(f.type, str) else f.type.__name__
    if kind in ("int", "float", "bool", "str"):
        if kind == "bool" and not isinstance(v, bool):
            raise ValueError(f"{f.name} has to be true or false")
        try:
            v = {"int": int, "float": float, "bool": bool, "str": str}[kind](v)
        except (TypeError, ValueError):
            raise ValueError(f"{f.name} has to be of type {kind}") from None
    least, choices = f.metadata.get("least"), f.metadata.get("choices")
    if least is not None and v < least:
        raise ValueError(f"{f.name} has to be at least {least}")
    if choices and v not in choices:
        raise ValueError(f"{f.name} has to be one of {', '.join(choices)}")
    return v


@dataclass
class Parameters:
    """Which frames are worked on: from ``start_frame`` on (1 is the first), ``nframes`` read (-1: all), every ``frame_stride``-th."""

    start_frame: int = p(1, least=1)
    nframes: int = p(-1)
    frame_stride: int = p(1, least=1)
    update_compounds: bool = p(False)

    def __post_init__(self):
        for f in fields(self):
            setattr(self, f.name, checked(f, getattr(self, f.name)))

    @classmethod
    def of(cls, given: dict) -> Parameters:
        """From a mapping; unknown names are an error, missing ones take their defaults."""
        names = {f.name for f in fields(cls)}
        if set(given) - names:
            raise ValueError(f"unknown parameters: {sorted(set(given) - names)}")
        need = [f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING and f.name not in given]
        if need:
            raise ValueError(f"missing parameters: {need}")
        return cls(**given)

    def frames(self) -> dict:
        return {"start": self.start_frame, "nframes": self.nframes, "stride": self.frame_stride, "update": self.update_compounds}


def analysis(name: str, title: str, parameters: type):
    def add(f):
        REGISTRY[name] = Analysis(name, title, parameters, f)
        return f

    return add


def run(name: str, system: System, given: dict | None = None) -> dict[str, DataFrame]:
    """Result tables of an analysis by their names; sinks write them as files."""
    if name not in REGISTRY:
        raise ValueError(f"no analysis {name}; there are {', '.join(REGISTRY)}")
    a = REGISTRY[name]
    return a.run(system, a.parameters.of(given or {}))


def _scaled(s: System, v: float):
    """A length in coordinate units: whole where these are."""
    return int(round(v * s.unit)) if s.unit > 1 else v


@dataclass
class Pair(Parameters):
    ref_compound: int = p(1, least=1)
    ref_labels: str = p("O")
    obs_compound: int = p(1, least=1)
    obs_labels: str = p("H")

    def chosen(self, s: System):
        return s.choose(self.ref_compound, self.ref_labels), s.choose(self.obs_compound, self.obs_labels)

    def table(self, s: System):
        a, b = self.chosen(s)
        return s.table(**self.frames(), needed=(a, b)), a, b


@dataclass
class Rdf(Pair):
    rmax: float = p(10.0, least=0.1)
    bins: int = p(500, least=1)


@analysis("rdf", "radial distribution function", Rdf)
def rdf(s: System, q: Rdf) -> dict[str, DataFrame]:
    atoms, a, b = q.table(s)
    return {"rdf": analyses.rdf(atoms, a, b, s.lengths, q.rmax, q.bins, s.unit, s.box)}


@dataclass
class Adf(Parameters):
    ref_compound: int = p(1, least=1)
    obs_compound: int = p(1, least=1)
    base1: str = p("O1")
    base1_from: str = p("r", choices=("r", "o"))
    tip1: str = p("H1")
    tip1_from: str = p("r", choices=("r", "o"))
    base2: str = p("O1")
    base2_from: str = p("o", choices=("r", "o"))
    tip2: str = p("H1")
    tip2_from: str = p("o", choices=("r", "o"))
    shared: bool = p(False)
    v1_cutoff: float = p(0.0, least=0.0)
    v2_cutoff: float = p(0.0, least=0.0)
    bins: int = p(180, least=1)


@analysis("adf", "angle between two vectors", Adf)
def adf(s: System, q: Adf) -> dict[str, DataFrame]:
    number = {"r": q.ref_compound, "o": q.obs_compound}
    ends = {}
    for end, labels, source in (("b1", q.base1, q.base1_from), ("t1", q.tip1, q.tip1_from), ("b2", q.base2, q.base2_from), ("t2", q.tip2, q.tip2_from)):
        ends[end] = (source, s.choose(number[source], labels))
    atoms = s.table(**q.frames(), needed=[c for _, c in ends.values()])
    return {"adf": analyses.adf(atoms, ends, s.lengths, q.bins, _scaled(s, q.v1_cutoff), _scaled(s, q.v2_cutoff), q.shared)}


@dataclass
class Three(Parameters):
    centre_compound: int = p(1, least=1)
    centre_labels: str = p("O")
    first_compound: int = p(1, least=1)
    first_labels: str = p("H")
    second_compound: int = p(1, least=1)
    second_labels: str = p("H")
    first_min: float = p(0.0, least=0.0)
    first_max: float = p(3.5, least=0.0)
    second_min: float = p(0.0, least=0.0)
    second_max: float = p(3.5, least=0.0)
    different_molecules: bool = p(True)
    bins: int = p(180, least=1)

    def parts(self, s: System):
        c = [s.choose(n, x) for n, x in ((self.centre_compound, self.centre_labels), (self.first_compound, self.first_labels), (self.second_compound, self.second_labels))]
        cuts = [(_scaled(s, a), _scaled(s, b)) for a, b in ((self.first_min, self.first_max), (self.second_min, self.second_max))]
        return s.table(**self.frames(), needed=c), c, cuts


@analysis("adf3b", "neighbour, centre, neighbour angle", Three)
def adf3b(s: System, q: Three) -> dict[str, DataFrame]:
    atoms, c, cuts = q.parts(s)
    return {"adf3b": analyses.adf3b(atoms, *c, s.lengths, *cuts, q.different_molecules, q.bins)}


@dataclass
class Density(Parameters):
    axis: str = p("z", choices=AXES)
    step: float = p(0.1, least=1e-6)
    per_compound: bool = p(False)


@analysis("dens", "density of centres of mass along an axis", Density)
def dens(s: System, q: Density) -> dict[str, DataFrame]:
    atoms = staged(s.table(**q.frames()), "dens")
    kinds = atoms.select(*FRAME, "mol", F.concat_ws("\t", "key", "formula").alias("rep")).distinct()
    out = analyses.density(atoms, kinds, s.lengths, q.axis, q.step, s.unit, s.box)
    if q.per_compound:  # over the frames that have the compound
        frames = kinds.groupBy("rep").agg(F.count_distinct(*FRAME).alias("own"))
        every = atoms.agg(F.count_distinct(*FRAME).alias("all"))
        out = out.join(frames, "rep").join(F.broadcast(every)).withColumn("value", F.col("value") * F.col("all") / F.col("own"))
    part = F.split("rep", "\t")
    return {"density": out.select("bin", "r", part[0].alias("comp_key"), part[1].alias("rep"), "value")}


@dataclass
class Percolation(Parameters):
    compounds: list = p([1])
    acceptors: list = p(["O"])
    protons: list = p(["H"])
    cutoff: float = p(2.5, least=0.1)
    max_depth: int = p(5, least=1)
    alternating: bool = p(False)


def _either(choices):
    """A condition: an atom is of one of the choices; choices without a label are left out."""
    out = F.lit(False)
    for c in choices:
        out = out | c.fits()
    return out


@analysis("percolation", "molecules reachable along hydrogen bonds", Percolation)
def percolation(s: System, q: Percolation) -> dict[str, DataFrame]:
    if not len(q.compounds) == len(q.acceptors) == len(q.protons):
        raise ValueError("every compound has acceptors and protons (which may be empty)")
    acceptors = [s.choose(n, x) for n, x in zip(q.compounds, q.acceptors, strict=True)]
    protons = [s.choose(n, x) for n, x in zip(q.compounds, q.protons, strict=True)]
    atoms = s.table(**q.frames(), needed=acceptors, together=False)
    a, h = atoms.where(_either(acceptors)), atoms.where(_either(protons))
    both = a.select(*FRAME).distinct().join(h.select(*FRAME).distinct(), FRAME)
    near = pairs_within(a, h, _scaled(s, q.cutoff), s.lengths).where("a_mol <> b_mol")
    edges = near.select(*FRAME, F.col("b_mol").alias("src"), F.col("a_mol").alias("dst"))
    if not q.alternating:
        edges = edges.union(edges.select(*FRAME, "dst", "src"))
    starts = a.join(both, FRAME, "left_semi").select(*FRAME, F.col("mol").alias("node"))
    return {"percolation": graphs.percolation(starts, edges, q.max_depth)}


@dataclass
class Cluster(Parameters):
    compounds: list = p([1])
    labels: list = p(["O"])
    cutoffs: dict = p({})
    graph_hash: bool = p(True)
    errors: bool = p(False)
    cacf: bool = p(True)
    cacf_depth: int = p(100, least=1)
    coordinates: str = p("no", choices=("no", "selected", "whole"))
    drawings: bool = p(False)


def grouped(s: System, atoms: DataFrame, compounds: list, labels: list) -> DataFrame:
    """Atoms with ``disp``, the number of their compound in the list, and ``grp``, "number-pattern".

    An atom that fits several patterns stands in each group; of these the first counts.
    """
    names = []
    for n, number in enumerate(compounds):
        for pattern in [x.strip() for x in labels[n].split(",") if x.strip()]:
            c = s.choose(number, pattern)
            names.append(F.when(c.fits(), F.struct(F.lit(n + 1).alias("disp"), F.lit(f"{n + 1}-{pattern}").alias("grp"))))
    every = F.filter(F.array(*names), lambda x: x.isNotNull())
    return atoms.withColumn("_g", F.get(every, F.lit(0))).where("_g is not null").select(*atoms.columns, "_g.disp", "_g.grp")


@analysis("cluster", "clusters of atoms of different compounds", Cluster)
def cluster(s: System, q: Cluster) -> dict[str, DataFrame]:
    if len(q.compounds) != len(q.labels):
        raise ValueError("every compound has labels")
    cut = {}
    for a in range(1, len(q.compounds) + 1):
        for b in range(a + 1, len(q.compounds) + 1):
            cut[str(a), str(b)] = _scaled(s, float(q.cutoffs.get(f"{a}-{b}", q.cutoffs.get(f"{b}-{a}", 0.0))))
    atoms = s.table(**q.frames(), needed=[s.choose(n, x) for n, x in zip(q.compounds, q.labels, strict=True)])
    nodes = staged(grouped(s, atoms, q.compounds, q.labels).withColumn("d", F.col("disp").cast("string")), "cluster-nodes")
    small = nodes.select(*FRAME, "atom", "d", *AXES, *box_columns(s.lengths))
    widest = max(cut.values(), default=0)
    edges = nodes.select(*FRAME, F.col("atom").alias("src"), F.col("atom").alias("dst")).limit(0)
    if widest > 0:
        edges = graphs.cutoff_edges(pairs_within(small, small, widest, s.lengths).where("a_d < b_d"), cut, "d")
    edges = staged(edges.distinct(), "cluster-edges")
    comp = staged(graphs.components(nodes, edges), "cluster-comps")
    found = graphs.clusters(nodes, edges, "grp", comp)
    if q.graph_hash:
        own = nodes.drop("mol").join(comp.withColumnRenamed("comp", "mol"), [*FRAME, "atom"]).select(*FRAME, "mol", "atom", "sym")
        ids = topology.graph_hashes(own, edges.toDF(*FRAME, "a", "b"), element=False).withColumnRenamed("mol", "comp")
        found = found.join(ids.withColumnRenamed("hash", "graph_id"), [*FRAME, "comp"])
    else:
        found = found.withColumn("graph_id", F.lit("0"))
    found = staged(found, "clusters")
    by = ["composition", "graph_id"]
    frames = nodes.agg(F.count_distinct(*FRAME).alias("frames"))
    member = nodes.select(*FRAME, "atom", "grp").join(comp, [*FRAME, "atom"]).join(found, [*FRAME, "comp"])
    if not q.errors:  # all frames count as one
        member = member.withColumns({"traj": F.lit(""), "frame": F.lit(0)})
        frames = 1
    out = {
        "cluster_occurrences": graphs.occurrences(found, frames, by).select(*by, "occurrences", "mean", "std"),
        "cluster_populations": graphs.populations(member, by).select(*by, F.col("grp").alias("atom_label"), "mean", "std"),
        "cluster_size": graphs.populations(member, "size").select("size", F.col("grp").alias("atom_label"), "mean", "std"),
    }
    if q.cacf:
        out["cacf"] = cluster_correlation(found, nodes, q.cacf_depth)
    if q.drawings:
        out |= cluster_graphs(found, nodes, edges, comp, out["cluster_occurrences"])
    if q.coordinates != "no":
        out["cluster_xyz"] = cluster_coordinates(s, atoms, nodes, comp, found, q.coordinates == "whole")
    return out


def cluster_correlation(found: DataFrame, atoms: DataFrame, depth: int) -> DataFrame:
    """``composition, graph_id, tau, c``: how long clusters of the same atoms live, a curve for every composition and graph."""
    by = ["composition", "graph_id"]
    order = W.partitionBy("traj").orderBy("frame")
    times = atoms.select(*FRAME).distinct().withColumn("t", F.row_number().over(order) - 1)
    total = times.groupBy("traj").agg(F.count("*").alias("n")).agg(F.max("n").alias("frames"))
    seen = staged(found.join(times, FRAME).select("traj", *by, "instance", "t").distinct(), "cluster-seen")
    keys = ["traj", *by, "instance"]
    ahead = seen.select(*keys, F.col("t").alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("tau")).withColumn("t", F.col("_t") + F.col("tau"))
    n = ahead.join(seen, [*keys, "t"]).groupBy(*by, "tau").agg(F.count("*").alias("n"))
    series_ = seen.groupBy(*by).agg(F.count_distinct("traj", "instance").alias("series"))
    lags = seen.sparkSession.range(depth).select(F.col("id").cast("int").alias("tau"))
    rows = series_.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(lags)).where("tau < frames").join(n, [*by, "tau"], "left")  # kinds x lags
    c = rows.withColumn("c", F.coalesce("n", F.lit(0)) / (F.col("series") * (F.col("frames") - F.col("tau"))))
    zero = F.max(F.when(F.col("tau") == 0, F.col("c"))).over(W.partitionBy(*by))
    return c.select(*by, "tau", F.when(zero != 0, F.col("c") / zero).otherwise(F.col("c")).alias("c"))


#: Kinds of clusters that are drawn: the most frequent ones.
DRAWN = 201


def cluster_graphs(found: DataFrame, nodes: DataFrame, edges: DataFrame, comp: DataFrame, kinds: DataFrame) -> dict[str, DataFrame]:
    """Atoms and bonds of one example of each of the most frequent kinds, numbered from 0: ``rank, composition, atom, sym, grp`` and ``rank, src, dst``."""
    by = ["composition", "graph_id"]
    order = W.partitionBy().orderBy(F.desc("occurrences"), *by)
    top_ = kinds.orderBy(F.desc("occurrences"), *by).limit(DRAWN).withColumn("rank", F.row_number().over(order) - 1)  # a report of the first kinds
    one = found.join(top_.select("rank", *by), by).groupBy("rank", *by).agg(F.min(F.struct(*FRAME, "comp")).alias("e")).select("rank", "composition", "e.*")
    atoms = nodes.select(*FRAME, "atom", "sym", "grp").join(comp, [*FRAME, "atom"]).join(one, [*FRAME, "comp"])
    bonds = edges.join(comp.withColumnRenamed("atom", "src"), [*FRAME, "src"]).join(one, [*FRAME, "comp"])
    return {"cluster_nodes": atoms.select("rank", "composition", "atom", "sym", "grp"), "cluster_edges": bonds.select("rank", "src", "dst")}


def cluster_coordinates(s: System, atoms: DataFrame, nodes: DataFrame, comp: DataFrame, found: DataFrame, whole: bool) -> DataFrame:
    """``composition, graph_id, frame, comp, n, sym, x, y, z`` of clusters of more than one atom: followed through the walls atom by atom, centred on their mean."""
    own = nodes.select(*FRAME, "atom", "mol").join(comp, [*FRAME, "atom"]).join(found.where("size > 1").select(*FRAME, "comp", "composition", "graph_id"), [*FRAME, "comp"])
    if whole:
        mols = own.select(*FRAME, "mol", F.col("comp").alias("cluster"), "composition", "graph_id").distinct()
        rows = atoms.withColumnRenamed("comp", "kind").join(mols, [*FRAME, "mol"])
    else:
        mols = own.select(*FRAME, "atom", F.col("comp").alias("cluster"), "composition", "graph_id")
        rows = atoms.withColumnRenamed("comp", "kind").join(mols, [*FRAME, "atom"])
    order = W.partitionBy(*FRAME, "cluster").orderBy("kind", "mol", "atom")
    rows = rows.withColumn("n", F.row_number().over(order))
    path = series.unwrapped(rows, ["traj", "frame", "cluster", "composition", "graph_id"], s.lengths, "n")
    every = W.partitionBy(*FRAME, "cluster")
    path = path.join(rows.select(*FRAME, "cluster", "n", "sym"), [*FRAME, "cluster", "n"])
    centred = [((F.col(k) - F.avg(k).over(every)) / s.unit).alias(k) for k in AXES]
    return path.select("composition", "graph_id", "traj", "frame", F.col("cluster").alias("comp"), "n", "sym", *centred)


@dataclass
class Dacf(Pair):
    cutoff: float = p(3.5, least=0.1)
    continuous: bool = p(False)
    depth: int = p(100, least=1)
    correction: bool = p(True)
    frame_time: float = p(1.0, least=1e-9)
    global_mode: bool = p(True)


@analysis("dacf", "autocorrelation of dimers", Dacf)
def dacf(s: System, q: Dacf) -> dict[str, DataFrame]:
    a, b = q.chosen(s)
    if q.global_mode:  # frames without the compounds count, with no dimer in them
        atoms = staged(s.table(**q.frames()), "dacf")
    else:
        atoms = staged(s.table(**q.frames(), needed=(a, b)), "dacf")
    ref, obs = a.of(atoms), b.of(atoms)
    frames = atoms.select(*FRAME).distinct()
    if not q.global_mode:
        frames = frames.join(ref.select(*FRAME).distinct(), FRAME, "left_semi").join(obs.select(*FRAME).distinct(), FRAME, "left_semi")
    times = frames.withColumn("t", F.row_number().over(W.partitionBy("traj").orderBy("frame")) - 1)
    near = pairs_within(ref, obs, _scaled(s, q.cutoff), s.lengths).where("a_atom <> b_atom")
    keys = ["traj", "a_atom", "b_atom"]
    presence = staged(near.join(times, FRAME).select(*keys, "t"), "dimers")
    sizes = analyses.per_frame(ref, obs).first()
    total = times.groupBy("traj").count().agg(F.max("count")).first()[0] or 0
    trajs = max(1, frames.select("traj").distinct().count())
    pairs = float((sizes.n_ref or 0) * (sizes.n_obs or 0)) * trajs
    if not total or not pairs:
        raise ValueError("no frame has both selections")
    c = series.continuous(presence, keys, total, q.depth) if q.continuous else series.intermittent(presence, keys, total, pairs, q.depth, q.correction)
    return {"dacf": c.select("tau", (F.col("tau") * q.frame_time / 1000).alias("t_ps"), "c")}


@dataclass
class Top(Parameters):
    ref_compound: int = p(1, least=1)
    ref_labels: str = p("O")
    obs_compounds: list = p([1])
    obs_labels: list = p(["O"])
    cutoff: float = p(0.0, least=0.0)
    q_bins: int = p(100, least=1)
    s_bins: int = p(10000, least=1)


@analysis("top", "tetrahedral order", Top)
def top(s: System, q: Top) -> dict[str, DataFrame]:
    a = s.choose(q.ref_compound, q.ref_labels)
    obs = [s.choose(n, x) for n, x in zip(q.obs_compounds, q.obs_labels, strict=True)]
    atoms = s.table(**q.frames(), needed=(a, *obs))
    orders = staged(analyses.tetrahedral(atoms, a, obs, s.lengths, _scaled(s, 3.5), _scaled(s, q.cutoff) if q.cutoff else None), "orders")
    kind = lambda name, f, n: analyses.top(orders, f, n).select(F.lit(name).alias("kind"), "bin", "center", "p")
    return {"top": kind("q", "q", q.q_bins).unionByName(kind("S", "s", q.s_bins))}


@dataclass
class Pccf(Parameters):
    acceptor_compound: int = p(1, least=1)
    acceptor_labels: str = p("O")
    proton_compound: int = p(1, least=1)
    proton_labels: str = p("H")
    molecules: bool = p(True)
    cutoff: float = p(1.2, least=0.1)
    dwell: int = p(2, least=1)
    squash: int = p(10, least=0)
    gaps: str = p("100")

    def __post_init__(self):
        super().__post_init__()
        if self.update_compounds:
            raise ValueError("this analysis needs one topology for all frames")


@analysis("pccf", "chains of proton transfers", Pccf)
def pccf(s: System, q: Pccf) -> dict[str, DataFrame]:
    a, h = s.choose(q.acceptor_compound, q.acceptor_labels), s.choose(q.proton_compound, q.proton_labels)
    atoms = s.table(**q.frames())
    held = transfers.assign_within(h.of(atoms), a.of(atoms), _scaled(s, q.cutoff), s.lengths)
    events = staged(transfers.squash(transfers.transfer_events(held, "acceptor_mol" if q.molecules else "acceptor", q.dwell), q.squash), "transfers")
    out = None
    for gap in [int(g) for g in q.gaps.split(",") if g.strip().isdigit()]:  # what is no number is left out
        c = transfers.chains(events, gap).select(F.lit(gap).alias("gap"), "n", "c", "total")
        out = c if out is None else out.unionByName(c)
    if out is None:
        raise ValueError("no gap is given")
    return {"pt_chains": out, "pt_events": events}


@dataclass
class Charges(Parameters):
    acceptor_compounds: list = p([1])
    acceptor_labels: list = p(["O"])
    proton_compounds: list = p([1])
    proton_labels: list = p(["H"])
    cutoff: float = p(1.2, least=0.1)
    label_cutoffs: dict = p({})
    neutral: int = p(2, least=0)
    max_lag: int = p(1000, least=2)

    def __post_init__(self):
        super().__post_init__()
        if self.update_compounds:
            raise ValueError("this analysis needs one topology for all frames")


@analysis("cmsd", "charge carriers and their displacement", Charges)
def cmsd(s: System, q: Charges) -> dict[str, DataFrame]:
    acceptors = [s.choose(n, x) for n, x in zip(q.acceptor_compounds, q.acceptor_labels, strict=True)]
    protons = [s.choose(n, x) for n, x in zip(q.proton_compounds, q.proton_labels, strict=True)]
    atoms = staged(s.table(**q.frames()), "charges")
    times = atoms.select(*FRAME).distinct().withColumn("t", (F.row_number().over(W.partitionBy("traj").orderBy("frame")) - 1).cast("long"))
    atoms = atoms.join(times, FRAME).withColumn("frame", F.col("t")).drop("t")  # frames are counted as they are processed
    a, h = atoms.where(_either(acceptors)), atoms.where(_either(protons))
    cuts = {k: _scaled(s, float(v)) for k, v in q.label_cutoffs.items()} or None
    held = staged(transfers.assign_always(h, a, _scaled(s, q.cutoff), s.lengths, cuts), "held")
    track = staged(transfers.charge_track(held, a, q.neutral), "track")
    paths = transfers.charge_paths(track, transfers.holder_centres(a, s.lengths), s.lengths)
    msd = series.mean_squared_displacement(paths, ["traj", "cid"], q.max_lag, by=("sign",))
    lags = atoms.sparkSession.range(1, q.max_lag).select(F.col("id").cast("int").alias("tau"))
    value = lambda sign: F.coalesce(F.max(F.when(F.col("sign") == sign, F.col("msd"))), F.lit(0.0)) / (s.unit * s.unit)
    wide = lags.join(msd, "tau", "left").groupBy("tau").agg(value(1).alias("msd_pos"), value(-1).alias("msd_neg"))
    w = W.partitionBy("traj", "cid").orderBy("frame")
    moves = track.withColumn("before", F.lag("mol").over(w)).where("before is null or before <> mol")
    return {"charge_track": moves.select("traj", "cid", "frame", "mol", "sign"), "charge_msd": wide}


@dataclass
class Ncount(Parameters):
    ref_compound: int = p(1, least=1)
    ref_labels: str = p("O")
    obs_compounds: list = p([1])
    obs_labels: list = p(["H"])
    cutoff: float = p(3.5, least=0.1)
    exclude_same_molecule: bool = p(True)


@analysis("ncount", "distribution of neighbour counts", Ncount)
def ncount(s: System, q: Ncount) -> dict[str, DataFrame]:
    a = s.choose(q.ref_compound, q.ref_labels)
    obs = [s.choose(n, x) for n, x in zip(q.obs_compounds, q.obs_labels, strict=True)]
    atoms = s.table(**q.frames(), needed=(a, *obs))
    return {"ncount": analyses.ncount(atoms, a, obs, s.lengths, _scaled(s, q.cutoff), not q.exclude_same_molecule)}


@dataclass
class Cdf(Three):
    distance_min: float = p(0.0, least=0.0)
    distance_max: float = p(10.0, least=0.1)
    distance_bins: int = p(200, least=1)
    angle_bins: int = p(180, least=1)


@analysis("cdf", "distance and angle of the same triplets", Cdf)
def cdf(s: System, q: Cdf) -> dict[str, DataFrame]:
    atoms, c, cuts = q.parts(s)
    return {"cdf": analyses.cdf(atoms, *c, s.lengths, *cuts, Bins(q.distance_min, q.distance_max, q.distance_bins), Bins(0.0, 180.0, q.angle_bins), s.unit)}


@dataclass
class Voro(Parameters):
    low: float = p(0.0)
    high: float = p(4.0)
    min_distance: float = p(0.8, least=0.0)
    bins: int = p(0, least=0)
    compactness_bins: int = p(100, least=1)


@analysis("voro2d", "Voronoi cells of a slab", Voro)
def voro2d(s: System, q: Voro) -> dict[str, DataFrame]:
    """Areas, distributions of cells, molecules and clusters, numbers of clusters, and compactness, by compound."""
    atoms = s.table(**q.frames())
    cells = voronoi.voronoi_cells(atoms, s.lengths, _scaled(s, q.low), _scaled(s, q.high), q.min_distance, s.unit)
    kinds = atoms.select(*FRAME, "atom", F.col("formula").alias("kind"))
    cells = staged(cells.join(kinds, [*FRAME, "atom"]), "voronoi")
    top_ = math.ceil(s.box[0] * s.box[1] / s.unit**2 / 100) * 100
    spec, round_ = Bins(0.0, float(top_), q.bins or 2 * top_), Bins(0.0, 1.0, q.compactness_bins)
    edges = staged(voronoi.same_kind_edges(cells, "kind"), "voronoi-edges")
    comp = staged(graphs.components(cells, edges).join(cells.select(*FRAME, "atom", "kind", "area"), [*FRAME, "atom"]), "voronoi-clusters")
    per_cluster = comp.groupBy(*FRAME, "kind", "comp").agg(F.sum("area").alias("area"))
    per_mol = cells.groupBy(*FRAME, "kind", "mol").agg(F.sum("area").alias("area"))

    def share(values: DataFrame, field_: str, bins: Bins) -> DataFrame:
        h = simple(values, field_, bins, ("kind",))
        total = F.sum("count").over(W.partitionBy("kind"))
        return h.select("kind", "bin", bins.centre(F.col("bin")).alias("center"), (F.col("count") / total).alias("p"))

    counts = per_cluster.groupBy(*FRAME, "kind").agg(F.count("*").alias("n")).groupBy("kind", "n").agg(F.count("*").alias("frames"))
    shapes = voronoi.compactness(cells, comp.select(*FRAME, "atom", "comp"))
    whole = voronoi.compactness(cells, cells.select(*FRAME, "atom", F.lit(0).alias("comp")))
    return {
        "voronoi_areas": voronoi.running_areas(cells, "kind"),
        "voronoi_area_distributions": share(cells, "area", spec),
        "voronoi_molecular_distributions": share(per_mol, "area", spec),
        "voronoi_cluster_distributions": share(per_cluster, "area", spec),
        "voronoi_cluster_counts": counts.select("kind", "n", (100 * F.col("frames") / F.sum("frames").over(W.partitionBy("kind"))).alias("pct")),
        "voronoi_cluster_compactness": share(shapes, "q", round_),
        "voronoi_global_compactness": share(whole, "q", round_),
    }


__all__ = ["REGISTRY", "Analysis", "Parameters", "run"]
