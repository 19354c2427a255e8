"""Proton transfer: assignment, dwell, squashing, chains; and charge carriers."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, box_columns, first_label, length_of, nearest_image
from .cells import nearest, pairs_within
from .graphs import components
from .staging import staged
from .topology import FRAME


def assign_within(protons: DataFrame, acceptors: DataFrame, r, box, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``traj, frame, proton, acceptor, acceptor_mol, d2``: the nearest acceptor within r; protons without one are absent.

    ``cutoffs`` gives label patterns of acceptors radii of their own, the first that fits; the others keep r.
    """
    best = F.min(F.struct("d2", F.col("b_atom").alias("acceptor"), F.col("b_mol").alias("acceptor_mol")))
    near = pairs_within(protons, acceptors, max([r, *(cutoffs or {}).values()]), box)
    if cutoffs:
        own = first_label(F.col("b_label"), cutoffs, r)
        near = near.where(F.col("d2") <= own * own)
    return near.groupBy(*FRAME, F.col("a_atom").alias("proton")).agg(best.alias("m")).select(*FRAME, "proton", "m.acceptor", "m.acceptor_mol", "m.d2")


def assign_always(protons: DataFrame, acceptors: DataFrame, r, box, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """As ``assign_within``, and where no acceptor is within r, the nearest of all."""
    acceptors = acceptors.hint("merge")  # see nearest
    near = staged(assign_within(protons, acceptors, r, box, cutoffs), "assigned")
    left = protons.join(near.select(*FRAME, F.col("proton").alias("atom")).hint("merge"), [*FRAME, "atom"], "left_anti").select(*protons.columns)
    far = nearest(left, acceptors, 1, box, 2 * r).select(*FRAME, F.col("a_atom").alias("proton"), F.col("b_atom").alias("acceptor"), F.col("b_mol").alias("acceptor_mol"), "d2")
    return near.unionByName(far)


def transfer_events(assigned: DataFrame, holder: str = "acceptor", dwell: int = 2) -> DataFrame:
    """``traj, frame, proton, donor, acceptor``: a change of holder after at least ``dwell`` bonded frames with the old one.

    Frames without a holder neither break nor extend a stay.
    """
    w = W.partitionBy("traj", "proton").orderBy("frame")
    change = F.coalesce((F.col(holder) != F.lag(holder).over(w)).cast("int"), F.lit(0))
    rows = assigned.select("traj", "frame", "proton", F.col(holder).alias("h"), change.alias("c")).withColumn("run", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    stay = rows.groupBy("traj", "proton", "run").agg(F.min("frame").alias("frame"), F.count("*").alias("n"), F.first("h").alias("h"))
    v = W.partitionBy("traj", "proton").orderBy("run")
    out = stay.select("traj", "frame", "proton", F.lag("h").over(v).alias("donor"), F.col("h").alias("acceptor"), F.lag("n").over(v).alias("n"))
    return out.where(F.col("donor").isNotNull() & (F.col("n") >= dwell)).drop("n")


def squash(events: DataFrame, tau: int = 10) -> DataFrame:
    """Without back-and-forth: an event that reverses the last one left of its proton within ``tau`` frames cancels both."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[int] = []
        pdf = pdf.sort_values("frame", kind="stable").reset_index(drop=True)
        f, d, a = pdf["frame"].tolist(), pdf["donor"].tolist(), pdf["acceptor"].tolist()
        for i in range(len(pdf)):
            if stack and d[i] == a[stack[-1]] and a[i] == d[stack[-1]] and f[i] - f[stack[-1]] <= tau:
                stack.pop()
            else:
                stack.append(i)
        return pdf.iloc[stack]

    return events.groupBy("traj", "proton").applyInPandas(run, events.schema)


def chains(events: DataFrame, gap: int = 100, longest: int = 20) -> DataFrame:
    """``n, c, total``: share of walks with n hops, one walk from every event.

    A walk goes on with the earliest event that its last acceptor donates within ``gap`` frames to a holder not yet visited;
    events of a frame come in order of donor and acceptor.  All open walks take a step at a time: an as-of join by holder and stretch of
    ``gap`` frames, of which a walk needs two, so that no trajectory has to be one task's.
    """
    spark, wide = events.sparkSession, max(1, gap)
    stretch = F.floor(F.col("frame") / wide).cast("long")
    given = staged(events.select("traj", "frame", "donor", "acceptor", stretch.alias("stretch")), "transfers-given")
    walks = given.select(F.monotonically_increasing_id().alias("walk"), "traj", F.col("acceptor").alias("donor"), F.col("frame").alias("at"), F.array("donor", "acceptor").alias("seen"))
    walks = staged(walks, "walks")
    open_ = [walks.count()]
    while open_[-1] and len(open_) < longest:
        here = F.floor(F.col("at") / wide).cast("long")
        ahead = walks.withColumn("stretch", F.explode(F.array(here, here + 1))).join(given, ["traj", "donor", "stretch"])
        ahead = ahead.where((F.col("frame") > F.col("at")) & (F.col("frame") <= F.col("at") + gap) & ~F.array_contains("seen", F.col("acceptor")))
        step = ahead.groupBy("walk").agg(F.min(F.struct("frame", "acceptor")).alias("e"))
        walks = walks.join(step, "walk").select("walk", "traj", F.col("e.acceptor").alias("donor"), F.col("e.frame").alias("at"), F.array_append("seen", F.col("e.acceptor")).alias("seen"))
        walks = staged(walks, "walks")
        open_.append(walks.count())
    sizes = [(n, a - b) for n, (a, b) in enumerate(zip(open_, [*open_[1:], 0], strict=True), 1) if a > b]  # at most ``longest`` numbers
    return spark.createDataFrame([(n, k / open_[0], open_[0]) for n, k in sizes], "n int, c double, total long")


def holder_centres(acceptors: DataFrame, box) -> DataFrame:
    """``traj, frame, mol, x, y, z``: unweighted periodic mean of each molecule's acceptor atoms."""
    first = W.partitionBy(*FRAME, "mol").orderBy("atom")
    rows = acceptors
    for k in AXES:
        rows = rows.withColumn(f"_{k}", F.first(k).over(first) + nearest_image(F.col(k) - F.first(k).over(first), length_of(box, k)))
    own = box_columns(box)
    whole = lambda k: F.first(length_of(box, k)) if own else F.lit(float(length_of(box, k)))
    return rows.groupBy(*FRAME, "mol").agg(*[F.pmod(F.avg(f"_{k}"), whole(k)).alias(k) for k in AXES], *[F.first(c).alias(c) for c in own])


def initial_charges(assigned: DataFrame, holders: DataFrame, neutral: int, start: int = 0) -> DataFrame:
    """``traj, mol, charge``: bound protons less the neutral number, in the first frame, for every molecule with acceptors."""
    n = assigned.where(F.col("frame") == start).groupBy("traj", F.col("acceptor_mol").alias("mol")).agg(F.count("*").alias("n"))
    own = holders.where(F.col("frame") == start).select("traj", "mol").distinct()
    return own.join(n, ["traj", "mol"], "left").select("traj", "mol", (F.coalesce("n", F.lit(0)) - neutral).cast("int").alias("charge"))


class Carriers:
    """Charge carriers and the rules by which a hop of a proton moves, makes or ends them; ``touched`` are those that changed since it was emptied."""

    def __init__(self, charges: dict[int, int]):
        self.charge, self.queue, self.sign, self.holder, self.n = dict(charges), defaultdict(deque), {}, {}, 0
        self.touched: set[int] = set()
        for mol in sorted(charges):
            for _ in range(abs(charges[mol])):
                self.make(mol, 1 if charges[mol] > 0 else -1)

    def make(self, mol: int, sign: int) -> None:
        self.sign[self.n], self.holder[self.n] = sign, mol
        self.queue[mol, sign].append(self.n)
        self.touched.add(self.n)
        self.n += 1

    def move(self, a: int, b: int, sign: int) -> None:
        c = self.queue[a, sign].popleft()
        self.queue[b, sign].append(c)
        self.holder[c] = b
        self.touched.add(c)

    def hop(self, donor: int, acceptor: int) -> None:
        d, a = self.charge.get(donor, 0), self.charge.get(acceptor, 0)
        if d > 0 and a >= 0:
            self.move(donor, acceptor, 1)
        elif d <= 0 and a < 0:
            self.move(acceptor, donor, -1)
        elif d > 0:
            for mol, sign in ((donor, 1), (acceptor, -1)):
                c = self.queue[mol, sign].popleft()
                del self.holder[c]
                self.touched.add(c)
        else:
            self.make(donor, -1)
            self.make(acceptor, 1)
        self.charge[donor], self.charge[acceptor] = d - 1, a + 1


#: Where a carrier comes from: the hop that made it (frame -1 and the molecule if it was there at the start) and its number there.
ORIGIN = ["born", "source", "nth"]


def _moves(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of molecules that exchange protons with each other only: a row per carrier and frame at whose end it is elsewhere than before; ``mol`` is null when it ends."""
    pdf = pdf.sort_values(["frame", "proton", "donor"])
    begin = pdf[pdf["frame"] < 0]
    charges = dict(zip(begin["donor"].tolist(), begin["acceptor"].tolist(), strict=True))
    state, origin, out = Carriers(charges), [], []
    for mol in sorted(charges):
        origin += [(-1, mol, k) for k in range(abs(charges[mol]))]
    traj, before = pdf["traj"].iloc[0], {}

    def put(frame: int) -> None:
        for c in sorted(state.touched):
            now = state.holder.get(c)
            if now != before.get(c):
                out.append((traj, *origin[c], state.sign[c], frame, now))
                before[c] = now
        state.touched.clear()

    put(-1)
    for frame, rows in pdf[pdf["frame"] >= 0].groupby("frame"):
        for r in rows.itertuples():
            state.hop(r.donor, r.acceptor)
            origin += [(frame, r.proton, k) for k in range(state.n - len(origin))]
        put(int(frame))
    out = pd.DataFrame(out, columns=["traj", *ORIGIN, "sign", "frame", "mol"])
    return out.astype({"mol": "Int64"})


def charge_track(assigned: DataFrame, holders: DataFrame, neutral: int, start: int = 0) -> DataFrame:
    """``traj, frame, cid, mol, sign``: where every carrier is at the end of each frame.

    The distributed part finds the hops (rows where a proton's molecule changes).  Molecules that no chain of hops connects don't
    interact: each such group goes through a state machine of its own, with its hops in order of frame and proton.  Carriers are numbered
    over the whole trajectory, those of the start by molecule, then by the hops that make them.
    """
    w = W.partitionBy("traj", "proton").orderBy("frame")
    hops = assigned.select("traj", "frame", "proton", F.lag("acceptor_mol").over(w).alias("donor"), F.col("acceptor_mol").alias("acceptor")).where("donor <> acceptor")
    hops = staged(hops, "hops")
    init = initial_charges(assigned, holders, neutral, start).select("traj", F.lit(-1).cast("long").alias("frame"), F.lit(0).cast("long").alias("proton"), F.col("mol").alias("donor"), F.col("charge").cast("long").alias("acceptor"))
    every = hops.unionByName(init)
    nodes = hops.select("traj", F.col("donor").alias("atom")).union(hops.select("traj", "acceptor")).union(init.select("traj", "donor")).distinct().withColumn("frame", F.lit(0).cast("long"))
    links = hops.select("traj", F.lit(0).cast("long").alias("frame"), F.col("donor").alias("src"), F.col("acceptor").alias("dst"))
    group = components(nodes, links).select("traj", F.col("atom").alias("donor"), F.col("comp").alias("group"))
    fields = "traj string, born long, source long, nth long, sign int, frame long, mol long"
    moves = staged(every.join(group, ["traj", "donor"]).groupBy("traj", "group").applyInPandas(_moves, fields), "carrier-moves")
    number = (F.row_number().over(W.partitionBy("traj").orderBy(*ORIGIN)) - 1).alias("cid")  # carriers, not their steps
    cids = moves.select("traj", *ORIGIN).distinct().select("traj", *ORIGIN, number)
    frames = assigned.select("traj", "frame").distinct().withColumn("i", F.row_number().over(W.partitionBy("traj").orderBy("frame")))
    last = frames.groupBy("traj").agg(F.max("i").alias("last"))
    at = moves.join(frames, ["traj", "frame"], "left").join(last, "traj").withColumn("i", F.coalesce("i", F.lit(1)))
    until = F.lead("i").over(W.partitionBy("traj", *ORIGIN).orderBy("frame")) - 1
    stays = at.withColumn("until", F.coalesce(until, "last")).where("mol is not null and until >= i").join(cids, ["traj", *ORIGIN])
    spread = stays.select("traj", F.explode(F.sequence("i", "until")).alias("i"), "cid", "mol", "sign")
    return spread.join(frames, ["traj", "i"]).select("traj", "frame", "cid", "mol", "sign")


def charge_paths(track: DataFrame, centres: DataFrame, box) -> DataFrame:
    """``traj, cid, sign, frame, x, y, z``: positions unwrapped; a carrier moves with the molecule that held it in the frame before.

    A hop therefore shows one frame later, and a new carrier has its first position one frame after it is made.
    """
    w = W.partitionBy("traj", "cid").orderBy("frame")
    held = track.withColumn("mol", F.coalesce(F.when(F.lag("frame").over(w).isNotNull(), F.lag("mol").over(w)), F.when(F.col("frame") == 0, F.col("mol")))).where("mol is not null")
    return unwrap_carriers(held.join(centres, [*FRAME, "mol"]), box)


def unwrap_carriers(points: DataFrame, box) -> DataFrame:
    from .series import unwrapped

    signs = points.groupBy("traj", "cid").agg(F.first("sign").alias("sign"))
    return unwrapped(points, ["traj", "cid"], [b if isinstance(b, str) else float(b) for b in box]).join(signs, ["traj", "cid"])
