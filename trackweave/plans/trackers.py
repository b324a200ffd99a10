"""The trackers: from detections to events."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import energies as en
from trackweave.functions.geometry import FieldOfView, point
from trackweave.operators import candidates, events, graph, mergers
from trackweave.plans import chaingraph, conservation, factors

log = logging.getLogger(__name__)

#: From labelled mergers to their (timestep, id, k, centre).
Centres = Callable[[DataFrame], DataFrame]
#: A cost: one number for all, or a column made of a row's own columns.
Cost = float | Callable[[], Column]
DETECTION_WEIGHT = 10.0
CHAINGRAPH_RADIUS = 50.0


def cost(value: Cost | None) -> Column:
    """A cost as a column; none at all is an error."""
    if value is None:
        raise ValueError("a cost is missing")
    return value().cast("double") if callable(value) else F.lit(float(value))


def show_gap(labelled: DataFrame, kind: str) -> None:
    """Tell of components whose labelling is not proven to be the best one."""
    if log.isEnabledFor(logging.INFO):
        r = labelled.agg(F.sum("cost").alias("cost"), F.max("gap").alias("gap"), F.count_if(F.col("gap") > 0).alias("n")).first()
        log.info("%s: cost %s, %s nodes of components with a gap, the largest %s", kind, r.cost, r.n, r.gap)


@dataclass(frozen=True)
class ConservationTracker:
    """Options of conservation tracking. ``average_size`` above 0 makes a prior from sizes.

    A given det_prob always wins over the prior of sizes. ``limit`` is the number of
    table entries up to which a component is solved exactly; beyond, its labelling is
    proven to lie within ``gap`` of the best one. A component that is not after
    ``time_limit`` seconds is an error, or with ``unproven`` a larger gap at its nodes.
    Components of more than ``window_nodes`` nodes are solved in windows of frames, in up
    to ``rounds`` rounds, see :mod:`windows`.
    Without ``constraints`` the model is written to the shared folder and an error follows:
    only the constrained model can be solved.
    """

    max_objects: int = 2
    radius: float = 20.0
    divisions: bool = True
    division_threshold: float = 0.3
    average_size: float = 0.0
    size_prior: bool = False
    fov: FieldOfView = field(default_factory=FieldOfView)
    gap: float = 0.01
    tracklets: bool = False
    division_weight: float = 10.0
    transition_weight: float = 10.0
    disappearance_cost: float = 100.0
    appearance_cost: float = 100.0
    alpha: float = 5.0
    border: float = 0.0
    misdetections: bool = True
    allow_appearance: bool = True
    allow_disappearance: bool = True
    limit: int = 2_000_000
    time_limit: float = 1e75
    unproven: bool = False
    window_nodes: int = 20_000
    rounds: int = 20
    constraints: bool = True

    def build_graph(self, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes with det_prob and arcs with distance."""
        graph.require(detections, "timestep", "id", "x", "y", "z")
        if "det_prob" in detections.columns:
            nodes = detections
        elif self.size_prior or self.average_size > 0:
            graph.require(detections, "count")
            size = F.when(F.col("count").isNull(), F.raise_error(F.lit("no feature count"))).otherwise(F.col("count"))
            nodes = detections.withColumn("det_prob", en.size_prior(size.cast("double"), self.average_size, self.max_objects))
        else:
            nodes = detections.withColumn("det_prob", F.lit(en.hard_prior(self.max_objects)))
        nodes = nodes.withColumn("node", graph.node_key(F.col("timestep"), F.col("id")))
        o = candidates.Candidates(1, self.radius, True, self.divisions, self.division_threshold)
        found = candidates.arcs(detections, o)
        return nodes, found.withColumns({"a": graph.node_key(F.col("src_t"), F.col("src")), "b": graph.node_key(F.col("dst_t"), F.col("dst"))})

    def model(self) -> conservation.ConservationModel:
        return conservation.ConservationModel(self.max_objects, self.divisions, self.tracklets, self.misdetections, self.allow_appearance, self.allow_disappearance, self.gap, self.limit, self.time_limit, self.unproven, self.window_nodes, self.rounds)

    def energies(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The model as tables: costs of nodes by number of objects, and of arcs by flow."""
        ends = nodes.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b"))
        at_border = lambda cost: en.border_aware_weight(point(), cost, self.border, True, self.fov) if self.border else F.lit(float(cost))
        p = F.col("div_prob") if "div_prob" in nodes.columns else F.lit(0.0)
        costs = nodes.join(F.broadcast(ends)).select(  # one row
            "node",
            "timestep",
            "id",
            en.detection_energies(F.slice("det_prob", 1, self.max_objects + 1), DETECTION_WEIGHT).alias("e"),
            F.when(F.col("timestep") <= F.col("a"), 0.0).otherwise(at_border(self.appearance_cost)).alias("app"),
            F.when(F.col("timestep") >= F.col("b"), 0.0).otherwise(at_border(self.disappearance_cost)).alias("dis"),
            en.division_energy(p, self.division_weight, False).alias("div0"),
            en.division_energy(p, self.division_weight, True).alias("div1"),
        )
        flows = arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), en.transition_energies(F.col("distance"), self.transition_weight, self.alpha, self.max_objects).alias("e"))
        return costs, flows

    def infer(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Labelled nodes(timestep, id, n_objects, divides, cost, gap) and arcs with ``flow``."""
        arcs = graph.cut_lineage(arcs, "arcs")
        costs, flows = self.energies(nodes, arcs)
        costs = graph.cut_lineage(costs, "costs")
        if not self.constraints:
            variables, entries = factors.conservation_tables(costs, flows, self.max_objects)
            paths = [graph.cut_lineage(x, f"conservation-{n}").inputFiles()[:1] for n, x in (("variables", variables), ("factors", entries))]
            raise NotImplementedError(f"a model without constraints has no solver; its tables are at {paths}")
        of = graph.components(costs.select("node"), flows)
        linked = flows.select(F.col("src").alias("node")).union(flows.select("dst")).distinct().withColumn("tied", F.lit(True))
        ready = costs.join(of.hint("merge"), "node").join(linked.hint("merge"), "node", "left").withColumn("alone", F.col("tied").isNull())
        mine = flows.join(of.withColumnRenamed("node", "src").hint("merge"), "src")
        labels, carried = conservation.infer(ready.drop("tied", "timestep", "id"), mine, self.model())
        out = nodes.join(labels.hint("merge"), "node")
        used = arcs.join(carried.withColumnsRenamed({"src": "a", "dst": "b"}).hint("merge"), ["a", "b"])
        out = graph.cut_lineage(out, "labels")
        show_gap(out, "conservation")
        return out, graph.cut_lineage(used.withColumn("active", F.col("flow") > 0), "flows")

    def track(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(events, labelled nodes, labelled arcs) of a built graph; each call starts afresh."""
        ends = nodes.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b")).first()
        labelled, used = self.infer(nodes, arcs)
        alive, going = self.active(labelled, used)
        found = events.events(alive.select("timestep", "id", "n_objects", "divides"), going, ends.a or 0, ends.b or 0)
        return found, labelled, used

    def active(self, labelled: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is active of a labelled graph: nodes, and arcs(src_t, src, dst_t, dst)."""
        alive, going = graph.prune(labelled, used.select("src_t", "src", "dst_t", "dst", "active", F.col("a"), F.col("b")).drop("src", "dst").withColumnsRenamed({"a": "src", "b": "dst"}))
        back = F.shiftright("src", graph.ID_BITS).cast("int"), F.shiftright("dst", graph.ID_BITS).cast("int")
        mask = F.lit((1 << graph.ID_BITS) - 1)
        return alive, going.select(back[0].alias("src_t"), F.col("src").bitwiseAND(mask).alias("src"), back[1].alias("dst_t"), F.col("dst").bitwiseAND(mask).alias("dst"))

    def resolve_mergers(self, labelled: DataFrame, used: DataFrame, centres: Centres | DataFrame, multi_frame_moves: bool = True, n_dim: int = 3) -> DataFrame:
        """Events of a labelled graph whose mergers are split at their centres and linked again.

        ``centres`` may also be pixels(timestep, id, pixel) of the mergers: mixtures of
        them, which start at what came before, then give the centres.

        With ``multi_frame_moves``, those of the labelled graph and the moves across its
        mergers; without, those of the resolved graph.
        """
        ends = labelled.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b")).first()
        first, last = ends.a or 0, ends.b or 0
        graph.require(labelled, "timestep", "id", "x", "y", "z", "n_objects", "divides")
        alive, going = self.active(labelled, used)
        merged = alive.where("n_objects > 1")
        # ids go on after the largest of all detections of the frame
        found = mergers.seeded_fit(centres, alive, going, n_dim) if isinstance(centres, DataFrame) else centres(merged)
        parts = graph.cut_lineage(mergers.split(labelled, found), "parts")
        links = mergers.resolve(alive, going, parts, self.transition_weight, self.alpha, self.gap, self.tracklets)
        src, dst = (merged.select(F.col("timestep").alias(f"{end}_t"), F.col("id").alias(end)) for end in ("src", "dst"))
        stay = going.join(src, ["src_t", "src"], "left_anti").join(dst, ["dst_t", "dst"], "left_anti")
        arcs = stay.select(*going.columns).unionByName(links.where("active").drop("active"))
        one = F.lit(1).alias("n_objects")
        rows = alive.where("n_objects = 1").select("timestep", "id", one, "divides", F.lit(None).cast("long").alias("origin"))
        rows = rows.unionByName(parts.select("timestep", "id", one, F.lit(False).alias("divides"), "origin"))
        if not multi_frame_moves:
            return events.events(rows, arcs, first, last)
        found = events.events(alive.select("timestep", "id", "n_objects", "divides"), going, first, last)
        return events.merge(found, events.multi_frame_moves(rows, graph.cut_lineage(arcs, "arcs"), first))

    def run(self, detections: DataFrame, centres: Centres | DataFrame | None = None) -> DataFrame:
        """Events; with ``centres``, such as of operators.mergers, or pixels, mergers are resolved, too."""
        found, labelled, used = self.track(*self.build_graph(detections))
        return found if centres is None or self.max_objects == 1 else self.resolve_mergers(labelled, used, centres)

    def detections(self, labelled: DataFrame) -> DataFrame:
        """(slot, id, active) of every detection of a labelled graph."""
        first = labelled.agg(F.min("timestep")).first()[0] or 0
        return events.states(labelled, first)


@dataclass(frozen=True)
class ChaingraphTracker:
    """Options of chaingraph tracking: costs of appearance, disappearance, move, division.

    Costs are numbers or functions that give a column: of the node's columns, for moves
    of the arc's (``distance``), for divisions of the mother (mx, my, mz) and daughters
    (px, ..., qz). ``forbidden`` is what the explicit tables of :mod:`factors` hold for
    states that the solver rules out. ``limit`` and ``time_limit`` as in the other tracker.
    """

    appearance: Cost = 500.0
    disappearance: Cost = 500.0
    detection: Cost = 10.0
    misdetection: Cost = 500.0
    move: Cost = lambda: F.col("distance")
    division: Cost | None = None  # by the distances and the angle
    cellness_by_features: bool = False
    opportunity: Cost = 0.0
    forbidden: float = 0.0
    divisions: bool = True
    mean_division_distance: float = 10.0
    least_angle: float = 0.0
    neighbours: int = 6
    radius: float = CHAINGRAPH_RADIUS
    fixed_detections: bool = False
    detection_variables: bool = True
    gap: float = 0.01
    limit: int = 200_000
    time_limit: float = 1e75
    unproven: bool = False
    window_nodes: int = 20_000
    rounds: int = 20

    def build_graph(self, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes = detections.withColumn("node", graph.node_key(F.col("timestep"), F.col("id")))
        arcs = candidates.arcs(detections, candidates.Candidates(self.neighbours, self.radius))
        return nodes, arcs.withColumns({"a": graph.node_key(F.col("src_t"), F.col("src")), "b": graph.node_key(F.col("dst_t"), F.col("dst"))})

    def energies(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Costs of nodes, of arcs and of pairs of arcs out of one node."""
        if self.cellness_by_features:
            c = F.get("det_prob", F.lit(0)) if "det_prob" in nodes.columns else F.col("cellness")
            det, non = en.neg_ln_cellness(c.cast("double"), self.detection), en.neg_ln_not_cellness(c.cast("double"), self.misdetection)
        else:
            det, non = cost(self.detection), cost(self.misdetection)
        costs = nodes.select("node", det.alias("det"), non.alias("non"), cost(self.appearance).alias("app"), cost(self.disappearance).alias("dis"), cost(self.opportunity).alias("opp"))
        at = nodes.select("node", "x", "y", "z")
        moves = arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), cost(self.move).alias("move"))
        three = moves.alias("l").join(moves.alias("r").hint("merge"), F.col("l.src") == F.col("r.src")).where("l.dst < r.dst")
        three = three.select(F.col("l.src").alias("src"), F.col("l.dst").alias("d1"), F.col("r.dst").alias("d2"))
        for name, key in (("m", "src"), ("p", "d1"), ("q", "d2")):
            three = three.join(at.select(F.col("node").alias(key), *[F.col(c).alias(f"{name}{c}") for c in "xyz"]).hint("merge"), key)
        by_geometry = en.division_by_geometry(point("m"), point("p"), point("q"), self.mean_division_distance, self.least_angle)
        return costs, moves, three.select("src", "d1", "d2", (cost(self.division) if self.division else by_geometry).alias("division"))

    def infer(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.infer_components(nodes, arcs)[1:]

    def infer_components(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(node, component), and what :meth:`infer` gives."""
        arcs = graph.cut_lineage(arcs, "arcs")
        costs, moves, pairs = (graph.cut_lineage(x, "chaingraph") for x in self.energies(nodes, arcs))
        of = graph.components(costs.select("node"), moves)
        by_src = of.withColumnRenamed("node", "src").hint("merge")
        labels, used = chaingraph.infer(costs.join(of.hint("merge"), "node"), moves.join(by_src, "src"), pairs.join(by_src, "src"), self)
        out = graph.cut_lineage(nodes.join(labels.hint("merge"), "node"), "labels")
        show_gap(out, "chaingraph")
        return of, out, graph.cut_lineage(arcs.join(used.withColumnsRenamed({"src": "a", "dst": "b"}).hint("merge"), ["a", "b"]), "used")

    def track(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        ends = nodes.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b")).first()
        labelled, used = self.infer(nodes, arcs)
        found = events.events(labelled.where("active").select("timestep", "id"), used.where("active").select("src_t", "src", "dst_t", "dst"), ends.a or 0, ends.b or 0)
        return found, labelled, used

    def run(self, detections: DataFrame) -> DataFrame:
        return self.track(*self.build_graph(detections))[0]

    def detections(self, labelled: DataFrame) -> DataFrame:
        """(slot, id, active) of every detection of a labelled graph."""
        first = labelled.agg(F.min("timestep")).first()[0] or 0
        return events.states(labelled, first)

    def explicit_tables(self, nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The model as variables and table entries, see :func:`factors.chaingraph_tables`."""
        if not self.detection_variables:
            raise ValueError("explicit tables need detection variables")
        arcs = graph.cut_lineage(arcs, "arcs")
        return factors.chaingraph_tables(*self.energies(nodes, arcs), self.forbidden, self.divisions)

    def with_time_limit(self, seconds: float) -> ChaingraphTracker:
        return replace(self, time_limit=seconds)

    def with_divisions(self, on: bool) -> ChaingraphTracker:
        return replace(self, divisions=on)
