"""Chaingraph tracking: each detection is on or off, each arc is used or not.

Per node: detected or not; out of it no arc (disappearance), one (move) or two
(division); into it no arc (appearance) or one. The model is a table of node costs, of
arc costs and of costs of pairs of arcs; components are solved in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.graph import cut_lineage
from trackweave.plans import windows
from trackweave.plans.flow import match
from trackweave.plans.prices import AGAIN, LAST, NEXT, NEXT_STEPS, End, Prices
from trackweave.plans.solver import INFINITY, Arc, Part, Problem, Rows, add_running_sum, by_component, calls, require_gap, solve


def outgoing_table(move: list[float], division: dict[tuple[int, int], float], dis: float, opp: float, forbidden: float, divisions: bool) -> np.ndarray:
    """Costs over (detected, arc 1, ..., arc k)."""
    k = len(move)
    table = np.full([2] * (k + 1), forbidden)
    at = lambda *on: (1, *(int(i in on) for i in range(k)))
    table[(0,) * (k + 1)], table[at()] = opp, dis
    for i in range(k):
        table[at(i)] = move[i]
    if divisions:
        for (i, j), cost in division.items():
            table[at(i, j)] = cost
    return table


def incoming_table(k: int, app: float, forbidden: float) -> np.ndarray:
    """Costs over (arc 1, ..., arc k, detected)."""
    table = np.full([2] * (k + 1), forbidden)
    table[(0,) * (k + 1)], table[(*[0] * k, 1)] = 0.0, app
    for i in range(k):
        table[(*(int(j == i) for j in range(k)), 1)] = 0.0
    return table


def build(nodes: pd.DataFrame, arcs: pd.DataFrame, pairs: dict[tuple[int, int, int], float], options: Any, unary: dict[Arc, np.ndarray] | None = None) -> Part:
    """The problem of some nodes and all arcs that touch them; an arc's other end may be elsewhere.

    ``unary`` are costs of arcs besides what their source's table holds.
    """
    problem = Problem()
    part = Part(problem)
    hard = INFINITY  # tables forbid by constraint, so that sums of forbidden costs can't win
    for r in sorted(nodes.itertuples(), key=lambda r: r.node):
        v = part.nodes[int(r.node)] = problem.variable(2)
        off = INFINITY if options.fixed_detections or not options.detection_variables else float(r.non)
        problem.add((v,), np.array([off, float(r.det) if options.detection_variables else 0.0]))
    move: dict[Arc, float] = {}
    outs_of: dict[int, list[Arc]] = {n: [] for n in part.nodes}
    ins_of: dict[int, list[Arc]] = {n: [] for n in part.nodes}
    for r in sorted(arcs.itertuples(), key=lambda r: (r.src, r.dst)):
        k = (int(r.src), int(r.dst))
        v = part.arcs[k] = problem.variable(2)
        move[k] = float(r.move)
        outs_of.get(k[0], []).append(k)
        ins_of.get(k[1], []).append(k)
        if unary and k in unary:
            problem.add((v,), unary[k])
    for r in nodes.itertuples():
        n = int(r.node)
        outs, ins = outs_of[n], ins_of[n]
        part.out_tables |= dict.fromkeys(outs, len(problem.factors))
        if not outs:
            problem.add((part.nodes[n],), np.array([float(r.opp), float(r.dis)]))
        else:
            division = {(i, j): pairs.get((n, outs[i][1], outs[j][1]), hard) for i in range(len(outs)) for j in range(i + 1, len(outs))}
            problem.add((part.nodes[n], *[part.arcs[k] for k in outs]), outgoing_table([move[k] for k in outs], division, float(r.dis), float(r.opp), hard, options.divisions))
        first = len(problem.factors)
        if len(ins) <= 8:
            part.in_tables |= dict.fromkeys(ins, first)
            problem.add((*[part.arcs[k] for k in ins], part.nodes[n]), incoming_table(len(ins), float(r.app), hard))
        else:
            part.in_tables |= {k: first + i for i, k in enumerate(ins)}
            total = add_running_sum(problem, [part.arcs[k] for k in ins], 1)
            problem.add((total, part.nodes[n]), np.array([[0.0, float(r.app)], [hard, 0.0]]))
    return part


def priced(nodes: Any, arcs: Any, pairs: dict[tuple[int, int, int], float], options: Any, paid: dict[Arc, float] | None = None) -> Prices:
    """The same problem by prices of detections; ``paid`` are costs of arcs besides those of moves."""
    paid = paid or {}
    off = not (options.fixed_detections or not options.detection_variables)
    ends = {int(r.node): End(float(r.det) if options.detection_variables else 0.0, float(r.non) + float(r.opp) if off else INFINITY, float(r.app), float(r.dis)) for r in nodes.itertuples()}
    moves, into = {}, {}
    for r in arcs.itertuples():
        k = (int(r.src), int(r.dst))
        if k[0] in ends:
            moves[k] = float(r.move) + paid.get(k, 0.0)
        else:
            into[k] = paid.get(k, 0.0)
    if any(k in paid for k in moves):
        pairs = {(n, a, b): c + paid.get((n, a), 0.0) + paid.get((n, b), 0.0) for (n, a, b), c in pairs.items()}
    return Prices(ends, moves, pairs, into)


def nothing(part: Part, options: Any) -> np.ndarray:
    """The labelling without arcs and, if that is allowed, without detections."""
    labels = np.zeros(len(part.problem.sizes), int)
    if options.fixed_detections or not options.detection_variables:
        labels[list(part.nodes.values())] = 1
    return labels


def without_divisions(nodes: pd.DataFrame, arcs: pd.DataFrame, options: Any) -> tuple[float, dict[int, bool], dict[Arc, bool]]:
    """The best labelling of a component whose nodes never divide, as a matching of sources to targets."""
    always = options.fixed_detections or not options.detection_variables
    ends, loops = {}, {}
    for r in nodes.itertuples():
        n, det = int(r.node), float(r.det) if options.detection_variables else 0.0
        ends[n] = (det, float(r.dis), float(r.app))
        loops[n] = None if always else float(r.non) + float(r.opp)
    cost, used, off = match(ends, {(int(r.src), int(r.dst)): float(r.move) for r in arcs.itertuples()}, loops)
    return cost, {n: n not in off for n in ends}, used


def solve_component(nodes: pd.DataFrame, arcs: pd.DataFrame, pairs: dict[tuple[int, int, int], float], options: Any) -> tuple[float, float, dict[int, bool], dict[Arc, bool]]:
    """(cost, gap, detected nodes, used arcs) of one component."""
    if not options.divisions:
        cost, on, used = without_divisions(nodes, arcs, options)
        return cost, 0.0, on, used
    part = build(nodes, arcs, pairs, options)

    def start() -> tuple[float, np.ndarray]:
        by = priced(nodes, arcs, pairs, options)
        return by.improve(), by.labels(part, {}, min(options.limit, 200_000))[1]

    cost, labels, gap = solve(part.problem, nothing(part, options), gap=options.gap, limit=options.limit, seconds=options.time_limit, order=[part.arcs[k] for k in sorted(part.arcs)], start=start)
    require_gap(cost, gap, options)
    return cost, gap, {n: bool(labels[v]) for n, v in part.nodes.items()}, {k: bool(labels[v]) for k, v in part.arcs.items()}


def windowed(options: Any) -> windows.Kind:
    """The model as :mod:`windows` take it: arcs(..., move, divisions) hold the costs of pairs, too."""

    def divisions(arcs: pd.DataFrame) -> dict[tuple[int, int, int], float]:
        return {(int(a), int(b), int(x["d2"])): float(x["cost"]) for a, b, more in zip(arcs.src, arcs.dst, arcs.divisions, strict=True) for x in more}

    def make(nodes: pd.DataFrame, arcs: pd.DataFrame, unary: dict[Arc, np.ndarray]) -> Part:
        return build(nodes, arcs, divisions(arcs), options, unary)

    def relax(nodes: pd.DataFrame, arcs: pd.DataFrame, share: dict[Arc, np.ndarray], inside: dict[Arc, np.ndarray], paid: dict[Arc, np.ndarray], again: bool) -> tuple[Part, float, dict[Arc, np.ndarray], windows.Labeller]:
        names = sorted(map(int, nodes.node))
        # variables as in ``build``, whose tables are only made where a dive leaves arcs open
        part = Part(Problem(), {n: i for i, n in enumerate(names)}, {k: len(names) + i for i, k in enumerate(sorted(share))})
        pairs, cut = divisions(arcs), {k: x for k, x in paid.items() if k not in inside}
        more = {k: float(x[1] - x[0]) for k, x in cut.items()}
        base = sum(float(x[0]) for x in cut.values())
        by = priced(nodes, arcs, pairs, options, more)
        for k, x in inside.items():
            by.prices[by.names[k[1]]] = x[0] - x[1]
        bound = (by.improve(NEXT, NEXT_STEPS) if again else by.improve()) + base
        shares = {k: np.array([0.0, -by.prices[by.names[k[1]]]]) for k in inside}

        def labels(held: dict[Arc, int], limit: float) -> tuple[float, np.ndarray]:
            here, on = by, {k for k, x in held.items() if x}
            if len(held) < len(share):
                if held:
                    here = by.with_held(held)
                    here.improve(LAST, AGAIN)
                state = here.dive()
                if (state < 0).any():
                    whole = make(nodes, arcs, paid)
                    return here.labels(whole, {whole.arcs[k]: x for k, x in held.items()}, min(limit, 200_000), state)
                on |= {k for k, i in here.arcs.items() if state[i] == 1}
            value, found = here.chosen(on, not held)
            out = np.zeros(len(part.nodes) + len(part.arcs), int)
            out[[part.nodes[n] for n, x in found.items() if x] + [part.arcs[k] for k in on]] = 1
            return value + base, out

        return part, bound, shares, labels

    return windows.Kind(make, lambda row: np.zeros(2), lambda part, labels: {n: (int(labels[v]), False) for n, v in part.nodes.items()}, relax)


class Move(NamedTuple):
    src: int
    dst: int
    move: float


RESULT = "node long, dst long, active boolean, cost double, gap double"


def infer(nodes: DataFrame, arcs: DataFrame, pairs: DataFrame, options: Any) -> tuple[DataFrame, DataFrame]:
    """(node, active, cost, gap) and (src, dst, active)."""
    both = arcs.select("component", "src", "dst", F.lit(None).cast("long").alias("d2"), F.col("move").alias("cost"))
    both = both.unionByName(pairs.select("component", "src", F.col("d1").alias("dst"), "d2", F.col("division").alias("cost")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        own, single, three = by_component(left, "component"), defaultdict(Rows), defaultdict(dict)
        for part, src, dst, d2, c in zip(right.part, right.src, right.dst, right.d2.astype("Int64"), right.cost, strict=True):
            if d2 is pd.NA:
                single[part].append(Move(src, dst, c))
            else:
                three[part][int(src), int(dst), int(d2)] = float(c)
        for name in own:
            cost, gap, on, used = solve_component(own[name], single[name], three[name], options)
            first = min(on)
            rows += [(n, None, v, cost if n == first else 0.0, gap) for n, v in on.items()]
            rows += [(a, b, v, None, None) for (a, b), v in used.items()]
        return pd.DataFrame(rows, columns=["node", "dst", "active", "cost", "gap"]).astype({"dst": "Int64"})

    ends = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct().withColumn("tied", F.lit(True))
    placed = nodes.join(ends.hint("merge"), "node", "left")
    buckets = calls(nodes)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
    linked = placed.where("tied").drop("tied")
    apart = windows.large(linked, options) if options.divisions else None
    if apart is not None:
        of = arcs.join(apart, "component", "left_semi").join(pairs.groupBy("src", F.col("d1").alias("dst")).agg(F.collect_list(F.struct("d2", F.col("division").alias("cost"))).alias("divisions")), ["src", "dst"], "left")
        none = F.array().cast("array<struct<d2:bigint,cost:double>>")
        ready = of.select("component", "src", "dst", "move", F.coalesce("divisions", none).alias("divisions"), F.array(F.lit(0.0), F.lit(0.0)).alias("share"), F.lit(0).alias("label"))
        values, flows, found = windows.infer(linked.join(apart, "component", "left_semi"), ready, windowed(options), options)
        linked, both = linked.join(apart, "component", "left_anti"), both.join(apart, "component", "left_anti")
    solved = linked.groupBy(bucket("component")).cogroup(both.withColumnRenamed("component", "part").groupBy(bucket("part"))).applyInPandas(run, RESULT)
    solved = cut_lineage(solved, "solved")  # both results read it
    # a detection without arcs is on if that is cheaper, or if it must be
    on, off = F.col("det") + F.col("app") + F.col("dis"), F.col("non") + F.col("opp")
    must = F.lit(options.fixed_detections or not options.detection_variables)
    alone = placed.where("tied IS NULL").select("node", (must | (on < off)).alias("active"), F.when(must, on).otherwise(F.least(on, off)).alias("cost"), F.lit(0.0).alias("gap"))
    labelled = solved.where("dst IS NULL").select("node", "active", "cost", "gap").unionByName(alone)
    used = solved.where("dst IS NOT NULL").select(F.col("node").alias("src"), "dst", "active")
    if apart is not None:
        labelled = labelled.unionByName(windows.labels(nodes, values, found).select("node", (F.col("value") > 0).alias("active"), "cost", "gap"))
        used = used.unionByName(flows.select("src", "dst", (F.col("value") > 0).alias("active")))
    return labelled, used

