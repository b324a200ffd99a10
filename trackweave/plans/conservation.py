"""Conservation tracking: how many objects each detection holds and where they go.

The model is a table of nodes with the cost of every number of objects and a table of
arcs with the cost of every flow. Independent components are solved in parallel; nodes
without arcs never leave the JVM. In a component only the flows on arcs are unknown: for
given flows in and out, appearance, disappearance and division of a node follow.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.graph import cut_lineage
from trackweave.plans import windows
from trackweave.plans.flow import match
from trackweave.plans.solver import INFINITY, Arc, Part, Problem, Rows, add_running_flags, add_running_sum, by_component, calls, require_gap, solve

FORBIDDEN = 0.0 + INFINITY


@dataclass(frozen=True)
class ConservationModel:
    states: int = 2
    divisions: bool = True
    tracklets: bool = False
    misdetections: bool = True
    appearance: bool = True
    disappearance: bool = True
    gap: float = 0.01
    limit: int = 2_000_000
    #: Seconds after which a component that is too wide for an exact labelling is improved no more.
    time_limit: float = 1e75
    #: Take such a labelling though its gap is larger than the one asked for.
    unproven: bool = False
    #: Larger components are solved in windows of about so many nodes, in so many rounds at most.
    window_nodes: int = 20_000
    rounds: int = 20


def node_table(model: ConservationModel, e: np.ndarray, app: float, dis: float, div: tuple[float, float] | None, has_in: bool, has_out: bool) -> np.ndarray:
    """Least cost for each flow in, flow out and whether an arc out carries more than one object.

    Index: [flow in, flow out, flag]. Flow out may exceed the objects by one where a
    division can make up for it.
    """
    m = model.states
    pair = np.full((m + 1, m + 1), INFINITY)  # [appearing side, disappearing side]
    for s in range(m + 1):
        pair[s, s] = e[s]
        if s:
            pair[s, 0] = e[s] + s * app
            pair[0, s] = e[s] + s * dis
    if not model.misdetections:
        pair[0, :] = pair[:, 0] = INFINITY
    if not model.disappearance:
        pair[0, :] = INFINITY
    if not model.appearance:
        pair[:, 0] = INFINITY
    out = np.full((m + 1 if has_in else 1, m + 2 if has_out else 1, 2), INFINITY)
    for i in range(out.shape[0]):
        lower = [i] if has_in else range(m + 1)
        for o in range(out.shape[1]):
            for flag in (0, 1):
                best = INFINITY
                for d in (0, 1) if div else (0,):
                    upper = [o - d] if has_out else range(m + 1)
                    if d and (o != 2 or flag):
                        continue
                    extra = div[d] if div else 0.0
                    for a in upper:
                        if 0 <= a <= m:
                            best = min([best, *(pair[a, b] + extra for b in lower)])
                out[i, o, flag] = best
    return out


def node_labels(model: ConservationModel, e: np.ndarray, app: float, dis: float, div: tuple[float, float] | None, into: int | None, out: int | None, flag: int) -> tuple[int, bool]:
    """(objects, divides) of the best completion of given flows (None: no such arcs)."""
    m, best, found = model.states, INFINITY, (0, False)
    for d in (0, 1) if div else (0,):
        if d and (out != 2 or flag):
            continue
        for a in [out - d] if out is not None else range(m + 1):
            for b in [into] if into is not None else range(m + 1):
                if not 0 <= a <= m or not (a == b or a == 0 or b == 0):
                    continue
                if (not model.misdetections and (a == 0 or b == 0)) or (not model.disappearance and a == 0) or (not model.appearance and b == 0):
                    continue
                s = max(a, b)
                cost = e[s] + (s * app if b == 0 and a else 0.0) + (s * dis if a == 0 and b else 0.0) + (div[d] if div else 0.0)
                if cost < best - 1e-12:
                    best, found = cost, (a or b, bool(d))
    return found


@dataclass
class Solution:
    cost: float
    gap: float
    objects: dict[int, int]
    divides: dict[int, bool]
    flow: dict[int, int]


@dataclass
class Tracks(Part):
    """A part with the chains that are solved as one node, by their first node."""

    chains: dict[int, list[int]] = field(default_factory=dict)
    ends: dict[int, tuple] = field(default_factory=dict)  # costs and arcs of a chain
    inner: dict[int, Arc] = field(default_factory=dict)  # the arc out of a node inside its chain
    tables: dict[int, np.ndarray] = field(default_factory=dict)


def build(nodes: pd.DataFrame, arcs: pd.DataFrame, model: ConservationModel, unary: dict[Arc, np.ndarray] | None = None) -> Tracks:
    """The problem of some nodes and all arcs that touch them; an arc's other end may be elsewhere.

    ``unary`` are costs of arcs in place of their own.
    """
    m = model.states
    node = {int(r.node): r for r in nodes.itertuples()}
    arc = {(int(r.src), int(r.dst)): np.asarray(r.e, float) for r in arcs.itertuples()}
    ins: dict[int, list[Arc]] = {n: [] for n in node}
    outs: dict[int, list[Arc]] = {n: [] for n in node}
    for k in sorted(arc):
        outs.get(k[0], []).append(k)
        ins.get(k[1], []).append(k)
    part = Tracks(Problem())
    # with tracklets: a node joins its only predecessor if it is that one's only successor
    after: dict[int, int] = {}
    if model.tracklets:
        for k in arc:
            if len(outs[k[0]]) == 1 and len(ins[k[1]]) == 1:
                after[k[0]], part.inner[k[0]] = k[1], k
    for n in sorted(set(node) - set(after.values())):
        part.chains[n] = [n]
        while part.chains[n][-1] in after:
            part.chains[n].append(after[part.chains[n][-1]])
    problem, inside = part.problem, set(part.inner.values())
    for k in sorted(arc):
        if k not in inside:
            v = part.arcs[k] = problem.variable(m + 1)
            problem.add((v,), unary.get(k, arc[k]) if unary else arc[k])
    for n, members in part.chains.items():
        e = np.sum([np.asarray(node[x].e, float) for x in members], axis=0)
        e = e + np.sum([arc[part.inner[x]] for x in members[:-1]], axis=0) if len(members) > 1 else e
        first, last = node[members[0]], node[members[-1]]
        in_arcs, out_arcs = ins[members[0]], outs[members[-1]]
        into, out = [part.arcs[k] for k in in_arcs], [part.arcs[k] for k in out_arcs]
        div = (float(last.div0), float(last.div1)) if model.divisions and len(out) > 1 else None
        part.ends[n] = (e, float(first.app), float(last.dis), div, into, out)
        table = part.tables[n] = node_table(model, e, float(first.app), float(last.dis), div, bool(into), bool(out))
        at = len(problem.factors)
        if not into and not out:
            problem.add((), np.asarray(table.min()))
            continue
        if len(into) + len(out) <= 5:  # few arcs: one table over the flows
            part.in_tables |= dict.fromkeys(in_arcs, at)
            part.out_tables |= dict.fromkeys(out_arcs, at)
            shape = [m + 1] * (len(into) + len(out))
            full = np.full(shape, INFINITY)
            for x in np.ndindex(*shape):
                i, o = sum(x[: len(into)]), sum(x[len(into) :])
                if i < table.shape[0] and o < table.shape[1]:
                    full[x] = table[i, o, int(any(y > 1 for y in x[len(into) :]))]
            problem.add((*into, *out), full)
            continue
        part.in_tables |= {k: at + i for i, k in enumerate(in_arcs)}
        part.out_tables |= {k: at + len(in_arcs) + i for i, k in enumerate(out_arcs)}
        total = add_running_sum(problem, into, m)
        both, width = add_running_flags(problem, out, m + 1)
        joint = np.full((problem.sizes[total], problem.sizes[both]), INFINITY)
        for i in range(min(joint.shape[0], table.shape[0])):
            for s in range(joint.shape[1]):
                o, flag = (s % width, s // width) if out else (0, 0)
                if o < table.shape[1]:
                    joint[i, s] = table[i, o, flag]
        problem.add((total, both), joint)
    return part


def label_nodes(part: Tracks, labels: np.ndarray, model: ConservationModel) -> tuple[dict[int, int], dict[int, bool], dict[Arc, int]]:
    """(objects, divides, flow) of all nodes and arcs by the labels of the part's problem."""
    objects: dict[int, int] = {}
    divides: dict[int, bool] = {}
    flow = {k: int(labels[v]) for k, v in part.arcs.items()}
    for n, members in part.chains.items():
        e, app, dis, div, into, out = part.ends[n]
        flows = [int(labels[v]) for v in out]
        count, divided = node_labels(model, e, app, dis, div, sum(int(labels[v]) for v in into) if into else None, sum(flows) if out else None, int(any(f > 1 for f in flows)))
        for x in members:
            objects[x], divides[x] = count, divided and x == members[-1]
        for x in members[:-1]:
            flow[part.inner[x]] = count
    return objects, divides, flow


def single_objects(part: Tracks, arcs: dict[Arc, np.ndarray], model: ConservationModel) -> tuple[float, np.ndarray] | None:
    """(cost, labels) where each detection holds one object at most and none divides, as a flow.

    Nothing if that is no flow: if a detection without arcs in use may cost more than its
    appearance and disappearance together.
    """
    if model.states != 1 or any(x[3] for x in part.ends.values()):
        return None
    at = {n: members[-1] for n, members in part.chains.items()}  # arcs leave a chain at its last node
    back = {last: n for n, last in at.items()}
    on: dict[int, tuple[float, float, float]] = {}
    off: dict[int, float | None] = {}
    base = 0.0
    for n, table in part.tables.items():
        f = np.where(table[..., 0] < INFINITY / 2, table[..., 0], np.inf)
        into, out = f.shape[0] > 1, f.shape[1] > 1
        if not into and not out:
            base += float(f[0, 0])
            continue
        full = f[int(into), int(out)]
        if not np.isfinite(full):
            return None
        end, start = f[int(into), 0] - full, f[0, int(out)] - full
        if into and out and f[0, 0] > full + end + start + 1e-12:
            return None
        on[n] = (float(full), float(end), float(start))
        off[n] = float(f[0, 0]) if into and out and np.isfinite(f[0, 0]) else None
    cost, used, _ = match(on, {(back[a], b): float(arcs[a, b][1] - arcs[a, b][0]) for a, b in part.arcs}, off)
    labels = np.zeros(len(part.problem.sizes), int)
    for (a, b), v in part.arcs.items():
        labels[v] = int(used[back[a], b])
    return cost + base + sum(float(arcs[k][0]) for k in part.arcs), labels


def solve_component(nodes: pd.DataFrame, arcs: pd.DataFrame, model: ConservationModel) -> Solution:
    """Labels of one component of nodes(node, e, app, dis, div0, div1) and arcs(arc, src, dst, e)."""
    part = build(nodes, arcs, model)
    name = {(int(r.src), int(r.dst)): int(r.arc) for r in arcs.itertuples()}
    found = single_objects(part, {(int(r.src), int(r.dst)): np.asarray(r.e, float) for r in arcs.itertuples()}, model)
    if found:
        (cost, labels), gap = found, 0.0
    else:
        cost, labels, gap = solve(part.problem, np.zeros(len(part.problem.sizes), int), model.limit, model.gap, seconds=model.time_limit, order=[part.arcs[k] for k in sorted(part.arcs)])
    require_gap(cost, gap, model)
    objects, divides, flow = label_nodes(part, labels, model)
    return Solution(cost, gap, objects, divides, {name[k]: f for k, f in flow.items()})


def windowed(model: ConservationModel) -> windows.Kind:
    def named(part: Tracks, labels: np.ndarray) -> dict[int, tuple[int, bool]]:
        objects, divides, _ = label_nodes(part, labels, model)
        return {n: (objects[n], divides[n]) for n in objects}

    return windows.Kind(lambda nodes, arcs, unary: build(nodes, arcs, model, unary), lambda row: np.asarray(row.e, float), named)


class Flow(NamedTuple):
    arc: int
    src: int
    dst: int
    e: list[float]


RESULT = "component long, node long, dst long, value int, divides boolean, cost double, gap double"


def infer(nodes: DataFrame, arcs: DataFrame, model: ConservationModel) -> tuple[DataFrame, DataFrame]:
    """Labels of nodes(component, node, e, app, dis, div0, div1, alone) and arcs(component, src, dst, e).

    Returns (node, n_objects, divides, cost, gap) and (src, dst, flow); the cost of a
    component stands at its least node.
    """

    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        own, flows = by_component(left, "component"), by_component(right, "part")
        for name in own:
            links = Rows(Flow(k, r.src, r.dst, r.e) for k, r in enumerate(sorted(flows[name], key=lambda r: (r.src, r.dst))))
            found = solve_component(own[name], links, model)
            first = min(found.objects)
            rows += [(name, n, None, v, found.divides[n], found.cost if n == first else 0.0, found.gap) for n, v in found.objects.items()]
            rows += [(name, int(links[k].src), int(links[k].dst), v, None, None, None) for k, v in found.flow.items()]
        return pd.DataFrame(rows, columns=names).astype({"dst": "Int64", "divides": "boolean"})

    linked = nodes.where(~F.col("alone"))
    # a flow is solved whole, and so are chains that windows would cut
    apart = None if model.tracklets or (model.states == 1 and not model.divisions) else windows.large(linked, model)
    small = arcs
    if apart is not None:
        ready = arcs.join(apart, "component", "left_semi").select("component", "src", "dst", "e", F.col("e").alias("share"), F.lit(0).alias("label"))
        values, passed, found = windows.infer(linked.join(apart, "component", "left_semi"), ready, windowed(model), model)
        linked, small = linked.join(apart, "component", "left_anti"), arcs.join(apart, "component", "left_anti")
    flows = small.withColumnRenamed("component", "part")
    # many components go to one call, which is where most of the time of small ones would go
    buckets = calls(nodes)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
    solved = linked.groupBy(bucket("component")).cogroup(flows.groupBy(bucket("part"))).applyInPandas(run, RESULT)
    solved = cut_lineage(solved, "solved")  # both results read it
    # a detection without arcs: both sides are free, so the cheapest number of objects
    usable = F.col("e") if model.misdetections and model.appearance and model.disappearance else F.transform("e", lambda x, i: F.when(i == 0, F.lit(INFINITY)).otherwise(x))
    least = F.array_min(usable)
    single = nodes.where("alone").select(F.col("node"), (F.array_position(usable, least) - 1).cast("int").alias("n_objects"), F.lit(False).alias("divides"), least.alias("cost"), F.lit(0.0).alias("gap"))
    labelled = solved.where("dst IS NULL").select("node", F.col("value").alias("n_objects"), "divides", "cost", "gap").unionByName(single)
    used = solved.where("dst IS NOT NULL").select(F.col("node").alias("src"), "dst", F.col("value").alias("flow"))
    if apart is not None:
        labelled = labelled.unionByName(windows.labels(nodes, values, found).withColumnRenamed("value", "n_objects"))
        used = used.unionByName(passed.withColumnRenamed("value", "flow"))
    return labelled, used
