"""Components that are too large for one task, solved in windows of frames.

A component is cut into windows of frames that are solved apart, in parallel. An arc
between two windows is known to both; each pays its share of the arc's cost, and a window
takes its arcs as it likes for that share. So the sum of the windows' bounds is a bound of
the whole. The next round cuts half a window later: arcs that were cut lie inside, and
their shares follow from the multipliers of the window that holds them.

Labels go the same way. A window labels its inside with the labels of cut arcs held: once
those of the best labelling, so that its cost never rises, and once those that the last
round's windows, which held these arcs inside, chose with their own cut arcs free. Rounds
go on until cost and bound of every component are close.

What goes from round to round is a table of arcs in the shared folder: shares and both labels.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.graph import ID_BITS, cut_lineage
from trackweave.plans.relaxation import Relaxation
from trackweave.plans.solver import INFINITY, Arc, Part, Problem, eliminate, rounded

#: Looks at the bound of a window in one round.
LOOKS = 20
#: Times that a labelling is rounded from shares that follow the held arcs.
ROUNDINGS = 2
#: Windows of a task where there are many.
TASK_WINDOWS = 2


#: (value, labels) of a window for states of arcs that are held, and a limit of table entries.
Labeller = Callable[[dict[Arc, int], float], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """What a model tells of its parts.

    ``build(nodes, arcs, unary)`` makes a part's problem, with costs of arcs in ``unary``;
    ``costs(row)`` are an arc's costs by state besides its source's table; ``nodes(part,
    labels)`` are (value, divides) of nodes. A model may have its own ``relax(nodes, arcs, share,
    inside, paid, again)``: variables of the part, bound, shares of the arcs inside, and labels for held
    arcs; ``again`` says that shares come from a round before.
    """

    build: Callable[[pd.DataFrame, pd.DataFrame, dict[Arc, np.ndarray]], Part]
    costs: Callable[[Any], np.ndarray]
    nodes: Callable[[Part, np.ndarray], dict[int, tuple[int, bool]]]
    relax: Callable[..., tuple[Part, float, dict[Arc, np.ndarray], Labeller]] | None = None


def frame(node: F.Column) -> F.Column:
    """The frame of a node's key; clones are negative."""
    return F.shiftright(F.when(node < 0, -node - 1).otherwise(node), ID_BITS)


def ascend(part: Part, inside: dict[Arc, np.ndarray], costs: dict[Arc, np.ndarray], gap: float) -> tuple[float, dict[Arc, np.ndarray], Relaxation]:
    """(bound, shares of the arcs inside, relaxation) of a window, from the shares it starts with."""
    relaxed = Relaxation(part.problem.sizes, part.problem.factors)
    # a table of one arc alone has no multipliers: it is part of the arc's costs
    out = {k: relaxed.at.get((part.out_tables[k], part.arcs[k])) for k in inside}
    into = {k: relaxed.at.get((part.in_tables[k], part.arcs[k])) for k in inside}
    for k, share in inside.items():
        more = share[1:] - share[0]
        if out[k] is not None:
            relaxed.prices[out[k] : out[k] + len(more)] = -more / relaxed.scale
        if into[k] is not None:
            relaxed.prices[into[k] : into[k] + len(more)] = (more - costs[k][1:] + costs[k][0]) / relaxed.scale
    bound = relaxed.bound(relaxed.prices)
    shares = dict(inside)

    def paid(k: Arc, share: np.ndarray) -> np.ndarray:
        price = lambda at: relaxed.prices[at : at + len(share) - 1] * relaxed.scale
        if out[k] is not None:
            return np.concatenate([share[:1], share[0] - price(out[k])])
        if into[k] is not None:
            return np.concatenate([share[:1], share[0] + costs[k][1:] - costs[k][0] + price(into[k])])
        return share

    for _ in range(LOOKS):
        found, apart = relaxed.improve()
        own = relaxed.bound(relaxed.prices)
        if own > bound:  # shares go with the bound that they give
            shares = {k: paid(k, share) for k, share in inside.items()}
        rise, bound = found - bound, max(bound, own)
        if apart < 1e-3 or 0 <= rise < 0.1 * gap * abs(bound):
            break
    return bound, shares, relaxed


def label_window(problem: Problem, relaxed: Relaxation, held: dict[int, int], limit: float) -> tuple[float, np.ndarray]:
    """(value, labels) with some variables held: the best ones if no table passes the limit, else by rounding."""
    value, labels, exact = eliminate(problem, limit, held)
    if exact:
        return value, labels
    here = relaxed.with_fixed(held)
    best = rounded(problem, here, limit)
    for _ in range(ROUNDINGS):
        here.improve()
        best = min(best, rounded(problem, here, limit), key=lambda x: x[0])
    return best


@dataclass
class Solved:
    part: Part
    bound: float
    shares: dict[Arc, np.ndarray]
    #: With all cut arcs free, with those of the best labelling held, and with those proposed.
    free: np.ndarray
    better: tuple[float, np.ndarray]
    other: tuple[float, np.ndarray]


def solve_window(kind: Kind, nodes: pd.DataFrame, arcs: pd.DataFrame, gap: float, limit: float, again: bool = False, follows: bool = False) -> Solved:
    """One window of arcs(src, dst, share, label, proposal, ...).

    ``again`` says that a round went before; with ``follows``, that one comes after it, labels stay as they are.
    """
    own = set(nodes.node.astype(int))
    cost, share, label, proposal = {}, {}, {}, {}
    for r in arcs.itertuples():
        k = (int(r.src), int(r.dst))
        cost[k], label[k], proposal[k] = kind.costs(r), int(r.label), int(r.proposal)
        share[k] = np.asarray(r.share, float)
    inside = {k: x for k, x in share.items() if k[0] in own and k[1] in own}
    cut = [k for k in share if k not in inside]
    paid = cost | {k: share[k] if k[0] in own else cost[k] - share[k] for k in cut}
    if kind.relax:
        part, bound, shares, labeller = kind.relax(nodes, arcs, share, inside, paid, again)
    else:
        part = kind.build(nodes, arcs, paid)
        bound, shares, relaxed = ascend(part, inside, cost, gap)
        labeller = lambda chosen, limit: label_window(part.problem, relaxed, {part.arcs[k]: s for k, s in chosen.items()}, limit)

    def with_held(chosen: dict[Arc, int]) -> tuple[float, np.ndarray]:
        value, labels = labeller({k: chosen[k] for k in cut}, limit)
        # a cut arc costs in full where it starts, and nothing where it ends
        return value + sum((cost[k][chosen[k]] if k[0] in own else 0.0) - paid[k][chosen[k]] for k in cut), labels

    free = labeller({}, limit)
    known, labels = labeller(label, np.inf)
    known += sum((cost[k][label[k]] if k[0] in own else 0.0) - paid[k][label[k]] for k in cut)
    better = (known, labels) if follows else with_held(label)
    other = better if all(label[k] == proposal[k] for k in cut) else with_held(proposal)
    if known <= better[0]:
        better = known, labels
    return Solved(part, bound, shares, free[1] if free[0] < INFINITY / 2 else labels, better, other)


RESULT = "component long, node long, dst long, value int, divides boolean, other int, other_divides boolean, share array<double>, proposal int, bound double, cost double, other_cost double"


def large(nodes: DataFrame, options: Any) -> DataFrame | None:
    """(component) of those with more than ``options.window_nodes`` nodes, if there are any."""
    found = cut_lineage(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > options.window_nodes).select("component"), "large")
    return None if found.isEmpty() else found


def infer(nodes: DataFrame, arcs: DataFrame, kind: Kind, options: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of components of nodes(component, node, ...) and arcs(component, src, dst, share, label, ...).

    ``share`` are the costs by state that the source's side pays at first, ``label`` a state
    that is allowed with all others. Returns (node, value, divides), (src, dst, value) and
    (component, cost, gap). The width of a component's windows follows from its number of
    nodes a frame and ``options.window_nodes``.
    """
    until = time.time() + min(options.time_limit, 1e9)
    frames = nodes.withColumn("frame", frame(F.col("node")))
    of = frames.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    width = F.greatest(F.lit(2), F.ceil(options.window_nodes * (F.col("last") - F.col("first") + 1) / F.col("n")))
    sized = cut_lineage(frames.join(of.select("component", "first", width.cast("long").alias("width")), "component"), "windowed")
    columns = [c for c in arcs.columns if c not in ("share", "label")]
    ends = of.select("component", "first", width.cast("long").alias("width"))
    now = cut_lineage(arcs.withColumn("proposal", F.col("label")).join(ends, "component"), "arcs")
    names = [c.split()[0] for c in RESULT.split(", ")]
    # a window is little to shuffle and much to solve: the number of tasks follows from that of windows
    spans = sized.groupBy("component", "first", "width").agg(F.max("frame").alias("last"))
    count = spans.agg(F.sum(F.expr("(last - first) div width + 2"))).first()[0] or 0
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), count // TASK_WINDOWS)
    tasks = max(1, min(tasks, count))
    dealt = lambda df: df.repartition(tasks, "component", "window").groupBy("component", "window")
    best: DataFrame | None = None
    for k in range(options.rounds):
        # labels of the first round are of no use where they are found from prices, as its cut arcs are off
        follows = kind.relax is not None and k == 0 and options.rounds > 1
        place = lambda f, k=k: F.expr(f"({f} - first + {k % 2} * (width div 2)) div width")
        windowed = sized.withColumn("window", place("frame")).drop("frame", "first", "width")
        both = now.withColumns({"sf": frame(F.col("src")), "df": frame(F.col("dst"))}).withColumns({"sw": place("sf"), "dw": place("df")})
        met = both.withColumn("window", F.explode(F.array_distinct(F.array("sw", "dw")))).drop("sf", "df", "sw", "dw", "first", "width")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple] = []
            if len(left):
                name = int(left.component.iloc[0])
                own = set(left.node.astype(int))
                x = solve_window(kind, left, right, options.gap, options.limit, k > 0, follows)  # noqa: B023
                (cost, labels), (other_cost, others) = x.better, x.other
                more = kind.nodes(x.part, others) if other_cost < INFINITY / 2 else {}
                rows += [(name, n, None, *mine, *more.get(n, mine), None, None, None, None, None) for n, mine in kind.nodes(x.part, labels).items()]
                old = {(int(r.src), int(r.dst)): r.share for r in right.itertuples()}
                rows += [(name, *k, int(labels[v]), None, int(others[v]), None, list(map(float, x.shares.get(k, old[k]))), int(x.free[v]), None, None, None) for k, v in x.part.arcs.items() if k[0] in own]
                rows.append((name, *[None] * 8, x.bound, cost, other_cost))
            whole = {"node": "Int64", "dst": "Int64", "value": "Int32", "other": "Int32", "proposal": "Int32", "divides": "boolean", "other_divides": "boolean"}
            return pd.DataFrame(rows, columns=names).astype(whole)

        done = dealt(windowed).cogroup(dealt(met)).applyInPandas(run, RESULT)
        done = cut_lineage(done, "window-round")
        sums = done.where("bound IS NOT NULL").groupBy("component").agg(F.sum("bound").alias("bound"), F.sum("cost").alias("cost"), F.sum("other_cost").alias("other_cost"))
        if best is not None:  # a bound once found stays one
            sums = sums.join(best.select("component", F.col("bound").alias("last_bound")), "component").withColumn("bound", F.greatest("bound", "last_bound"))
        switch = F.col("other_cost") < F.col("cost")
        sums = sums.select("component", "bound", F.least("cost", "other_cost").alias("cost"), switch.alias("switch"))
        left_over = F.greatest(F.lit(0.0), F.col("cost") - F.col("bound")) / F.greatest(F.abs("cost"), F.lit(1e-9))
        best = cut_lineage(sums.withColumn("gap", F.when(F.col("cost") < INFINITY / 2, left_over).otherwise(F.lit(float("inf")))), "bounds")
        chosen = done.where("node IS NOT NULL").join(best.select("component", "switch"), "component")
        chosen = chosen.withColumns({"value": F.when(F.col("switch"), F.col("other")).otherwise(F.col("value")), "divides": F.when(F.col("switch"), F.col("other_divides")).otherwise(F.col("divides"))})
        labelled = chosen.where("dst IS NOT NULL").select("component", F.col("node").alias("src"), "dst", "share", F.col("value").alias("label"), "proposal")
        now = cut_lineage(now.select(*columns, "first", "width").join(labelled, ["component", "src", "dst"]), "arcs")
        worst = best.agg(F.max("gap")).first()[0]
        # both cuts have been tried at least once
        if worst is None or (k and worst <= options.gap) or (time.time() > until and not follows):
            break
    if worst is not None and worst > options.gap + 1e-9 and not options.unproven:
        raise RuntimeError(f"a gap of {worst} is left after {k + 1} rounds of windows, {options.gap} was asked for")
    values = chosen.where("dst IS NULL").select("node", "value", "divides")
    return values, now.select("src", "dst", F.col("label").alias("value")), best.select("component", "cost", "gap")


def labels(nodes: DataFrame, values: DataFrame, found: DataFrame) -> DataFrame:
    """(node, value, divides, cost, gap); a component's cost stands at its least node."""
    own = nodes.select("node", "component").join(values, "node").join(found.withColumnRenamed("cost", "all"), "component")
    # a component is named by its least node
    return own.select("node", "value", "divides", F.when(F.col("node") == F.col("component"), F.col("all")).otherwise(0.0).alias("cost"), "gap")
