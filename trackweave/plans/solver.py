"""Minimisation of sums of small tables with a proven gap.

A problem is a list of variables (numbers of states) and factors (variables, costs).
Variables are eliminated by least table size; each leaves the table of its best states,
from which the labelling is read backwards, ties by the least state. That is exact. A
caller may order variables: of all best labellings :func:`first_of_ties` takes the one
whose labels come first in that order.

Where a table would have more than ``limit`` entries, the linear program of local choices
(:mod:`relaxation`) gives a rising bound and shares of states. Variables with clear shares
are fixed and the others eliminated, which gives labellings; what still lies further apart
than the asked gap is branched, least bound first.
"""

from __future__ import annotations

import heapq
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trackweave.plans.relaxation import Relaxation

INFINITY = 1e300
#: Nodes in one solver call, components kept whole.
CALL_NODES = 20_000


def calls(nodes: DataFrame) -> int:
    """Into how many calls a table of nodes is cut: some for each task, more if they are large."""
    each = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(each, nodes.count() // CALL_NODES + 1)


class Rows(list):
    """Rows of a component as build functions read them, without a table for each small one."""

    def itertuples(self):
        return iter(self)


def by_component(table: pd.DataFrame, key: str) -> dict[int, Rows]:
    """The rows of each component of a call."""
    out: dict[int, Rows] = defaultdict(Rows)
    for r in table.itertuples(index=False):
        out[getattr(r, key)].append(r)
    return out


@dataclass
class Problem:
    sizes: list[int] = field(default_factory=list)
    factors: list[tuple[tuple[int, ...], np.ndarray]] = field(default_factory=list)

    def variable(self, states: int) -> int:
        self.sizes.append(states)
        return len(self.sizes) - 1

    def add(self, variables: tuple[int, ...], costs: np.ndarray) -> None:
        self.factors.append((variables, np.asarray(costs, float)))

    def value(self, labels: np.ndarray) -> float:
        return float(sum(t[tuple(labels[list(v)])] for v, t in self.factors))


#: Source and target of an arc.
Arc = tuple[int, int]


@dataclass
class Part:
    """The problem of some nodes and the arcs at them: its variables, and which tables hold an arc at either end."""

    problem: Problem
    nodes: dict[int, int] = field(default_factory=dict)
    arcs: dict[Arc, int] = field(default_factory=dict)
    out_tables: dict[Arc, int] = field(default_factory=dict)
    in_tables: dict[Arc, int] = field(default_factory=dict)


def _sum(factors: list[tuple[tuple[int, ...], np.ndarray]], scope: tuple[int, ...], sizes: list[int]) -> np.ndarray:
    total = np.zeros([sizes[v] for v in scope])
    for vs, table in factors:
        order = sorted(range(len(vs)), key=lambda k: scope.index(vs[k]))
        shape = [1] * len(scope)
        for k in order:
            shape[scope.index(vs[k])] = sizes[vs[k]]
        total = total + table.transpose(order).reshape(shape)
    return np.minimum(total, INFINITY)


def elimination_order(sizes: list[int], scopes: list[tuple[int, ...]], limit: float, skip: set[int] | dict[int, int]) -> list[int] | None:
    """Variables, the one with the least table first; none if a table has more than ``limit`` entries."""
    near: dict[int, set[int]] = {v: {v} for v in range(len(sizes)) if v not in skip}
    for scope in scopes:
        for v in scope:
            near[v].update(scope)
    entries = lambda v: float(np.prod([float(sizes[u]) for u in near[v]]))
    cost = {v: entries(v) for v in near}
    heap = [(c, v) for v, c in cost.items()]
    heapq.heapify(heap)
    order: list[int] = []
    while heap:
        c, v = heapq.heappop(heap)
        if v not in near or c != cost[v]:
            continue  # stale
        if c > limit:
            return None
        order.append(v)
        rest = near.pop(v) - {v}
        for u in rest:
            near[u] |= rest
            near[u].discard(v)
            if (now := entries(u)) != cost[u]:
                cost[u] = now
                heapq.heappush(heap, (now, u))
    return order


#: Labellings whose costs differ by less are equally good: sums of the same costs in another order differ.
TIE = 5e-10
#: Ties are looked for among so many ordered variables at most.
TIED_VARIABLES = 256


def eliminate(problem: Problem, limit: float = 2_000_000, fixed: dict[int, int] | None = None) -> tuple[float, np.ndarray, bool]:
    """(value, labels, exact); without ``exact`` a table would pass the limit, and nothing is known."""
    return eliminated(problem, limit, fixed)[:3]


def eliminated(problem: Problem, limit: float = 2_000_000, fixed: dict[int, int] | None = None) -> tuple[float, np.ndarray, bool, bool]:
    """As :func:`eliminate`, and whether another labelling is as good."""
    sizes, fixed = problem.sizes, fixed or {}
    labels = np.zeros(len(sizes), int)
    for v, s in fixed.items():
        labels[v] = s
    live: list[tuple[tuple[int, ...], np.ndarray]] = []
    base = 0.0
    for vs, table in problem.factors:
        rest = vs
        if fixed and any(v in fixed for v in vs):
            rest = tuple(v for v in vs if v not in fixed)
            table = table[tuple(fixed.get(v, slice(None)) for v in vs)]
        if rest:
            live.append((rest, table))
        else:
            base += float(table)
    order = elimination_order(sizes, [vs for vs, _ in live], limit, fixed)
    if order is None:
        return -np.inf, labels, False, False
    place = {v: k for k, v in enumerate(order)}
    buckets: list[list[tuple[tuple[int, ...], np.ndarray]]] = [[] for _ in order]
    for vs, table in live:
        buckets[min(place[v] for v in vs)].append((vs, table))
    for v, mine in zip(order, buckets, strict=True):
        others = tuple(sorted({u for vs, _ in mine for u in vs} - {v}))
        best = _sum(mine, (*others, v), sizes).min(axis=-1)
        if others:
            buckets[min(place[u] for u in others)].append((others, best))
        else:
            base += float(best)
    tied = False
    for v, mine in zip(reversed(order), reversed(buckets), strict=True):
        costs = _sum([((v,), t[tuple(slice(None) if u == v else labels[u] for u in vs)]) for vs, t in mine], (v,), sizes)
        labels[v] = int(np.argmin(costs))
        tied = tied or int((costs <= costs[labels[v]] + TIE).sum()) > 1
    return base, labels, True, tied


def first_of_ties(problem: Problem, value: float, labels: np.ndarray, order: list[int], limit: float) -> np.ndarray:
    """Of the labellings that cost ``value`` the one whose labels of the variables ``order`` come first."""
    fixed: dict[int, int] = {}
    for v in order:
        for s in range(int(labels[v])):
            cost, found, exact = eliminate(problem, limit, fixed | {v: s})
            if exact and cost <= value + TIE:
                labels = found
                break
        fixed[v] = int(labels[v])
    return labels


#: Looks at a bound that rose by less than this share of the gap to go; after so many, branch.
SLOW, PATIENCE = 0.02, 4


def solve(problem: Problem, feasible: np.ndarray, limit: float = 2_000_000, gap: float = 0.0, seconds: float = 1e75, order: list[int] | None = None, start: Callable[[], tuple[float, np.ndarray]] | None = None) -> tuple[float, np.ndarray, float]:
    """(cost, labels, gap to the bound), the gap at most ``gap`` unless time is up.

    Of several best labellings the first one by the labels of ``order`` counts, where these are
    few enough for an exact search.

    ``start`` gives a bound and a labelling by the caller's own means where no exact search is
    possible. ``feasible`` is a labelling to start from; a cost of ``INFINITY`` or more says that no
    labelling is allowed, or that none was found in time.
    """
    until = time.monotonic() + seconds
    value, labels, exact, tied = eliminated(problem, limit)
    if exact:
        if tied and order and len(order) <= TIED_VARIABLES:
            labels = first_of_ties(problem, value, labels, order, limit)
        return value, labels, 0.0
    best, labels = problem.value(feasible), np.array(feasible)
    known = -np.inf
    if start:
        known, found_labels = start()
        if (value := problem.value(found_labels)) < best:
            best, labels = value, found_labels
        if best < INFINITY / 2 and best - known <= max(gap, 1e-9) * abs(best):
            return best, labels, max(0.0, best - known) / max(abs(best), 1e-9)
    allowed = sum(float(np.abs(t[t < INFINITY / 2]).sum()) for _, t in problem.factors)  # no labelling costs more
    root = Relaxation(problem.sizes, problem.factors)
    queue: list[tuple[float, int, Relaxation]] = [(known, 0, root)]
    born, floor = 0, np.inf  # floor: the least bound of what is not in the queue any more
    while queue:
        bound, _, relaxed = heapq.heappop(queue)
        close = lambda: best - bound <= max(gap, 1e-9) * abs(best)  # noqa: B023, E731
        idle, look = 0, 0
        while not close() and bound <= allowed and idle < PATIENCE and time.monotonic() < until:
            found, apart = relaxed.improve()
            to_go = best - bound if best < INFINITY / 2 and bound > -np.inf else np.inf
            idle = idle + 1 if found - bound < SLOW * (to_go - gap * abs(best)) or apart < 1e-6 else 0
            bound = max(bound, found)
            look += 1
            if look % 2 == 0 or idle:
                value, found_labels = rounded(problem, relaxed, limit)
                if value < best:
                    best, labels = value, found_labels
        if close() or bound > allowed or time.monotonic() >= until:
            if bound <= allowed:
                floor = min(floor, bound)
            if time.monotonic() >= until:
                floor = min([floor, *(b for b, _, _ in queue)])
                break
            continue
        state, clear = relaxed.states()
        open_ = [v for v in range(len(state)) if v not in relaxed.fixed and problem.sizes[v] > 1]
        if not open_:
            floor = min(floor, bound)
            continue
        v = min(open_, key=lambda u: clear[u])
        for s in range(problem.sizes[v]):
            born += 1
            heapq.heappush(queue, (bound, born, relaxed.with_fixed({v: s})))
    return best, labels, max(0.0, best - floor) / max(abs(best), 1e-9) if best < INFINITY / 2 else np.inf


def require_gap(cost: float, gap: float, options: Any) -> None:
    """An error if no labelling is allowed, or if the best one found is not proven to be within the gap."""
    if not cost < INFINITY / 2:
        raise RuntimeError("no labelling satisfies the constraints")
    if gap > options.gap + 1e-9 and not options.unproven:
        raise RuntimeError(f"a gap of {gap} is left after {options.time_limit} seconds, {options.gap} was asked for")


def rounded(problem: Problem, relaxed: Relaxation, limit: float) -> tuple[float, np.ndarray]:
    """The best labelling with the clearest variables fixed, the others free as far as the limit lets them."""
    state, clear = relaxed.states()
    for least in (0.9, 0.7, 0.5, 0.3, 0.1):
        fixed = {v: int(state[v]) for v in range(len(state)) if clear[v] > least} | relaxed.fixed
        value, labels, exact = eliminate(problem, min(limit, 200_000), fixed)
        if exact and value < INFINITY / 2:
            return value, labels
    return np.inf, state


def add_running_sum(problem: Problem, variables: list[int], most: int) -> int:
    """A variable for the sum of others, built one by one so that tables stay small.

    Its states are 0..most and a forbidden overflow is never entered.
    """
    total = problem.variable(1)
    for v in variables:
        n, states = problem.sizes[total], problem.sizes[v]
        upper = min(most, n - 1 + states - 1)
        after = problem.variable(upper + 1)
        table = np.full((n, states, upper + 1), INFINITY)
        for a in range(n):
            for b in range(states):
                if a + b <= upper:
                    table[a, b, a + b] = 0.0
        problem.add((total, v, after), table)
        total = after
    return total


def add_running_flags(problem: Problem, variables: list[int], most: int) -> tuple[int, int]:
    """(variable, m): its state is sum + (most + 1) * (any label above 1), sums up to ``most``."""
    total, width = problem.variable(1), most + 1
    first = True
    for v in variables:
        n, states = problem.sizes[total], problem.sizes[v]
        after = problem.variable(2 * width)
        table = np.full((n, states, 2 * width), INFINITY)
        for a in range(n):
            s, flag = (0, 0) if first else (a % width, a // width)
            for b in range(states):
                if s + b <= most:
                    table[a, b, s + b + width * (flag or b > 1)] = 0.0
        problem.add((total, v, after), table)
        total, first = after, False
    return total, width
