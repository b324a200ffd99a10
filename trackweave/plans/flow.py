"""Models without divisions as a least-cost flow of single objects, exact at any width.

A track is a path, so that each node has one arc in and one out at most: the arcs that are
used match sources to targets. A node without an arc out or in pays its end or its start,
and a node that is off is matched to itself. Sources enter one by one; each finds the
shortest augmenting path by costs that are reduced by potentials, which stay valid from
one path to the next. So the time is polynomial, and searches end where ending or starting
a track is cheaper than rerouting others.
"""

from __future__ import annotations

import heapq

import numpy as np

Node, Arc = int, tuple[int, int]


def match(nodes: dict[Node, tuple[float, float, float]], arcs: dict[Arc, float], off: dict[Node, float | None]) -> tuple[float, dict[Arc, bool], set[Node]]:
    """(cost, which arcs are used, nodes that are off) of least cost.

    ``nodes`` have the cost of being on, of no arc out and of no arc in; ``off`` the cost
    of being off, or none if a node can't be. Infinite costs forbid; if nothing else is left, the
    cost is infinite. Ties go to the arc that sorts first.
    """
    names = sorted(nodes)
    place = {n: k for k, n in enumerate(names)}
    on, end, start = (np.array([nodes[n][k] for n in names], float) for k in range(3))
    loop = np.array([np.inf if off.get(n) is None else off[n] for n in names], float)
    # a forbidden end or start costs more than all others together
    finite = [x[np.isfinite(x)] for x in (on, end, start, loop, np.array(list(arcs.values()), float))]
    large = 1 + 2 * sum(float(np.abs(x).sum()) for x in finite)
    end, start = np.where(np.isfinite(end), end, large), np.where(np.isfinite(start), start, large)
    # reduced by what the target pays if it is not reached
    links: list[list[tuple[int, float]]] = [[] for _ in names]
    for a, b in sorted(arcs):
        links[place[a]].append((place[b], arcs[a, b] - start[place[b]]))
    for k in range(len(names)):
        if np.isfinite(loop[k]):
            links[k].append((k, loop[k] - on[k] - start[k]))
    target = [-1] * len(names)  # of a source
    source = [-1] * len(names)  # of a target
    price = [0.0] * len(names)
    potential = [0.0] * len(names)
    ends = end.tolist()
    for new in range(len(names)):
        potential[new] = min([ends[new], *(w - price[v] for v, w in links[new])])
        far: dict[int, float] = {}
        via: dict[int, int] = {}
        done: list[int] = []
        closed: set[int] = set()
        reached = [(new, 0.0)]
        heap: list[tuple[float, int]] = []
        best, last, ending = np.inf, -1, True
        at, base = new, 0.0
        while True:
            if (c := base + ends[at] - potential[at]) < best:
                best, last, ending = c, at, True
            for v, w in links[at]:
                if v not in closed and (d := base + w - potential[at] - price[v]) < far.get(v, np.inf):
                    far[v], via[v] = d, at
                    heapq.heappush(heap, (d, v))
            while heap and (heap[0][1] in closed or heap[0][0] > far[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            base, v = heapq.heappop(heap)
            closed.add(v)
            if source[v] < 0:
                best, last, ending = base, v, False
                break
            done.append(v)
            at = source[v]
            reached.append((at, base))
        for v in done:
            price[v] += far[v] - best
        for u, d in reached:
            potential[u] += best - d
        if ending:  # the source ``last`` gives up its target, if it has one
            v, target[last] = target[last], -1
            if last == new:
                continue
        else:
            v = last
        while True:
            u = via[v]
            given_up, target[u], source[v] = target[u], v, u
            if u == new:
                break
            v = given_up
    out = {k for k in range(len(names)) if target[k] == k}
    used = {(a, b): target[place[a]] == place[b] for a, b in arcs}
    cost = float(on.sum() + sum(loop[k] - on[k] for k in out) + sum(arcs[k] for k, x in used.items() if x))
    cost += float(sum(end[k] for k in range(len(names)) if target[k] < 0) + sum(start[k] for k in range(len(names)) if source[k] < 0))
    return (np.inf if cost >= large / 2 else cost), used, {names[k] for k in out}
