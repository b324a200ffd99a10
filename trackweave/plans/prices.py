"""Prices of detections: bounds and labels of large chaingraphs.

A detection that is on needs an arc into it or appears. One price for each detection says
what its arc is worth: whoever takes the arc gets it, the detection pays it, at most its
cost of appearance. For given prices every detection chooses by itself among being off and
being on with no arc out, one or two; the sum of the least costs is a bound of the whole,
as good as the linear program of local choices. Choices softened by a temperature give
slopes for accelerated steps; as it falls, the shares of choices tell which arcs are clear.
The clearest are fixed and prices found again, until all arcs are; what is left falls apart
into pieces that are eliminated exactly.

[Y. Nesterov, Smooth minimization of non-smooth functions, 2005; S. Haller et al., A
primal-dual solver for large-scale tracking-by-assignment, 2020]
"""

from __future__ import annotations

from collections import defaultdict
from copy import copy
from dataclasses import dataclass

import numpy as np

from trackweave.plans.solver import INFINITY, Arc, Part, Problem, eliminate

#: Temperatures as shares of the usual cost of appearance, and steps at each.
COOLING, STEPS = (0.12, 0.04, 0.014, 0.005, 0.002, 0.0008), 100
#: Those of a start from known prices.
LAST, AGAIN = (0.014, 0.005, 0.002), 15
#: Those of a window whose prices come from the windows of the last round.
NEXT, NEXT_STEPS = (0.04, 0.014, 0.005, 0.002, 0.0008), 80
#: Rounds in which arcs are fixed, and the share of the open ones that is fixed in each.
DIVES, DIVE_SHARE = 40, 0.25
#: What is as good as forbidden, and still leaves sums exact enough.
FAR = 1e12


@dataclass
class End:
    """Costs of a detection: on, off, with no arc into it, with no arc out."""

    on: float
    off: float
    app: float
    dis: float


class Prices:
    """Choices of detections ``ends`` and arcs ``moves`` out of them; targets may be elsewhere.

    ``into`` are costs of arcs from elsewhere.
    """

    def __init__(self, ends: dict[int, End], moves: dict[Arc, float], pairs: dict[tuple[int, int, int], float], into: dict[Arc, float]):
        self.ends, self.moves, self.pairs, self.into = ends, moves, pairs, into
        self.names = {n: i for i, n in enumerate(ends)}
        n, self.arcs = len(ends), {k: i for i, k in enumerate(moves)}
        none = len(self.arcs)
        self.source = np.array([self.names[k[0]] for k in moves], int)
        self.target = target = np.array([self.names.get(k[1], n) for k in moves] + [n])
        outs: dict[int, list[Arc]] = defaultdict(list)
        for k in moves:
            outs[k[0]].append(k)
        first, a, b, costs = [], [], [], []
        for name, end in ends.items():
            first.append(len(costs))
            mine = outs.get(name, [])
            a.append(none), b.append(none), costs.append(end.dis)
            for k in mine:
                a.append(self.arcs[k]), b.append(none), costs.append(moves[k])
            mine = sorted(mine)
            for i, k in enumerate(mine):
                for other in mine[i + 1 :]:
                    cost = pairs.get((name, k[1], other[1]), INFINITY)
                    if cost < INFINITY / 2:
                        a.append(self.arcs[k]), b.append(self.arcs[other]), costs.append(cost)
        self.first, self.cost, self.arc = np.array(first), np.array(costs), (np.array(a), np.array(b))
        self.own = np.repeat(np.arange(n), np.diff([*first, len(costs)]))
        self.to = target[self.arc[0]], target[self.arc[1]]
        self.on, self.off = np.array([e.on for e in ends.values()]), np.array([min(e.off, FAR) for e in ends.values()])
        self.app = np.array([e.app for e in ends.values()])
        self.state = np.full(none, -1)
        reached = np.zeros(n + 1, bool)
        reached[target] = True
        self.reached = reached[:n]
        self.scale = float(np.median(np.abs(self.app))) or 1.0
        self._hold({})
        self.prices = self.start

    def _hold(self, held: dict[Arc, int]) -> None:
        """Costs with states of arcs between here and elsewhere."""
        self.most = self.app.copy()
        for k, cost in self.into.items():
            i = self.names[k[1]]
            if held.get(k) == 1:
                self.most[i], self.off[i] = cost, FAR
            elif k not in held:
                self.most[i] = min(self.most[i], cost)
        for k, state in held.items():
            if k in self.arcs:
                self.state[self.arcs[k]] = state
            if state and k[0] in self.names:
                self.off[self.names[k[0]]] = FAR
        if held:
            self.cost[self._gone(self.state)] = FAR
        self.start = np.where(self.reached, self.most - 0.5 * np.abs(self.most), self.most)

    def with_held(self, held: dict[Arc, int]) -> Prices:
        """The same with states of arcs between here and elsewhere, from these prices."""
        here = copy(self)
        here.cost, here.off, here.state = self.cost.copy(), self.off.copy(), self.state.copy()
        here._hold(held)
        here.prices = np.where(here.start < here.most, self.prices, here.most)
        return here

    def _gone(self, state: np.ndarray) -> np.ndarray:
        """Which options lack an arc that is on, or have one that is off."""
        m = len(state)
        now = np.append(state, 0)
        must = np.bincount(self.source[state == 1], minlength=len(self.first))[self.own]
        has = (now[self.arc[0]] == 1).astype(int) + (now[self.arc[1]] == 1)
        off = [(now[x] == 0) & (x < m) for x in self.arc]
        return (has < must) | off[0] | off[1]

    def _reduced(self, prices: np.ndarray) -> np.ndarray:
        more = np.append(prices, 0.0)
        return self.cost - more[self.to[0]] - more[self.to[1]]

    def bound(self, prices: np.ndarray) -> float:
        out = np.minimum.reduceat(self._reduced(prices), self.first)
        return float(np.minimum(self.off, self.on + prices + out).sum())

    def improve(self, cooling: tuple[float, ...] = COOLING, steps: int = STEPS) -> float:
        """The best bound found, with its prices in ``prices`` and shares of arcs in ``shares``."""
        n = len(self.first)
        now, best, at = np.minimum(self.prices, self.most), -np.inf, self.prices
        for heat in cooling:
            t = heat * self.scale
            last, ahead, pace = now, now, 1.0
            for _ in range(steps):
                reduced = self._reduced(ahead)
                least = np.minimum.reduceat(reduced, self.first)
                each = np.exp((least[self.own] - reduced) / t)
                whole = np.add.reduceat(each, self.first)
                on = 1 / (1 + np.exp(np.clip((self.on + ahead + least - t * np.log(whole) - self.off) / t, -500, 500)))
                each *= (on / whole)[self.own]
                slope = on - (np.bincount(self.to[0], each, n + 1) + np.bincount(self.to[1], each, n + 1))[:n]
                now = np.minimum(self.most, ahead + t * slope)
                if float(slope @ (now - last)) < 0:
                    pace = 1.0
                after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
                ahead = np.minimum(self.most, now + (pace - 1) / after * (now - last))
                last, pace = now, after
            if (found := self.bound(now)) > best:
                best, at = found, now
        self.prices = at
        none = len(self.arcs)
        self.shares = (np.bincount(self.arc[0], each, none + 1) + np.bincount(self.arc[1], each, none + 1))[:none]
        return best

    def dive(self) -> np.ndarray:
        """The state of every arc: the clearest are fixed, and prices follow, until all are."""
        n, m = len(self.first), len(self.arcs)
        source, target = self.source, self.target[:m]
        here = copy(self)
        here.off = self.off.copy()
        state = self.state.copy()
        far = n + 1 + np.arange(m)  # arcs that end elsewhere don't meet
        into = np.where(target < n, target, far)
        for _ in range(DIVES):
            open_ = np.flatnonzero(state < 0)
            if not len(open_):
                break
            shares = here.shares[open_]
            state[open_[shares < 0.01]] = 0
            order = open_[np.argsort(-shares, kind="stable")]
            order = order[state[order] < 0]
            # the best arc into each target and out of each source, if it is clear or among the clearest
            top = order[np.sort(np.unique(into[order], return_index=True)[1])]
            top = top[np.sort(np.unique(source[top], return_index=True)[1])]
            picked = top[(here.shares[top] > 0.9) | (np.arange(len(top)) < max(1, DIVE_SHARE * len(top)))]
            state[picked] = 1
            taken = np.zeros(n + 1 + m, bool)
            taken[into[state == 1]] = True
            state[(state < 0) & taken[into]] = 0
            # an arc that no option holds any more is off
            here._leave_out(here._gone(state))
            held = np.zeros(m + 1, bool)
            for x in here.arc:
                held[x[here.cost < FAR]] = True
            state[(state < 0) & ~held[:m]] = 0
            for on in (source[state == 1], target[state == 1]):
                here.off[on[on < n]] = FAR
            here.improve(LAST[1:], AGAIN)
        return state

    def _leave_out(self, gone: np.ndarray) -> None:
        """Drop options; a detection that keeps none has one that is too dear."""
        kept = ~gone
        last = np.bincount(self.own[kept], minlength=len(self.first)) == 0
        self.cost = np.where(gone, FAR, self.cost)
        kept[self.first[last]] = True
        self.cost, self.own = self.cost[kept], self.own[kept]
        self.arc, self.to = tuple(x[kept] for x in self.arc), tuple(x[kept] for x in self.to)
        self.first = np.searchsorted(self.own, np.arange(len(self.first)))

    def labels(self, part: Part, fixed: dict[int, int], limit: float, state: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(value, labels) of the part's problem with some variables fixed, arcs as a dive tells."""
        state = self.dive() if state is None else state
        own = {part.arcs[k]: int(state[i]) for k, i in self.arcs.items() if state[i] >= 0 and part.arcs[k] not in fixed}
        last = {part.arcs[k]: 0 for k, i in self.arcs.items() if state[i] < 0}
        return apart(part.problem, fixed, [own, last], limit)

    def chosen(self, on: set[Arc], free: bool) -> tuple[float, dict[int, bool]]:
        """(value, detections) where these arcs are on and all others off; arcs from elsewhere may be taken as well if they are ``free``."""
        outs, into = defaultdict(list), {}
        for k in sorted(on):
            outs[k[0]].append(k)
            if k[1] in into:
                return INFINITY, dict.fromkeys(self.ends, False)
            if k[1] in self.names:
                into[k[1]] = self.into.get(k, 0.0)
        value, found = 0.0, {}
        for i, (name, end) in enumerate(self.ends.items()):
            mine = outs.get(name, [])
            leaving = end.dis if not mine else self.moves[mine[0]] if len(mine) == 1 else INFINITY
            if len(mine) == 2:
                leaving = self.pairs.get((name, mine[0][1], mine[1][1]), INFINITY)
            cost = end.on + leaving + into.get(name, float(self.most[i]) if free else end.app)
            found[name] = bool(mine) or name in into or cost < end.off
            value += cost if found[name] else end.off
        return min(value, INFINITY), found


def apart(problem: Problem, fixed: dict[int, int], levels: list[dict[int, int]], limit: float) -> tuple[float, np.ndarray]:
    """(value, labels) with the first level's states fixed, in pieces; a piece that passes the limit goes on to the next."""
    labels = np.zeros(len(problem.sizes), int)
    for v, s in fixed.items():
        labels[v] = s
    value = 0.0
    work = [(problem.factors, fixed | levels[0], 0)]
    while work:
        factors, states, k = work.pop()
        up: dict[int, int] = {}

        def root(v: int, up: dict[int, int] = up) -> int:
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        live = []
        for vs, table in factors:
            rest = tuple(v for v in vs if v not in states)
            if len(rest) < len(vs):
                table = table[tuple(states.get(v, slice(None)) for v in vs)]
            if rest:
                live.append((rest, table))
                for v in rest[1:]:
                    up[root(v)] = root(rest[0])
            else:
                value += float(table)
        for v, s in states.items():
            labels[v] = s
        pieces: dict[int, list] = defaultdict(list)
        for vs, table in live:
            pieces[root(vs[0])].append((vs, table))
        for piece in pieces.values():
            names = sorted({v for vs, _ in piece for v in vs})
            if len(names) == 1:
                total = np.minimum(sum(t for _, t in piece), INFINITY)
                labels[names[0]] = int(total.argmin())
                value += float(total.min())
                continue
            place = {v: i for i, v in enumerate(names)}
            small = Problem([problem.sizes[v] for v in names], [(tuple(place[v] for v in vs), t) for vs, t in piece])
            cost, found, exact = eliminate(small, limit)
            if exact or k + 1 == len(levels):
                if not exact:
                    cost, found, _ = eliminate(small, np.inf)
                value += cost
                labels[names] = found
            else:
                inside = {v: s for v, s in levels[k + 1].items() if v in place}
                work.append((piece, inside, k + 1))
    return value, labels
