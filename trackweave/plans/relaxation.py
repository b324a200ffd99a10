"""A rising lower bound for sums of tables, from the linear program of their local choices.

Every table picks one of its allowed entries, every variable one of its states, in shares;
a multiplier for each variable and state of a table prices where both disagree. For given
multipliers, tables and variables choose by themselves: the sum of their least prices is
a bound. Multipliers and shares are improved together by primal-dual steps, which restart
from their average; a step only adds along the links between tables and variables.

[A. Chambolle and T. Pock, A first-order primal-dual algorithm, 2011; D. Applegate et al.,
Practical large-scale linear programming using primal-dual hybrid gradient, 2021]
"""

from __future__ import annotations

import copy

import numpy as np

#: Table entries from here on are forbidden.
FORBIDDEN = 1e290
#: Steps between restarts, and between looks at the bound.
STEPS = 400


class Relaxation:
    """Shares and multipliers of a problem; ``fixed`` variables keep their states."""

    def __init__(self, sizes: list[int], factors: list[tuple[tuple[int, ...], np.ndarray]]):
        self.fixed: dict[int, int] = {}
        self.entries: dict[int, list[tuple[int, np.ndarray]]] = {}  # of a variable: where a table's entries are, its state in each
        self.sizes, self.first = np.asarray(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        n = int(self.first[-1])
        unary = np.zeros(n)
        self.base = 0.0
        costs, groups = [unary], [np.repeat(np.arange(len(sizes)), sizes)]
        rows, columns, signs = [], [], []
        row = 0
        self.at: dict[tuple[int, int], int] = {}  # of a table and a variable: the first of their multipliers, for state 1
        for k, (vs, table) in enumerate(factors):
            if len(vs) < 2:
                if vs:
                    unary[self.first[vs[0]] : self.first[vs[0] + 1]] += np.where(table < FORBIDDEN, table, np.inf)
                else:
                    self.base += float(table)
                continue
            entries = np.argwhere(table < FORBIDDEN)
            at = n + np.arange(len(entries))
            n += len(entries)
            costs.append(table[tuple(entries.T)])
            groups.append(np.full(len(entries), len(sizes) + len(groups) - 1))
            for p, v in enumerate(vs):
                self.entries.setdefault(v, []).append((int(n - len(entries)), entries[:, p]))
                self.at[k, v] = row
                used = entries[:, p] > 0  # state 0 follows, as shares sum to one
                many = sizes[v] - 1
                rows += [row + entries[used, p] - 1, row + np.arange(many)]
                columns += [at[used], self.first[v] + 1 + np.arange(many)]
                signs += [np.ones(int(used.sum())), -np.ones(many)]
                row += many
        cost, group = np.concatenate(costs), np.concatenate(groups)
        link = [np.concatenate(x) if x else np.zeros(0) for x in (rows, columns, signs)]
        self.row, self.column, self.sign, self.rows, self.n = link[0].astype(int), link[1].astype(int), link[2], row, n
        self.allowed, self.group = np.isfinite(cost), group
        self.groups = int(group.max()) + 1 if n else 0
        usual = np.abs(cost[self.allowed & (cost != 0)])
        self.scale, self.weight = float(np.median(usual)) if len(usual) else 1.0, 1.0
        self.cost = np.where(self.allowed, cost, 0.0) / self.scale
        self.ahead = 1 / (1 + np.bincount(self.column, minlength=n))
        self.back = 1 / np.maximum(1, np.bincount(self.row, minlength=row))
        self.even = 1 / np.maximum(1, np.bincount(group, minlength=self.groups))
        self.shares = np.zeros(n)
        self.prices, self.sums = np.zeros(row), np.zeros(self.groups)

    def with_fixed(self, states: dict[int, int]) -> Relaxation:
        """A copy, with its shares and multipliers, in which some variables have one state."""
        other = copy.copy(self)
        other.fixed, other.allowed = self.fixed | states, self.allowed.copy()
        for v, state in states.items():
            own = np.arange(self.first[v], self.first[v + 1])
            other.allowed[own[own != self.first[v] + state]] = False
            for at, of in self.entries.get(v, ()):
                other.allowed[at + np.flatnonzero(of != state)] = False
        return other

    def _reduced(self, prices: np.ndarray) -> np.ndarray:
        return self.cost - np.bincount(self.column, self.sign * prices[self.row], self.n)

    def bound(self, prices: np.ndarray) -> float:
        """The sum of the least prices of all tables and variables; infinite if one has no choice."""
        least = np.full(self.groups, np.inf)
        np.minimum.at(least, self.group[self.allowed], self._reduced(prices)[self.allowed])
        return float(least.sum()) * self.scale + self.base

    def improve(self, steps: int = STEPS) -> tuple[float, float]:
        """(bound, disagreement) after some steps, started where the last ones ended on average."""
        x, y, z = self.shares, self.prices, self.sums
        ahead, back, even = self.ahead * self.weight, self.back / self.weight, self.even / self.weight
        mean_x, mean_y, mean_z = np.zeros_like(x), np.zeros_like(y), np.zeros_like(z)
        for _ in range(steps):
            slope = self._reduced(y) - z[self.group]
            after = np.where(self.allowed, np.maximum(0.0, x - ahead * slope), 0.0)
            twice = 2 * after - x
            y = y - back * np.bincount(self.row, self.sign * twice[self.column], self.rows)
            z = z + even * (1 - np.bincount(self.group, twice, self.groups))
            x = after
            mean_x += x
            mean_y += y
            mean_z += z
        mean_x, mean_y, mean_z = mean_x / steps, mean_y / steps, mean_z / steps
        # steps of shares and prices in the proportion of the ways that both went
        way_x, way_y = np.linalg.norm(mean_x - self.shares), np.hypot(np.linalg.norm(mean_y - self.prices), np.linalg.norm(mean_z - self.sums))
        if way_x > 1e-9 and way_y > 1e-9:
            self.weight = float(np.sqrt(self.weight * way_x / way_y))
        self.shares, self.prices, self.sums = mean_x, mean_y, mean_z
        off = np.abs(np.bincount(self.row, self.sign * self.shares[self.column], self.rows)).sum() + np.abs(1 - np.bincount(self.group, self.shares, self.groups)).sum()
        return max(self.bound(self.prices), self.bound(y)), float(off)

    def states(self) -> tuple[np.ndarray, np.ndarray]:
        """(state, how clear it is from 0 to 1) of every variable, by its shares."""
        state, clear = np.zeros(len(self.sizes), int), np.ones(len(self.sizes))
        for v in range(len(self.sizes)):
            own = self.shares[self.first[v] : self.first[v + 1]]
            top = int(np.argmax(own))
            state[v], clear[v] = top, own[top] / max(own.sum(), 1e-12) - (np.partition(own, -2)[-2] if len(own) > 1 else 0.0)
        return state, clear
