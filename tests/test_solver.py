"""The exact solver against enumeration on random small components."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from trackweave.operators.mergers import bic, kmeans, mixture
from trackweave.plans.chaingraph import build as build_chain
from trackweave.plans.chaingraph import incoming_table, outgoing_table, priced
from trackweave.plans.chaingraph import solve_component as solve_chain
from trackweave.plans import chaingraph, prices, windows
from trackweave.plans.conservation import ConservationModel, build, single_objects, solve_component, windowed
from trackweave.plans.flow import match
from trackweave.plans.relaxation import Relaxation
from trackweave.plans.solver import INFINITY, Problem, eliminate, solve
from trackweave.plans.trackers import ChaingraphTracker


def enumerate_conservation(nodes, arcs, m, divisions):
    best = float("inf")
    arcs, nodes = arcs.to_dict("records"), nodes.to_dict("records")
    for y in itertools.product(range(m + 1), repeat=len(arcs)):
        total = sum(a["e"][v] for a, v in zip(arcs, y, strict=True))
        for n in nodes:
            into = [v for a, v in zip(arcs, y, strict=True) if a["dst"] == n["node"]]
            out = [v for a, v in zip(arcs, y, strict=True) if a["src"] == n["node"]]
            least = float("inf")
            for app, dis, d in itertools.product(range(m + 1), range(m + 1), (0, 1) if divisions and len(out) > 1 else (0,)):
                if (out and sum(out) != app + d) or (into and sum(into) != dis) or any(v > app for v in out):
                    continue
                if (d and (app != 1 or sorted(out)[-2:] != [1, 1] or sum(out) != 2)) or not (app == dis or app == 0 or dis == 0):
                    continue
                cost = n["e"][max(app, dis)] + (app * n["app"] if not dis else 0) + (dis * n["dis"] if not app else 0)
                if divisions and len(out) > 1:
                    cost += n["div1"] if d else n["div0"]
                least = min(least, cost)
            total += least
        best = min(best, total)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_conservation_matches_enumeration(seed):
    r = random.Random(seed)
    m, n = r.choice([1, 2]), r.randint(2, 6)
    nodes = pd.DataFrame([dict(node=k, e=[r.uniform(0, 5) for _ in range(m + 1)], app=r.uniform(0, 5), dis=r.uniform(0, 5), div0=r.uniform(0, 2), div1=r.uniform(-3, 3)) for k in range(n)])
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    r.shuffle(pairs)
    arcs = pd.DataFrame([dict(arc=k, src=a, dst=b, e=[r.uniform(0, 2)] + [r.uniform(-3, 3)] * m) for k, (a, b) in enumerate(pairs[: r.randint(1, 7)])])
    divisions = r.random() < 0.7
    found = solve_component(nodes, arcs, ConservationModel(states=m, divisions=divisions))
    assert found.cost == pytest.approx(enumerate_conservation(nodes, arcs, m, divisions))
    assert found.gap == 0


def test_hubs_are_split_into_running_sums():
    r = random.Random(3)
    nodes = pd.DataFrame([dict(node=k, e=[r.uniform(0, 5) for _ in range(3)], app=1.0, dis=1.0, div0=0.1, div1=0.2) for k in range(8)])
    arcs = pd.DataFrame([dict(arc=k, src=0, dst=k + 1, e=[1.0, r.uniform(-3, 0), 0.5]) for k in range(7)])
    found = solve_component(nodes, arcs, ConservationModel())
    assert found.cost == pytest.approx(enumerate_conservation(nodes, arcs, 2, True))


@pytest.mark.parametrize("seed", range(20))
def test_chaingraph_matches_enumeration(seed):
    r = random.Random(seed)
    nodes = pd.DataFrame([dict(node=k, det=r.uniform(0, 5), non=r.uniform(0, 9), app=r.uniform(0, 4), dis=r.uniform(0, 4), opp=r.uniform(0, 1)) for k in range(5)])
    ends = r.sample([(a, b) for a in range(5) for b in range(a + 1, 5)], 6)
    arcs = pd.DataFrame([dict(src=a, dst=b, move=r.uniform(-6, 3)) for a, b in ends])
    division = {(s, *sorted(p)): r.uniform(-8, 3) for s in range(5) for p in itertools.combinations([b for a, b in ends if a == s], 2)}
    cost, gap, _, _ = solve_chain(nodes, arcs, division, ChaingraphTracker())
    best = float("inf")
    for on in itertools.product((0, 1), repeat=5):
        for used in itertools.product((0, 1), repeat=6):
            total = 0.0
            for n in nodes.itertuples():
                out = sorted(b for (a, b), u in zip(ends, used, strict=True) if u and a == n.node)
                into = sum(u for (_, b), u in zip(ends, used, strict=True) if b == n.node)
                if (not on[n.node] and (out or into)) or len(out) > 2 or into > 1:
                    break
                move = {b: float(arcs.move[k]) for k, (a, b) in enumerate(ends) if a == n.node}
                total += (n.det if on[n.node] else n.non + n.opp) + (n.app if on[n.node] and not into else 0)
                if on[n.node]:
                    total += n.dis if not out else move[out[0]] if len(out) == 1 else division[n.node, out[0], out[1]]
            else:
                best = min(best, total)
    assert cost == pytest.approx(best) and gap == 0


@pytest.mark.parametrize("seed", range(12))
def test_relaxation_and_branching_match_enumeration(seed):
    """With tables of a few entries at most, only the relaxation and its branches can prove the optimum."""
    r = random.Random(seed)
    m, n = r.choice([1, 2]), 5
    nodes = pd.DataFrame([dict(node=k, e=[r.uniform(0, 5) for _ in range(m + 1)], app=r.uniform(0, 5), dis=r.uniform(0, 5), div0=r.uniform(0, 2), div1=r.uniform(-3, 3)) for k in range(n)])
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    r.shuffle(pairs)
    arcs = pd.DataFrame([dict(arc=k, src=a, dst=b, e=[r.uniform(0, 2)] + [r.uniform(-3, 3)] * m) for k, (a, b) in enumerate(pairs[:7])])
    best = enumerate_conservation(nodes, arcs, m, True)
    found = solve_component(nodes, arcs, ConservationModel(states=m, limit=4, gap=1e-4))
    assert best - 1e-6 <= found.cost <= best + 1e-4 * abs(found.cost) + 1e-6 and found.gap <= 1e-4
    loose = solve_component(nodes, arcs, ConservationModel(states=m, limit=4, gap=0.2))
    assert best - 1e-6 <= loose.cost and loose.cost - loose.gap * abs(loose.cost) <= best + 1e-6


def test_bounds_never_pass_the_optimum():
    r = np.random.default_rng(5)
    for _ in range(10):
        p = Problem()
        v = [p.variable(int(r.integers(1, 4))) for _ in range(6)]
        for a, b, c in [(0, 1, 2), (2, 3, 4), (4, 5, 0), (1, 3, 5)]:
            table = r.normal(size=[p.sizes[v[a]], p.sizes[v[b]], p.sizes[v[c]]])
            table[r.random(table.shape) < 0.2] = INFINITY
            p.add((v[a], v[b], v[c]), table)
        best = min(p.value(np.array(x)) for x in itertools.product(*map(range, p.sizes)))
        relaxed, last = Relaxation(p.sizes, p.factors), -np.inf
        for _ in range(8):
            last = max(last, relaxed.improve(50)[0])
        assert last <= best + 1e-9
        if best < INFINITY / 2:
            value, labels, gap = solve(p, np.zeros(6, int), limit=2, gap=1e-3)
            assert value == pytest.approx(p.value(labels)) and gap <= 1e-3 and value <= best + 1e-3 * abs(value) + 1e-9


def test_a_gap_that_is_left_is_an_error():
    r = random.Random(2)
    nodes = pd.DataFrame([dict(node=k, det=r.uniform(0, 5), non=r.uniform(3, 9), app=4.0, dis=4.0, opp=0.0) for k in range(30)])
    arcs = pd.DataFrame([dict(src=a, dst=b, move=r.uniform(-6, 3)) for a in range(30) for b in range(30) if a // 6 + 1 == b // 6])
    pairs = {(a, b, c): r.uniform(-9, 9) for a in range(24) for b, c in itertools.combinations(range(6 * (a // 6 + 1), 6 * (a // 6 + 2)), 2)}
    tracker = ChaingraphTracker(limit=50, gap=0.01)
    cost, gap, _, _ = solve_chain(nodes, arcs, pairs, tracker)
    assert gap <= 0.01
    near, less, _, _ = solve_chain(nodes, arcs, pairs, ChaingraphTracker(limit=50, gap=1e-4))
    assert less <= 1e-4 and near - less * abs(near) - 1e-6 <= cost and cost - gap * abs(cost) <= near + 1e-6
    with pytest.raises(RuntimeError, match="gap"):
        solve_chain(nodes, arcs, pairs, ChaingraphTracker(limit=50, time_limit=0.0))
    _, left, _, _ = solve_chain(nodes, arcs, pairs, ChaingraphTracker(limit=50, time_limit=0.0, unproven=True))
    assert left > 0.01


def test_elimination_grows_in_proportion_to_a_chain():
    def chain(n):
        p, r = Problem(), np.random.default_rng(0)
        on, used = [p.variable(2) for _ in range(n)], [p.variable(2) for _ in range(n - 1)]
        for k in range(n):
            scope = (*used[max(0, k - 1) : k], on[k], *used[k : k + 1])
            p.add(scope, r.normal(size=[2] * len(scope)))
        began = time.process_time()
        value, labels, exact = eliminate(p)
        assert exact and value == pytest.approx(p.value(labels))
        return time.process_time() - began

    chain(100)
    assert chain(4000) < 12 * chain(1000)


@pytest.mark.parametrize("seed", range(30))
def test_flow_matches_enumeration(seed):
    """One object a detection without divisions is a flow, whatever may be forbidden."""
    r = random.Random(seed)
    n = r.randint(2, 6)
    nodes = pd.DataFrame([dict(node=k, e=[r.uniform(0, 9), r.uniform(0, 9)], app=r.uniform(4, 9), dis=r.uniform(4, 9), div0=0.0, div1=0.0) for k in range(n)])
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    r.shuffle(pairs)
    arcs = pd.DataFrame([dict(arc=k, src=a, dst=b, e=[r.uniform(0, 2), r.uniform(-9, 9)]) for k, (a, b) in enumerate(pairs[:8])])
    model = ConservationModel(states=1, divisions=False, misdetections=r.random() < 0.5, appearance=r.random() < 0.7, disappearance=r.random() < 0.7, tracklets=r.random() < 0.3)
    part = build(nodes, arcs, model)
    exact, _, _ = eliminate(part.problem)
    found = single_objects(part, {(a["src"], a["dst"]): np.array(a["e"]) for a in arcs.to_dict("records")}, model)
    assert found and (found[0] == pytest.approx(exact) or (exact >= INFINITY / 2 and found[0] == np.inf))
    if exact < INFINITY / 2:
        assert part.problem.value(found[1]) == pytest.approx(exact)
        assert solve_component(nodes, arcs, model).cost == pytest.approx(exact)


@pytest.mark.parametrize("seed", range(30))
def test_flow_of_a_chaingraph_matches_elimination(seed):
    r = random.Random(seed)
    n = r.randint(2, 9)
    nodes = pd.DataFrame([dict(node=k, det=r.uniform(-5, 5), non=r.uniform(-3, 9), app=r.uniform(0, 4), dis=r.uniform(0, 4), opp=r.uniform(0, 1)) for k in range(n)])
    ends = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6] or [(0, 1)]
    arcs = pd.DataFrame([dict(src=a, dst=b, move=r.uniform(-6, 6)) for a, b in ends])
    options = ChaingraphTracker(divisions=False, fixed_detections=r.random() < 0.3, detection_variables=r.random() < 0.8)
    cost, gap, on, used = solve_chain(nodes, arcs, {}, options)
    part = build_chain(nodes, arcs, {}, options)
    assert gap == 0 and cost == pytest.approx(eliminate(part.problem)[0])
    labels = np.zeros(len(part.problem.sizes), int)
    for values, names in ((on, part.nodes), (used, part.arcs)):
        for k, v in names.items():
            labels[v] = values[k]
    if len(labels) == len(part.nodes) + len(part.arcs):  # no running sums
        assert part.problem.value(labels) == pytest.approx(cost)


def test_flow_of_a_hundred_thousand_nodes():
    r = np.random.default_rng(0)
    frames, each = 100, 1000
    ends = {(f, k): f * each + k for f in range(frames) for k in range(each)}
    nodes = {v: (-20.0, 8.0, 8.0) for v in ends.values()}
    arcs = {(ends[f, k], ends[f + 1, int(j)]): float(r.uniform(0, 10)) for f in range(frames - 1) for k in range(each) for j in (k + r.integers(-3, 4, size=3)) % each}
    began = time.process_time()
    cost, used, off = match(nodes, arcs, dict.fromkeys(nodes, 0.0))
    assert time.process_time() - began < 60
    # one arc in and out at most, and no better by taking or leaving any one arc
    chosen = [k for k, x in used.items() if x]
    assert len({a for a, _ in chosen}) == len(chosen) == len({b for _, b in chosen})
    total = sum(arcs[k] for k in chosen) + sum(-20 for n in nodes if n not in off) + 8 * 2 * (len(nodes) - len(off)) - 16 * len(chosen)
    assert cost == pytest.approx(total)


def test_explicit_tables():
    table = incoming_table(3, 3.0, 8.0)
    assert all(table[x] == 8 for x in itertools.product((0, 1), repeat=4) if sum(x[:-1]) > 1 or (sum(x[:-1]) and not x[-1]))
    assert [outgoing_table([5.0, 5.0], {(0, 1): 6.0}, 4.0, 7.0, 8.0, True)[x] for x in itertools.product((0, 1), repeat=3)] == [7, 8, 8, 8, 4, 5, 5, 6]
    assert table[0, 0, 0, 0] == 0 and table[0, 0, 0, 1] == 3 and table[1, 0, 0, 1] == 0 and table[1, 0, 0, 0] == 8 and table[1, 1, 0, 1] == 8


def test_wide_problems_report_a_gap_and_a_bound():
    r = np.random.default_rng(1)
    p = Problem()
    v = [p.variable(2) for _ in range(9)]
    for a, b in itertools.combinations(v, 2):
        p.add((a, b), r.normal(size=(2, 2)))
    exact, labels, ok = eliminate(p)
    assert ok and exact == pytest.approx(p.value(labels)) == pytest.approx(min(p.value(np.array(x)) for x in itertools.product((0, 1), repeat=9)))
    value, _, gap = solve(p, np.zeros(9, int), limit=16)
    assert value >= exact - 1e-9 and gap >= 0 and value - gap * abs(value) <= exact + 1e-9


def test_kmeans_and_mixtures():
    x = np.array([[-6, 0, 0], [-5, 0, 0], [-4, 0, 0], [6, 0, 0], [5, 0, 0], [4, 0, 0]], float)
    assert sorted(kmeans(x, 2)[:, 0]) == [-5, 5]
    centre, score = mixture(x, 2)
    assert sorted(centre[:, 0].round(6)) == [-5, 5] and np.isfinite(score)
    assert bic(score, 6, 2, 0.5) == pytest.approx(score / 6 - 1)


@pytest.mark.parametrize("seed", range(3))
def test_windows_agree_with_the_whole(seed):
    """Shares and labels passed from window to window close the gap to the best labelling of the whole."""
    r = random.Random(seed)
    frames, each, width = 12, 3, 4
    at = lambda f, k: (f << 32) + k
    nodes = pd.DataFrame([dict(node=at(f, k), e=[24.1, 3.6, 15.6], app=100.0 if f else 0.0, dis=100.0 if f < frames - 1 else 0.0, div0=r.uniform(0, 5), div1=r.uniform(0, 20)) for f in range(frames) for k in range(each)])
    arcs = pd.DataFrame([dict(src=at(f, a), dst=at(f + 1, b), e=[r.uniform(0, 5), *[r.uniform(0, 40)] * 2]) for f in range(frames - 1) for a in range(each) for b in range(each) if a == b or r.random() < 0.4])
    model = ConservationModel()
    exact, _, ok = eliminate(build(nodes, arcs, model).problem)
    assert ok
    arcs["share"], arcs["label"], arcs["proposal"] = arcs.e, 0, 0
    bound = -np.inf
    for k in range(8):
        place = lambda n, k=k: ((n >> 32) + k % 2 * (width // 2)) // width
        solved = []
        for w in sorted(set(map(place, nodes.node))):
            own = nodes[[place(n) == w for n in nodes.node]]
            near = arcs[[w in (place(a), place(b)) for a, b in zip(arcs.src, arcs.dst, strict=True)]]
            solved.append((set(own.node), windows.solve_window(windowed(model), own, near, 0.001, 2e6)))
        now, cost = sum(x.bound for _, x in solved), min(sum(x.better[0] for _, x in solved), sum(x.other[0] for _, x in solved))
        other = cost < sum(x.better[0] for _, x in solved)
        bound = max(bound, now)
        assert now <= exact + 1e-6 <= cost + 2e-6
        new = {a: (int((x.other if other else x.better)[1][v]), int(x.free[v]), x.shares.get(a)) for own, x in solved for a, v in x.part.arcs.items() if a[0] in own}
        keys = list(zip(arcs.src, arcs.dst, strict=True))
        arcs["label"], arcs["proposal"] = [new[a][0] for a in keys], [new[a][1] for a in keys]
        arcs["share"] = [s if new[a][2] is None else list(new[a][2]) for a, s in zip(keys, arcs.share, strict=True)]
        whole = build(nodes, arcs, model)
        assert eliminate(whole.problem, np.inf, {whole.arcs[a]: new[a][0] for a in keys})[0] == pytest.approx(cost)
    assert cost - bound <= 0.01 * abs(cost)


@pytest.mark.parametrize("seed", range(4))
def test_prices_of_a_crowded_chaingraph(seed):
    """Prices give a bound, and a labelling close to it, where exact elimination is out of reach or says the least cost."""
    r = np.random.default_rng(seed)
    frames, each = (4, 4) if seed < 2 else (8, 40)
    at = r.normal(size=(frames, each, 3)) * 12
    key = lambda f, k: (f << 32) + k
    nodes = pd.DataFrame([dict(node=key(f, k), det=10.0, non=500.0, app=500.0, dis=500.0, opp=0.0) for f in range(frames) for k in range(each)])
    rows, pairs = [], {}
    for f in range(frames - 1):
        for k in range(each):
            d = np.sqrt(((at[f + 1] - at[f, k]) ** 2).sum(axis=1))
            near = sorted(int(j) for j in np.argsort(d)[: min(each - 1, 6)])
            rows += [dict(src=key(f, k), dst=key(f + 1, j), move=float(d[j])) for j in near]
            pairs |= {(key(f, k), key(f + 1, i), key(f + 1, j)): float((d[i] - 10) ** 2 + (d[j] - 10) ** 2) for i, j in itertools.combinations(near, 2)}
    arcs, options = pd.DataFrame(rows), ChaingraphTracker()
    part, by = build_chain(nodes, arcs, pairs, options), priced(nodes, arcs, pairs, options)
    bound = by.improve()
    value, labels = by.labels(part, {}, 200_000)
    assert value == pytest.approx(part.problem.value(labels)) and bound <= value + 1e-6
    least, _, exact = eliminate(part.problem, 2e6)
    assert exact == (seed < 2)
    if exact:
        assert bound <= least + 1e-6 <= value + 2e-6
    assert value - bound <= 0.01 * value
    began = time.monotonic()
    cost, gap, on, used = solve_chain(nodes, arcs, pairs, options)
    assert gap <= 0.01 and time.monotonic() - began < 20
    labels = [on[n] for n in part.nodes], [used[a] for a in part.arcs]
    whole = np.zeros(len(part.problem.sizes), int)
    whole[list(part.nodes.values())], whole[list(part.arcs.values())] = labels
    if len(whole) == len(part.nodes) + len(part.arcs):
        assert part.problem.value(whole) == pytest.approx(cost)


@pytest.mark.parametrize("dives", [prices.DIVES, 1])
def test_windows_by_prices(monkeypatch, dives):
    """Windows of a chaingraph pass on prices and label without tables, unless a dive leaves arcs open; costs are those of the whole."""
    monkeypatch.setattr(prices, "DIVES", dives)
    built = []
    monkeypatch.setattr(chaingraph, "build", lambda *a: built.append(1) or build_chain(*a))
    r = np.random.default_rng(5)
    frames, each, width = 12, 20, 4
    at = r.normal(size=(frames, each, 3)) * 12
    key = lambda f, k: (f << 32) + k
    nodes = pd.DataFrame([dict(node=key(f, k), det=10.0, non=500.0, app=500.0, dis=500.0, opp=0.0) for f in range(frames) for k in range(each)])
    rows, pairs = [], {}
    for f in range(frames - 1):
        for k in range(each):
            d = np.sqrt(((at[f + 1] - at[f, k]) ** 2).sum(axis=1))
            near = sorted(int(j) for j in np.argsort(d)[:6])
            costs = {(i, j): float((d[i] - 10) ** 2 + (d[j] - 10) ** 2) for i, j in itertools.combinations(near, 2)}
            rows += [dict(src=key(f, k), dst=key(f + 1, j), move=float(d[j]), divisions=[dict(d2=key(f + 1, b), cost=c) for (a, b), c in costs.items() if a == j]) for j in near]
            pairs |= {(key(f, k), key(f + 1, i), key(f + 1, j)): c for (i, j), c in costs.items()}
    arcs, options = pd.DataFrame(rows), ChaingraphTracker()
    whole = build_chain(nodes, arcs, pairs, options)
    arcs["share"], arcs["label"], arcs["proposal"] = [[0.0, 0.0]] * len(arcs), 0, 0
    keys, bound = list(zip(arcs.src, arcs.dst, strict=True)), -np.inf
    for k in range(4):
        place = lambda n, k=k: ((n >> 32) + k % 2 * (width // 2)) // width
        solved = []
        for w in sorted(set(map(place, nodes.node))):
            own = nodes[[place(n) == w for n in nodes.node]]
            near = arcs[[w in (place(a), place(b)) for a, b in keys]]
            x = windows.solve_window(chaingraph.windowed(options), own, near, 0.01, 2e6, k > 0, k == 0)
            solved.append((set(own.node), x))
        other = sum(x.other[0] for _, x in solved) < sum(x.better[0] for _, x in solved)
        cost = sum((x.other if other else x.better)[0] for _, x in solved)
        bound = max(bound, sum(x.bound for _, x in solved))
        new = {a: (int((x.other if other else x.better)[1][v]), int(x.free[v]), x.shares.get(a)) for own, x in solved for a, v in x.part.arcs.items() if a[0] in own}
        on = {n: int((x.other if other else x.better)[1][v]) for own, x in solved for n, v in x.part.nodes.items()}
        fixed = {whole.arcs[a]: new[a][0] for a in keys}
        assert eliminate(whole.problem, np.inf, fixed)[0] == pytest.approx(cost) == pytest.approx(eliminate(whole.problem, np.inf, fixed | {whole.nodes[n]: v for n, v in on.items()})[0])
        assert bound <= cost + 1e-6
        arcs["label"], arcs["proposal"] = [new[a][0] for a in keys], [new[a][1] for a in keys]
        arcs["share"] = [s if new[a][2] is None else list(new[a][2]) for a, s in zip(keys, arcs.share, strict=True)]
        if k and cost - bound <= 0.01 * cost:
            break
    assert dives == 1 or cost - bound <= 0.01 * cost
    assert bool(built) == (dives == 1)
