"""Scenes with given probabilities, merger resolution, explicit tables, stores and graphs made by hand."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import energies as en
from trackweave.functions.geometry import FieldOfView
from trackweave.operators import candidates, classifier, detections, events, forest, graph, loglinear, mergers, pixels
from trackweave.operators.hypotheses import HypothesesGraph
from trackweave.plans import factors, learning
from trackweave.plans.trackers import ChaingraphTracker, ConservationTracker
from trackweave.sources import graphs, stores

BASE = ConservationTracker(radius=99999.0, division_threshold=0.1, gap=0.05, tracklets=True, appearance_cost=1500, disappearance_cost=1500)
SCHEMA = "timestep int, id long, x double, y double, z double, x_corr double, y_corr double, z_corr double, div_prob double, count double, det_prob array<double>"


def placed(text, prob, shift=(), div=0.01, divs=()):
    """``id@t(x,y[,z])`` words to rows; ``prob`` and ``shift`` by id, None: for all others."""
    out = []
    for word in text.split():
        key, at = word.split("@")
        t, p = at.split("(")
        xyz = [*map(float, p[:-1].split(",")), 0.0, 0.0][:3]
        s = [*dict(shift).get(int(key), (0.0, 0.0)), 0.0]
        out.append((int(t), int(key), *xyz, *[a + float(b) for a, b in zip(xyz, s, strict=True)], dict(divs).get(int(key), div), 1.0, list(map(float, prob.get(int(key), prob[None])))))
    return out


def counts(found):
    return {r.type: r["count"] for r in found.groupBy("type").count().collect()}


def shown(found):
    return sorted((r.slot, r.type, *r.traxel_ids) for r in found.collect())


def cost(nodes):
    return nodes.agg(F.sum("cost")).first()[0]


ONE, TWO, NONE = (0.01, 0.98, 0.01), (0.01, 0.01, 0.98), (0.98, 0.01, 0.01)


def test_merger_that_divides_later(spark):
    text = "11@1(854,718) 12@1(846,751) 21@2(845,732) 31@3(853,724) 32@3(835,747) 41@4(825,753) 42@4(842,761) 43@4(853,724)"
    det = spark.createDataFrame(placed(text, {None: ONE, 21: TWO, 42: NONE}), SCHEMA)
    tracker = replace(BASE, appearance_cost=500, disappearance_cost=500)
    found, nodes, used = tracker.track(*tracker.build_graph(det))
    assert cost(nodes) == pytest.approx(155.610, abs=2e-3)
    of = counts(found)
    assert "Appearance" not in of and "Disappearance" not in of and sum(of.values()) >= 3


@pytest.mark.parametrize("tracklets", [False, True])
def test_shifted_positions(spark, tracklets):
    there, back = (100, 100), (-100, -100)
    text = "11@1(100,100) 12@1(200,200) 21@2(100,100) 22@2(200,200) 23@2(300,300) 31@3(0,0) 32@3(100,100) 33@3(200,200)"
    shift = {11: there, 12: there, 21: back, 22: back, 23: back, 31: there, 32: back, 33: there}.items()
    det = spark.createDataFrame(placed(text, {None: (0, 1)}, shift, 0.0), SCHEMA)
    tracker = replace(BASE, max_objects=1, radius=301.0, divisions=False, tracklets=tracklets, appearance_cost=10, disappearance_cost=10)
    found, nodes, _ = tracker.track(*tracker.build_graph(det))
    assert cost(nodes) == pytest.approx(10.0, abs=1e-3)
    assert shown(found) == [(1, "Appearance", 21), (1, "Move", 11, 22), (1, "Move", 12, 23), (2, "Move", 21, 31), (2, "Move", 22, 32), (2, "Move", 23, 33)]


def test_shifted_positions_of_two_tracks(spark):
    text = "11@1(90,267) 12@1(113,312) 21@2(83,270) 22@2(106,315) 31@3(90,267) 32@3(113,312) 41@4(117,313) 42@4(140,358)"
    shift = {11: (-7, 3), 12: (-7, 3), 21: (7, -3), 22: (7, -3), 31: (27, 46), 32: (27, 46)}.items()
    det = spark.createDataFrame(placed(text, {None: (0, 1)}, shift, 0.0), SCHEMA)
    tracker = replace(BASE, max_objects=1, radius=301.0, divisions=False, appearance_cost=10, disappearance_cost=10)
    found, nodes, _ = tracker.track(*tracker.build_graph(det))
    assert cost(nodes) == pytest.approx(0.0, abs=1e-3)
    assert shown(found) == [(t, "Move", 10 * t + k, 10 * t + 10 + k) for t in (1, 2, 3) for k in (1, 2)]


def test_merger_without_a_way_out(spark):
    det = spark.createDataFrame(placed("11@1(0,0) 12@1(2,2) 21@2(1,1) 31@3(1,1)", {None: ONE, 21: TWO, 31: TWO}), SCHEMA)
    found, nodes, used = BASE.track(*BASE.build_graph(det))
    assert cost(nodes) == pytest.approx(6.465, abs=1e-3)
    assert counts(found) == {"Move": 3, "Merger": 2}
    pixels = spark.createDataFrame([(t, i, [x, x, 0.0]) for t, i in ((2, 21), (3, 31)) for x in (0.0, 0.2, 1.8, 2.0)], stores.PIXELS)
    whole = BASE.resolve_mergers(nodes, used, pixels, n_dim=2)
    assert counts(whole) == {"Move": 3, "Merger": 2}
    assert shown(BASE.resolve_mergers(nodes, used, pixels, False, 2)) == [(1, "Move", 11, 22), (1, "Move", 12, 23), (1, "ResolvedTo", 21, 22, 23), (2, "Move", 22, 32), (2, "Move", 23, 33), (2, "ResolvedTo", 31, 32, 33)]


def test_division_into_two_mergers(spark):
    one, two = (0, 1, 0), (0, 0, 1)
    det = spark.createDataFrame(placed("11@1(0,0) 12@1(2,2) 13@1(4,4) 21@2(0,0) 22@2(4,4)", {None: one, 21: two, 22: two}, divs={12: 1.0}.items()), SCHEMA)
    tracker = replace(BASE, gap=0.0, fov=FieldOfView((0, 0, 0, 0), (4, 1000, 1000, 1)))
    found, nodes, used = tracker.track(*tracker.build_graph(det))
    assert cost(nodes) == pytest.approx(11.314, abs=1e-3)
    want = [(1, "Division", 12, 22, 21), (1, "Merger", 21, 2), (1, "Merger", 22, 2), (1, "Move", 11, 21), (1, "Move", 13, 22)]
    assert shown(found) == want
    pixels = spark.createDataFrame([(2, 21, [0.0, 0.0, 0.0]), (2, 21, [1.0, 1.0, 0.0]), (2, 22, [4.0, 4.0, 0.0]), (2, 22, [5.0, 5.0, 0.0])], stores.PIXELS)
    assert shown(tracker.resolve_mergers(nodes, used, pixels, n_dim=2)) == want
    # the mother divides into one part of each merger
    alive, going = tracker.active(nodes, used)
    fit = graph.cut_lineage(mergers.seeded_fit(pixels, alive, going, 2), "fit")
    parts = graph.cut_lineage(mergers.split(nodes, fit), "parts")
    links = mergers.resolve(alive, going, parts).where("active").collect()
    assert len(links) == 4 and sorted(r.src for r in links) == [11, 12, 12, 13] and len({r.dst for r in links}) == 4
    origin = {r.id: r.origin for r in parts.collect()}
    assert {origin[r.dst] for r in links if r.src == 12} == {21, 22}


def test_a_built_graph_can_be_tracked_again(spark):
    text = "1@1(0,0,0) 3@1(2,2,2) 10@2(2,2,2) 11@3(2,2,2)"
    det = spark.createDataFrame(placed(text, {None: (0.1, 0.8, 0.1)}), SCHEMA)
    built = BASE.build_graph(det)
    first = shown(BASE.track(*built)[0])
    assert shown(replace(BASE, transition_weight=1.0, division_weight=1.0).track(*built)[0]) and shown(BASE.track(*built)[0]) == first


def test_appearances_and_mergers_by_size(spark):
    words = [*[f"{k}@{k}(0,0,0)" for k in (1, 2, 3)], *[f"{k}@{k - 3}(5,5,5)" for k in (4, 5, 6)], *[f"{k}@{k - 6}(10,10,10)" for k in (7, 8, 9)], "10@2(15,15,15)", "11@3(15,15,15)", "12@3(20,20,20)"]
    rows = [(t, i, x, y, z, 0.1, 10.0 if i in (7, 8, 9) else 1.0) for t, i, x, y, z, *_ in placed(" ".join(words), {None: ()})]
    det = spark.createDataFrame(rows, "timestep int, id long, x double, y double, z double, div_prob double, count double")
    tracker = ConservationTracker(radius=2.0, size_prior=True, average_size=1.0, appearance_cost=10, disappearance_cost=10)
    found, nodes, _ = tracker.track(*tracker.build_graph(det))
    assert cost(nodes) == pytest.approx(3.539, abs=1e-3)
    assert counts(found) == {"Move": 7, "Appearance": 2, "Merger": 3}
    assert {(r.slot, r.traxel_ids[0]) for r in found.where("type = 'Merger'").collect()} == {(0, 7), (1, 8), (2, 9)}


def test_given_probabilities_win_over_sizes(spark):
    det = spark.createDataFrame(placed("1@1(0,0,0)", {None: (0.2, 0.5, 0.3)}), SCHEMA)
    for tracker in (BASE, replace(BASE, size_prior=True, average_size=5.0)):
        assert tracker.build_graph(det)[0].first().det_prob == [0.2, 0.5, 0.3]
    with pytest.raises(ValueError, match="count"):
        replace(BASE, size_prior=True, average_size=5.0).build_graph(det.drop("det_prob", "count"))
    with pytest.raises(ValueError, match="x"):
        BASE.build_graph(det.drop("x"))


def test_without_constraints_the_tables_are_written(spark):
    det = spark.createDataFrame(placed("1@1(0,0,0) 2@2(0,0,1)", {None: (0.1, 0.8, 0.1)}), SCHEMA)
    tracker = replace(BASE, constraints=False)
    with pytest.raises(NotImplementedError, match="conservation-factors"):
        tracker.track(*tracker.build_graph(det))


def test_split_in_the_middle_and_pixels(spark):
    at = [(1, 11, 1.0), (1, 12, 6.0), (2, 21, 3.0), (3, 31, 1.0), (3, 32, 6.0)]
    nodes = spark.createDataFrame([(t, i, 2 if i == 21 else 1, x, 0.0, 0.0) for t, i, x in at], "timestep int, id long, n_objects int, x double, y double, z double")
    arcs = spark.createDataFrame([(1, 11, 2, 21), (1, 12, 2, 21), (2, 21, 3, 31), (2, 21, 3, 32)], "src_t int, src long, dst_t int, dst long")
    pixels = spark.createDataFrame([(2, 21, [x, 0.0, 0.0]) for x in (0.9, 1.0, 1.1, 5.9, 6.0, 6.1)] + [(1, 11, [1.0, 0.0, 0.0])], stores.PIXELS)
    fit = mergers.seeded_fit(pixels.where("id = 21"), nodes, arcs)
    assert sorted(round(r.centre[0], 6) for r in fit.collect()) == [1, 6]
    parts = mergers.split(nodes, fit)
    assert sorted((r.timestep, r.id, r.origin) for r in parts.collect()) == [(2, 22, 21), (2, 23, 21)]
    links = mergers.replacement_arcs(nodes, arcs, parts)
    assert links.count() == 8 and {round(r.distance) for r in links.collect()} == {0, 5}
    moved = sorted((r.timestep, r.id, r.pixel[0]) for r in mergers.reassigned(pixels, parts, fit).collect())
    assert moved == [(1, 11, 1.0), *[(2, 22, x) for x in (0.9, 1.0, 1.1)], *[(2, 23, x) for x in (5.9, 6.0, 6.1)]]
    listed = nodes.where("id = 21").withColumn("merger_coms", F.array(*map(F.lit, (1.0, 0.0, 0.0, 6.0, 0.0, 0.0))))
    assert sorted(r.centre for r in mergers.centres_from_list(listed).collect()) == [[1, 0, 0], [6, 0, 0]]
    with pytest.raises(Exception, match="without pixels"):
        mergers.seeded_fit(pixels.where("id = 11"), nodes, arcs).collect()


def test_seeds_of_mergers_that_follow_mergers(spark):
    nodes = spark.createDataFrame([(t, i, n, x, 0.0, 0.0) for t, i, n, x in ((0, 1, 1, -3.0), (0, 2, 1, 3.0), (1, 3, 2, 0.0), (2, 4, 2, 0.0), (2, 9, 3, 50.0))], "timestep int, id long, n_objects int, x double, y double, z double")
    arcs = spark.createDataFrame([(0, 1, 1, 3), (0, 2, 1, 3), (1, 3, 2, 4)], "src_t int, src long, dst_t int, dst long")
    points = {(1, 3): (-2, -1, 2, 1), (2, 4): (-1, -2, 1, 2), (2, 9): (40, 41, 50, 51, 60, 61)}
    pixels = spark.createDataFrame([(t, i, [float(x), 0.0, 0.0]) for (t, i), xs in points.items() for x in xs], stores.PIXELS)
    got = {(r.timestep, r.id, r.k): r.centre[0] for r in mergers.seeded_fit(pixels, nodes, arcs, 1).collect()}
    assert got == pytest.approx({(1, 3, 0): -1.5, (1, 3, 1): 1.5, (2, 4, 0): -1.5, (2, 4, 1): 1.5, (2, 9, 0): 40.5, (2, 9, 1): 50.5, (2, 9, 2): 60.5}, abs=1e-2)


def test_fits():
    x = np.array([[-6, 0, 0], [-5, 0, 0], [-4, 0, 0], [6, 0, 0], [5, 0, 0], [4, 0, 0]], float)
    centre, labels = mergers.fitted(x, 2)
    assert sorted(centre[:, 0].round(6)) == [-5, 5] and len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3]
    assert np.allclose(mergers.centres_of(x, labels, 2), centre)
    assert np.isnan(mergers.centres_of(x, np.zeros(6, int), 2)[1]).all()
    # equal points leave a mixture's component empty; clusters take over
    assert mergers.fitted(np.array([[0.0], [0.0], [9.0]]), 2)[1].tolist() in ([0, 0, 1], [1, 1, 0])
    with pytest.raises(ValueError, match="3 objects"):
        mergers.fitted(x[:2], 3)


def test_ids_go_on_after_the_largest(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "timestep int, id long")
    assert {r.timestep: r.max_id for r in rows.groupBy("timestep").agg(F.max("id").alias("max_id")).collect()} == {1: 2, 2: 2}
    found = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 0.0]), (2, 2, 0, [1.0, 1.0, 1.0])], "timestep int, id long, k int, centre array<double>")
    assert sorted((r.timestep, r.id, r.origin) for r in mergers.split(rows, found).collect()) == [(1, 3, 1), (2, 3, 2)]


# graphs


ARCS = [(11, 21), (12, 21), (12, 22), (13, 23), (21, 31), (22, 32), (23, 33), (31, 41), (32, 42), (32, 43), (33, 43)]


def test_paths_of_active_arcs(spark):
    on = {(13, 23), (21, 31), (22, 32), (31, 41)}
    nodes = spark.createDataFrame([(n,) for n in (11, 12, 13, 14, 21, 22, 23, 31, 32, 33, 41, 42, 43)], "node long")
    arcs = spark.createDataFrame([(a, b, (a, b) in on) for a, b in ARCS], "src long, dst long, active boolean")
    paths, between = (graph.cut_lineage(x, "paths") for x in graph.active_tracklets(nodes, arcs))
    want = [[11], [12], [13, 23], [14], [21, 31, 41], [22, 32], [33], [42], [43]]
    assert sorted(r.members for r in paths.collect()) == want
    assert sorted(map(tuple, between.collect())) == [(11, 21), (12, 21), (12, 22), (13, 33), (22, 42), (22, 43), (33, 43)]
    again, links = graph.active_tracklets(paths.withColumnRenamed("head", "node"), between.withColumn("active", F.lit(False)))
    assert sorted(r.members for r in again.collect()) == want and links.count() == 7
    with pytest.raises(Exception, match="more than one active arc"):
        graph.active_tracklets(nodes, arcs.withColumn("active", F.lit(True)))


def test_an_active_arc_at_an_inactive_node_is_an_error(spark):
    nodes = spark.createDataFrame([(1, True), (2, False)], "node long, active boolean")
    arcs = spark.createDataFrame([(1, 2, True)], "src long, dst long, active boolean")
    with pytest.raises(Exception, match="inactive node"):
        graph.prune(nodes, arcs)[1].collect()


def test_graph_made_by_hand(spark):
    g = HypothesesGraph.empty(spark)
    g, a = g.add_node(0)
    g, b = g.add_node([1, 2], [(1, 7), (2, 8)])
    g, c = g.add_node(2)
    g, ab = g.add_arc(a, b)
    g, ac = g.add_arc(a, c)
    assert (a, b, c, ab, ac) == (0, 1, 2, 0, 1) and (g.count_nodes(), g.count_arcs(), g.timesteps()) == (3, 2, (0, 2))
    assert [r.node for r in g.at(2).orderBy("node").collect()] == [b, c]
    assert (g.source(ab), g.target(ab), g.opposite(a, ab), g.opposite(b, ab)) == (a, b, b, a)
    assert g.out_arcs(a).count() == 2 and g.in_arcs(c).count() == 1
    moved = g.change_end(ac, "src", b)
    assert moved.source(ac) == b and moved.erase_node(b).count_arcs() == 0 and moved.erase_arc(ab).count_arcs() == 1
    assert g.valid(c) and not g.erase_node(c).valid(c)
    for bad in (lambda: g.add_arc(0, 99), lambda: g.source(99), lambda: g.change_end(ab, "dst", 99)):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: g.opposite(c, ab), lambda: g.add_node([])):
        with pytest.raises(ValueError):
            bad()


def test_translate_subset_and_counts(spark):
    values = spark.createDataFrame([(1, "a"), (2, "b")], "node long, v string")
    names = spark.createDataFrame([(1, 10)], "node long, other long")
    assert [tuple(r) for r in graph.translate(values, names).select("node", "v").collect()] == [(10, "a")]
    nodes = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "node long, pick boolean")
    arcs = spark.createDataFrame([(1, 2, True), (2, 4, False)], "src long, dst long, pick boolean")
    some, links = graph.subset(nodes, arcs, "pick", "pick")
    assert sorted(r.node for r in some.collect()) == [1, 2, 3] and [(r.src, r.dst) for r in links.collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="n_objects, divides"):
        graph.require(nodes, "node", "n_objects", "divides")


# events


def test_order_text_and_slots_of_events(spark):
    rows = [(1, "MultiFrameMove", [1, 2, 0]), (1, "ResolvedTo", [5, 6, 7]), (1, "Move", [2, 3]), (1, "Move", [1, 9]), (3, "Void", [])]
    found = spark.createDataFrame(rows, "slot int, type string, traxel_ids array<long>")
    assert [(r.type, r.traxel_ids[:1]) for r in found.orderBy(*events.order_key()).collect()] == [("Move", [1]), ("Move", [2]), ("ResolvedTo", [5]), ("MultiFrameMove", [1]), ("Void", [])]
    assert {r[0] for r in found.select(events.render()).collect()} == {"MultiFrameMove: 1, 2, 0", "ResolvedTo: 5, 6, 7", "Move: 2, 3", "Move: 1, 9", "Void: "}
    nested = {r.slot: [e.type for e in r.events] for r in events.nested(found, 4).collect()}
    assert nested == {0: [], 1: ["Move", "Move", "ResolvedTo", "MultiFrameMove"], 2: [], 3: ["Void"]}
    resized = found.select(events.resize_features(F.array(F.lit(1.0), F.lit(2.0)), 3).alias("a"), events.resize_features(F.lit(None).cast("array<double>"), 2).alias("b")).first()
    assert (resized.a, resized.b) == ([1, 2, 0], [0, 0])


def test_sums_of_statistics(spark):
    rows = [(1, "Move", [1, 2]), (2, "Division", [1, 2, 3])]
    one = events.statistics(spark.createDataFrame(rows, "slot int, type string, traxel_ids array<long>"))
    got = {r.slot: (r.n_total, r.n_move, r.n_division) for r in events.add_statistics(one, one).collect()}
    assert got == {1: (2, 2, 0), 2: (2, 0, 2)}
    with pytest.raises(Exception, match="another type"):
        events.statistics(spark.createDataFrame([(1, "Merger", [1, 2])], "slot int, type string, traxel_ids array<long>")).collect()


# explicit tables


def chain_model(spark, **options):
    arcs = [("m1", "o1"), ("n2", "m1"), ("m4", "o4"), ("m4", "o3"), ("n3", "m4"), ("n1", "m2"), ("n3", "m3"), ("m2", "o2"), ("n2", "m2")]
    names = [f"{a}{k}" for a in "nmo" for k in (1, 2, 3, 4)]
    key = {n: k for k, n in enumerate(names)}
    nodes = spark.createDataFrame([(k, "nmo".index(n[0]), k, 0.0, 0.0, 0.0) for n, k in key.items()], "node long, timestep int, id long, x double, y double, z double")
    links = spark.createDataFrame([(key[a], key[b], 1.0) for a, b in arcs], "a long, b long, distance double")
    tracker = ChaingraphTracker(appearance=3, disappearance=4, detection=1, misdetection=2, move=lambda: F.lit(5.0), division=lambda: F.lit(6.0), opportunity=7, forbidden=8, **options)
    return key, nodes, links, tracker


def test_explicit_tables_of_a_chaingraph(spark):
    key, nodes, links, tracker = chain_model(spark)
    variables, entries = tracker.explicit_tables(nodes, links)
    entries = graph.cut_lineage(entries, "entries")
    assert variables.count() == 21 and entries.select("factor").distinct().count() == 36
    table = lambda kind, n: [r.value for r in entries.where(F.col("factor") == f"{kind}:{key[n]}").orderBy("at").collect()]
    assert table("incoming", "m2") == [0, 8, 8, 8, 3, 0, 0, 8]
    assert table("outgoing", "m4") == [7, 8, 8, 8, 4, 5, 5, 6]
    assert table("detection", "n4") == [2, 1]
    # entries are found and changed whatever the order of the variables
    arc = lambda a, b: f"a{key[a]}-{key[b]}"
    mine = [arc("n2", "m2"), f"n{key['m2']}", arc("n1", "m2")]
    name = f"incoming:{key['m2']}"
    assert factors.get_entry(entries, name, mine, [1, 1, 0]) == 0 and factors.get_entry(entries, name, mine, [0, 1, 0]) == 3
    change = lambda vars_, at: spark.createDataFrame([(name, vars_, at, 17.0)], "factor string, vars array<string>, at array<int>, value double")
    changed = factors.set_entries(entries, change(mine, [1, 1, 0]))
    assert factors.get_entry(changed, name, mine, [1, 1, 0]) == 17 and changed.where("value = 17").count() == 1
    for bad in (change(mine[:2], [1, 1]), change([*mine[:2], "x"], [1, 1, 0]), change(mine, [1, 2, 0])):
        with pytest.raises(Exception, match="other variables|no such entry"):
            factors.set_entries(entries, bad).collect()
    with pytest.raises(ValueError):
        chain_model(spark, detection_variables=False)[3].explicit_tables(nodes, links)
    with pytest.raises(ValueError, match="missing"):
        replace(tracker, appearance=None).explicit_tables(nodes, links)


def test_energies_of_explicit_tables_are_the_solvers(spark):
    key, nodes, links, tracker = chain_model(spark)
    tracker = replace(tracker, appearance=lambda: F.lit(1.5) + F.col("timestep"), misdetection=9)
    arcs = links.select((F.floor(F.col("a") / 4)).cast("int").alias("src_t"), F.col("a").alias("src"), (F.floor(F.col("b") / 4)).cast("int").alias("dst_t"), F.col("b").alias("dst"), "distance", "a", "b")
    _, entries = tracker.explicit_tables(nodes, arcs)
    labelled, used = tracker.infer(nodes, arcs)
    labels = labelled.select(factors.node_var(F.col("node")).alias("var"), F.col("active").cast("int").alias("state"))
    labels = labels.unionByName(used.select(factors.arc_var(F.col("a"), F.col("b")).alias("var"), F.col("active").cast("int").alias("state")))
    assert factors.energy(entries, labels).first()[0] == pytest.approx(cost(labelled))
    sums = factors.feature_sums(entries, labels)
    assert sum(r.total for r in sums.collect()) == pytest.approx(cost(labelled))
    weights = spark.createDataFrame([(w, 2.0) for w in loglinear.WEIGHTS], "weight string, w double")
    assert factors.energy(factors.weighted(entries, weights), labels).first()[0] == pytest.approx(2 * cost(labelled))
    assert loglinear.energy(sums, weights).first()[0] == pytest.approx(2 * cost(labelled))
    assert sorted((r.slot, r.active) for r in tracker.detections(labelled).collect()) == sorted((r.timestep, r.active) for r in labelled.collect())


def test_factors_by_hand(spark):
    table = factors.factor([1, 3], [2, 3], 2.0)
    assert sorted(table) == list(itertools.product(range(2), range(3))) and set(table.values()) == {2.0}
    for bad in (([3, 1], [2, 2]), ([1, 1], [2, 2]), ([1], [2, 2])):
        with pytest.raises(ValueError):
            factors.factor(*bad)
    labels = F.array(F.lit(1), F.lit(2), F.lit(3))
    row = spark.range(1).select(loglinear.indicator(labels, [1, 2, 3], 17.0, 2.0).alias("hit"), loglinear.indicator(labels, [1, 1, 3], 17.0, 2.0).alias("miss")).first()
    assert (row.hit, row.miss) == (17, 2)
    features = spark.createDataFrame([("0", "a", 0, 2.0), ("0", "b", 0, 2.0), ("1", "a", 0, 3.0), ("1", "a", 1, 9.0)], "weight string, variable string, label int, value double")
    chosen = spark.createDataFrame([("a", 0), ("b", 0)], "variable string, label int")
    assert {r.weight: r.total for r in loglinear.weighted_sums(features, chosen).collect()} == {"0": 4, "1": 3}


# storage


def test_stores(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = spark.sql("SELECT 3 AS timestep, 9L AS id, true AS alive, map('com', array(1.5f, 2f), 'count', array(4f)) AS features UNION ALL SELECT 4, 1L, false, map('com', array(0f)) UNION ALL SELECT 4, 2L, true, map()")
    stores.write_detections(rows, at("d"))
    assert sorted((r.timestep, r.id) for r in stores.read_detections(spark, at("d")).collect()) == [(3, 9), (4, 1), (4, 2)]
    stores.write_features(rows, at("f"))
    assert {(r.timestep, r.id): r.features for r in stores.read_features(spark, at("f")).collect()} == {(3, 9): {"com": [1.5, 2.0], "count": [4.0]}, (4, 2): {}}
    found = [(1, "Move", [1, 2]), (2, "Merger", [5, 2])]
    stores.write_events(spark.createDataFrame(found, stores.EVENTS), at("e"))
    assert sorted((r.slot, r.type, r.traxel_ids) for r in stores.read_events(spark, at("e")).collect()) == found
    stores.write_pixels(spark.createDataFrame([(1, 2, [3.0, 4.0])], stores.PIXELS), at("p"))
    assert [tuple(r) for r in stores.read_pixels(spark, at("p")).collect()] == [(1, 2, [3.0, 4.0])]
    _, nodes, links, tracker = chain_model(spark)
    stores.write_model(*tracker.explicit_tables(nodes, links), at("m"))
    assert [x.count() for x in stores.read_model(spark, at("m"))][0] == 21
    with pytest.raises(ValueError, match="traxel_ids"):
        stores.write_events(rows.withColumn("slot", F.lit(1)).withColumn("type", F.lit("Move")), at("x"))
    with pytest.raises(Exception, match="(?i)no such|not exist|not found|path"):
        stores.load_forest(at("none"))


def test_added_features(spark):
    row = spark.sql("SELECT map('com', array(1f)) AS f").select(detections.add_feature(F.col("f"), "new", 2).alias("f")).first()
    assert row.f == {"com": [1.0], "new": [0.0, 0.0]}


def test_crowded_cells_and_flat_scenes(spark):
    rows = spark.createDataFrame([(t, 10 * t + k, float(k), 0.0, 0.0) for t in (0, 1) for k in range(6)], "timestep int, id long, x double, y double, z double")
    arcs = candidates.arcs(rows, candidates.Candidates(2, 1.5, True))
    want = {(k, 10 + j) for k in range(6) for j in sorted(range(6), key=lambda j: (abs(j - k), j))[:2] if abs(j - k) <= 1}
    want |= {(j, 10 + k) for k in range(6) for j in sorted(range(6), key=lambda j: (abs(j - k), j))[:2] if abs(j - k) <= 1}
    assert {(r.src, r.dst) for r in arcs.collect()} == want


def test_graph_text_with_detections(spark, tmp_path):
    nodes = spark.createDataFrame([(k, k // 3, 100 + k) for k in range(9)], "node long, timestep int, traxel long")
    arcs = spark.createDataFrame([(0, 3), (1, 4), (3, 8)], "src long, dst long")
    path = f"file://{tmp_path}/g"
    graphs.write_lgf(nodes, arcs, path)
    a, b = graphs.read_lgf(spark, path, traxels=True)
    assert sorted(map(tuple, a.collect())) == [(k, k // 3, 100 + k) for k in range(9)] and sorted(map(tuple, b.collect())) == [(0, 3), (1, 4), (3, 8)]
    whole = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    lines = whole.splitlines()
    assert lines[:3] == ["@nodes", "label\ttimestep\ttraxel\t", "0\t0\t100\t"] and lines[11] == "@arcs" and [x.split("\t")[3:5] for x in lines[13:]] == [["0", "1"], ["0", "1"], ["1", "2"]]
    (tmp_path / "one.lgf").write_text(whole)
    assert [x.count() for x in graphs.read_lgf(spark, f"file://{tmp_path}/one.lgf")] == [9, 3]


def test_neighbours_in_three_dimensions_and_with_corrections(spark):
    r = np.random.default_rng(3)
    rows = [(t, 100 * t + k, *map(float, r.uniform(0, 10, 3)), *map(float, r.uniform(0, 10, 3))) for t in range(3) for k in range(25)]
    det = spark.createDataFrame(rows, "timestep int, id long, x double, y double, z double, x_corr double, y_corr double, z_corr double")
    for radius, k in ((3.0, 1), (3.0, 2), (50.0, 2)):
        got = {(x.src, x.dst) for x in candidates.arcs(det, candidates.Candidates(k, radius, True)).collect()}
        want = set()
        for a in rows:
            near = sorted((np.hypot.reduce(np.subtract(a[5:8], b[2:5])), b[1]) for b in rows if b[0] == a[0] + 1)
            want |= {(a[1], i) for d, i in [x for x in near if x[0] <= radius][:k]}
        for b in rows:
            near = sorted((np.hypot.reduce(np.subtract(a[5:8], b[2:5])), a[1]) for a in rows if b[0] == a[0] + 1)
            want |= {(i, b[1]) for d, i in [x for x in near if x[0] <= radius][:k]}
        assert got == want


def test_division_cost_of_distance_and_angle(spark):
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    near = en.division_by_geometry(p(0, 0, 0), p(3, 0, 0), p(0, 4, 0), 2.0, 0.4)
    narrow = en.division_by_geometry(p(0, 0, 0), p(3, 0, 0), p(0, 4, 0), 2.0, 0.6)
    row = spark.range(1).select(near.alias("a"), narrow.alias("b")).first()
    assert row.a == pytest.approx(1 + 4) and row.b == pytest.approx(1e13 + 5)


def test_pixels_of_one_object_in_three_dimensions(spark):
    labels = [[[0, 1], [2, 0]], [[1, 0], [0, 2]]]
    rows = pixels.pixel_rows(spark.createDataFrame([(7, labels)], "image long, labels array<array<array<int>>>"), 3)
    found = pixels.extract_one(rows, 7, [10, 20, 30], 4, 1, 2)
    assert sorted(r.pixel for r in found.collect()) == [[10, 20, 31], [11, 20, 30]]
    with pytest.raises(Exception, match="not the count"):
        pixels.extract_one(rows, 7, [0, 0, 0], 4, 1, 3).collect()
    # one pixel of the object lies outside of the image
    moved = found.withColumn("id", F.lit(9).cast("long")).unionByName(spark.createDataFrame([(4, 9, [99, 99, 99])], "timestep int, id long, pixel array<int>"))
    out = {tuple(r.pos): r.label for r in pixels.update_one(rows, moved, [10, 20, 30], 4, 9).collect()}
    assert out == {(i, j, k): 9 if labels[i][j][k] == 1 else labels[i][j][k] for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    with pytest.raises(KeyError):
        pixels.update_one(rows, moved, [0, 0, 0], 4, 8)


# learning


def test_smallest_weights():
    # one constraint 2 w >= 4, and a cheaper way out if violation costs little
    assert learning.smallest_weights(np.array([[2.0]]), np.array([4.0]), 100.0).tolist() == pytest.approx([2.0])
    assert learning.smallest_weights(np.array([[2.0]]), np.array([4.0]), 0.5).tolist() == pytest.approx([1.0])
    two = learning.smallest_weights(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([3.0, 5.0]), 100.0)
    assert two.tolist() == pytest.approx([3.0, 5.0])


def test_learned_weights_give_the_true_labelling(spark):
    rows = [(t, 10 * t + k, 5.0 * k + 0.3 * t, 0.0, 0.0) for t in range(3) for k in range(3)]
    det = spark.createDataFrame([*rows, (1, 99, 2.5, 0.0, 0.0)], "timestep int, id long, x double, y double, z double")
    tracker = ChaingraphTracker(appearance=1, disappearance=1, detection=1, misdetection=1, opportunity=1, neighbours=2, radius=4.0, mean_division_distance=1.0)
    nodes, arcs = (graph.cut_lineage(x, "built") for x in tracker.build_graph(det))
    true_active = nodes.where("id <> 99").select("node")
    true_used = arcs.where("dst = src + 10").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert true_used.count() == 6 and arcs.count() > 6
    weights, rounds = learning.train(tracker, nodes, arcs, true_active, true_used)
    assert 1 <= rounds < 30
    plain = tracker.energies(nodes, arcs)
    of = graph.components(nodes.select("node"), plain[1])
    w = np.array([weights[n] for n in loglinear.WEIGHTS])
    active, used = learning.infer(learning.weighted(*plain, w), of, tracker)
    assert learning.hamming(active, used, true_active, true_used) == 0
    # features agree with those of the explicit tables
    _, entries = tracker.explicit_tables(nodes, arcs)
    on, go = {r.node for r in true_active.collect()}, {(r.src, r.dst) for r in true_used.collect()}
    labels = [(f"n{r.node}", int(r.node in on)) for r in nodes.collect()] + [(f"a{r.a}-{r.b}", int((r.a, r.b) in go)) for r in arcs.collect()]
    sums = {r.weight: r.total for r in factors.feature_sums(entries, spark.createDataFrame(labels, "var string, state int")).collect()}
    assert learning.features(*plain, true_active, true_used).tolist() == pytest.approx([sums[n] for n in loglinear.WEIGHTS])


def test_weights_and_features_by_hand(spark):
    weights = loglinear.weight_table(spark, [2.0, 3.0], ["a", "b"])
    features = loglinear.with_feature(spark.createDataFrame([("a", "x", 0, 1.0)], "weight string, variable string, label int, value double"), weights, "b", "x", 0, 5.0)
    sums = loglinear.weighted_sums(features, spark.createDataFrame([("x", 0)], "variable string, label int"))
    assert loglinear.energy(sums, weights).first()[0] == 2 * 1 + 3 * 5
    with pytest.raises(ValueError, match="no weight c"):
        loglinear.with_feature(features, weights, "c", "x", 0, 1.0)
    with pytest.raises(ValueError, match="6 weights"):
        loglinear.weight_table(spark, [1.0])
    rows = spark.sql("SELECT map('cellness', array(0.7f)) AS features UNION ALL SELECT map('cellness', array(0.2f))")
    assert classifier.count_above(rows) == 1


def test_trials_are_never_less_likely_and_the_same_however_dealt(spark):
    r = np.random.default_rng(3)
    spots = [(0, 0, 0), (1.5, 0, 0), (0.7, 1.2, 0)]
    rows = [(g, [float(v) for v in r.normal(c, 0.5)]) for g in range(3) for c in spots for _ in range(15)]
    points = spark.createDataFrame(rows, "group long, pixel array<double>")
    one, many = ({(x.group, x.k): x.bic for x in mergers.priors_and_centres(points.repartition(n), 3, 0.1, 2, t).collect()} for n, t in ((3, 1), (3, 5)))
    again = {(x.group, x.k): x.bic for x in mergers.priors_and_centres(points.repartition(1), 3, 0.1, 2, 5).collect()}
    assert set(one) == set(many) and all(many[g] >= one[g] - 1e-9 for g in one) and many == again
    assert any(many[g] > one[g] + 1e-6 for g in one)
    pixels = points.select(F.lit(1).alias("timestep"), F.col("group").alias("id"), F.lit(3).alias("n_objects"), "pixel")

    def likelihood(found):
        out = {}
        for x in found.collect():
            out.setdefault(x.id, []).extend(map(tuple, x.pixels))
        return {k: len(v) for k, v in out.items()}

    assert likelihood(mergers.fit(pixels, 2, trials=4)) == {0: 45, 1: 45, 2: 45}
    first, second = (sorted((x.id, x.k, tuple(x.centre)) for x in mergers.fit(pixels.repartition(n), 2, trials=4).collect()) for n in (1, 4))
    assert first == second


def test_a_long_run_of_mergers_takes_as_many_jobs_as_a_short_one(spark):
    def jobs(length):
        nodes = [(0, 1, 1, 0.0, 0.0, 0.0), (0, 2, 1, 9.0, 0.0, 0.0)] + [(t, 5, 2, 4.5, 0.0, 0.0) for t in range(1, length)]
        arcs = [(0, 1, 1, 5), (0, 2, 1, 5)] + [(t, 5, t + 1, 5) for t in range(1, length - 1)]
        pixels = [(t, 5, [x + d, 0.0, 0.0]) for t in range(1, length) for x in (0.0, 9.0) for d in (0.0, 0.5)]
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        found = mergers.seeded_fit(spark.createDataFrame(pixels, "timestep int, id long, pixel array<double>"), spark.createDataFrame(nodes, "timestep int, id long, n_objects int, x double, y double, z double"), spark.createDataFrame(arcs, "src_t int, src long, dst_t int, dst long"))
        rows = found.collect()
        assert {(r.timestep, r.k): round(r.centre[0], 6) for r in rows} == {(t, k): 9.0 * k + 0.25 for t in range(1, length) for k in (0, 1)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before

    short, long = jobs(4), jobs(60)
    assert long <= short + 40  # rounds of components grow with the logarithm


def test_ids_go_into_their_own_images(spark):
    images = spark.createDataFrame([(t, [[0, t, t], [0, 0, 7]]) for t in (1, 2)], "image long, labels array<array<long>>")
    rows = pixels.pixel_rows(images, 2)
    where = spark.createDataFrame([(1, 9, [11, 20]), (1, 8, [11, 20]), (2, 5, [10, 22]), (2, 6, [99, 99])], "image long, id long, pixel array<int>")
    got = {(r.image, *r.pos): r.label for r in pixels.update_many(rows, where, [10, 20]).collect()}
    assert got == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 0, 2): 1, (1, 1, 0): 9, (1, 1, 1): 0, (1, 1, 2): 7, (2, 0, 0): 0, (2, 0, 1): 2, (2, 0, 2): 5, (2, 1, 0): 0, (2, 1, 1): 0, (2, 1, 2): 7}
    one = pixels.update(rows, where.where("image = 2").select("image", "pixel"), [10, 20], 4)
    assert {(r.image, *r.pos) for r in one.where("label = 4").collect()} == {(2, 0, 2)}


def test_a_forest_of_rows(spark):
    rows = [(t, k, {"size": [float(k)], "other": [float(k % 3), float(t)]}, int(k >= 10)) for t in range(2) for k in range(20)]
    table = spark.createDataFrame(rows, "timestep int, id long, features map<string,array<float>>, label int")
    grown = forest.grow(table.repartition(3), ["size", "other"], growth=forest.Growth(trees=4, depth=6, least=2))
    nodes = {(r.tree, r.node): r for r in grown.collect()}
    assert all(((t, 2 * n) in nodes) == ((t, 2 * n + 1) in nodes) == (r.feature is not None) for (t, n), r in nodes.items())
    assert all(sum(r.shares) == pytest.approx(1) for r in nodes.values())

    def walk(v):
        out = []
        for t in range(4):
            n = 1
            while (r := nodes[t, n]).feature is not None:
                n = 2 * n + (v[r.feature] > r.threshold)
            out.append(r.shares[1])
        return sum(out) / len(out)

    got = {(r.timestep, r.id): r.features["cellness"][0] for r in forest.predict(table, grown, ["size", "other"]).collect()}
    assert got == {(t, k): pytest.approx(walk([*f["size"], *f["other"]]), abs=1e-6) for t, k, f, _ in rows}
    assert np.mean([(got[t, k] > 0.5) == bool(y) for t, k, _, y in rows]) > 0.9
    with pytest.raises(Exception, match="no such class"):
        forest.predict(table, grown, ["size", "other"], cls=2).collect()
