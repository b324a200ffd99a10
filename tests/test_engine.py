"""Scenes with known energies and events, and the operators on small tables."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import calculators as calc
from trackweave.functions import energies as en
from trackweave.functions.geometry import COM, INTENSITY_MAXIMUM, FieldOfView, Locator, angle, distance
from trackweave.operators import candidates, detections, events, graph, mergers
from trackweave.plans.trackers import ConservationTracker
from trackweave.queries import QUERIES
from trackweave.sources import graphs

BASE = ConservationTracker(appearance_cost=1500, disappearance_cost=1500)
SCHEMA = "timestep int, id long, x double, y double, z double, div_prob double, count double"


def scene(text, divs=(), counts=()):
    """``id@t(x,y,z)`` words to rows."""
    out = []
    for k, word in enumerate(text.split()):
        key, at = word.split("@")
        t, p = at.split("(")
        div = divs[k] if k < len(divs) else 0.1
        count = float(counts[k]) if k < len(counts) else 1.0
        out.append((int(t), int(key), *map(float, p[:-1].split(",")), div, count))
    return out


MERGER = "1@1(0,0,0) 3@1(2,2,2) 10@2(1,1,1) 11@3(1,1,1) 12@4(0,0,0) 13@4(0,0,0)"
LINES = "1@1(0,0,0) 3@1(2,2,2) 10@2(2,2,2) 11@3(2,2,2) 12@1(100,100,100) 13@2(100,100,100) 14@3(100,100,100) 15@1(200,100,100) 16@2(200,100,100) 17@3(200,100,100)"
SIMPLE = "1@1(0,0,0) 2@2(0,0,0) 3@3(0,0,0) 4@1(5,5,5) 5@2(5,5,5) 6@3(2,1,1)"
BOTH = "1@1(18,0,0) 3@1(0,0,0) 10@2(0,0,0) 11@3(18,0,0) 15@3(0,0,0)"
SCENES = [
    (scene(MERGER), BASE, 60.390, {"Move": 5, "Merger": 2}),
    (scene("1@1(1,1,1) 10@2(1,1,1) 11@3(1,0,0) 13@3(2,2,2)", (0.8, 0.7)), BASE, 24.126, {"Move": 1, "Division": 1}),
    (scene("1@1(0,0,0) 10@2(0,0,0)"), BASE, 7.133, {"Move": 1}),
    (scene(MERGER, (), (2, 100, 90, 90, 110, 60)), replace(BASE, size_prior=True, average_size=99.0), 46.598, {"Move": 3}),
    (scene("1@1(18,0,0) 3@1(0,0,0) 10@2(0,0,0)"), replace(BASE, size_prior=True, average_size=1.0), 41.356, {"Move": 1}),
    (scene(BOTH), replace(BASE, size_prior=True, average_size=1.0), 83.406, {"Move": 2}),
    (scene(SIMPLE), replace(BASE, max_objects=1, radius=100.0, size_prior=True, average_size=1.0), 24.434, {"Move": 4}),
    (scene(LINES, (), (1, 3, 1, 1, 1, 3, 1, 0.1, 1, 0.1)), replace(BASE, size_prior=True, average_size=1.1, tracklets=True), 200.706, {"Move": 6}),
]


@pytest.mark.parametrize("rows,tracker,energy,counts", SCENES)
def test_scenes(spark, rows, tracker, energy, counts):
    found, nodes, _ = tracker.track(*tracker.build_graph(spark.createDataFrame(rows, SCHEMA)))
    assert nodes.agg(F.sum("cost")).first()[0] == pytest.approx(energy, abs=6e-4)
    assert {r.type: r["count"] for r in found.groupBy("type").count().collect()} == counts


def test_tracker_resolves_mergers(spark):
    rows = [(*r, [0.0] * 3 + ([*map(float, at)] if (at := {10: (2, 2, 2, 0, 0, 0), 11: (0, 0, 0, 2, 2, 2)}.get(r[1])) else [0.0] * 6)) for r in scene("1@1(0,0,0) 3@1(2,2,2) 10@2(1,1,1) 11@3(1,1,1) 12@4(0,0,0) 13@4(2,2,2)")]
    det = spark.createDataFrame(rows, SCHEMA + ", possible_coms array<double>")
    _, labelled, used = BASE.track(*BASE.build_graph(det))
    got = lambda found: sorted((r.slot, r.type, *r.traxel_ids) for r in found.collect())
    moves = [(3, "MultiFrameMove", 1, 12, 0), (3, "MultiFrameMove", 3, 13, 0)]
    whole = got(BASE.run(det, mergers.centres_from_packed))
    assert [r for r in whole if r[1] == "MultiFrameMove"] == moves and [r for r in whole if r[1] == "Merger"] == [(1, "Merger", 10, 2), (2, "Merger", 11, 2)]
    resolved = got(BASE.resolve_mergers(labelled, used, mergers.centres_from_packed, False))
    assert resolved == [(1, "Move", 1, 12), (1, "Move", 3, 11), (1, "ResolvedTo", 10, 11, 12), (2, "Move", 11, 13), (2, "Move", 12, 12), (2, "ResolvedTo", 11, 12, 13), (3, "Move", 12, 12), (3, "Move", 13, 13)]


def test_scalars(spark):
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    fov = FieldOfView((3, 1, 1, 1), (5, 10, 12, 6))
    flat = FieldOfView((0, 0, 0, 0), (1, 10, 10, 0))
    weights = [en.border_aware_weight(p(x, y, 0), 100, m, rel, flat) for m, rel in ((2, False), (0.2, True)) for x, y in ((1, 1), (1, 10), (5, 5), (8, 8), (8, 5), (0.5, 7))]
    row = spark.range(1).select(
        distance(p(1, 2, 0), p(2, 3, 7)),
        angle(p(1, 2, 0), p(2, 3, 7), p(1, 0.5, 1.5)),
        angle(p(1, 0, 0), p(2, 0, 0), p(0, 0, 0)),
        *[fov.spatial_margin(p(*q)) for q in ((0, 0, 0), (2, 1, 1), (9, 11, 5))],
        fov.temporal_margin(F.lit(0)),
        *weights,
    ).first()
    assert list(row) == pytest.approx([7.1414284285, 0.93466, 3.14159265, 1, 0, 1, 3, *[50, 0, 100, 100, 100, 25] * 2], abs=1e-5)
    assert en.hard_prior(2) == pytest.approx([0.09, 0.7, 0.21])
    with pytest.raises(ValueError):
        FieldOfView((1, 0, 0, 0), (0, 0, 0, 0))
    with pytest.raises(NotImplementedError):
        calc.calculator("Ratio")(F.lit(1))
    with pytest.raises(KeyError):
        calc.calculator("none")


def test_locators_and_features(spark):
    rows = spark.sql("SELECT 1 AS timestep, 7L AS id, map('com', array(34f, 45f, 12.5f), 'intmaxpos', array(0f, 1f, 2f, 3f)) AS features")
    r = detections.located(rows, Locator("com", 0, (0.5, 1.0, 2.0))).first()
    assert (r.x, r.y, r.z, r.x_corr) == (17, 45, 25, 17)
    assert detections.located(rows, INTENSITY_MAXIMUM).select("x", "y", "z").first() == (1, 2, 3)
    changed = rows.select(detections.set_feature(F.col("features"), "com", 1, 9.0).alias("f")).first().f
    assert changed["com"] == [34, 9, 12.5]
    for bad in (detections.set_feature(F.col("features"), "com", 5, 9.0), detections.get_feature(F.col("features"), "none", 0), COM.position(F.map_from_arrays(F.array(), F.array()).cast("map<string,array<float>>"))[0]):
        with pytest.raises(Exception, match="no (value|feature)"):
            rows.select(bad).collect()


def test_builder(spark):
    rows = scene("5@0(0,0,0) 7@0(0,1,0) 9@1(0,0,0) 11@1(0,1,0) 8@1(0,2,0)", (0.1, 0.6))
    det = spark.createDataFrame(rows, SCHEMA)
    arcs = lambda o: sorted((r.src, r.dst) for r in candidates.arcs(det, o).collect())
    assert arcs(candidates.Candidates(1, 10, True)) == [(5, 9), (7, 8), (7, 11)]
    assert arcs(candidates.Candidates(1, 10, False, True)) == [(5, 9), (7, 8), (7, 11)]
    with pytest.raises(ValueError):
        candidates.arcs(det, candidates.Candidates(1, -1))


def test_tracklets(spark):
    arcs = [(11, 21), (12, 21), (12, 22), (13, 23), (21, 31), (22, 32), (23, 33), (21, 41), (32, 42), (32, 43), (33, 43)]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for a in arcs for x in a} | {14})], "node long")
    links = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, distance double")
    contracted, between = graph.tracklets(nodes, links)
    got = sorted(r.members for r in contracted.collect())
    assert got == [[11], [12], [13, 23, 33], [14], [21], [22, 32], [31], [41], [42], [43]]
    assert between.count() == len(arcs) - 3


def test_events_without_divisions_and_statistics(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (1, 4)], "timestep int, id long")
    two = spark.createDataFrame([(0, 1, 1, 2), (0, 1, 1, 3)], "src_t int, src long, dst_t int, dst long")
    got = sorted((r.slot, r.type, r.traxel_ids) for r in events.events(nodes, two).collect())
    assert got == [(1, "Appearance", [4]), (1, "Division", [1, 3, 2])]
    assert events.statistics(events.events(nodes, two)).first().asDict() == dict(slot=1, n_total=2, n_move=0, n_division=1, n_appearance=1, n_disappearance=0)
    three = two.union(spark.createDataFrame([(0, 1, 1, 4)], two.schema))
    with pytest.raises(Exception, match="more than two"):
        events.events(nodes, three).collect()


def test_multi_frame_moves_of_any_length(spark):
    last = 130
    nodes = spark.createDataFrame([(t, 1, 9 if 0 < t < last else None) for t in range(last + 1)] + [(0, 2, None), (1, 3, 9)], "timestep int, id long, origin long")
    arcs = spark.createDataFrame([(t, 1, t + 1, 1) for t in range(last)] + [(0, 2, 1, 3)], "src_t int, src long, dst_t int, dst long")
    assert [tuple(r) for r in events.multi_frame_moves(nodes, arcs, 0).collect()] == [(last, "MultiFrameMove", [1, 1, 0])]
    assert events.multi_frame_moves(nodes.where("origin IS NULL"), arcs, 0).count() == 0
    loop = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 2, 1), (2, 1, 1, 1)], arcs.schema)
    with pytest.raises(RuntimeError, match="settle"):
        events.multi_frame_moves(nodes, loop, 0, 4)


def test_merger_split_of_three_and_two(spark):
    nodes = spark.createDataFrame([(1, 11, 3, 3.0), (2, 21, 2, 3.0), (2, 22, 1, 6.0)], "timestep int, id long, n_objects int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    packed = spark.createDataFrame([(1, 11, 3, [*map(float, (3, 0, 0, 1, 0, 0, 6, 0, 0, 1, 0, 0, 3, 0, 0, 6, 0, 0))]), (2, 21, 2, [*map(float, (3, 0, 0, 3, 0, 0, 6, 0, 0, 1, 0, 0, 3, 0, 0, 6, 0, 0))])], "timestep int, id long, n_objects int, possible_coms array<double>")
    parts = mergers.split(nodes, mergers.centres_from_packed(packed))
    assert sorted((r.timestep, r.id, r.origin) for r in parts.collect()) == [(1, 12, 11), (1, 13, 11), (1, 14, 11), (2, 23, 21), (2, 24, 21)]
    arcs = spark.createDataFrame([(1, 11, 2, 21), (1, 11, 2, 22)], "src_t int, src long, dst_t int, dst long")
    links = mergers.replacement_arcs(nodes, arcs, parts)
    assert links.count() == 9 and {round(r.distance) for r in links.collect()} == {0, 2, 3, 5}
    used = mergers.resolve(nodes, arcs, parts).where("active").collect()
    assert len(used) == 3 and len({r.src for r in used}) == 3 and len({r.dst for r in used}) == 3


def test_resolve_mergers_query_resolves_every_detection(spark, tmp_path):
    frames = 4
    r = __import__("random").Random(2)
    rows = [(k, [r.random() for _ in range(8)], 0) for k in range(50 * frames)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["resolve_mergers"](spark, str(tmp_path)).collect()
    # 25 pairs of frames' detections: 2 x 1 + 2 x 2 + 1 x 2 arcs, of which the three objects use three
    assert len(found) == 25 * 8 * (frames - 1)
    used = [x for x in found if x.active]
    assert len(used) == 25 * 3 * (frames - 1) and len({(x.src_t, x.src) for x in used}) == len(used) == len({(x.dst_t, x.dst) for x in used})
    kept = {x.src for x in found if x.src < 50 and x.src_t == 0} | {x.dst for x in found if x.dst_t == 1 and x.dst < 100}
    assert kept == {k for k in range(100) if (k // 50 + k) % 2 == 0}


def test_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "node long, timestep int")
    arcs = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    graphs.write_graph(nodes, arcs, str(tmp_path / "g"))
    assert [x.count() for x in graphs.read_graph(spark, str(tmp_path / "g"))] == [3, 2]
    graphs.write_lgf(nodes, arcs, f"file://{tmp_path}/g.lgf")
    a, b = graphs.read_lgf(spark, f"file://{tmp_path}/g.lgf")
    assert sorted(map(tuple, a.collect())) == [(1, 0), (2, 1), (3, 1)] and sorted(map(tuple, b.collect())) == [(1, 2), (1, 3)]
    det = spark.sql("SELECT 3 AS timestep, 9L AS id, map('com', array(1.5f, 2f), 'count', array(4f)) AS features")
    graphs.write_text_detections(det, str(tmp_path / "t"))
    spark.dataSource.register(graphs.TextDetections)
    back = spark.read.format("text_detections").load(str(tmp_path / "t" / next(p.name for p in (tmp_path / "t").glob("part*")))).collect()
    assert [(r.timestep, r.id, r.features) for r in back] == [(3, 9, {"com": [1.5, 2.0], "count": [4.0]})]
    (tmp_path / "a.txt").write_text("22 serialization::archive 9 0 2 2 0 0 0 0 1 0 0 0 2 0 0 0 3 com 3 0 1.5 2 3 5 count 1 0 7 3 1 0\n0 0 0 1 1 12.5 3 com 1 0\n1 2 4 2 0 3 com 3 0 -4 5e-1 6 5 count 1 0 8 3\n2 1 1 12.5 3 com\n")
    got = sorted((r.timestep, r.id, r.features) for r in graphs.read_archive(spark, str(tmp_path / "a.txt")).collect())
    assert got == [(0, 1, {"com": [1.5, 2.0, 3.0], "count": [7.0]}), (4, 2, {"com": [-4.0, 0.5, 6.0], "count": [8.0]})]


@pytest.mark.parametrize("options", [candidates.Candidates(3, 5.0), candidates.Candidates(1, 5.0, True, True), candidates.Candidates(2, 50.0, True)])
def test_crowded_frames_have_the_same_arcs(spark, options):
    """Halved cells find what all pairs in range give: crowds, many at one place, ties, lone ones, null positions of nobody."""
    r = random.Random(4)
    rows = []
    for t in range(3):
        at = [(r.gauss(0, 0.3), r.gauss(0, 0.3), 0.0) for _ in range(260)] + [(1.0, 1.0, 0.0)] * 140 + [(r.uniform(-60, 60), r.uniform(-60, 60), 0.0) for _ in range(60)] + [(float(k % 5), float(k // 5), 0.0) for k in range(20)]
        rows += [(t, k, *p, r.random()) for k, p in enumerate(at)]
    table = spark.createDataFrame(rows, "timestep int, id long, x double, y double, z double, div_prob double")
    key = lambda df: sorted((r.src_t, r.src, r.dst, round(r.distance, 9)) for r in df.collect())
    assert candidates.crowded(table, tuple(F.col(c) for c in "xyz"), options.radius, max(2, options.neighbours), (0, 1)) > 0
    found = key(candidates.arcs(table, options))
    by_frame = {t: [x for x in rows if x[0] == t] for t in range(3)}
    expected = set()
    for t in range(2):
        for turned in (False, True)[: 1 + options.forward_backward]:
            near, far = (by_frame[t + 1], by_frame[t]) if turned else (by_frame[t], by_frame[t + 1])
            for q in near:
                k = options.neighbours if turned or not options.divisions or options.neighbours > 1 else 2 if q[5] > options.division_threshold else options.neighbours
                d2 = sorted(((q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2, p[1]) for p in far)
                for d, i in [x for x in d2 if x[0] <= options.radius**2][:k]:
                    a, b = (i, q[1]) if turned else (q[1], i)
                    expected.add((t, a, b, round(d**0.5, 9)))
    assert found == sorted(expected)


def test_a_crowded_frame_makes_few_pairs(spark):
    n, k = 20_000, 6
    rows = spark.range(2 * n).select((F.col("id") >= n).cast("int").alias("timestep"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(0.0).alias("z"))
    rows = graph.cut_lineage(rows, "crowd")
    levels = candidates.crowded(rows, tuple(F.col(c) for c in "xyz"), 50.0, k, ())
    found = candidates.nearest_in_range(rows, rows, tuple(F.col(c) for c in "xyz"), tuple(F.col(c) for c in "xyz"), 50.0, 1, k, k, levels)
    out = graph.cut_lineage(found, "found")
    assert out.count() == n * k and out.agg(F.max("d2")).first()[0] < 0.01


def test_archives_keep_names_scales_and_positions(spark, tmp_path):
    rows = [(t, 10 * t + k, {"com": [1.5 + k, -2.0, 0.25], "feature2": [3.0], "a b": [], "count": [7e-05]} | ({"intmaxpos": [9.0, 1.0, 2.0, 3.0]} if k else {}), "intmaxpos" if k else "com", [1.0, 2.0, 12.3]) for t in range(3) for k in range(4)]
    table = spark.createDataFrame(rows, "timestep int, id long, features map<string,array<float>>, locator string, scale array<double>")
    for files in (1, 3):
        path = str(tmp_path / f"archive{files}")
        graphs.write_archive(table, path, files)
        got = sorted((r.timestep, r.id, r.features, r.locator, r.scale, r.x, r.y, r.z) for r in graphs.read_archive(spark, path + "/*").collect())
        single = lambda x: [float(np.float32(v)) for v in x]
        expected = [(t, i, {n: single(v) for n, v in f.items()}, w, s, *((1.0, 4.0, 3 * 12.3) if w == "intmaxpos" else (f["com"][0], -4.0, 0.25 * 12.3))) for t, i, f, w, s in rows]
        assert [x[:5] for x in got] == [x[:5] for x in expected]
        assert [x[5:] for x in got] == [pytest.approx(x[5:]) for x in expected]
    plain = str(tmp_path / "plain")
    graphs.write_archive(table.select("timestep", "id", "features"), plain)
    assert {(r.locator, tuple(r.scale)) for r in graphs.read_archive(spark, plain + "/*").collect()} == {("com", (1.0, 1.0, 1.0))}
