"""Queries against their SQL on small tables that once told them apart."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from trackweave.operators import crowds, graph
from trackweave.plans import windows
from trackweave.queries import ORACLES, QUERIES

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def plain(v):
    """A value as text, so that zeros with another sign differ."""
    return [plain(x) for x in v] if isinstance(v, list | tuple) else repr(v)


def differences(spark, name, path, **tables):
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{table}.parquet")
    with duckdb.connect() as c:
        for table in tables:
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
        wanted = c.execute(ORACLES[name]).fetchall()
    got, wanted = (Counter(str(plain(list(r))) for r in rows) for rows in (QUERIES[name](spark, str(path)).collect(), wanted))
    assert wanted
    return got - wanted, wanted - got


@pytest.mark.parametrize("name", ["argsort_reorder", "feature_vector", "calc_identity", "merger_split"])
def test_rounded_zeros_keep_their_sign(spark, tmp_path, name):
    rows = [(i, [(-1e-7 if k % 5 == i % 5 else (k - 30) / 77) for k in range(64)], 0) for i in range(6)]
    rows = [(i, [x + k * 1e-12 for k, x in enumerate(v)], y) for i, v, y in rows]
    assert differences(spark, name, tmp_path, embeddings=spark.createDataFrame(rows, EMBEDDINGS)) == (Counter(), Counter())


def test_equal_values_are_ordered_as_in_sql(spark, tmp_path):
    r, nan = random.Random(3), float("nan")
    odd = [[None, nan, -0.0, 0.0, *[0.25, None, nan, -1.0] * 15], [1.0] * 64]
    rows = [*odd, *[[r.randrange(k) / 8 for _ in range(64)] for k in (5, 40, 400) for _ in range(20)]]
    rows = [(i, v, 0) for i, v in enumerate(rows)]
    assert differences(spark, "argsort_reorder", tmp_path, embeddings=spark.createDataFrame(rows, EMBEDDINGS).coalesce(1)) == (Counter(), Counter())


@pytest.mark.parametrize("name", ["chaingraph_events", "ctrack_events"])
def test_equal_costs_take_the_first_arcs(spark, tmp_path, name):
    # one detection, two at one place next, two at one place then; a and b to c and d on a line
    rows, at = [], datetime(2024, 1, 1)
    for k, (hour, user, value) in enumerate([(0, 10, 1.0), (1, 14, 2.5), (1, 14, 2.5), (2, 50, 1.0), (2, 50, 2.0), (3, 50, 3.5), (3, 50, 4.25), (4, 90, 1.0), (4, 90, 1.0), (5, 92, 1.0), (6, 500, 1.0)]):
        rows.append((k, at + timedelta(hours=hour), user, "view", value, ""))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert differences(spark, name, tmp_path, events=events) == (Counter(), Counter())


@pytest.mark.parametrize("name", ["arcs_crowded", "chaingraph_factors", "tracklet_graph", "resolve_mergers"])
def test_growing_tables_are_not_broadcast(spark, tmp_path, capsys, name):
    at = datetime(2024, 1, 1)
    events = [(k, at + timedelta(hours=k % 48), k % 40, "view", k % 17 / 10, "") for k in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    vectors = [(k, [(k * (j + 3) % 101 - 50) / 200 for j in range(64)], 0) for k in range(200)]
    spark.createDataFrame(vectors, EMBEDDINGS).write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES[name](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    # levels in use by frame are few whatever the input
    sent = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" not in x]
    assert "SortMergeJoin" in plan and not sent


#: Detections of which a mixture takes two apart, so that its covariance is flat but for the floor.
FLAT = [(1, [-0.06428874, -0.036012735, 0.04203628]), (6, [-0.0015886676, 0.030582773, 0.13844515]), (11, [-0.2407025, 0.16433784, -0.09234933]), (16, [-0.07077251, -0.0021257598, 0.01666875]), (21, [0.14741546, 0.116834745, -0.0055725616]), (26, [0.027536537, 0.09711184, 0.095289126]), (31, [0.3540472, -0.25751585, 0.28696844]), (36, [0.09817939, -0.056531537, -0.13817082]), (41, [-0.23385738, -0.15215649, 0.21247025]), (46, [0.094605766, -0.0039721555, 0.0072061555])]


@pytest.mark.parametrize("name", ["merger_centres", "gmm_bic"])
def test_flat_mixtures_and_short_frames(spark, tmp_path, name):
    # the last frame has fewer detections than objects
    rows = [(k, v + [0.0] * 61, 0) for k, v in [*FLAT, (50, [0.1, 0.2, 0.3])]]
    assert differences(spark, name, tmp_path, embeddings=spark.createDataFrame(rows, EMBEDDINGS)) == (Counter(), Counter())


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("most_rows", [10, 60, 1 << 17])
def test_crowds_in_small_cells(spark, tmp_path, monkeypatch, most_rows):
    """Queries near the border of a cell, in empty ones and far from all; crowds on a line, many at one place."""
    r, at = random.Random(5), datetime(2024, 1, 1)
    places = [(r.randrange(2000), r.randrange(500)) for _ in range(330)] + [(777, 7)] * 90 + [(k * 100, 300) for k in range(60)] + [(r.randrange(200_000), r.randrange(90_000)) for _ in range(60)]
    rows = [(k, at + timedelta(hours=k % 72), u, "view", v / 10, "") for k, (u, v) in enumerate(places)]
    # a day's users all lie apart from those of the next one
    rows += [(1000 + k, at + timedelta(hours=96 + 24 * (k % 2)), 30_000 * (k % 2) + k, "view", k / 10, "") for k in range(200)]
    monkeypatch.setattr(crowds, "MOST_ROWS", most_rows)
    assert differences(spark, "arcs_crowded", tmp_path, events=spark.createDataFrame(rows, EVENTS)) == (Counter(), Counter())


def test_crowds_shuffle_few_bytes(spark, tmp_path):
    n = 48_000
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id % 96) AS ts", "id * 7919 % 1500 AS user_id", "'view' AS event_type", "id * 104729 % 17792 / 100.0D AS value", "'' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    on_disk = lambda: sum(files.getAllFiles().apply(k).length() for k in range(files.getAllFiles().size()))
    before = on_disk()
    assert QUERIES["arcs_crowded"](spark, str(tmp_path)).count() == 3 * n * 3 // 4
    assert on_disk() - before < 100 * n


def test_windows_are_dealt_by_their_number(spark, tmp_path, capsys, monkeypatch):
    """Tasks follow from windows, not from the few bytes that these shuffle; components are found once."""
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 0.12) for _ in range(3)], 0) for k in range(300)]
    plans, calls, find = [], [], graph.components

    def cut(df, name):
        if name == "window-round":
            df.explain()
            plans.append(capsys.readouterr().out)
        return graph.cut_lineage(df, name)

    monkeypatch.setattr(windows, "cut_lineage", cut)
    monkeypatch.setattr(graph, "components", lambda *a: calls.append(1) or find(*a))
    assert differences(spark, "chaingraph_windows", tmp_path, embeddings=spark.createDataFrame(rows, EMBEDDINGS)) == (Counter(), Counter())
    assert len(calls) == 1 and len(plans) > 1
    assert all(p.count("REPARTITION_BY_NUM") == 2 for p in plans)
