"""The registered queries of the engine and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions import calculators as calc
from trackweave.functions import energies as en
from trackweave.functions.geometry import FieldOfView, Point, angle, distance, point, reorder
from trackweave.functions.ordering import grade_up
from trackweave.operators import candidates, classifier, detections, events, forest, graph, loglinear, mergers, pixels
from trackweave.plans.trackers import ChaingraphTracker, ConservationTracker
from trackweave.sources.adapters import detections_from_embeddings, detections_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DET = """det AS (SELECT floor((epoch_us(ts) - 1704067200000000) / 3600000000)::INT AS timestep, event_id AS id, user_id::DOUBLE AS x, value::DOUBLE AS y, 0.0::DOUBLE AS z,
  (event_id * 37 % 100) / 100.0 AS div_prob, (1 + event_id % 40)::DOUBLE AS count FROM events)"""
EMB = """emb AS (SELECT (vec_id // 50)::INT AS timestep, vec_id AS id, 100.0 * embedding[1]::DOUBLE AS x, 100.0 * embedding[2]::DOUBLE AS y, 100.0 * embedding[3]::DOUBLE AS z, embedding AS f, label FROM embeddings)"""
RADIUS = 5.0


def pairs_sql(radius: float = RADIUS) -> str:
    return f"""pairs AS (SELECT a.timestep AS src_t, a.id AS src, b.timestep AS dst_t, b.id AS dst, a.div_prob AS p, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM det a JOIN det b ON b.timestep = a.timestep + 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius * radius}),
fwd AS (SELECT *, row_number() OVER (PARTITION BY src_t, src ORDER BY d2, dst) AS r FROM pairs),
bwd AS (SELECT *, row_number() OVER (PARTITION BY dst_t, dst ORDER BY d2, src) AS r FROM pairs),
arcs AS (SELECT DISTINCT src_t, src, dst_t, dst, sqrt(d2) AS distance FROM (SELECT * FROM fwd WHERE r = 1 UNION ALL SELECT * FROM bwd WHERE r = 1)),
divs AS (SELECT src_t, src, dst_t, dst, sqrt(d2) AS distance FROM fwd WHERE r <= CASE WHEN p > 0.5 THEN 2 ELSE 1 END)"""


GRAPH = f"{DET}, {pairs_sql()}"
#: A labelled graph by a rule: division-aware arcs are active, some detections hold two objects.
LABELLED = f"""{GRAPH}, lab AS (SELECT timestep, id, (1 + (id % 11 = 0)::INT) AS n_objects, div_prob > 0.5 AS divides, CASE WHEN id % 13 = 0 THEN id // 13 END AS origin FROM det),
ends AS (SELECT min(timestep) AS t0, max(timestep) AS t1 FROM det),
deg AS (SELECT l.*, t0, t1, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i, o.next FROM lab l CROSS JOIN ends
  LEFT JOIN (SELECT src_t, src, count(*) AS n, list(dst ORDER BY dst DESC) AS next FROM divs GROUP BY ALL) o ON o.src_t = l.timestep AND o.src = l.id
  LEFT JOIN (SELECT dst_t, dst, count(*) AS n FROM divs GROUP BY ALL) i ON i.dst_t = l.timestep AND i.dst = l.id),
ev AS (SELECT (timestep - t0 + 1)::INT AS slot, 'Move' AS type, [id, unnest(next)] AS ids FROM deg WHERE timestep < t1 AND o > 0 AND NOT (o = 2 AND divides)
  UNION ALL SELECT timestep - t0 + 1, 'Division', list_concat([id], next) FROM deg WHERE timestep < t1 AND o = 2 AND divides
  UNION ALL SELECT timestep - t0 + 1, 'Disappearance', [id] FROM deg WHERE timestep < t1 AND o = 0
  UNION ALL SELECT timestep - t0, 'Appearance', [id] FROM deg WHERE timestep > t0 AND i = 0
  UNION ALL SELECT timestep - t0, 'Merger', [id, n_objects] FROM deg WHERE n_objects > 1
  UNION ALL SELECT timestep - t0, 'ResolvedTo', list_concat([origin], list(id ORDER BY id)) FROM deg WHERE origin IS NOT NULL GROUP BY timestep, t0, origin)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_from_events(spark, sf_dir)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_from_embeddings(spark, sf_dir)


def arcs_of(rows: DataFrame) -> DataFrame:
    return candidates.arcs(rows, candidates.Candidates(1, RADIUS, True))


def divisions_of(rows: DataFrame) -> DataFrame:
    return candidates.arcs(rows, candidates.Candidates(1, RADIUS, False, True))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def signed_round(v: Column, n: int) -> Column:
    """Rounded as SQL rounds doubles: a negative value that becomes zero keeps its sign, which counts inside of arrays."""
    return F.signum(v) * F.abs(F.round(v, n))


def labelled(rows: DataFrame) -> DataFrame:
    return rows.select("timestep", "id", (1 + (F.col("id") % 11 == 0).cast("int")).alias("n_objects"), (F.col("div_prob") > 0.5).alias("divides"), F.when(F.col("id") % 13 == 0, F.floor(F.col("id") / 13)).alias("origin"))


def found_events(rows: DataFrame) -> DataFrame:
    return events.events(labelled(rows), divisions_of(rows))


def shown(found: DataFrame) -> DataFrame:
    return found.select("slot", "type", F.array_join("traxel_ids", ",").alias("ids"))


def shown_with(found: DataFrame, *more: str) -> DataFrame:
    return found.select("slot", "type", F.array_join("traxel_ids", ",").alias("ids"), *more)


SHOWN = "SELECT slot, type, array_to_string(ids, ',') AS ids FROM ev"


# detections


@register("bounding_box", f"WITH {DET} SELECT [min(timestep), min(x), min(y), min(z), max(timestep), max(x), max(y), max(z)] AS box FROM det")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.bounding_box(det(spark, sf_dir))


@register("timesteps", f"WITH {DET} SELECT DISTINCT timestep FROM det")
def timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.timesteps(det(spark, sf_dir))


@register("time_range", f"WITH {DET} SELECT min(timestep) AS earliest, max(timestep) AS latest FROM det")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.time_range(det(spark, sf_dir))


@register("nested_frames", f"WITH {DET}, e AS (SELECT min(timestep) a, max(timestep) b FROM det) SELECT t.timestep::INT AS timestep, coalesce(list(id ORDER BY id) FILTER (id IS NOT NULL), []) AS ids FROM (SELECT unnest(range(a, b + 1)) AS timestep FROM e) t LEFT JOIN det USING (timestep) GROUP BY 1")
def nested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.frames(det(spark, sf_dir))


STORED = "both_ AS (SELECT timestep, id, y, 0 AS n FROM det UNION ALL SELECT timestep, id % 500, y + 1, 1 FROM det WHERE id % 3 = 0)"


def _stored(rows: DataFrame) -> DataFrame:
    return rows.where("id % 3 = 0").select("timestep", (F.col("id") % 500).alias("id"), (F.col("y") + 1).alias("y"))


@register("dedupe_store", f"WITH {DET}, {STORED} SELECT timestep, id, round(min(y), 6) AS y FROM both_ WHERE n = 0 GROUP BY ALL UNION ALL SELECT timestep, id, round(min(y), 6) FROM both_ b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM det d WHERE d.timestep = b.timestep AND d.id = b.id) GROUP BY ALL")
def dedupe_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    more = _stored(rows).groupBy("timestep", "id").agg(F.min("y").alias("y"))
    return rounded(detections.add(rows.select("timestep", "id", "y"), more), "y")


@register("last_wins", f"WITH {DET} SELECT id % 500 AS id, max(id) AS seq FROM det GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).select((F.col("id") % 500).alias("id"), F.col("id").alias("seq"))
    return detections.last_wins(rows, "seq")


@register("largest_ids", f"WITH {DET} SELECT timestep, max(id) AS max_id FROM det GROUP BY 1")
def largest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.largest_id(det(spark, sf_dir))


@register("argsort_reorder", "SELECT vec_id AS id, list_grade_up(embedding) AS o, list_transform(list_grade_up(embedding), lambda i: round(embedding[i]::DOUBLE, 6)) AS v FROM embeddings".replace("list_grade_up(embedding) AS o", "list_transform(list_grade_up(embedding), lambda i: (i - 1)::INT) AS o"))
def argsort_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", grade_up(F.col("embedding")).alias("o"))
    return rows.select(F.col("vec_id").alias("id"), "o", F.transform(reorder(F.col("embedding"), F.col("o")), lambda v: signed_round(v.cast("double"), 6)).alias("v"))


# field of view

FOV = FieldOfView((10, 20.0, 20.0, 0.0), (200, 400.0, 400.0, 0.0))
DEEP = FieldOfView((10, 20.0, 20.0, -5.0), (200, 400.0, 400.0, 7.0))


@register("fov_filter", f"WITH {DET} SELECT timestep, id FROM det WHERE timestep BETWEEN 10 AND 200 AND x BETWEEN 20 AND 400 AND y BETWEEN 20 AND 400 AND z BETWEEN 0 AND 0")
def fov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.in_view(det(spark, sf_dir), FOV).select("timestep", "id")


@register("fov_margins", f"WITH {DET} SELECT timestep, id, round(least(abs(x - 20), abs(x - 400), abs(y - 20), abs(y - 400), abs(z + 5), abs(z - 7)), 6) AS spatial, least(abs(timestep - 10), abs(timestep - 200))::DOUBLE AS temporal FROM det")
def fov_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = det(spark, sf_dir).select("timestep", "id", DEEP.spatial_margin(point()).alias("spatial"), DEEP.temporal_margin(F.col("timestep")).cast("double").alias("temporal"))
    return rounded(out, "spatial")


@register("fov_borders", f"WITH {DET}, d AS (SELECT timestep, id, least(abs(x - 20), abs(x - 400), abs(y - 20), abs(y - 400)) AS b FROM det) SELECT timestep, id, round(b, 6) AS flat, round(b / 380, 6) AS relative, round(CASE WHEN b < 30 THEN 100 * b / 30 ELSE 100 END, 6) AS cost FROM d")
def fov_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = point()
    out = det(spark, sf_dir).select("timestep", "id", FOV.border_distance(p).alias("flat"), FOV.border_distance(p, True).alias("relative"), en.border_aware_weight(p, 100.0, 30.0, False, FOV).alias("cost"))
    return rounded(out, "flat", "relative", "cost")


@register("border_constants", f"WITH {DET} SELECT timestep, id, CASE WHEN timestep >= 0 AND timestep < 3 THEN 0 ELSE 7.5 END AS early, CASE WHEN timestep > 97 AND timestep <= 100 THEN 0 ELSE 7.5 END AS late FROM det")
def border_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("timestep")
    return det(spark, sf_dir).select("timestep", "id", en.border_aware_constant(t, 7.5, 0, True, 3).alias("early"), en.border_aware_constant(t, 7.5, 100, False, 3).alias("late"))


# joins


@register("knn_in_range", f"WITH {GRAPH} SELECT src_t AS timestep, src AS id, dst AS other, round(d2, 6) AS d2, r::INT AS rank FROM fwd WHERE r <= 3")
def knn_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates._with_corrected(det(spark, sf_dir))
    return rounded(candidates.nearest(candidates.in_range(rows, rows, RADIUS, 1), 3).select("timestep", "id", "other", "d2", "rank"), "d2")


@register("count_in_range", f"WITH {GRAPH} SELECT timestep, id, count(dst) AS n FROM det LEFT JOIN pairs ON src_t = timestep AND src = id GROUP BY ALL")
def count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates._with_corrected(det(spark, sf_dir))
    return candidates.count_in_range(rows, rows, RADIUS)


@register("arcs_forward", f"WITH {GRAPH} SELECT src_t, src, dst_t, dst, round(sqrt(d2), 6) AS distance FROM fwd WHERE r <= 6")
def arcs_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.arcs(det(spark, sf_dir), candidates.Candidates(6, RADIUS)), "distance")


@register("arcs_fwd_bwd", f"WITH {GRAPH} SELECT src_t, src, dst_t, dst, round(distance, 6) AS distance FROM arcs")
def arcs_fwd_bwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arcs_of(det(spark, sf_dir)), "distance")


@register("arcs_divisions", f"WITH {GRAPH} SELECT src_t, src, dst_t, dst, round(distance, 6) AS distance FROM divs")
def arcs_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(divisions_of(det(spark, sf_dir)), "distance")


@register("arcs_crowded", f"""WITH {DET}, day AS (SELECT timestep // 24 AS timestep, id, x / 1000 AS x, y / 1000 AS y FROM det),
pairs AS (SELECT a.timestep AS src_t, a.id AS src, b.timestep AS dst_t, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM day a JOIN day b ON b.timestep = a.timestep + 1),
near AS (SELECT * FROM pairs WHERE d2 <= 2500 QUALIFY row_number() OVER (PARTITION BY src_t, src ORDER BY d2, dst) <= 3)
SELECT src_t, src, dst_t, dst, round(sqrt(d2), 6) AS distance FROM near""")
def arcs_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest of the next day, of hundreds within the radius."""
    rows = det(spark, sf_dir).withColumns({"timestep": F.floor(F.col("timestep") / 24).cast("int"), "x": F.col("x") / 1000, "y": F.col("y") / 1000})
    return rounded(candidates.arcs(rows, candidates.Candidates(3, 50.0)), "distance")


@register("degrees", f"WITH {GRAPH} SELECT timestep, id, (SELECT count(*) FROM arcs WHERE dst_t = timestep AND dst = id) AS in_degree, (SELECT count(*) FROM arcs WHERE src_t = timestep AND src = id) AS out_degree FROM det")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return candidates.degrees(rows, arcs_of(rows))


# energies


@register("pair_distance", f"WITH {GRAPH} SELECT src_t, src, dst, round(distance, 6) AS plain, round(sqrt((a.x + 1 - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS shifted FROM arcs JOIN det a ON a.timestep = src_t AND a.id = src JOIN det b ON b.timestep = dst_t AND b.id = dst")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ends(det(spark, sf_dir))
    moved: Point = (a[0] + 1, a[1], a[2])
    out = _pairs(det(spark, sf_dir)).select("src_t", "src", "dst", en.distance_energy(a, b).alias("plain"), distance(moved, b).alias("shifted"))
    return rounded(out, "plain", "shifted")


def _ends(_: DataFrame) -> tuple[Point, Point]:
    return point("a"), point("b")


def _pairs(rows: DataFrame) -> DataFrame:
    """Arcs with the positions, and more, of both ends."""
    keep = ["x", "y", "z", "count", "div_prob"]
    out = arcs_of(rows)
    for p, t, i in (("a", "src_t", "src"), ("b", "dst_t", "dst")):
        out = out.join(rows.select(F.col("timestep").alias(t), F.col("id").alias(i), *[F.col(c).alias(p + c) for c in keep]), [t, i])
    return out


def _triples(rows: DataFrame) -> DataFrame:
    """Pairs of arcs out of one detection with the positions of all three."""
    three = candidates.triples(candidates.arcs(rows, candidates.Candidates(4, 4 * RADIUS)))
    for p, t, i in (("m", "src_t", "src"), ("p", "dst_t", "dst1"), ("q", "dst_t", "dst2")):
        three = three.join(rows.select(F.col("timestep").alias(t), F.col("id").alias(i), *[F.col(c).alias(p + c) for c in ("x", "y", "z", "div_prob")]), [t, i])
    return three


TRIPLES = f"""{DET}, {pairs_sql(4 * RADIUS)}, k4 AS (SELECT * FROM fwd WHERE r <= 4),
tri AS (SELECT l.src_t, l.src, l.dst AS dst1, r.dst AS dst2, m.x mx, m.y my, p.x px, p.y py, q.x qx, q.y qy, m.div_prob mc, p.div_prob pc, q.div_prob qc,
  sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) AS d1, sqrt((m.x - q.x) ** 2 + (m.y - q.y) ** 2) AS d2 FROM k4 l JOIN k4 r ON l.src_t = r.src_t AND l.src = r.src AND l.dst < r.dst
  JOIN det m ON m.timestep = l.src_t AND m.id = l.src JOIN det p ON p.timestep = l.dst_t AND p.id = l.dst JOIN det q ON q.timestep = r.dst_t AND q.id = r.dst),
ang AS (SELECT *, CASE WHEN d1 * d2 = 0 THEN 'nan'::DOUBLE ELSE acos(greatest(-1, least(1, ((px - mx) * (qx - mx) + (py - my) * (qy - my)) / (d1 * d2)))) END AS a FROM tri)"""


@register("triple_angle", f"WITH {TRIPLES} SELECT src_t, src, dst1, dst2, round(a, 6) AS angle FROM ang")
def triple_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = _triples(det(spark, sf_dir))
    return rounded(three.select("src_t", "src", "dst1", "dst2", angle(point("m"), point("p"), point("q")).alias("angle")), "angle")


@register("division_costs", f"WITH {TRIPLES} SELECT src_t, src, dst1, dst2, round((d1 - 3) ** 2 + (d2 - 3) ** 2, 6) AS geometry, CASE WHEN a / pi() < 0.8 THEN 1e13 ELSE 0 END AS by_angle, round(d1 + d2 + 2.5, 6) AS by_sum, round(0.5 * (d1 ** 2 + d2 ** 2 + 2.5), 6) AS by_squares FROM ang")
def division_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = point("m"), point("p"), point("q")
    three = _triples(det(spark, sf_dir)).select("src_t", "src", "dst1", "dst2", en.division_by_geometry(*at, 3.0, 0.4, by_angle=False).alias("geometry"), en.division_by_angle(*at).alias("by_angle"), en.division_by_sum(*at, 2.5).alias("by_sum"), en.division_by_squares(*at, 0.5, 2.5).alias("by_squares"))
    return rounded(three, "geometry", "by_sum", "by_squares")


@register("division_cellness", f"WITH {TRIPLES} SELECT src_t, src, dst1, dst2, round(d1 ** 2 + d2 ** 2 - 190 * ln((mc * mc + 1e-7) / (1 + 1e-7)) - 1461 * ln((1 - (pc - qc) ** 2 + 1e-7) / (1 + 1e-7)), 4) AS cost FROM tri")
def division_cellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = en.division_by_cellness(point("m"), point("p"), point("q"), F.col("mdiv_prob"), F.col("pdiv_prob"), F.col("qdiv_prob"))
    return _triples(det(spark, sf_dir)).select("src_t", "src", "dst1", "dst2", F.round(cost, 4).alias("cost"))


@register("energy_cellness", f"WITH {DET} SELECT timestep, id, round(-2 * ln(CASE WHEN div_prob = 0 THEN 1e-5 ELSE div_prob END), 6) AS cell, round(-2 * ln(CASE WHEN div_prob = 1 THEN 1e-5 ELSE 1 - div_prob END), 6) AS other, round(-1000 * ln((1 - div_prob + 1e-7) / (1 + 1e-7)), 4) AS dis, round(-1000 * ln((1 - div_prob + 1e-5) / (1 + 1e-5)), 4) AS app FROM det")
def energy_cellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("div_prob").cast("double")
    out = det(spark, sf_dir).select("timestep", "id", en.neg_ln_cellness(c, 2).alias("cell"), en.neg_ln_not_cellness(c, 2).alias("other"), F.round(en.disappearance_by_cellness(c), 4).alias("dis"), F.round(en.appearance_by_cellness(c), 4).alias("app"))
    return rounded(out, "cell", "other")


@register("energy_move_cellness", f"WITH {GRAPH} SELECT src_t, src, dst, round(distance ** 2 - 1140 * ln((1 - (a.div_prob - b.div_prob) ** 2 + 1e-7) / (1 + 1e-7)), 4) AS cost FROM arcs JOIN det a ON a.timestep = src_t AND a.id = src JOIN det b ON b.timestep = dst_t AND b.id = dst")
def energy_move_cellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(det(spark, sf_dir)).select("src_t", "src", "dst", F.round(en.move_by_cellness(point("a"), point("b"), F.col("adiv_prob"), F.col("bdiv_prob")), 4).alias("cost"))


@register("energy_division", f"WITH {DET} SELECT timestep, id, round(-10 * ln(greatest(1 - div_prob, 1e-10)), 6) AS single, round(-10 * ln(greatest(div_prob, 1e-10)), 6) AS divides FROM det")
def energy_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("div_prob").cast("double")
    return rounded(det(spark, sf_dir).select("timestep", "id", en.division_energy(p, 10, False).alias("single"), en.division_energy(p, 10, True).alias("divides")), "single", "divides")


@register("energy_transition", f"WITH {GRAPH} SELECT src_t, src, dst, round(-10 * ln(greatest(1 - exp(-distance / 5), 1e-10)), 6) AS still, round(-10 * ln(greatest(exp(-distance / 5), 1e-10)), 6) AS moves FROM arcs")
def energy_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = en.transition_energies(F.col("distance"), 10, 5, 1)
    return rounded(arcs_of(det(spark, sf_dir)).select("src_t", "src", "dst", F.get(e, F.lit(0)).alias("still"), F.get(e, F.lit(1)).alias("moves")), "still", "moves")


@register("energy_detection_size", f"WITH {DET}, w AS (SELECT timestep, id, exp(-(count * count) / 100) a, exp(-((count - 20) * (count - 20)) / 100) b, exp(-((count - 40) * (count - 40)) / 100) c FROM det) SELECT timestep, id, " + ", ".join(f"round(-10 * ln(greatest(0.01, least(0.99, {v} / (a + b + c)))), 6) AS e{k}" for k, v in enumerate("abc")) + " FROM w")
def energy_detection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = en.detection_energies(en.size_prior(F.col("count"), 20.0, 2), 10)
    return rounded(det(spark, sf_dir).select("timestep", "id", *[F.get(e, F.lit(k)).alias(f"e{k}") for k in range(3)]), "e0", "e1", "e2")


@register("energy_detection_hard", f"WITH {DET} SELECT timestep, id, round(-10 * ln(0.09), 6) AS e0, round(-10 * ln(0.7), 6) AS e1, round(-10 * ln(0.21), 6) AS e2 FROM det")
def energy_detection_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = en.hard_prior(2)
    return rounded(det(spark, sf_dir).select("timestep", "id", *[en.prior_energy(10, prior, k).alias(f"e{k}") for k in range(3)]), "e0", "e1", "e2")


# calculators

CALC = f"{EMB}, two AS (SELECT a.id AS src, b.id AS dst, a.f::DOUBLE[] AS u, b.f::DOUBLE[] AS v FROM emb a JOIN emb b ON b.id = a.id + 1)"
ZEROS = "list_transform(range(63), lambda i: 0.0::DOUBLE)"


def _calc_sql(value: str) -> str:
    return f"WITH {CALC} SELECT src, dst, list_transform({value}, lambda q: round(q, 6)) AS v FROM two"


def _zip(expr: str) -> str:
    return f"list_transform(list_zip(u, v), lambda q: {expr})"


CALC_SQL = {
    "Identity": "u",
    "ElementWiseSquaredDistance": _zip("(q[1] - q[2]) * (q[1] - q[2])"),
    "AbsoluteDifference": f"list_prepend(list_sum({_zip('abs(q[1] - q[2])')}), {ZEROS})",
    "SquaredDifference": f"list_prepend(list_sum({_zip('(q[1] - q[2]) * (q[1] - q[2])')}), {ZEROS})",
    "SquareRooteSquaredDifference": f"list_prepend(sqrt(list_sum({_zip('(q[1] - q[2]) * (q[1] - q[2])')})), {ZEROS})",
    "Ratio": _zip("CASE WHEN q[1] = q[2] OR (q[1] < 1e-4 AND q[2] < 1e-4) THEN 1.0 ELSE least(q[1], q[2]) / greatest(q[1], q[2]) END"),
    "AsymmetricRatio": _zip("CASE WHEN q[1] = q[2] OR (q[1] < 1e-4 AND q[2] < 1e-4) THEN 1.0 ELSE q[1] / q[2] END"),
}


def _calculated(key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = emb(spark, sf_dir)
        a = rows.select(F.col("id").alias("src"), F.col("features").alias("fa"))
        b = rows.select(F.col("id").alias("dst"), F.col("features").alias("fb"))
        two = a.join(b, b["dst"] == a["src"] + 1)
        of = [F.col("fa"), F.col("fb")][: 1 if key == "Identity" else 2]
        value = F.transform(calc.extract(calc.calculator(key), "emb", *of), lambda q: signed_round(q.cast("double"), 6))
        return two.select("src", "dst", value.alias("v"))

    return run


for _key, _sql in CALC_SQL.items():
    register(f"calc_{_key.lower()}", _calc_sql(_sql))(_calculated(_key))


@register("multi_feature", f"WITH {CALC} SELECT src, dst, round(list_sum({_zip('abs(q[1] - q[2])')}), 6) AS abs_diff, round(list_sum({_zip('(q[1] - q[2]) * (q[1] - q[2])')}), 6) AS squared_diff FROM two")
def multi_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb(spark, sf_dir)
    two = rows.select(F.col("id").alias("src"), F.col("features").alias("fa")).join(rows.select(F.col("id").alias("dst"), F.col("features").alias("fb")), F.expr("dst = src + 1"))
    both = calc.extract_all([("AbsoluteDifference", "emb"), ("SquaredDifference", "emb")], F.col("fa"), F.col("fb"))
    out = two.select("src", "dst", both.alias("m"))
    first = lambda n: F.get(F.col("m").getItem(n), F.lit(0))
    return rounded(out.select("src", "dst", first("AbsDiff<emb>").alias("abs_diff"), first("SquaredDiff<emb>").alias("squared_diff")), "abs_diff", "squared_diff")


# graphs


def _keyed(rows: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = graph.node_key
    return rows.select(key(F.col("timestep"), F.col("id")).alias("node")), arcs.select(key(F.col("src_t"), F.col("src")).alias("src"), key(F.col("dst_t"), F.col("dst")).alias("dst"), "distance")


def _id(node: str) -> Column:
    return F.col(node).bitwiseAND(F.lit((1 << graph.ID_BITS) - 1))


KEYED = f"WITH RECURSIVE {GRAPH}, n AS (SELECT (timestep::BIGINT << 32) + id AS node FROM det), e AS (SELECT (src_t::BIGINT << 32) + src AS src, (dst_t::BIGINT << 32) + dst AS dst, distance FROM arcs)"


@register("component_ids", f"{KEYED}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT node, node AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node WHERE r.c < b.dst) SELECT node, min(c) AS component FROM r GROUP BY 1")
def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    nodes, links = _keyed(rows, arcs_of(rows))
    return graph.components(nodes, links)


@register("tracklet_chains", f"{KEYED}, l AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1)), r AS (SELECT node AS head, node, 0::BIGINT AS place FROM n WHERE node NOT IN (SELECT dst FROM l) UNION ALL SELECT r.head, l.dst, place + 1 FROM r JOIN l ON l.src = r.node) SELECT node, head, place FROM r")
def tracklet_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return graph.chains(*_keyed(rows, arcs_of(rows)))


@register("tracklet_graph", f"{KEYED}, l AS (SELECT src, dst, distance FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1)), r AS (SELECT node AS head, node, 0::BIGINT AS place, 0.0::DOUBLE AS d FROM n WHERE node NOT IN (SELECT dst FROM l) UNION ALL SELECT r.head, l.dst, place + 1, l.distance FROM r JOIN l ON l.src = r.node) SELECT head, list(node ORDER BY place) AS members, coalesce(list(round(d, 6) ORDER BY place) FILTER (place > 0), []) AS intern_dist FROM r GROUP BY 1")
def tracklet_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    contracted, _ = graph.tracklets(*_keyed(rows, arcs_of(rows)))
    return contracted.select("head", "members", F.transform("intern_dist", lambda d: F.round(d, 6)).alias("intern_dist"))


@register("prune_inactive", f"WITH {GRAPH}, keep AS (SELECT * FROM det WHERE id % 10 < 8) SELECT timestep, id FROM keep")
def prune_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).withColumn("node", graph.node_key(F.col("timestep"), F.col("id"))).withColumn("active", F.col("id") % 10 < 8)
    found = arcs_of(rows)
    nodes, links = _keyed(rows, found)
    ok = rows.where("active").select("node")
    links = links.join(ok.withColumnRenamed("node", "src").withColumn("l", F.lit(True)), "src", "left").join(ok.withColumnRenamed("node", "dst").withColumn("r", F.lit(True)), "dst", "left")
    kept, _ = graph.prune(rows, links.select("src", "dst", (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("active")))
    return kept.select("timestep", "id")


@register("prune_inactive_arcs", f"{KEYED} SELECT src, dst FROM e WHERE (src & 4294967295) % 10 < 8 AND (dst & 4294967295) % 10 < 8")
def prune_inactive_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).withColumn("active", F.col("id") % 10 < 8)
    nodes, links = _keyed(rows, arcs_of(rows))
    nodes = nodes.withColumn("active", _id("node") % 10 < 8)
    return graph.prune(nodes, links.withColumn("active", (_id("src") % 10 < 8) & (_id("dst") % 10 < 8)))[1].select("src", "dst")


@register("tracklet_arcs", f"{KEYED}, l AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1)), r AS (SELECT node AS head, node FROM n WHERE node NOT IN (SELECT dst FROM l) UNION ALL SELECT r.head, l.dst FROM r JOIN l ON l.src = r.node) SELECT a.head AS src_head, b.head AS dst_head, src, dst, round(distance, 6) AS distance FROM e JOIN r a ON a.node = src JOIN r b ON b.node = dst WHERE a.head <> b.head")
def tracklet_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return rounded(graph.tracklets(*_keyed(rows, arcs_of(rows)))[1], "distance")


ACTIVE = f"{KEYED}, l AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1) AND (src + dst) % 3 <> 0), r AS (SELECT node AS head, node, 0 AS place FROM n WHERE node NOT IN (SELECT dst FROM l) UNION ALL SELECT r.head, l.dst, place + 1 FROM r JOIN l ON l.src = r.node), p AS (SELECT head, list(node ORDER BY place) AS members, arg_max(node, place) AS last FROM r GROUP BY 1)"


def _active_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths of some arcs that are the only ones at both their ends."""
    rows = det(spark, sf_dir)
    nodes, links = _keyed(rows, arcs_of(rows))
    links = graph.cut_lineage(links, "links")
    once = lambda end: links.groupBy(end).agg(F.count(F.lit(1)).alias(f"{end}_n"))
    links = links.join(once("src"), "src").join(once("dst"), "dst")
    return graph.active_tracklets(nodes, links.select("src", "dst", ((F.col("src_n") == 1) & (F.col("dst_n") == 1) & ((F.col("src") + F.col("dst")) % 3 != 0)).alias("active")))


@register("active_tracklets", f"{ACTIVE} SELECT head, members FROM p")
def active_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active_paths(spark, sf_dir)[0]


@register("active_tracklet_arcs", f"{ACTIVE} SELECT a.head AS src, b.head AS dst FROM e JOIN p a ON a.last = src JOIN p b ON b.head = dst")
def active_tracklet_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active_paths(spark, sf_dir)[1]


@register("subset_arcs", f"{KEYED} SELECT src, dst FROM e WHERE (src + dst) % 5 = 0")
def subset_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    nodes, links = _keyed(rows, arcs_of(rows))
    return graph.subset(nodes.withColumn("chosen", F.lit(False)), links.withColumn("chosen", (F.col("src") + F.col("dst")) % 5 == 0), "chosen", "chosen")[1].select("src", "dst")


@register("subset_graph", f"WITH {GRAPH} SELECT timestep, id FROM det WHERE id % 17 = 0 UNION SELECT src_t, src FROM arcs WHERE (src + dst) % 5 = 0 UNION SELECT dst_t, dst FROM arcs WHERE (src + dst) % 5 = 0")
def subset_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).withColumn("node", graph.node_key(F.col("timestep"), F.col("id"))).withColumn("chosen", F.col("id") % 17 == 0)
    links = arcs_of(rows).withColumn("chosen", (F.col("src") + F.col("dst")) % 5 == 0)
    links = links.select(graph.node_key(F.col("src_t"), F.col("src")).alias("src"), graph.node_key(F.col("dst_t"), F.col("dst")).alias("dst"), "chosen")
    return graph.subset(rows, links, "chosen", "chosen")[0].select("timestep", "id")


# events


@register("events_from_labels", f"WITH {LABELLED} {SHOWN}")
def events_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(found_events(det(spark, sf_dir)))


@register("event_stats", f"WITH {LABELLED} SELECT slot, count(*) AS n_total, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t.lower()}" for t in events.COUNTED) + " FROM ev WHERE type IN ('Move', 'Division', 'Appearance', 'Disappearance') GROUP BY 1")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.statistics(found_events(det(spark, sf_dir)), ignore_unknown=True)


@register("merge_event_vectors", f"WITH {LABELLED}, b AS (SELECT * FROM ev WHERE type = 'Move' UNION ALL SELECT * FROM ev WHERE type <> 'Move' UNION ALL SELECT * FROM ev WHERE type = 'Merger') SELECT slot, type, array_to_string(ids, ',') AS ids FROM b")
def merge_event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_events(det(spark, sf_dir))
    return shown(events.merge(found, found.where("type = 'Merger'")))


RANKED = f"WITH {LABELLED}, k AS (SELECT *, list_position({events.TYPES!r}, type) AS rank FROM ev)"


@register("event_order", f"{RANKED} SELECT slot, type, array_to_string(ids, ',') AS ids, row_number() OVER (PARTITION BY slot ORDER BY rank, ids[1], coalesce(ids[2], -1)) AS place FROM k")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's place in its slot, by type and ids."""
    order = Window.partitionBy("slot").orderBy(*events.order_key())
    return shown_with(found_events(det(spark, sf_dir)).withColumn("place", F.row_number().over(order).cast("long")), "place")


@register("nested_events", f"{RANKED} SELECT s.slot::INT AS slot, coalesce(list(type || ': ' || array_to_string(ids, ', ') ORDER BY rank, ids) FILTER (type IS NOT NULL), []) AS events FROM (SELECT unnest(range(1 + (SELECT max(timestep) - min(timestep) FROM det))) AS slot) s LEFT JOIN k USING (slot) GROUP BY 1")
def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of rendered events a slot, empty ones included."""
    rows = det(spark, sf_dir)
    ends = detections.time_range(rows).first()
    found = events.nested(found_events(rows), ends.latest - ends.earliest + 1)
    text = F.transform("events", lambda e: F.concat(e["type"], F.lit(": "), F.array_join(e["traxel_ids"], ", ")))
    return found.select("slot", text.alias("events"))


@register("added_statistics", f"WITH {LABELLED} SELECT slot, 2 * count(*) AS n_total, " + ", ".join(f"2 * count(*) FILTER (type = '{t}') AS n_{t.lower()}" for t in events.COUNTED) + " FROM ev WHERE type IN ('Move', 'Division', 'Appearance', 'Disappearance') GROUP BY 1")
def added_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = events.statistics(found_events(det(spark, sf_dir)), ignore_unknown=True)
    return events.add_statistics(one, one)


@register("event_energy", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)), 6) AS energy FROM embeddings")
def event_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return rounded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), events.energy(v, v).alias("energy")), "energy")


@register("state_of_nodes", f"WITH {DET} SELECT (timestep - (SELECT min(timestep) FROM det))::INT AS slot, id, id % 10 < 8 AS active FROM det")
def state_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).withColumn("active", F.col("id") % 10 < 8)
    return events.states(rows, detections.time_range(rows).first().earliest)


@register("multi_frame_moves", f"""WITH RECURSIVE {GRAPH}, res AS (SELECT timestep, id FROM det WHERE id % 3 = 0), nxt AS (SELECT src_t, src, dst_t, min(dst) AS dst FROM arcs GROUP BY ALL),
r AS (SELECT src_t AS t0, src AS a, dst_t AS t, dst AS b FROM arcs WHERE dst % 3 = 0 AND src % 3 <> 0 UNION ALL SELECT t0, a, n.dst_t, n.dst FROM r JOIN nxt n ON n.src_t = r.t AND n.src = r.b WHERE r.b % 3 = 0)
SELECT (t - (SELECT min(timestep) FROM det))::INT AS slot, 'MultiFrameMove' AS type, a || ',' || b || ',' || (t0 - (SELECT min(timestep) FROM det)) AS ids FROM r WHERE b % 3 <> 0""")
def multi_frame_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    nodes = rows.select("timestep", "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("origin"))
    return shown(events.multi_frame_moves(nodes, arcs_of(rows), detections.time_range(rows).first().earliest))


# log-linear models


@register("loglinear_sums", f"WITH {LABELLED}, s AS (SELECT d.id % 10 < 8 AS active, o, i FROM deg d) SELECT * FROM (VALUES ('move', (SELECT count(*) FROM s WHERE active AND o = 1)), ('appearance', (SELECT count(*) FROM s WHERE active AND i = 0)), ('disappearance', (SELECT count(*) FROM s WHERE active AND o = 0)), ('division', (SELECT count(*) FROM s WHERE active AND o = 2)), ('detection', (SELECT count(*) FROM s WHERE active)), ('opportunity', (SELECT count(*) FROM s WHERE NOT active AND o = 0))) v(weight, total)")
def loglinear_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return loglinear.chaingraph_features(rows.withColumn("active", F.col("id") % 10 < 8), divisions_of(rows).withColumn("active", F.lit(True)))


@register("weighted_feature_sums", f"WITH {DET} SELECT id % 4 AS weight, sum(CASE WHEN timestep % 2 = id % 2 THEN count ELSE 0 END) AS total FROM det GROUP BY 1")
def weighted_feature_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    features = rows.select((F.col("id") % 4).alias("weight"), F.col("id").alias("variable"), (F.col("timestep") % 2).cast("long").alias("label"), F.col("count").alias("value"))
    return loglinear.weighted_sums(features, rows.select(F.col("id").alias("variable"), (F.col("id") % 2).alias("label")))


@register("hamming_loss", f"WITH {DET} SELECT id, CASE WHEN timestep % 3 = id % 3 THEN 0.0 ELSE -1.0 END AS loss FROM det")
def hamming_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("id", loglinear.hamming(F.col("timestep") % 3, F.col("id") % 3).alias("loss"))


@register("indicator", f"WITH {DET} SELECT id, CASE WHEN timestep % 2 = 1 AND id % 3 = 2 THEN 17.0 ELSE 2.0 END AS value FROM det")
def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("id", loglinear.indicator(F.array((F.col("timestep") % 2).cast("int"), (F.col("id") % 3).cast("int")), [1, 2], 17.0, 2.0).alias("value"))


# mergers


def _mergers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.transform(F.slice("embedding", 1, 18), lambda v: signed_round(v.cast("double"), 6))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).cast("int").alias("timestep"), F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 3).cast("int").alias("n_objects"), packed.alias("possible_coms"))


SPLIT = """m AS (SELECT (vec_id // 50)::INT AS timestep, vec_id AS id, 1 + vec_id % 3 AS n, list_transform(embedding[1:18], lambda v: round(v::DOUBLE, 6)) AS c FROM embeddings),
s AS (SELECT timestep, id, n, unnest(range(n)) AS k, c FROM m WHERE n > 1), mx AS (SELECT timestep, max(id) AS max_id FROM m GROUP BY 1),
sp AS (SELECT s.timestep, max_id + row_number() OVER (PARTITION BY s.timestep ORDER BY id, k) AS id, id AS origin, c[n * (n - 1) // 2 * 3 + 3 * k + 1] AS x, c[n * (n - 1) // 2 * 3 + 3 * k + 2] AS y, c[n * (n - 1) // 2 * 3 + 3 * k + 3] AS z FROM s JOIN mx USING (timestep))"""


@register("merger_split", f"WITH {SPLIT} SELECT * FROM sp")
def merger_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mergers(spark, sf_dir)
    return mergers.split(rows, mergers.centres_from_packed(rows.where("n_objects > 1"))).drop("k")


@register("replacement_arcs", f"""WITH {SPLIT}, a AS (SELECT p.timestep AS src_t, p.id AS src, q.timestep AS dst_t, q.id AS dst FROM m p JOIN m q ON q.id = p.id + 50),
e AS (SELECT timestep, id AS old, id, FALSE AS new, c[1] AS x, c[2] AS y, c[3] AS z FROM m WHERE n = 1 UNION ALL SELECT timestep, origin, id, TRUE, x, y, z FROM sp)
SELECT src_t, p.id AS src, dst_t, q.id AS dst, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS distance FROM a JOIN e p ON p.timestep = src_t AND p.old = src JOIN e q ON q.timestep = dst_t AND q.old = dst WHERE p.new OR q.new""")
def replacement_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mergers(spark, sf_dir)
    parts = mergers.split(rows, mergers.centres_from_packed(rows.where("n_objects > 1")))
    at = rows.select("timestep", "id", *[F.get("possible_coms", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    links = at.alias("p").join(at.alias("q"), F.col("q.id") == F.col("p.id") + 50).select(F.col("p.timestep").alias("src_t"), F.col("p.id").alias("src"), F.col("q.timestep").alias("dst_t"), F.col("q.id").alias("dst"))
    return rounded(mergers.replacement_arcs(at, links, parts), "distance")


# pixels


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda i, j: ((F.col("vec_id") + i * j) % 4).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: value(i, j)))
    return rows.select(F.col("vec_id").alias("image"), grid.alias("labels"))


PIX = "px AS (SELECT vec_id AS image, i, j, (vec_id + i * j) % 4 AS label FROM embeddings, range(6) a(i), range(6) b(j))"


@register("extract_pixels", f"WITH {PIX} SELECT image, label AS id, [i + 2, j] AS pixel FROM px WHERE label = 1")
def extract_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels.pixel_rows(_images(spark, sf_dir), 2)
    objects = rows.where("label = 1").groupBy("image").agg(F.count(F.lit(1)).alias("count")).select("image", F.col("image").cast("int").alias("timestep"), F.lit(1).cast("long").alias("id"), "count")
    return pixels.extract(rows, objects, [2, 0]).select(F.col("timestep").cast("long").alias("image"), "id", "pixel")


@register("update_labelimage", f"WITH {PIX} SELECT image, [i, j] AS pos, CASE WHEN i = j THEN 9 ELSE label END AS label FROM px")
def update_labelimage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels.pixel_rows(_images(spark, sf_dir), 2)
    diagonal = spark.range(9).select(F.array(F.col("id") + 2, F.col("id")).alias("pixel"))
    return pixels.update(rows, diagonal, [2, 0], 9)


@register("feature_vector", "SELECT vec_id AS id, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS v FROM embeddings")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = classifier.feature_vector(F.col("features"), ["missing", "emb"])
    return emb(spark, sf_dir).select("id", F.transform(v, lambda x: signed_round(x, 6)).alias("v"))


# trackers: the oracle tries every labelling of each component, which is small at this radius

TRACKER = ConservationTracker(radius=RADIUS)


def _log(p: str) -> str:
    return f"(-10.0 * ln(greatest({p}, {en.PROBABILITY_FLOOR!r})))"


#: Components of arcs ``t`` (src, dst and what they cost), with their arcs numbered.
PARTS = """n AS (SELECT (timestep::BIGINT << 32) + id AS node, * FROM det), t0 AS (SELECT min(timestep) AS a, max(timestep) AS b FROM det),
b AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t),
r AS (SELECT node, node AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node WHERE r.c < b.dst),
comp AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
num AS (SELECT t.*, c, row_number() OVER (PARTITION BY c ORDER BY src, dst) AS k FROM t JOIN comp ON comp.node = t.src),
most AS (SELECT c, max(k) AS m FROM num GROUP BY 1),"""
KEYED_ARC = "(src_t::BIGINT << 32) + src AS src, (dst_t::BIGINT << 32) + dst AS dst, distance AS d"
CTRACK = f"""WITH RECURSIVE {DET}, {pairs_sql().split("divs AS")[0].rstrip().rstrip(",")},
t AS (SELECT DISTINCT {KEYED_ARC} FROM (SELECT src_t, src, dst_t, dst, sqrt(d2) AS distance FROM fwd WHERE r <= CASE WHEN p > 0.3 THEN 2 ELSE 1 END UNION SELECT src_t, src, dst_t, dst, sqrt(d2) FROM bwd WHERE r = 1)),
{PARTS}
flow AS (SELECT c, 0 AS k, []::INT[] AS y FROM most UNION ALL SELECT f.c, f.k + 1, list_append(f.y, v) FROM flow f JOIN most USING (c), (VALUES (0), (1), (2)) s(v) WHERE f.k < m),
way AS (SELECT f.c, f.y FROM flow f JOIN most USING (c) WHERE f.k = m),
used AS (SELECT w.c, w.y, src, dst, y[k] AS v, CASE WHEN y[k] = 0 THEN {_log("1 - exp(-d / 5.0)")} ELSE {_log("exp(-d / 5.0)")} END AS e FROM way w JOIN num USING (c)),
o AS (SELECT c, y, src AS node, sum(v) AS o, max(v) AS top, count(*) AS arcs FROM used GROUP BY ALL), i AS (SELECT c, y, dst AS node, sum(v) AS i FROM used GROUP BY ALL),
pick AS (SELECT way.c, way.y, comp.node, s.a, s.b, s.d, [{_log("0.09")}, {_log("0.7")}, {_log("0.21")}][1 + greatest(s.a, s.b)] + CASE WHEN s.b = 0 AND s.a > 0 AND timestep > t0.a THEN 100.0 * s.a ELSE 0 END + CASE WHEN s.a = 0 AND s.b > 0 AND timestep < t0.b THEN 100.0 * s.b ELSE 0 END
    + CASE WHEN coalesce(o.arcs, 0) < 2 THEN 0 WHEN s.d = 1 THEN {_log("div_prob")} ELSE {_log("1 - div_prob")} END AS e
  FROM way JOIN comp USING (c) JOIN n ON n.node = comp.node CROSS JOIN t0 LEFT JOIN o ON o.c = way.c AND o.y = way.y AND o.node = comp.node LEFT JOIN i ON i.c = way.c AND i.y = way.y AND i.node = comp.node,
    (SELECT a, b, d FROM range(3) x(a), range(3) z(b), range(2) w(d) WHERE a = b OR a = 0 OR b = 0) s
  WHERE (o.o IS NULL OR o.o = s.a + s.d) AND (i.i IS NULL OR i.i = s.b) AND (s.d = 0 OR (o.arcs > 1 AND o.o = 2 AND o.top = 1))),
state AS (SELECT c, y, node, a, b, d, e FROM pick QUALIFY row_number() OVER (PARTITION BY c, y, node ORDER BY round(e, 9), d, a, b) = 1),
total AS (SELECT c, y, sum(e) AS e, count(*) AS nodes FROM state GROUP BY ALL), arcsum AS (SELECT c, y, sum(e) AS e FROM used GROUP BY ALL),
best AS (SELECT c, y, total.e + arcsum.e AS e FROM total JOIN arcsum USING (c, y) JOIN (SELECT c, count(*) AS size FROM comp GROUP BY 1) z USING (c) WHERE nodes = size QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(total.e + arcsum.e, 9), y) = 1),
single AS (SELECT node, 1 AS n_objects, FALSE AS divides, {_log("0.7")} AS e FROM comp WHERE c NOT IN (SELECT c FROM most)),
lab AS (SELECT node, CASE WHEN a = 0 THEN b ELSE a END AS n_objects, d = 1 AS divides FROM state JOIN best USING (c, y) UNION ALL SELECT node, n_objects, divides FROM single),
go AS (SELECT src, dst FROM used JOIN best USING (c, y) WHERE v > 0),
deg AS (SELECT n.timestep, n.id, n_objects, divides, t0.a AS t0, t0.b AS t1, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i, o.next FROM lab JOIN n USING (node) CROSS JOIN t0
  LEFT JOIN (SELECT src, count(*) AS n, list(dst & 4294967295 ORDER BY dst DESC) AS next FROM go GROUP BY 1) o ON o.src = node LEFT JOIN (SELECT dst, count(*) AS n FROM go GROUP BY 1) i ON i.dst = node WHERE n_objects > 0),
ev AS (SELECT (timestep - t0 + 1)::INT AS slot, 'Move' AS type, [id, unnest(next)] AS ids FROM deg WHERE timestep < t1 AND o > 0 AND NOT (o = 2 AND divides)
  UNION ALL SELECT timestep - t0 + 1, 'Division', list_concat([id], next) FROM deg WHERE timestep < t1 AND o = 2 AND divides
  UNION ALL SELECT timestep - t0 + 1, 'Disappearance', [id] FROM deg WHERE timestep < t1 AND o = 0
  UNION ALL SELECT timestep - t0, 'Appearance', [id] FROM deg WHERE timestep > t0 AND i = 0
  UNION ALL SELECT timestep - t0, 'Merger', [id, n_objects] FROM deg WHERE n_objects > 1)"""
COUNTS = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t.lower()}" for t in events.COUNTED)


@register("ctrack_events", f"{CTRACK} {SHOWN}")
def ctrack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(TRACKER.run(det(spark, sf_dir)))


@register("ctrack_statistics", f"{CTRACK} SELECT slot, count(*) AS n_total, {COUNTS} FROM ev WHERE type IN ('Move', 'Division', 'Appearance', 'Disappearance') GROUP BY 1")
def ctrack_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.statistics(TRACKER.run(det(spark, sf_dir)), ignore_unknown=True)


@register("ctrack_costs", f"{CTRACK} SELECT c AS node, round(e, 6) AS cost, 0.0::DOUBLE AS gap FROM best UNION ALL SELECT node, round(e, 6), 0.0 FROM single")
def ctrack_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of each component, at its least node, and the gap to the proven bound."""
    tracker = TRACKER
    labelled, _ = tracker.infer(*tracker.build_graph(det(spark, sf_dir)))
    return rounded(labelled.where("cost <> 0").select("node", "cost", "gap"), "cost")


CHAIN = ChaingraphTracker(radius=RADIUS, appearance=30, disappearance=30, misdetection=100)
CHAINED = f"""WITH RECURSIVE {DET}, {pairs_sql().split("divs AS")[0].rstrip().rstrip(",")},
t AS (SELECT {KEYED_ARC} FROM (SELECT src_t, src, dst_t, dst, sqrt(d2) AS distance FROM fwd WHERE r <= {CHAIN.neighbours})),
{PARTS}
flow AS (SELECT c, 0 AS k, []::INT[] AS y, []::BIGINT[] AS srcs, []::BIGINT[] AS dsts FROM most
  UNION ALL SELECT f.c, f.k + 1, list_append(f.y, v), CASE WHEN v = 1 THEN list_append(srcs, src) ELSE srcs END, CASE WHEN v = 1 THEN list_append(dsts, dst) ELSE dsts END
  FROM flow f JOIN num ON num.c = f.c AND num.k = f.k + 1, (VALUES (0), (1)) s(v)
  WHERE v = 0 OR (NOT list_contains(dsts, dst) AND len(list_filter(srcs, lambda x: x = src)) < 2)),
way AS (SELECT f.c, f.y FROM flow f JOIN most USING (c) WHERE f.k = m),
used AS (SELECT w.c, w.y, src, dst, d FROM way w JOIN num USING (c) WHERE y[k] = 1),
o AS (SELECT c, y, src AS node, count(*) AS o, CASE WHEN count(*) = 1 THEN sum(d) ELSE sum((d - 10.0) * (d - 10.0)) END AS e FROM used GROUP BY ALL), i AS (SELECT c, y, dst AS node, count(*) AS i FROM used GROUP BY ALL),
state AS (SELECT way.c, way.y, comp.node, CASE WHEN o.o IS NULL AND i.i IS NULL THEN least(70.0, 100.0) ELSE 10.0 + coalesce(o.e, 30.0) + CASE WHEN i.i IS NULL THEN 30.0 ELSE 0 END END AS e
  FROM way JOIN comp USING (c) LEFT JOIN o ON o.c = way.c AND o.y = way.y AND o.node = comp.node LEFT JOIN i ON i.c = way.c AND i.y = way.y AND i.node = comp.node),
total AS (SELECT c, y, sum(e) AS e FROM state GROUP BY ALL),
best AS (SELECT * FROM total QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(e, 9), y) = 1),
go AS (SELECT src, dst FROM used JOIN best USING (c, y)),
deg AS (SELECT n.timestep, n.id, t0.a AS t0, t0.b AS t1, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i, o.next FROM n CROSS JOIN t0
  LEFT JOIN (SELECT src, count(*) AS n, list(dst & 4294967295 ORDER BY dst DESC) AS next FROM go GROUP BY 1) o ON o.src = node LEFT JOIN (SELECT dst, count(*) AS n FROM go GROUP BY 1) i ON i.dst = node),
ev AS (SELECT (timestep - t0 + 1)::INT AS slot, 'Move' AS type, [id, unnest(next)] AS ids FROM deg WHERE timestep < t1 AND o = 1
  UNION ALL SELECT timestep - t0 + 1, 'Division', list_concat([id], next) FROM deg WHERE timestep < t1 AND o = 2
  UNION ALL SELECT timestep - t0 + 1, 'Disappearance', [id] FROM deg WHERE timestep < t1 AND o = 0
  UNION ALL SELECT timestep - t0, 'Appearance', [id] FROM deg WHERE timestep > t0 AND i = 0)"""


@register("chaingraph_events", f"{CHAINED} {SHOWN}")
def chaingraph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(CHAIN.run(det(spark, sf_dir)))


@register("chaingraph_costs", f"{CHAINED} SELECT c AS node, round(e, 6) AS cost, 0.0::DOUBLE AS gap FROM best UNION ALL SELECT node, 70.0, 0.0 FROM comp WHERE c NOT IN (SELECT c FROM most)")
def chaingraph_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of each component, at its least node, and the gap to the proven bound."""
    labelled, _ = CHAIN.infer(*CHAIN.build_graph(det(spark, sf_dir)))
    return rounded(labelled.where("cost <> 0").select("node", "cost", "gap"), "cost")


#: Six neighbours within 50 make one component of all detections; the defaults of the tracker.
WIDE = ChaingraphTracker()
WIDE_ARCS = f"""{EMB}, pairs AS (SELECT a.timestep AS src_t, a.id AS src, b.timestep AS dst_t, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM emb a JOIN emb b ON b.timestep = a.timestep + 1),
near AS (SELECT * FROM pairs WHERE d2 <= {WIDE.radius * WIDE.radius} QUALIFY row_number() OVER (PARTITION BY src_t, src ORDER BY d2, dst) <= {WIDE.neighbours}),
e AS (SELECT (src_t::BIGINT << 32) + src AS src, (dst_t::BIGINT << 32) + dst AS dst FROM near),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT node, node AS c FROM (SELECT (timestep::BIGINT << 32) + id AS node FROM emb) UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node WHERE r.c < b.dst),
comp AS (SELECT node, min(c) AS component FROM r GROUP BY 1)"""


def _wide(spark: SparkSession, sf_dir: str, **more: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, labelled nodes, labelled arcs) of all embeddings, labels proven to a gap of 0.01."""
    tracker = replace(WIDE, **more)
    nodes, arcs = tracker.build_graph(emb(spark, sf_dir))
    of, labelled, used = tracker.infer_components(nodes, arcs)
    return of, labelled, used.select(F.col("a").alias("src"), F.col("b").alias("dst"), "active", "distance")


def _proofs(of: DataFrame, labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Size, cost and gap of each component, and whether its labels are allowed and have that cost."""
    on = links.where("active")
    out = on.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.sum("distance").alias("d"), F.sum((F.col("distance") - WIDE.mean_division_distance) ** 2).alias("d2"))
    into = on.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    met = labelled.select("node", "active", "cost", "gap").join(of, "node").join(out, "node", "left").join(into, "node", "left")
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    leaving = F.when(o == 0, WIDE.disappearance).when(o == 1, F.col("d")).otherwise(F.col("d2"))
    own = F.when(F.col("active"), WIDE.detection + leaving + F.when(i == 0, WIDE.appearance).otherwise(0.0)).otherwise(WIDE.misdetection + WIDE.opportunity)
    n_arcs = links.join(of.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("n_arcs"))
    found = met.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("cost").alias("cost"), F.max("gap").alias("gap"), F.sum(own).alias("recounted"), F.bool_and((i <= 1) & (o <= 2) & (F.col("active") | ((i == 0) & (o == 0)))).alias("allowed"))
    return found.join(n_arcs, "component", "left").select("component", "n_nodes", F.coalesce("n_arcs", F.lit(0)).alias("n_arcs"), "cost", "gap", ((F.col("gap") <= WIDE.gap) & (F.abs(F.col("recounted") - F.col("cost")) < 1e-6 * F.abs("cost"))).alias("proven"), "allowed")


@register("chaingraph_wide")
def chaingraph_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and gap of each component at six neighbours within 50."""
    return rounded(_proofs(*_wide(spark, sf_dir)).drop("proven", "allowed"), "cost", "gap")


@register("chaingraph_windows", f"WITH RECURSIVE {WIDE_ARCS} SELECT component, count(*) AS n_nodes, (SELECT count(*) FROM e JOIN comp x ON x.node = e.src WHERE x.component = comp.component) AS n_arcs, true AS proven, true AS allowed FROM comp GROUP BY component")
def chaingraph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same components in windows of about 250 detections: the gap is proven, the labels are allowed and cost what is said."""
    return _proofs(*_wide(spark, sf_dir, window_nodes=250)).drop("cost", "gap")


FORBIDDEN = 1000.0


@register("chaingraph_factors", f"""WITH {GRAPH}, n AS (SELECT (timestep::BIGINT << 32) + id AS node FROM det), e AS (SELECT {KEYED_ARC} FROM fwd_),
o AS (SELECT src, count(*) AS k, sum(d) AS d FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS k FROM e GROUP BY 1),
two AS (SELECT p.src, sum((p.d - 10.0) ** 2 + (q.d - 10.0) ** 2) AS d, count(*) AS k FROM e p JOIN e q ON q.src = p.src AND p.dst < q.dst GROUP BY 1)
SELECT 'detection:' || node AS factor, 2 AS entries, 110.0::DOUBLE AS total FROM n
UNION ALL SELECT 'outgoing:' || node, (2 ** (1 + coalesce(o.k, 0)))::BIGINT, round(30.0 + coalesce(o.d, 0) + coalesce(two.d, 0) + {FORBIDDEN} * (2 ** (1 + coalesce(o.k, 0)) - 2 - coalesce(o.k, 0) - coalesce(two.k, 0)), 4) FROM n LEFT JOIN o ON o.src = node LEFT JOIN two ON two.src = node
UNION ALL SELECT 'incoming:' || node, (2 ** (1 + coalesce(i.k, 0)))::BIGINT, 30.0 + {FORBIDDEN} * (2 ** (1 + coalesce(i.k, 0)) - 2 - coalesce(i.k, 0)) FROM n LEFT JOIN i ON i.dst = node""".replace("FROM fwd_", "FROM (SELECT src_t, src, dst_t, dst, sqrt(d2) AS distance FROM fwd WHERE r <= 6)"))
def chaingraph_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and sum of every explicit table of the model."""
    tracker = replace(CHAIN, forbidden=FORBIDDEN)
    _, entries = tracker.explicit_tables(*tracker.build_graph(det(spark, sf_dir)))
    return entries.groupBy("factor").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("value"), 4).alias("total"))


#: What :func:`resolve_mergers` links: parts and single objects of a pair's frames, three on each side.
RESOLVED = """rows_ AS (SELECT (vec_id // 50)::INT AS t, vec_id AS id, 100.0 * embedding[1]::DOUBLE AS x, 100.0 * embedding[2]::DOUBLE AS y, 100.0 * embedding[3]::DOUBLE AS z, vec_id // 2 AS pair, 1 + (vec_id // 50 + vec_id) % 2 AS n FROM embeddings),
mx AS (SELECT t, max(id) AS top FROM rows_ GROUP BY 1),
obj AS (SELECT t, id AS old, id, pair, x, y, z, 1 AS n FROM rows_ WHERE n = 1 UNION ALL
  SELECT t, id, top + row_number() OVER (PARTITION BY t ORDER BY id, k), pair, x + 2 * k - 1, y, z, 2 FROM rows_ JOIN mx USING (t), range(2) a(k) WHERE n = 2),
full_ AS (SELECT t, pair FROM rows_ GROUP BY ALL HAVING count(*) = 2),
arc AS (SELECT a.t AS src_t, a.pair, a.id AS src, b.t AS dst_t, b.id AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, dense_rank() OVER (PARTITION BY a.t, a.pair ORDER BY a.id) AS s
  FROM obj a JOIN obj b ON b.t = a.t + 1 AND b.pair = a.pair + 25 AND (a.n = 2 OR b.n = 2) JOIN full_ p ON p.t = a.t AND p.pair = a.pair JOIN full_ q ON q.t = b.t AND q.pair = b.pair)"""


@register("resolve_mergers", f"""WITH {RESOLVED}, cost AS (SELECT *, {_log("exp(-d / 5.0)")} - {_log("1 - exp(-d / 5.0)")} AS e FROM arc),
way AS (SELECT a.src_t, a.pair, [a.dst, b.dst, c.dst] AS to_ FROM cost a JOIN cost b ON b.src_t = a.src_t AND b.pair = a.pair AND b.s = 2 JOIN cost c ON c.src_t = a.src_t AND c.pair = a.pair AND c.s = 3
  WHERE a.s = 1 AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst QUALIFY row_number() OVER (PARTITION BY a.src_t, a.pair ORDER BY round(a.e + b.e + c.e, 9), a.dst, b.dst) = 1)
SELECT src_t, src, dst_t, dst, coalesce(to_[s] = dst, FALSE) AS active FROM arc LEFT JOIN way USING (src_t, pair)""")
def resolve_mergers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections, in pairs of which one holds two objects, the other one in each frame, in turn; split and link them.

    Of the three objects of a pair one moves between its two detections from frame to
    frame, so a pair is one component over all frames. A pair that lacks a detection in
    a frame has no links there.
    """
    rows = emb(spark, sf_dir).select("timestep", "id", "x", "y", "z", F.floor(F.col("id") / 2).alias("pair"), (1 + (F.col("timestep") + F.col("id")) % 2).alias("n"))
    centre = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array(F.col("x") + 2 * k - 1, F.col("y"), F.col("z")).alias("centre")) for k in (0, 1)]))
    parts = mergers.split(rows, rows.where("n = 2").select("timestep", "id", centre.alias("c")).select("timestep", "id", "c.*"))
    whole = rows.groupBy("timestep", "pair").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("of")).where("size(of) = 2")
    links = whole.alias("p").join(whole.alias("q"), F.expr("q.timestep = p.timestep + 1 AND q.pair = p.pair + 25"))
    # from the one object to where two are next, from the two to both
    ends = F.array(*[F.struct(F.get("p.of", F.lit(i))["id"].alias("src"), F.get("q.of", F.lit(j))["id"].alias("dst")) for i, j in ((0, 1), (1, 0), (1, 1))])
    links = links.select(F.col("p.timestep").alias("src_t"), F.col("q.timestep").alias("dst_t"), F.inline(ends))
    return mergers.resolve(rows.select("timestep", "id", "x", "y", "z"), links, parts)


#: Rounds that the SQL of clusters spells out; assignments settle long before.
SETTLED = 20


def clusters_sql(k: int) -> str:
    """CTEs that end in ``km{k}`` (g, j, x, y, z): the sorted centres of k clusters of pt(g, i, x, y, z), numbered from 0."""
    far = lambda p, c: f"({p}.x - {c}.x) * ({p}.x - {c}.x) + ({p}.y - {c}.y) * ({p}.y - {c}.y) + ({p}.z - {c}.z) * ({p}.z - {c}.z)"
    parts = [f"s{k}_1 AS (SELECT g, 0 AS j, x, y, z FROM pt WHERE i = 0)"]
    for n in range(1, k):
        pick = f"SELECT p.g, p.i, min({far('p', 'c')}) AS gap FROM pt p JOIN s{k}_{n} c USING (g) GROUP BY ALL"
        parts.append(f"s{k}_{n + 1} AS (SELECT * FROM s{k}_{n} UNION ALL SELECT g, {n}, x, y, z FROM (SELECT g, i FROM ({pick}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY gap DESC, i) = 1) JOIN pt USING (g, i))")
    parts.append(f"c{k}_0 AS MATERIALIZED (SELECT * FROM s{k}_{k})")
    for n in range(SETTLED):
        near = f"SELECT p.g, p.i, p.x, p.y, p.z, c.j FROM pt p JOIN c{k}_{n} c USING (g) QUALIFY row_number() OVER (PARTITION BY p.g, p.i ORDER BY {far('p', 'c')}, c.j) = 1"
        mean = f"SELECT g, j, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({near}) GROUP BY g, j"
        parts.append(f"c{k}_{n + 1} AS MATERIALIZED (SELECT g, j, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z FROM c{k}_{n} c LEFT JOIN ({mean}) m USING (g, j))")
    parts.append(f"km{k} AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY x, y, z) - 1 AS j, x, y, z FROM c{k}_{SETTLED})")
    return ",\n".join(parts)


def mixture_sql(k: int, rounds: int = 30, tolerance: float = 1e-6) -> str:
    """CTEs that end in ``mix{k}`` (g, j, x, y, z, score, ended): a mixture of pt(g, i, x, y, z) that starts at km{k}."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = ", ".join(f"{'covar_pop'}({a}, {b}) * count(*) / greatest(count(*) - 1, 1) + {mergers.COVARIANCE_FLOOR if a == b else 0.0!r} AS {a}{b}" for a, b in pairs)
    names = ", ".join(a + b for a, b in pairs)
    parts = [f"spread{k} AS (SELECT g, count(*) AS n, {cov} FROM pt GROUP BY g)", f"m{k}_0 AS MATERIALIZED (SELECT g, j, x, y, z, n, 1.0 / {k} AS w, {names}, NULL::DOUBLE AS score, FALSE AS done, 0 AS labels FROM km{k} JOIN spread{k} USING (g))"]
    det = "(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))"
    quad = "((yy * zz - yz * yz) * a * a + (xx * zz - xz * xz) * b * b + (xx * yy - xy * xy) * c * c + 2 * (xz * yz - xy * zz) * a * b + 2 * (xy * yz - xz * yy) * a * c + 2 * (xy * xz - xx * yz) * b * c)"
    for r in range(rounds):
        old, new = f"m{k}_{r}", f"m{k}_{r + 1}"
        off = f"SELECT p.g, p.i, m.j, m.w, {names}, p.x AS px, p.y AS py, p.z AS pz, p.x - m.x AS a, p.y - m.y AS b, p.z - m.z AS c FROM pt p JOIN {old} m USING (g) WHERE NOT done"
        parts.append(f"l{k}_{r} AS (SELECT g, i, j, px, py, pz, ln(w) - 0.5 * (3 * ln(2 * pi()) + ln({det}) + {quad} / {det}) AS l FROM ({off}))")
        parts.append(f"e{k}_{r} AS MATERIALIZED (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY g, i)) AS each FROM (SELECT *, max(l) OVER (PARTITION BY g, i) AS top FROM l{k}_{r}))")
        parts.append(f"t{k}_{r} AS (SELECT g, sum(each) FILTER (j = 0) AS score FROM e{k}_{r} GROUP BY g)")
        parts.append(f"b{k}_{r} AS (SELECT g, count(DISTINCT j) AS labels FROM (SELECT g, j FROM e{k}_{r} QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY l DESC, j) = 1) GROUP BY g)")
        parts.append(f"u{k}_{r} AS (SELECT g, j, sum(exp(l - each)) + 1e-300 AS tot, sum(exp(l - each) * px) / (sum(exp(l - each)) + 1e-300) AS x, sum(exp(l - each) * py) / (sum(exp(l - each)) + 1e-300) AS y, sum(exp(l - each) * pz) / (sum(exp(l - each)) + 1e-300) AS z FROM e{k}_{r} GROUP BY g, j)")
        again = ", ".join(f"sum(exp(l - each) * (p{a} - u.{a}) * (p{b} - u.{b})) / any_value(tot) + {mergers.COVARIANCE_FLOOR if a == b else 0.0!r} AS {a}{b}" for a, b in pairs)
        parts.append(f"v{k}_{r} AS (SELECT g, j, {again} FROM e{k}_{r} JOIN u{k}_{r} u USING (g, j) GROUP BY g, j)")
        values = ", ".join(f"CASE WHEN o.done THEN o.{c} ELSE {t}.{c} END AS {c}" for c, t in [*[(c, "u") for c in "xyz"], *[(a + b, "v") for a, b in pairs]])
        parts.append(f"{new} AS MATERIALIZED (SELECT g, j, {values}, o.n, CASE WHEN o.done THEN o.w ELSE tot / o.n END AS w, CASE WHEN o.done THEN o.score ELSE t.score END AS score, o.done OR coalesce(abs(t.score - o.score) < {tolerance!r} * abs(t.score), FALSE) AS done, coalesce(bb.labels, o.labels) AS labels FROM {old} o LEFT JOIN u{k}_{r} u USING (g, j) LEFT JOIN v{k}_{r} v USING (g, j) LEFT JOIN t{k}_{r} t USING (g) LEFT JOIN b{k}_{r} bb USING (g))")
    parts.append(f"mix{k} AS (SELECT g, j, x, y, z, n, score, labels FROM m{k}_{rounds})")
    return ",\n".join(parts)


CENTRES = "SELECT (g // 5)::INT AS timestep, g % 5 AS id, j::INT AS k, [round(x, 4), round(y, 4), round(z, 4)] AS centre"
TENS = f"{EMB}, pt AS MATERIALIZED (SELECT timestep * 5 + id % 5 AS g, row_number() OVER (PARTITION BY timestep, id % 5 ORDER BY x, y, z) - 1 AS i, x, y, z FROM emb)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir).select("timestep", (F.col("id") % 5).alias("id"), F.lit(2).alias("n_objects"), F.array("x", "y", "z").alias("pixel"))


def _centres(found: DataFrame) -> DataFrame:
    return found.withColumn("centre", F.transform("centre", lambda v: signed_round(v, 4)))


@register("merger_clusters", f"WITH {TENS}, {clusters_sql(2)} {CENTRES} FROM km2")
def merger_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centres(mergers.centres(_pixels(spark, sf_dir), method="kmeans", shared=True))


@register("merger_centres", f"WITH {TENS}, {clusters_sql(2)}, {mixture_sql(2)} {CENTRES} FROM (SELECT g, j, x, y, z FROM mix2 WHERE labels = 2 UNION ALL SELECT g, km2.j, km2.x, km2.y, km2.z FROM km2 WHERE g IN (SELECT g FROM mix2 WHERE labels < 2))")
def merger_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centres(mergers.centres(_pixels(spark, sf_dir), shared=True))


FIFTIES = f"{EMB}, pt AS MATERIALIZED (SELECT timestep AS g, row_number() OVER (PARTITION BY timestep ORDER BY x, y, z) - 1 AS i, x, y, z FROM emb)"


@register("gmm_bic", f"WITH {FIFTIES}, {', '.join(f'{clusters_sql(k)}, {mixture_sql(k)}' for k in (1, 2, 3))} " + " UNION ALL ".join(f'SELECT g::BIGINT AS "group", {k} AS k, round(any_value(score) / any_value(n) - 0.5 * {k}, 4) AS bic, flatten(list([round(x, 3), round(y, 3), round(z, 3)] ORDER BY j)) AS centres FROM mix{k} GROUP BY g' for k in (1, 2, 3)))
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mergers.priors_and_centres(emb(spark, sf_dir).select(F.col("timestep").cast("long").alias("group"), F.array("x", "y", "z").alias("pixel")), 3, 0.5, shared=True)
    return found.select("group", "k", F.round("bic", 4).alias("bic"), F.transform("centres", lambda v: signed_round(v, 3)).alias("centres"))


@register("rf_cellness")
def rf_cellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb(spark, sf_dir)
    model = classifier.train(rows.withColumn("label", (F.col("label") > 4).cast("int")), ["emb"])
    scored = classifier.predict(rows, model, ["emb"])
    return scored.select("id", F.round(F.get(F.col("features").getItem("cellness"), F.lit(0)).cast("double"), 6).alias("cellness"))


GROWTH = forest.Growth(trees=6, depth=4)


def forest_sql(g: forest.Growth) -> str:
    """The forest of embeddings by label above 4, and each row's mean share of that class."""
    parts = [f"p0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (label > 4)::INT AS y, t AS tree, 1::BIGINT AS node FROM embeddings, range({g.trees}) a(t))"]
    for d in range(g.depth + 1):
        split = f"n >= {g.least} AND ones > 0 AND ones < n AND a < b" if d < g.depth else "false"
        parts.append(f"""n{d} AS (SELECT *, {split} AS split, (a + b) / 2 AS threshold FROM (SELECT tree, node, (tree * 31 + node * 17) % len(any_value(v)) + 1 AS f, count(*) AS n, sum(y) AS ones, min(v[(tree * 31 + node * 17) % len(v) + 1]) AS a, max(v[(tree * 31 + node * 17) % len(v) + 1]) AS b FROM p{d} GROUP BY tree, node)),
l{d} AS (SELECT id, tree, ones / n AS share FROM p{d} JOIN n{d} USING (tree, node) WHERE NOT split)""")
        if d < g.depth:
            parts.append(f"p{d + 1} AS (SELECT id, v, y, tree, 2 * node + (v[f] > threshold)::INT AS node FROM p{d} JOIN n{d} USING (tree, node) WHERE split)")
    leaves = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(g.depth + 1))
    return f"WITH {', '.join(parts)} SELECT id, round(avg(share), 5) AS cellness FROM ({leaves}) GROUP BY id"


@register("forest_cellness", forest_sql(GROWTH))
def forest_cellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest grown on all embeddings, and the probability that it gives each of them."""
    rows = emb(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    grown = forest.grow(rows, ["emb"], growth=GROWTH)
    scored = forest.predict(rows, grown, ["emb"])
    return scored.select("id", F.round(F.get(F.col("features").getItem("cellness"), F.lit(0)).cast("double"), 5).alias("cellness"))
