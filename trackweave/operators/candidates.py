"""Candidate arcs: nearest neighbours within a radius in the next or previous frame.

The join key is the frame and a grid cell as wide as the radius: a query row goes to
its own cell and those around it, so that each pair in range meets once and no frame
is compared with itself as a whole. Axes along which all detections lie within the
radius need no grid. Distances on the radius count; ties go by id.

Where a cell holds many detections, nearest neighbours are not sought among all pairs in
range: see :mod:`trackweave.operators.crowds`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import Point, point, squared_distance
from trackweave.operators import crowds


@dataclass(frozen=True)
class Candidates:
    neighbours: int = 6
    radius: float = 50.0
    forward_backward: bool = False
    divisions: bool = False
    division_threshold: float = 0.5


def wide_axes(rows: DataFrame, radius: float) -> tuple[int, ...]:
    """The axes along which detections, corrected or not, lie further apart than the radius."""
    ends = [f(F.least(p, q) if f is F.min else F.greatest(p, q)) for p, q in zip(point(), point(suffix="_corr"), strict=True) for f in (F.min, F.max)]
    found = rows.agg(*ends).first()
    # not a number counts as far
    return tuple(k for k in range(3) if found[2 * k] is not None and not found[2 * k + 1] - found[2 * k] <= radius)


def in_range(queries: DataFrame, targets: DataFrame, radius: float, shift: int, reverse: bool = False, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Pairs (timestep, id, other_timestep, other, d2) of queries and targets ``shift`` frames on.

    Forward, a query stands at its corrected position; in reverse, the targets do. The
    grid has cells along ``axes`` only.
    """
    if radius < 0:
        raise ValueError("a radius is not negative")
    size = radius or 1.0
    at: Point = point() if reverse else point(suffix="_corr")
    to: Point = point(suffix="_corr") if reverse else point()
    cell = lambda v: F.floor(v / size)
    q = queries.select("timestep", "id", *[c.alias(f"q{k}") for k, c in enumerate(at)], (F.col("timestep") + shift).alias("other_timestep"))
    for k in axes:
        q = q.withColumn(f"c{k}", F.explode(F.sequence(cell(F.col(f"q{k}")) - 1, cell(F.col(f"q{k}")) + 1)))
    t = targets.select(F.col("timestep").alias("other_timestep"), F.col("id").alias("other"), *[c.alias(f"t{k}") for k, c in enumerate(to)], *[cell(to[k]).alias(f"c{k}") for k in axes])
    d2 = squared_distance(tuple(F.col(f"q{k}") for k in range(3)), tuple(F.col(f"t{k}") for k in range(3)))
    # merged, as all joins of tables that grow: a table sent to all passes through the driver
    pairs = q.join(t.hint("merge"), ["other_timestep", *[f"c{k}" for k in axes]]).withColumn("d2", d2)
    return pairs.where(F.col("d2") <= radius * radius).select("timestep", "id", "other_timestep", "other", "d2")


def nearest(pairs: DataFrame, k: Column | int) -> DataFrame:
    w = Window.partitionBy("timestep", "id").orderBy("d2", "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Times ``k`` that a cell may hold before its frames are searched by halved cells.
CROWD = 32
#: Cells are halved so often at most.
MOST_LEVELS = 40


def crowded(targets: DataFrame, at: Point, radius: float, k: int, axes: tuple[int, ...]) -> int:
    """How often cells of the radius should be halved, by the fullest one; 0 if all pairs in range are few enough."""
    size = radius or 1.0
    cells = targets.groupBy("timestep", *[F.floor(at[a] / size).alias(f"c{a}") for a in axes]).agg(F.count(F.lit(1)).alias("n"))
    most = cells.agg(F.max("n")).first()[0] or 0
    return 0 if most <= CROWD * max(k, 1) else min(MOST_LEVELS, (most // max(k, 1)).bit_length() + 1)


def nearest_in_range(queries: DataFrame, targets: DataFrame, at: Point, to: Point, radius: float, shift: int, k: Column | int, most: int, levels: int = MOST_LEVELS) -> DataFrame:
    """(timestep, id, other_timestep, other, d2, rank) of up to ``k`` (``most`` at most) nearest targets in range of each query.

    Cells that hold many are halved, ``levels`` times at most. Of targets at one place only
    the first ``most`` by id can be among the nearest of any query.
    """
    placed = lambda rows, frame, role, where, n: rows.select(frame.cast("int").alias("frame"), F.lit(role).alias("role"), F.col("id").cast("long").alias("id"), *[c.cast("double").alias(a) for a, c in zip("xyz", where, strict=True)], n.cast("double").alias("k"))
    q = placed(queries, F.col("timestep") + shift, crowds.QUERY, at, F.lit(k) if isinstance(k, int) else k)
    t = placed(targets, F.col("timestep"), crowds.TARGET, to, F.lit(0))
    # who has no place is near nobody
    rows = q.where("k >= 1").unionByName(t).where(" AND ".join(f"abs({a}) < double('infinity')" for a in "xyz"))
    cells = crowds.cells_of(rows, radius or 1.0, levels)
    return crowds.Search(cells, radius, shift, most).run(rows)


def count_in_range(queries: DataFrame, targets: DataFrame, radius: float, shift: int = 1, reverse: bool = False) -> DataFrame:
    n = in_range(queries, targets, radius, shift, reverse).groupBy("timestep", "id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("timestep", "id").join(n, ["timestep", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _with_corrected(rows: DataFrame) -> DataFrame:
    missing = {f"{a}_corr": F.col(a) for a in "xyz" if f"{a}_corr" not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def arcs(detections: DataFrame, options: Candidates | None = None) -> DataFrame:
    """arcs(src_t, src, dst_t, dst, distance), each from a frame to the next one."""
    o = options or Candidates()
    rows = _with_corrected(detections)
    k: Column | int = o.neighbours
    # one table of pairs for both directions: either way a row stands at its corrected
    # position against the next frame's plain ones
    axes = wide_axes(rows, o.radius)
    if o.divisions and o.neighbours < 2:
        if "div_prob" not in rows.columns:
            raise ValueError("division-aware neighbours need div_prob")
        p = F.when(F.col("div_prob").isNull(), F.raise_error(F.lit("no feature divProb"))).otherwise(F.col("div_prob"))
        k = F.when(p > o.division_threshold, 2).otherwise(o.neighbours)
    most = max(2, o.neighbours) if isinstance(k, Column) else k
    # many detections in one cell: each side seeks its nearest, not all pairs in range
    if crowded(rows, point(), o.radius, most, axes):
        plain, shifted = point(), point(suffix="_corr")
        chosen = nearest_in_range(rows, rows, shifted, plain, o.radius, 1, k, most).drop("rank")
        if o.forward_backward:
            behind = nearest_in_range(rows, rows, plain, shifted, o.radius, -1, o.neighbours, o.neighbours)
            turned = behind.select(F.col("other_timestep").alias("timestep"), F.col("other").alias("id"), F.col("timestep").alias("other_timestep"), F.col("id").alias("other"), "d2")
            chosen = chosen.unionByName(turned).dropDuplicates(["timestep", "id", "other_timestep", "other"])
        return _found(chosen)
    forward = in_range(rows, rows, o.radius, 1, axes=axes)
    if isinstance(k, Column):
        # a frame's rows meet their pairs again by key
        forward = forward.join(rows.select("timestep", "id", k.alias("k")).hint("merge"), ["timestep", "id"])
        k = F.col("k")
    ahead = F.row_number().over(Window.partitionBy("timestep", "id").orderBy("d2", "other")) <= k
    if o.forward_backward:
        behind = F.row_number().over(Window.partitionBy("other_timestep", "other").orderBy("d2", "id")) <= o.neighbours
        chosen = forward.withColumns({"_ahead": ahead, "_behind": behind}).where("_ahead OR _behind")
    else:
        chosen = forward.withColumn("_ahead", ahead).where("_ahead")
    return _found(chosen)


def _found(pairs: DataFrame) -> DataFrame:
    found = pairs.select(F.col("timestep").alias("src_t"), F.col("id").alias("src"), F.col("other_timestep").alias("dst_t"), F.col("other").alias("dst"), "d2")
    return found.withColumn("distance", F.sqrt("d2")).drop("d2")


def degrees(detections: DataFrame, graph: DataFrame) -> DataFrame:
    """In- and out-degree of every detection."""
    out = graph.groupBy(F.col("src_t").alias("timestep"), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = graph.groupBy(F.col("dst_t").alias("timestep"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    all_ = detections.select("timestep", "id").join(out, ["timestep", "id"], "left").join(into, ["timestep", "id"], "left")
    return all_.select("timestep", "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])


def triples(graph: DataFrame) -> DataFrame:
    """(src_t, src, dst1, dst2) of every pair of arcs that leave one detection, dst1 < dst2."""
    a = graph.select("src_t", "src", F.col("dst").alias("dst1"), "dst_t")
    b = graph.select("src_t", "src", F.col("dst").alias("dst2"))
    return a.join(b, ["src_t", "src"]).where("dst1 < dst2")
