"""Typed events of a labelled graph, and what is computed from them.

nodes(timestep, id, n_objects, divides[, origin]) and arcs(src_t, src, dst_t, dst) hold
what is active. events(slot, type, traxel_ids): slots count from the earliest frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators import graph

#: Order of the types.
TYPES = ["Move", "Division", "Appearance", "Disappearance", "Merger", "ResolvedTo", "MultiFrameMove", "Void"]
COUNTED = ["Move", "Division", "Appearance", "Disappearance"]


def _event(slot: Column, kind: str, ids: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), F.lit(kind).alias("type"), ids.cast("array<bigint>").alias("traxel_ids"))


def events(nodes: DataFrame, arcs: DataFrame, earliest: int | None = None, latest: int | None = None) -> DataFrame:
    """All events of the labelled graph, one row each.

    Without a ``divides`` column two successors are a division, and three an error.
    """
    if earliest is None or latest is None:
        ends = nodes.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b")).first()
        earliest, latest = ends.a or 0, ends.b or 0
    key = ["timestep", "id"]
    out = arcs.groupBy(F.col("src_t").alias("timestep"), F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst"), asc=False).alias("next"))
    into = arcs.select(F.col("dst_t").alias("timestep"), F.col("dst").alias("id")).distinct().withColumn("fed", F.lit(True))
    rows = nodes.join(out, key, "left").join(into, key, "left")
    t, me = F.col("timestep"), F.col("id")
    degree = F.coalesce(F.size("next"), F.lit(0))
    slot = t - earliest + 1
    moves = F.transform(F.col("next"), lambda d: _event(slot, "Move", F.array(me, d)))
    splits = F.array(_event(slot, "Division", F.concat(F.array(me), F.col("next"))))
    if "divides" in nodes.columns:
        going = F.when((degree == 2) & F.col("divides"), splits).otherwise(moves)
    else:
        too_many = F.raise_error(F.lit("more than two successors without divisions")).cast(splits_type())
        going = F.when(degree == 2, splits).when(degree > 2, too_many).otherwise(moves)
    going = F.when(t >= latest, none()).when(degree == 0, F.array(_event(slot, "Disappearance", F.array(me)))).otherwise(going)
    coming = F.when(F.col("fed").isNull() & (t > earliest), F.array(_event(t - earliest, "Appearance", F.array(me)))).otherwise(none())
    many = none()
    if "n_objects" in nodes.columns:
        many = F.when(F.col("n_objects") > 1, F.array(_event(t - earliest, "Merger", F.array(me, F.col("n_objects"))))).otherwise(none())
    found = rows.select(F.explode(F.concat(going, coming, many)).alias("e")).select("e.*")
    if "origin" in nodes.columns:
        split = nodes.where("origin IS NOT NULL").groupBy("timestep", "origin").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        made = split.select(_event(t - earliest, "ResolvedTo", F.concat(F.array(F.col("origin")), F.col("ids"))).alias("e")).select("e.*")
        found = found.unionByName(made)
    return found


def splits_type() -> str:
    return "array<struct<slot:int,type:string,traxel_ids:array<bigint>>>"


def none() -> Column:
    return F.array().cast(splits_type())


def multi_frame_moves(nodes: DataFrame, arcs: DataFrame, earliest: int, most_rounds: int = 60) -> DataFrame:
    """Moves across resolved nodes: from the node before them to the first unresolved one after.

    nodes(timestep, id, origin); the first successor is the one with the least id.
    Pointers double each round, so any number of frames may lie between; a way that
    ends at a resolved node gives no move, and a cycle is an error.
    """
    arcs = graph.cut_lineage(arcs, "arcs")  # read twice
    first = arcs.groupBy("src_t", "src").agg(F.min(F.struct("dst_t", "dst")).alias("n"))
    resolved = nodes.where("origin IS NOT NULL").select("timestep", "id")
    hit = resolved.select(F.col("timestep").alias("dst_t"), F.col("id").alias("dst"))
    start = arcs.join(hit, ["dst_t", "dst"], "left_semi")
    start = start.join(resolved.select(F.col("timestep").alias("src_t"), F.col("id").alias("src")), ["src_t", "src"], "left_anti")
    steps = first.select(F.col("src_t").alias("t"), F.col("src").alias("at"), F.col("n.dst_t").alias("nt"), F.col("n.dst").alias("nat"))
    inside = resolved.select(F.col("timestep").alias("t"), F.col("id").alias("at"))
    flags = inside.withColumnsRenamed({"t": "nt", "at": "nat"}).withColumn("inside", F.lit(True))
    # each resolved node's pointer along first successors; one that ends inside leads nowhere
    now = steps.join(inside, ["t", "at"], "left_semi").join(flags, ["nt", "nat"], "left").select("t", "at", "nt", "nat", "inside")
    now = graph.cut_lineage(now, "frames")
    for _ in range(most_rounds):
        if now.where("inside").isEmpty():
            break
        up = now.select(F.col("t").alias("nt"), F.col("at").alias("nat"), F.col("nt").alias("t2"), F.col("nat").alias("at2"), F.col("inside").alias("inside2"))
        ahead = now.where("inside").join(up, ["nt", "nat"]).select("t", "at", F.col("t2").alias("nt"), F.col("at2").alias("nat"), F.col("inside2").alias("inside"))
        now = graph.cut_lineage(now.where("inside IS NULL").unionByName(ahead), "frames")
    else:
        raise RuntimeError("multi-frame moves did not settle")
    begun = start.select(F.col("src_t").alias("t0"), F.col("src").alias("from"), F.col("dst_t").alias("t"), F.col("dst").alias("at"))
    done = begun.join(now, ["t", "at"])
    return done.select(_event(F.col("nt") - earliest, "MultiFrameMove", F.array(F.col("from"), F.col("nat"), F.col("t0") - earliest)).alias("e")).select("e.*")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Slot-wise concatenation of two event tables."""
    return a.unionByName(b)


def nested(found: DataFrame, slots: int) -> DataFrame:
    """One row a slot, empty slots included, with its events in order."""
    every = found.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    lists = found.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct(type_rank(F.col("type")).alias("k"), "traxel_ids", "type"))).alias("l"))
    lists = lists.select("slot", F.transform("l", lambda e: F.struct(e["type"].alias("type"), e["traxel_ids"].alias("traxel_ids"))).alias("events"))
    return every.join(lists, "slot", "left").select("slot", F.coalesce("events", F.array().cast("array<struct<type:string,traxel_ids:array<bigint>>>")).alias("events"))


def type_rank(kind: Column) -> Column:
    return F.array_position(F.lit(TYPES), kind)


def order_key() -> list[Column]:
    """Type, then the first and the second id."""
    return [type_rank(F.col("type")), F.get("traxel_ids", F.lit(0)), F.get("traxel_ids", F.lit(1))]


def statistics(found: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """Counts by slot of the four basic types and in all."""
    if not ignore_unknown:
        known = F.when(F.col("type").isin(COUNTED), True).otherwise(F.raise_error(F.lit("an event of another type")).cast("boolean"))
        found = found.where(known)
    counts = [F.count_if(F.col("type") == k).alias(f"n_{k.lower()}") for k in COUNTED]
    return found.where(F.col("type").isin(COUNTED)).groupBy("slot").agg(F.count(F.lit(1)).alias("n_total"), *counts)


def add_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    names = [c for c in a.columns if c != "slot"]
    return a.unionByName(b).groupBy("slot").agg(*[F.sum(c).alias(c) for c in names])


def energy(weights: Column, features: Column) -> Column:
    """Weights times features; nothing if there are none, and an error if lengths differ."""
    w, f = F.coalesce(weights, F.array().cast("array<double>")), F.coalesce(features, F.array().cast("array<double>"))
    dot = F.aggregate(F.zip_with(w, f, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(w) != F.size(f), F.raise_error(F.lit("weights and features differ in length")).cast("double")).otherwise(dot)


def resize_features(values: Column, n: int) -> Column:
    """The first n values, filled up with zeros."""
    v = F.coalesce(values, F.array().cast("array<double>"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def render() -> Column:
    return F.concat(F.col("type"), F.lit(": "), F.array_join("traxel_ids", ", "))


def states(nodes: DataFrame, earliest: int) -> DataFrame:
    """(slot, id, active) of every node before pruning."""
    active = F.col("n_objects") > 0 if "n_objects" in nodes.columns else F.col("active")
    return nodes.select((F.col("timestep") - earliest).cast("int").alias("slot"), "id", active.alias("active"))
