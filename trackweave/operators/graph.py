"""Candidate and labelled graphs: components, chains, pruning, subsets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids are unsigned 32-bit numbers, so that frame and id make one key.
ID_BITS = 32


def node_key(timestep: Column, id_: Column) -> Column:
    return F.shiftleft(timestep.cast("long"), ID_BITS) + id_.cast("long")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """A table in the cluster's shared folder in place of a plan that grows with each round."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of nodes(node) and edges(src, dst); a component is named by its least node.

    Each round gives a node the least label among its neighbours and jumps once along
    labels, so that long chains take a number of rounds logarithmic in their length.
    """
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(edges.select(F.inline(ways)).distinct(), "edges")  # one pass: what the edges come from may be dear
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.hint("merge"), both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("m"))
        hooked = labels.join(near.hint("merge"), labels["node"] == near["src"]).select("node", "label", F.least("label", "m").alias("m"))
        # the old root learns of the lower label that any of its nodes has seen, and labels jump one step
        lower = hooked.groupBy(F.col("label").alias("root")).agg(F.min("m").alias("r"))
        stepped = hooked.join(lower.hint("merge"), hooked["label"] == lower["root"]).select("node", "label", F.least("m", "r").alias("next"))
        parent = stepped.select(F.col("node").alias("p"), F.col("next").alias("pp"))
        jumped = stepped.join(parent.hint("merge"), stepped["next"] == parent["p"], "left")
        step = cut_lineage(jumped.select("node", F.least("next", F.coalesce("pp", "next")).alias("label"), F.col("label").alias("was")), "labels")
        changed = step.where("label <> was").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def chains(nodes: DataFrame, arcs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, head, place) of maximal unambiguous chains in nodes(node), arcs(src, dst).

    A node joins its predecessor if that is its only one and has no other successor.
    Pointers double each round; only nodes that join one take part, and arcs are read once.
    """
    arcs = cut_lineage(arcs.select("src", "dst"), "chain-arcs")
    one_out = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    one_in = arcs.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    links = arcs.join(one_out.where("o = 1").select("src"), "src", "left_semi").join(one_in.where("i = 1").select("dst"), "dst", "left_semi")
    links = links.select(F.col("dst").alias("node"), F.col("src").alias("up"))
    now = cut_lineage(links.select("node", F.col("up").alias("head"), F.lit(1).cast("long").alias("place")), "chains")
    for _ in range(most_rounds):
        up = now.select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("place").alias("p2"))
        step = now.join(up.hint("merge"), "head", "left").select("node", F.coalesce("h2", "head").alias("head"), (F.col("place") + F.coalesce("p2", F.lit(0))).alias("place"), "p2")
        step = cut_lineage(step, "chains")
        moved = step.where("p2 > 0").limit(1).count()
        now = step.drop("p2")
        if not moved:
            return nodes.select("node").join(now.hint("merge"), "node", "left").select("node", F.coalesce("head", "node").alias("head"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    raise RuntimeError("chains did not settle")


def tracklets(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracted graph: (head, members, intern_dist, intern_arcs) and arcs between chains.

    ``arcs`` has src, dst and distance; an arc between chains keeps its own ends.
    """
    arcs = cut_lineage(arcs, "arcs")
    of = chains(nodes, arcs)
    members = of.groupBy("head").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]).alias("members"))
    a, b = of.select(F.col("node").alias("src"), F.col("head").alias("src_head")), of.select(F.col("node").alias("dst"), F.col("head").alias("dst_head"), "place")
    placed = arcs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    inside = placed.where("src_head = dst_head").groupBy(F.col("src_head").alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "distance", "src", "dst"))).alias("inner"))
    contracted = members.join(inside.hint("merge"), "head", "left").select(
        "head",
        "members",
        F.coalesce(F.transform("inner", lambda s: s["distance"]), F.array().cast("array<double>")).alias("intern_dist"),
        F.coalesce(F.transform("inner", lambda s: F.struct(s["src"].alias("src"), s["dst"].alias("dst"))), F.array().cast("array<struct<src:bigint,dst:bigint>>")).alias("intern_arcs"),
    )
    return contracted, placed.where("src_head <> dst_head").select("src_head", "dst_head", "src", "dst", "distance")


def active_tracklets(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracted graph (head, members) of paths of active arcs, and arcs between them (src, dst).

    nodes(node[, members]) and arcs(src, dst, active). A path goes on along its one
    active arc; a node with two active arcs out or in is an error. All arcs out of a
    path's last node that lead to the first node of a path remain. The result can be
    contracted again: ``members`` are then strung together.
    """
    on = arcs.where("active").select("src", "dst")
    for end in ("src", "dst"):
        n = on.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        twice = F.when(F.col("n") > 1, F.raise_error(F.lit("more than one active arc"))).otherwise(True).cast("boolean")
        on = on.join(n.where(twice).select(end), end).select("src", "dst")
    of = chains(nodes, cut_lineage(on, "active"))
    own = F.col("members") if "members" in nodes.columns else F.array("node")
    placed = of.join(nodes.select("node", own.alias("own")), "node")
    strung = F.transform(F.sort_array(F.collect_list(F.struct("place", "node", "own"))), lambda s: s["own"])
    paths = placed.groupBy("head").agg(F.flatten(strung).alias("members"), F.max_by("node", "place").alias("last"))
    ends = paths.select(F.col("last").alias("src"), F.col("head").alias("from"))
    between = arcs.join(ends, "src").join(paths.select(F.col("head").alias("dst")), "dst").select(F.col("from").alias("src"), "dst")
    return paths.select("head", "members"), between


def require(rows: DataFrame, *columns: str) -> None:
    """A missing property is an error that names it."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def prune(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop inactive arcs, then inactive nodes; an active arc at a dropped node is an error.

    nodes(node, n_objects or active), arcs(src, dst, active).
    """
    alive = F.col("n_objects") > 0 if "n_objects" in nodes.columns else F.col("active")
    kept_nodes, kept_arcs = nodes.where(alive), arcs.where("active")
    dead = nodes.where(~alive).select(F.col("node").alias("_dead"))
    for end in ("src", "dst"):
        hit = kept_arcs.join(dead, kept_arcs[end] == dead["_dead"], "left")
        bad = F.when(F.col("_dead").isNotNull(), F.raise_error(F.lit("an active arc at an inactive node"))).otherwise(True)
        kept_arcs = hit.where(bad.cast("boolean")).drop("_dead")
    return kept_nodes, kept_arcs


def subset(nodes: DataFrame, arcs: DataFrame, node_flag: str, arc_flag: str) -> tuple[DataFrame, DataFrame]:
    """Flagged nodes, flagged arcs and the ends of these arcs."""
    chosen = arcs.where(arc_flag)
    ends = chosen.select(F.col("src").alias("node")).union(chosen.select("dst")).union(nodes.where(node_flag).select("node")).distinct()
    return nodes.join(ends, "node", "left_semi"), chosen


def translate(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Carry columns of values(node, ...) over to other node names by mapping(node, other)."""
    return values.join(mapping, "node").drop("node").withColumnRenamed("other", "node")
