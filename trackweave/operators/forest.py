"""Forests of decision trees as tables: a split or a leaf is a row, grown and walked level by level.

Trees are extremely randomised: every tree sees all rows; a node splits one feature, drawn
by a rule from tree and node, halfway between its least and greatest value there. So a
forest is the same however rows are dealt, and SQL can say the same.

[P. Geurts, D. Ernst and L. Wehenkel, Extremely randomized trees, 2006]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.classifier import feature_vector
from trackweave.operators.graph import cut_lineage


@dataclass(frozen=True)
class Growth:
    """Nodes of fewer than ``least`` rows, of one class or without a spread are leaves, and so are those at ``depth``."""

    trees: int = 10
    depth: int = 5
    classes: int = 2
    least: int = 4


def feature_of(tree: Column, node: Column, many: Column) -> Column:
    """The feature that a node splits."""
    return F.pmod(tree * 31 + node * 17, many)


def grow(rows: DataFrame, names: list[str], label: str = "label", growth: Growth | None = None) -> DataFrame:
    """(tree, node, feature, threshold, shares) of rows(features, label 0, 1, ...); a leaf has no feature.

    The root is node 1; rows at most the threshold go to node 2 n, others to 2 n + 1.
    ``shares`` are the classes' parts of the rows at a node.
    """
    g = growth or Growth()
    vectors = rows.select(feature_vector(F.col("features"), names).alias("v"), F.col(label).cast("int").alias("y"))
    at = vectors.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(g.trees - 1))), "node": F.lit(1).cast("long")})
    done: DataFrame | None = None
    for level in range(g.depth + 1):
        value = F.get("v", F.col("feature").cast("int"))
        drawn = at.withColumn("feature", feature_of(F.col("tree"), F.col("node"), F.size("v")))
        counts = [F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(g.classes)]
        nodes = drawn.groupBy("tree", "node", "feature").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), *counts)
        shares = F.array(*[F.col(f"c{c}") / F.col("n") for c in range(g.classes)])
        pure = F.greatest(*[F.col(f"c{c}") for c in range(g.classes)], F.lit(0)) == F.col("n")
        split = F.lit(level < g.depth) & (F.col("n") >= g.least) & ~pure & (F.col("a") < F.col("b"))
        halves = nodes.select("tree", "node", F.when(split, F.col("feature")).cast("int").alias("feature"), F.when(split, (F.col("a") + F.col("b")) / 2).alias("threshold"), shares.alias("shares"))
        halves = cut_lineage(halves, "forest")
        done = halves if done is None else done.unionByName(halves)
        if level < g.depth:
            at = step(at, halves)
    return cut_lineage(done, "forest")


def step(at: DataFrame, forest: DataFrame) -> DataFrame:
    """Rows (v, tree, node, ...) at split nodes, one level further; rows at leaves are left out."""
    splits = forest.where("feature IS NOT NULL").select("tree", "node", "feature", "threshold")
    right = F.get("v", F.col("feature")) > F.col("threshold")
    moved = at.join(splits, ["tree", "node"]).withColumn("node", 2 * F.col("node") + right.cast("int"))
    return moved.drop("feature", "threshold")


def probabilities(rows: DataFrame, forest: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """(key, shares): the mean over trees of the shares of the leaf that a row reaches."""
    trees = forest.select("tree").distinct()
    height = int(forest.agg(F.max(F.floor(F.log2(F.col("node"))))).first()[0] or 0)
    # a row meets each tree once; the table of trees is as small as the forest
    listed = trees.agg(F.collect_set("tree").alias("trees"))
    at = rows.select(*key, feature_vector(F.col("features"), names).alias("v")).join(F.broadcast(listed)).withColumn("tree", F.explode("trees")).drop("trees")
    at = at.withColumn("node", F.lit(1).cast("long"))
    leaves = forest.where("feature IS NULL").select("tree", "node", "shares")
    reached = at.join(leaves, ["tree", "node"]).select(*key, "tree", "shares")
    for _ in range(height):
        at = step(at, forest)
        reached = reached.unionByName(at.join(leaves, ["tree", "node"]).select(*key, "tree", "shares"))
    many = reached.select(*key, F.posexplode("shares").alias("class", "share"))
    means = many.groupBy(*key, "class").agg(F.avg("share").alias("share"))
    return means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "share"))), lambda x: x["share"]).alias("shares"))


def predict(rows: DataFrame, forest: DataFrame, names: list[str], cls: int = 1, output: str = "cellness") -> DataFrame:
    """Add P(cls) as a feature of length one to rows(timestep, id, features, ...); no such class is an error."""
    found = probabilities(rows, forest, names, ["timestep", "id"])
    bad = F.raise_error(F.lit("no such class")).cast("array<float>")
    p = F.when((F.size("shares") > cls) & F.lit(cls >= 0), F.array(F.get("shares", F.lit(max(cls, 0))).cast("float"))).otherwise(bad)
    rest = F.map_filter("features", lambda k, _: k != output)
    return rows.join(found, ["timestep", "id"]).withColumn("features", F.map_concat(rest, F.create_map(F.lit(output), p))).select(*rows.columns)
