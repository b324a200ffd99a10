"""Connected components of edge tables, with hot nodes dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize

#: Copies of the small side; adaptive execution splits what is still hot.
SALTS = 8


def salted_join(rows: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` with ``small``, which has one row a key at most.

    A key may hold any share of ``rows``: they are dealt over ``salts`` keys by a hash
    of the whole row, and each row of ``small`` is copied to all of them.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [key] if isinstance(key, str) else key
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, rounds: int | None = None) -> DataFrame:
    """(node, label) of every node of edges(a, b); the label is the least node of its component.

    With ``rounds``, stop after so many: nodes of one label are then connected, but
    connected nodes may still differ in label.

    Alternates large-star and small-star steps: each step re-links every node's
    neighbours to the least of them, and the number of rounds grows with the logarithm
    of the longest path. Every round is cut with a table in the shared folder.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    for _ in range(rounds or most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(down.select("a", F.col("m").alias("b"))).distinct(), name)
        if rounds:
            continue
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if (seen.n, seen.h) == last:
            break
        last = (seen.n, seen.h)
    else:
        if rounds:
            ends = now.union(now.select("b", "b"))
            return ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
