"""Sharding by a hierarchical weighted hash tree.

Every document descends region, rack and shard. At each level each child draws
``-ln(u) / weight`` from a hash of its name and the document's id, and the least
draw wins, so children get shares by weight. A changed weight alters the draws of
its own ancestors only: documents move into or out of subtrees whose weights
change and nowhere else. A shard added as a region of its own takes documents only
into itself, which is how ``grow`` extends a tree (law ``key``).

Null texts have size 16 and checksum 0; a null doc_id hashes as the word ``null``;
repeated ids land in one shard with slots of their own. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import let

LEVELS = ("region", "rack", "shard")
#: Draws use 52 bits of a hash, which a double holds exactly.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(n_shards: int, racks: int = 2, shards: int = 5) -> list[Leaf]:
    """Equal shards, ``shards`` to a rack and ``racks`` to a region."""
    rack = [k // shards for k in range(n_shards)]
    return [Leaf(f"g{r // racks}", f"g{r // racks}r{r}", k) for k, r in enumerate(rack)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    n = 1 + max(leaf.shard for leaf in tree)
    return [*tree, Leaf(f"new{n}", f"new{n}r", n, weight)]


def children(tree: list[Leaf]) -> dict[str, list[tuple[str, float]]]:
    """Name and weight of each node's children; the root's name is empty."""
    out: dict[str, dict[str, float]] = {}
    for leaf in tree:
        for parent, child in (("", leaf.region), (leaf.region, leaf.rack), (leaf.rack, f"s{leaf.shard}")):
            node = out.setdefault(parent, {})
            node[child] = node.get(child, 0.0) + leaf.weight
    return {k: sorted(v.items()) for k, v in out.items()}


def _hash_unit(text: Column) -> Column:
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double")
    return (digits + 1) / float(16**DRAW_DIGITS + 1)


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The number of the shard that ``key`` (string) falls into."""
    below = children(tree)
    one = lambda name, weight: F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))
    nodes = F.create_map(*[x for name, kids in below.items() for x in (F.lit(name), F.array(*[one(*k) for k in kids]))])

    def pick(parent: Column) -> Column:
        draws = F.transform(F.element_at(nodes, parent), lambda c: F.struct((-F.log(_hash_unit(F.concat(c["name"], F.lit("|"), key))) / c["weight"]).alias("draw"), c["name"].alias("name")))
        return F.array_min(draws)["name"]

    shard = let(pick(F.lit("")), lambda region: let(pick(region), pick))
    return F.substring(shard, 2, 10).cast("int")


def shard_by_tree(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, rows_per_bucket: int = 500) -> DataFrame:
    """Assign every row of ``docs(doc_id, text)`` a shard and a gapless slot in it.

    Slots number hash buckets of bounded size one after the other, so no task sorts
    a whole shard: the buckets' row counts are summed up first, from doc_id alone.
    """
    n_shards = len(tree)
    buckets = 1 + docs.count() // (rows_per_bucket * n_shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        descend(key, tree).alias("shard"),
        (descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        bucket.cast("long").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"),
        "grown_shard",
    )


def oracle(tree: list[Leaf], grown: list[Leaf], rows_per_bucket: int = 500) -> str:
    """DuckDB SQL for :func:`shard_by_tree`."""

    def choose(name: str, nodes: list[Leaf]) -> str:
        rows = ", ".join(f"('{p}', '{c}', {w})" for p, kids in children(nodes).items() for c, w in kids)
        draw = f"-ln((('0x' || substr(md5(child || '|' || key), 1, {DRAW_DIGITS}))::BIGINT + 1) / {float(16**DRAW_DIGITS + 1)!r}) / weight"
        out = f"{name}_n(parent, child, weight) AS (VALUES {rows}),\n{name}0 AS (SELECT k.key, '' AS node FROM k)"
        for i in range(3):
            out += f",\n{name}{i + 1} AS (SELECT key, arg_min(child, {draw}) AS node FROM {name}{i} JOIN {name}_n ON parent = node GROUP BY key)"
        return out

    return f"""
WITH k AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
{choose("a", tree)},
{choose("b", grown)},
c AS MATERIALIZED (SELECT list(t ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i))),
x AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
y AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM x, c),
d AS (SELECT doc_id, coalesce(strlen(y.text), 0)::BIGINT + 16 AS size, text_crc32, substr(a3.node, 2)::INT AS shard, substr(b3.node, 2)::INT AS grown_shard,
  ('0x' || substr(md5('slot|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % (SELECT 1 + count(*) // {rows_per_bucket * len(tree)} FROM documents) AS bucket
  FROM documents JOIN y ON y.text = coalesce(documents.text, '') JOIN a3 ON a3.key = coalesce(doc_id::VARCHAR, 'null') JOIN b3 ON b3.key = coalesce(doc_id::VARCHAR, 'null'))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM d"""
