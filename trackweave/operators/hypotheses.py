"""A graph of hypotheses to be put together and asked, node by node, over two tables.

For hand-made graphs; large ones come from :func:`candidates.arcs` as tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

NODES = "node long, timestep int, traxels array<struct<timestep:int,id:bigint>>"
ARCS = "arc long, src long, dst long"


@dataclass(frozen=True)
class HypothesesGraph:
    """nodes(node, timestep, traxels) and arcs(arc, src, dst); every change makes a new graph."""

    nodes: DataFrame
    arcs: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> HypothesesGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], ARCS))

    def _after(self, rows: DataFrame, key: str) -> int:
        last = rows.agg(F.max(key)).first()[0]
        return 0 if last is None else last + 1

    def add_node(self, timesteps: int | list[int], traxels: list[tuple[int, int]] | None = None) -> tuple[HypothesesGraph, int]:
        """The graph with one more node, and its name. Of several frames the last one is the node's."""
        frames = [timesteps] if isinstance(timesteps, int) else list(timesteps)
        if not frames:
            raise ValueError("a node lies in a frame")
        name = self._after(self.nodes, "node")
        held = traxels if traxels is not None else [(t, None) for t in frames]
        row = self.nodes.sparkSession.createDataFrame([(name, frames[-1], held)], NODES)
        return HypothesesGraph(self.nodes.unionByName(row), self.arcs), name

    def add_arc(self, src: int, dst: int) -> tuple[HypothesesGraph, int]:
        if not (self.valid(src) and self.valid(dst)):
            raise KeyError("no such node")
        name = self._after(self.arcs, "arc")
        row = self.arcs.sparkSession.createDataFrame([(name, src, dst)], ARCS)
        return HypothesesGraph(self.nodes, self.arcs.unionByName(row)), name

    def erase_node(self, node: int) -> HypothesesGraph:
        """Without a node and its arcs."""
        return HypothesesGraph(self.nodes.where(F.col("node") != node), self.arcs.where((F.col("src") != node) & (F.col("dst") != node)))

    def erase_arc(self, arc: int) -> HypothesesGraph:
        return HypothesesGraph(self.nodes, self.arcs.where(F.col("arc") != arc))

    def change_end(self, arc: int, end: str, node: int) -> HypothesesGraph:
        """Let an arc's ``end`` (src or dst) be another node."""
        if end not in ("src", "dst"):
            raise ValueError("an end is src or dst")
        self._arc(arc)
        if not self.valid(node):
            raise KeyError("no such node")
        moved = F.when(F.col("arc") == arc, F.lit(node).cast("long")).otherwise(F.col(end))
        return HypothesesGraph(self.nodes, self.arcs.withColumn(end, moved))

    def valid(self, node: int) -> bool:
        return not self.nodes.where(F.col("node") == node).isEmpty()

    def _arc(self, arc: int) -> Row:
        found = self.arcs.where(F.col("arc") == arc).first()
        if found is None:
            raise KeyError("no such arc")
        return found

    def source(self, arc: int) -> int:
        return self._arc(arc).src

    def target(self, arc: int) -> int:
        return self._arc(arc).dst

    def opposite(self, node: int, arc: int) -> int:
        found = self._arc(arc)
        if node not in (found.src, found.dst):
            raise ValueError("the arc has no such end")
        return found.dst if node == found.src else found.src

    def out_arcs(self, node: int) -> DataFrame:
        return self.arcs.where(F.col("src") == node)

    def in_arcs(self, node: int) -> DataFrame:
        return self.arcs.where(F.col("dst") == node)

    def count_nodes(self) -> int:
        return self.nodes.count()

    def count_arcs(self) -> int:
        return self.arcs.count()

    def at(self, timestep: int) -> DataFrame:
        return self.nodes.where(F.col("timestep") == timestep)

    def timesteps(self) -> tuple[int | None, int | None]:
        """The earliest and the latest frame."""
        return tuple(self.nodes.agg(F.min("timestep"), F.max("timestep")).first())
