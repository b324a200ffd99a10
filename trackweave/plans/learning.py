"""Weights of the chaingraph model from a labelled graph: a structured support vector machine.

The energy of a labelling is the product of six weights (see operators.loglinear) and
its features. Training looks for small weights with which the true labelling is cheaper
than any other by at least the number of variables in which they differ. Each round
finds the labelling that violates this most, by the exact solver with the loss built
into the costs, and adds it to the constraints of a small quadratic problem. The tables
stay in Spark; the driver holds six numbers for each round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import graph
from trackweave.operators.loglinear import WEIGHTS
from trackweave.plans import chaingraph
from trackweave.plans.trackers import ChaingraphTracker

MOVE, APPEARANCE, DISAPPEARANCE, DIVISION, DETECTION, OPPORTUNITY = range(len(WEIGHTS))


@dataclass(frozen=True)
class Training:
    penalty: float = 10.0  # of each unit of violation
    rounds: int = 30
    tolerance: float = 1e-3


def features(costs: DataFrame, moves: DataFrame, pairs: DataFrame, active: DataFrame, used: DataFrame) -> np.ndarray:
    """The features of a labelling, in the order of the weights.

    costs, moves and pairs are those of ``ChaingraphTracker.energies``; active(node) and
    used(src, dst) are what is on.
    """
    out = used.join(moves, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.sum("move").alias("move"), F.min("dst").alias("d1"), F.max("dst").alias("d2"))
    into = used.select(F.col("dst").alias("node")).distinct().withColumn("fed", F.lit(True))
    rows = costs.join(active.select("node").distinct().withColumn("on", F.lit(True)), "node", "left").join(out, "node", "left").join(into, "node", "left")
    rows = rows.join(pairs.withColumnRenamed("src", "node"), ["node", "d1", "d2"], "left")
    on, o = F.col("on").isNotNull(), F.coalesce("o", F.lit(0))
    parts = [
        F.when(o == 1, F.col("move")),
        F.when(on & F.col("fed").isNull(), F.col("app")),
        F.when(on & (o == 0), F.col("dis")),
        F.when(o == 2, F.col("division")),
        F.when(on, F.col("det")).otherwise(F.col("non")),
        F.when(~on, F.col("opp")),
    ]
    return np.array(rows.agg(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in parts]).first(), float)


def weighted(costs: DataFrame, moves: DataFrame, pairs: DataFrame, w: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model's tables with its costs times the weights."""
    by = {"det": DETECTION, "non": DETECTION, "app": APPEARANCE, "dis": DISAPPEARANCE, "opp": OPPORTUNITY}
    costs = costs.withColumns({c: F.col(c) * float(w[k]) for c, k in by.items()})
    return costs, moves.withColumn("move", F.col("move") * float(w[MOVE])), pairs.withColumn("division", F.col("division") * float(w[DIVISION]))


def augmented(costs: DataFrame, moves: DataFrame, pairs: DataFrame, active: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with the loss taken off: one less for each variable that is wrong, up to a constant."""
    on = active.select("node").distinct().withColumn("_on", F.lit(True))
    costs = costs.join(on, "node", "left").withColumns({"non": F.col("non") - F.when(F.col("_on"), 1.0).otherwise(0.0), "det": F.col("det") - F.when(F.col("_on"), 0.0).otherwise(1.0)}).drop("_on")
    true = used.select("src", "dst").distinct().withColumn("_used", F.lit(True))
    # to leave a true arc out counts one, here as one more for using it
    change = F.when(F.col("_used"), 1.0).otherwise(-1.0)
    moved = moves.join(true, ["src", "dst"], "left").withColumn("_change", change).drop("_used")
    both = pairs
    for end in ("d1", "d2"):
        both = both.join(moved.select("src", F.col("dst").alias(end), F.col("_change").alias(f"_{end}")), ["src", end])
    both = both.withColumn("division", F.col("division") + F.col("_d1") + F.col("_d2")).select(*pairs.columns)
    return costs, moved.withColumn("move", F.col("move") + F.col("_change")).drop("_change"), both


def infer(tables: tuple[DataFrame, DataFrame, DataFrame], of: DataFrame, options: ChaingraphTracker) -> tuple[DataFrame, DataFrame]:
    """What is on in the best labelling: active(node) and used(src, dst); ``of`` has the components."""
    costs, moves, pairs = tables
    mine = of.withColumnRenamed("node", "src")
    labels, used = chaingraph.infer(costs.join(of, "node"), moves.join(mine, "src"), pairs.join(mine, "src"), options)
    return graph.cut_lineage(labels.where("active").select("node"), "active"), graph.cut_lineage(used.where("active").select("src", "dst"), "used")


def hamming(active: DataFrame, used: DataFrame, true_active: DataFrame, true_used: DataFrame) -> int:
    """In how many variables two labellings differ."""
    apart = lambda a, b, key: a.select(*key).join(b.select(*key), key, "left_anti").count() + b.select(*key).join(a.select(*key), key, "left_anti").count()
    return apart(active, true_active, ["node"]) + apart(used, true_used, ["src", "dst"])


def smallest_weights(apart: np.ndarray, loss: np.ndarray, penalty: float, rounds: int = 2000) -> np.ndarray:
    """The weights of least norm and penalty with w . apart >= loss, by the dual problem."""
    share = np.zeros(len(loss) + 1)  # the last one takes what is not used
    share[-1] = penalty
    rows, gain = np.vstack([apart, np.zeros(apart.shape[1])]), np.append(loss, 0.0)
    for _ in range(rounds):
        w = share @ rows
        slope = gain - rows @ w
        up, low = int(np.argmax(slope)), int(np.argmin(np.where(share > 0, slope, np.inf)))
        step = rows[up] - rows[low]
        if slope[up] - slope[low] < 1e-9:
            break
        length = float(step @ step)
        move = min(share[low], (slope[up] - slope[low]) / length if length else share[low])
        share[up] += move
        share[low] -= move
    return share @ rows


def train(tracker: ChaingraphTracker, nodes: DataFrame, arcs: DataFrame, true_active: DataFrame, true_used: DataFrame, training: Training | None = None) -> tuple[dict[str, float], int]:
    """(weights by name, rounds) from a built graph and what is on in truth: true_active(node), true_used(src, dst).

    Weights that do not settle in ``training.rounds`` rounds are an error.
    """
    training = training or Training()
    plain = tuple(graph.cut_lineage(x, "training") for x in tracker.energies(nodes, arcs))
    of = graph.cut_lineage(graph.components(plain[0].select("node"), plain[1]), "components")
    truth = features(*plain, true_active, true_used)
    w = np.zeros(len(WEIGHTS))
    apart, loss = np.empty((0, len(WEIGHTS))), np.empty(0)
    for done in range(training.rounds):
        active, used = infer(augmented(*weighted(*plain, w), true_active, true_used), of, tracker)
        found, wrong = features(*plain, active, used) - truth, hamming(active, used, true_active, true_used)
        slack = max([0.0, *(loss - apart @ w)])
        if wrong - found @ w <= slack + training.tolerance:
            return dict(zip(WEIGHTS, w.tolist(), strict=True)), done
        apart, loss = np.vstack([apart, found]), np.append(loss, wrong)
        w = smallest_weights(apart, loss, training.penalty)
    raise RuntimeError(f"weights did not settle in {training.rounds} rounds")
