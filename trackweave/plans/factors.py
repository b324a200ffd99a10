"""Models as explicit tables: variables, and factors with a row for every entry.

variables(var, kind, states), entries(factor, kind, vars, at, value[, weight, feature]):
``at`` is the state of each of ``vars``. An entry's value may be a
weight times a feature, which makes the model log-linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.loglinear import WEIGHTS

MOVE, APPEARANCE, DISAPPEARANCE, DIVISION, DETECTION, OPPORTUNITY = WEIGHTS
ENTRY = ["factor", "kind", "vars", "at", "value", "weight", "feature"]


def node_var(node: Column) -> Column:
    return F.concat(F.lit("n"), node.cast("string"))


def arc_var(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("a"), src.cast("string"), F.lit("-"), dst.cast("string"))


def states(rows: DataFrame, n: Column, base: int = 2) -> DataFrame:
    """A row for each of base^n states ``at`` of n variables; the first one changes fastest."""
    counted = rows.withColumn("_code", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(base), n).cast("long") - 1)))
    digit = lambda k: (F.floor(F.col("_code") / F.pow(F.lit(base), k)) % base).cast("int")
    return counted.withColumn("at", F.transform(F.sequence(F.lit(0), n - 1), digit)).drop("_code")


def chaingraph_tables(costs: DataFrame, moves: DataFrame, pairs: DataFrame, forbidden: float, divisions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Variables and entries of nodes(node, det, non, app, dis, opp), moves(src, dst, move) and pairs(src, d1, d2, division).

    Three factors a node: detection, outgoing and incoming (the node, then its arcs by
    their other ends). States that no labelling may have hold ``forbidden`` and no weight.
    A node's table has 2^arcs entries.
    """
    arcs = moves.select("src", "dst", "move", arc_var(F.col("src"), F.col("dst")).alias("var"))
    variables = costs.select(node_var(F.col("node")).alias("var"), F.lit("node").alias("kind"), F.lit(2).alias("states"))
    variables = variables.unionByName(arcs.select("var", F.lit("arc").alias("kind"), F.lit(2).alias("states")))
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "var", "move"))).alias("out"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct("src", "var"))).alias("into"))
    two = pairs.groupBy(F.col("src").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "d1", "d2"), "division"))).alias("two"))
    rows = costs.join(out.hint("merge"), "node", "left").join(into.hint("merge"), "node", "left").join(two.hint("merge"), "node", "left")
    rows = rows.withColumns({"out": F.coalesce("out", F.array().cast(out.schema["out"].dataType)), "into": F.coalesce("into", F.array().cast(into.schema["into"].dataType))})
    me = node_var(F.col("node"))
    factor = lambda kind: F.concat(F.lit(kind + ":"), F.col("node").cast("string"))
    none = F.lit(None).cast("string")

    def entries(kind: str, filled: DataFrame, weight: Column, feature: Column) -> DataFrame:
        weighted = F.when(feature.isNull(), F.lit(float(forbidden))).otherwise(feature)
        return filled.select(factor(kind).alias("factor"), F.lit(kind).alias("kind"), "vars", "at", weighted.alias("value"), weight.alias("weight"), feature.alias("feature"))

    det = states(rows.withColumn("vars", F.array(me)), F.lit(1))
    on = F.get("at", F.lit(0))
    # a detection that is left out weighs on the same parameter as one that is there
    detection = entries("detection", det, F.lit(DETECTION), F.when(on == 1, F.col("det")).otherwise(F.col("non")))

    going = rows.withColumn("vars", F.concat(F.array(me), F.transform("out", lambda a: a["var"])))
    going = states(going, F.size("vars"))
    chosen = F.filter(F.transform("out", lambda a, i: F.struct(F.get("at", i + 1).alias("s"), a["dst"].alias("dst"), a["move"].alias("move"))), lambda x: x["s"] == 1)
    going = going.withColumn("chosen", chosen)
    n = F.size("chosen")
    key = F.array_join(F.transform("chosen", lambda x: x["dst"].cast("string")), "-")
    off = F.when((on == 0) & (n == 0), F.lit(OPPORTUNITY)).when((on == 1) & (n == 0), F.lit(DISAPPEARANCE))
    kinds = off.when((on == 1) & (n == 1), F.lit(MOVE)).when((on == 1) & (n == 2) & F.lit(divisions), F.lit(DIVISION)).otherwise(none)
    value = F.when(kinds == OPPORTUNITY, F.col("opp")).when(kinds == DISAPPEARANCE, F.col("dis")).when(kinds == MOVE, F.get("chosen", F.lit(0))["move"]).when(kinds == DIVISION, F.element_at("two", key))
    outgoing = entries("outgoing", going, kinds, value)

    coming = rows.withColumn("vars", F.concat(F.array(me), F.transform("into", lambda a: a["var"])))
    coming = states(coming, F.size("vars"))
    fed = F.aggregate(F.slice("at", F.lit(2), F.size("into")), F.lit(0), lambda s, x: s + x)
    alone = (on == 1) & (fed == 0)
    fine = ((on == 0) & (fed == 0)) | ((on == 1) & (fed == 1))
    incoming = entries("incoming", coming, F.when(alone, F.lit(APPEARANCE)).otherwise(none), F.when(alone, F.col("app")).when(fine, F.lit(0.0)))
    return variables, detection.unionByName(outgoing).unionByName(incoming)


def conservation_tables(costs: DataFrame, flows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The single-variable tables of conservation tracking: nodes(node, e), flows(src, dst, e)."""
    several = F.lit(most + 1)
    nodes = costs.select(node_var(F.col("node")).alias("var"), F.lit("node").alias("kind"), several.alias("states"), "e")
    arcs = flows.select(arc_var(F.col("src"), F.col("dst")).alias("var"), F.lit("arc").alias("kind"), several.alias("states"), "e")
    both = nodes.unionByName(arcs)
    rows = both.select(F.col("var").alias("factor"), "kind", F.array("var").alias("vars"), F.posexplode("e").alias("s", "value"))
    return both.drop("e"), rows.select("factor", "kind", "vars", F.array("s").alias("at"), "value", F.lit(None).cast("string").alias("weight"), F.lit(None).cast("double").alias("feature"))


def factor(variables: list[int], sizes: list[int], default: float = 0.0) -> dict[tuple[int, ...], float]:
    """A table of ``default`` for every state of variables in rising order."""
    if len(variables) != len(sizes):
        raise ValueError("a size for each variable")
    if any(a >= b for a, b in zip(variables, variables[1:], strict=False)):
        raise ValueError("variables must rise")
    table: dict[tuple[int, ...], float] = {(): default}
    for n in sizes:
        table = {(*at, s): default for at in table for s in range(n)}
    return table


def reordered(at: Column, given: Column, wanted: Column) -> Column:
    """States ``at`` of variables ``given`` in the order of ``wanted``; other variables are an error."""
    bad = (F.size(given) != F.size(wanted)) | (F.size(at) != F.size(given)) | (F.sort_array(given) != F.sort_array(wanted))
    moved = F.transform(wanted, lambda v: F.get(at, F.array_position(given, v).cast("int") - 1))
    return F.when(bad, F.raise_error(F.lit("other variables than the factor's"))).otherwise(moved)


def set_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with the values of changes(factor, vars, at, value); ``vars`` may come in any order.

    A change to a factor or a state that is not there is an error.
    """
    known = entries.groupBy("factor").agg(F.first("vars").alias("wanted"))
    placed = changes.join(known, "factor", "left")
    missing = F.raise_error(F.lit("no such factor")).cast("array<int>")
    at = F.when(F.col("wanted").isNull(), missing).otherwise(reordered(F.col("at"), F.col("vars"), F.col("wanted")))
    new = placed.select("factor", at.alias("at"), F.col("value").alias("_new"), F.lit(True).alias("_set"))
    both = entries.withColumn("_here", F.lit(True)).join(new, ["factor", "at"], "full")
    checked = F.when(F.col("_here").isNull(), F.raise_error(F.lit("no such entry")).cast("double")).when(F.col("_set"), F.col("_new")).otherwise(F.col("value"))
    return both.withColumn("value", checked).select(*entries.columns)


def get_entry(entries: DataFrame, factor: str, vars_: list[str], at: list[int]) -> float:
    """The value of one state; ``vars_`` may come in any order."""
    rows = entries.where(F.col("factor") == factor)
    wanted = reordered(F.array(*map(F.lit, at)), F.array(*map(F.lit, vars_)), F.col("vars"))
    found = rows.where(F.col("at") == wanted).select("value").first()
    if found is None:
        raise KeyError(f"no entry {at} of factor {factor}")
    return found.value


def weighted(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries whose value is weights(weight, w) times feature; those without a weight stay as they are."""
    known = entries.join(weights, "weight", "left")
    missing = F.col("weight").isNotNull() & F.col("w").isNull()
    value = F.when(missing, F.raise_error(F.lit("a feature without a weight")).cast("double")).when(F.col("weight").isNotNull(), F.col("w") * F.col("feature")).otherwise(F.col("value"))
    return known.withColumn("value", value).select(*entries.columns)


def energy(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(energy) of labels(var, state): the sum of each factor's entry at its variables' states."""
    each = entries.groupBy("factor").agg(F.first("vars").alias("vars")).select("factor", F.posexplode("vars").alias("place", "var"))
    state = each.join(labels, "var", "left")
    known = F.when(F.col("state").isNull(), F.raise_error(F.lit("a variable without a label")).cast("int")).otherwise(F.col("state"))
    at = state.groupBy("factor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", known.alias("s")))), lambda x: x["s"]).alias("at"))
    return entries.join(at, ["factor", "at"]).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("energy"))


def feature_sums(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(weight, total): the features of a labelling, summed by weight; weights without any have 0."""
    at = entries.groupBy("factor").agg(F.first("vars").alias("vars")).select("factor", F.posexplode("vars").alias("place", "var")).join(labels, "var")
    at = at.groupBy("factor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "state"))), lambda x: x["state"]).alias("at"))
    hit = entries.join(at, ["factor", "at"]).where("weight IS NOT NULL").groupBy("weight").agg(F.sum("feature").alias("t"))
    every = entries.sparkSession.createDataFrame([(w,) for w in WEIGHTS], "weight string")
    return every.join(hit, "weight", "left").select("weight", F.coalesce("t", F.lit(0.0)).alias("total"))
