"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent, which is searched so that no
source is repeated more than ``repeats`` times (or so that the mix reaches a share of
the greatest entropy). The budget is the least with which every document is used at
least once. Weights times budget give each source a token budget, which is realised in
passes: in each pass the source's documents lie in hash blocks, the blocks are
permuted, and the last pass ends where the budget does (inside one block, by document).

A null source counts as the empty name; null texts have no tokens. Sources without
tokens are used once. Repeated rows are rows of their own (ties are broken by all
columns, so equal rows may stand for each other). Very long texts may leave a budget
unfilled by less than their own length. An empty table gives an empty result.

Only sums over the table of sources reach the driver. Blocks are capped in number by
making them larger, so that the windows over them stay small at any size of corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, words
from trackweave.llm.graphs import salted_join


@dataclass(frozen=True)
class Mixing:
    repeats: float = 2.0
    entropy: float | None = None  # share of ln(number of sources); if set, it is the target
    budget: int | None = None  # tokens of the whole mix; else as few as use every document once
    block_tokens: int = 50_000
    most_blocks: int = 65_536
    grid: int = 16
    rounds: int = 5
    seed: str = "mix"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _number(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long")


def exponent(sources: DataFrame, model: Mixing) -> float:
    """The least exponent in [0, 1] that keeps the repetition limit, or the greatest that reaches the entropy.

    Each round splits the interval into ``grid`` parts; one aggregate over
    sources(tokens) judges all of them.
    """
    low, high = 0.0, 1.0
    for _ in range(model.rounds):
        tries = [low + (high - low) * k / model.grid for k in range(model.grid + 1)]
        power = [F.pow(F.col("tokens") / F.col("total"), F.lit(a)) for a in tries]
        if model.entropy is None:
            # tokens used per token there is, over the least such ratio
            ratio = [p / F.col("tokens") for p in power]
            found = [F.max(r) / F.min(r) <= model.repeats for r in ratio]
        else:
            found = [F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p) < model.entropy * F.log(F.count(F.lit(1))) for p in power]
        row = sources.where("tokens > 0").agg(*[x.alias(f"t{k}") for k, x in enumerate(found)]).first()
        first = next((k for k in range(model.grid + 1) if row[k]), model.grid)
        low, high = tries[max(0, first - 1)], tries[first]
    return high if model.entropy is None else low


def mix(docs: DataFrame, model: Mixing | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each use of a row of docs(doc_id, text, source), with its columns ``carry``.

    Returns doc_id, source, n_tokens, weight (of the source in the mix), epoch (pass),
    block, block_rank (its place in the pass) and order_key, by which sorting
    interleaves the sources.
    """
    model = model or Mixing()
    name = F.coalesce("source", F.lit(""))
    # rows without doc_id are dealt by their text
    lost = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("lost"))
    meta = docs.select("doc_id", name.alias("source"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"), lost.alias("lost"), *carry)
    meta = materialize(meta, "mixing")
    counted = meta.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    counted = materialize(counted.withColumn("total", F.lit(total).cast("long")), "mixing-sources")
    alpha = exponent(counted, model)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(alpha))).otherwise(0.0)
    shared = counted.withColumn("power", share)
    sums = shared.where("tokens > 0").agg(F.sum("power").alias("s"), F.min(F.col("power") / F.col("tokens")).alias("least")).first()
    norm, least = (sums.s or 1.0), (sums.least or 1.0)
    sources = shared.select(
        "source",
        "tokens",
        F.round(F.col("power") / norm, 9).alias("weight"),
        # without a budget, the source used least, by its tokens, is used once
        F.when(F.col("tokens") > 0, F.round(F.col("power") * F.lit(model.budget / norm) if model.budget else F.col("power") / F.lit(least)).cast("long")).otherwise(0).alias("budget"),
        F.greatest(F.lit(1), F.least(F.lit(model.most_blocks), F.ceil(F.col("tokens") / model.block_tokens))).cast("long").alias("blocks"),
    ).select(
        "*",
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long").alias("full"),
    )
    sources = sources.withColumn("rest", F.greatest(F.col("budget") - F.col("full") * F.col("tokens"), F.lit(0)))
    seed = F.lit(model.seed)
    dealt = salted_join(meta, sources.select("source", "blocks"), "source")
    dealt = dealt.withColumn("block", F.pmod(_number(_hash(seed, key)), F.col("blocks"))).drop("blocks")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    passes = blocks.join(sources, "source").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch"))
    passes = passes.where((F.col("epoch") < F.col("full")) | (F.col("rest") > 0))
    order = Window.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("source"), F.col("epoch").cast("string"), F.col("block").cast("string")), "block")
    ranked = passes.select(
        "*",
        (F.row_number().over(order) - 1).cast("long").alias("block_rank"),
        F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("until"),
    )
    last = F.col("epoch") == F.col("full")
    begin = F.col("until") - F.col("block_tokens")
    fits = ~last | (F.col("until") <= F.col("rest"))
    rank_key = F.round((F.col("epoch") + F.col("block_rank") / F.col("blocks")) / F.greatest(F.lit(1.0), F.col("budget") / F.greatest("tokens", F.lit(1))), 9)
    plan = ranked.where(fits | (begin < F.col("rest"))).select(
        "source",
        "block",
        F.struct("epoch", "block_rank", "weight", rank_key.alias("order_key"), F.when(~fits, F.col("rest") - begin).alias("room")).alias("use"),
    )
    plan = plan.groupBy("source", "block").agg(F.sort_array(F.collect_list("use")).alias("uses"))  # at most repeats + 1 in each
    used = salted_join(dealt, plan, ["source", "block"]).select("doc_id", "lost", "source", "n_tokens", *carry, "block", F.explode("uses").alias("use"))
    used = used.select("doc_id", "lost", "source", "n_tokens", *carry, "block", "use.*")
    # the one block of each source in which its budget ends
    by_doc = Window.partitionBy("source", "block").orderBy(_hash(seed, key, F.lit("last")), "doc_id", "n_tokens", *carry)
    partial = used.where("room IS NOT NULL").withColumn("upto", F.sum("n_tokens").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    columns = ["doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_rank", "order_key", *carry]
    return used.where("room IS NULL").select(*columns).unionByName(partial.where("upto <= room").select(*columns))


def oracle(model: Mixing | None = None) -> str:
    """DuckDB SQL for :func:`mix` with a repetition limit."""
    model = model or Mixing()
    n = model.grid
    steps = [f"""
WITH m AS MATERIALIZED (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))) AS key, coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
c AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens, (SELECT sum(n_tokens) FROM m)::BIGINT AS total FROM m GROUP BY 1),
r0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"""]
    for i in range(model.rounds):
        steps.append(f"""g{i} AS (SELECT k, lo + (hi - lo) * k / {n} AS a FROM r{i}, range({n + 1}) t(k)),
h{i} AS (SELECT coalesce(min(k), {n}) AS k FROM (SELECT k, a FROM g{i}, c WHERE tokens > 0 GROUP BY k, a
  HAVING max(pow(tokens / total, a) / tokens) / min(pow(tokens / total, a) / tokens) <= {model.repeats})),
r{i + 1} AS MATERIALIZED (SELECT (SELECT a FROM g{i} WHERE g{i}.k = greatest(0, h{i}.k - 1)) AS lo, (SELECT a FROM g{i} WHERE g{i}.k = h{i}.k) AS hi FROM h{i})""")
    return (
        ",\n".join(steps)
        + f""",
p AS (SELECT c.*, CASE WHEN tokens > 0 THEN pow(tokens / total, hi) ELSE 0 END AS power FROM c, r{model.rounds}),
z AS (SELECT sum(power) AS s, min(power / tokens) AS least FROM p WHERE tokens > 0),
s AS (SELECT source, tokens, round(power / s, 9) AS weight, CASE WHEN tokens > 0 THEN round(power / least)::BIGINT ELSE 0 END AS budget,
  greatest(1, least({model.most_blocks}, ceil(tokens / {model.block_tokens})))::BIGINT AS blocks FROM p, z),
t AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs FROM s),
u AS (SELECT *, greatest(budget - epochs * tokens, 0) AS rest FROM t),
d AS (SELECT m.*, ('0x' || substr(md5('{model.seed}|' || key), 1, 12))::BIGINT % blocks AS block FROM m JOIN u USING (source)),
b AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM d GROUP BY ALL),
e AS (SELECT * FROM (SELECT b.*, u.* EXCLUDE (source), unnest(range(0, epochs + 1)) AS epoch FROM b JOIN u USING (source)) WHERE epoch < epochs OR rest > 0),
k AS (SELECT *, row_number() OVER w - 1 AS block_rank, sum(block_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS until FROM e
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('{model.seed}|' || source || '|' || epoch || '|' || block), block)),
q AS (SELECT *, round((epoch + block_rank / blocks) / greatest(1.0, budget / greatest(tokens, 1)), 9) AS order_key,
  CASE WHEN epoch = epochs AND until > rest THEN rest - (until - block_tokens) END AS room FROM k),
f AS (SELECT d.doc_id, d.source, d.n_tokens, weight, epoch, d.block, block_rank, order_key, room,
  sum(d.n_tokens) OVER (PARTITION BY d.source, d.block, epoch ORDER BY md5('{model.seed}|' || key || '|last'), doc_id, d.n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON q.source = d.source AND q.block = d.block WHERE room IS NULL OR room > 0)
SELECT doc_id, source, n_tokens, weight, epoch, block, block_rank, order_key FROM f WHERE room IS NULL OR upto <= room"""
    )
