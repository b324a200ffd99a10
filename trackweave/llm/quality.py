"""Quality rules by weak supervision.

Eight rules look at counts of each text and vote good (+1), bad (-1) or abstain
(0). Expectation-maximisation over the table of vote patterns (at most 3**8 rows
at any corpus size) estimates how often each rule is right about good and about
bad texts, and the share of good texts; a rule that votes alike on both weighs
nothing. The posterior probability of good decides instead of an all-must-pass filter.

Null and empty texts have no words, fail the base rules and are not kept. Columns
of the input that are not used are ignored, so clashing names do no harm; repeated
rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import NO_GAP, WORD_GAP, let, materialize

SYMBOLS = "#*$%&|<>"
MARKS = "!#$%&*+,./:;<=>?@_|~"


@dataclass(frozen=True)
class WeakSupervision:
    """Parameters of the label model."""

    iterations: int = 25
    first_good: float = 0.8
    first_bad: float = 0.6
    least_accuracy: float = 0.02
    most_accuracy: float = 0.98
    keep_from: float = 0.5
    window: int = 5


#: (name, votes bad when, votes good when), SQL that both engines read alike.
RULES = [
    ("length", "n_words < 20", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("marks", "4 * n_marks > n_words", "6 * n_marks <= n_words"),
    ("dup_lines", "5 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    ("repeats", "20 * n_repeat_words > n_words", "n_repeat_words = 0"),
    ("capitals", "3 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
    ("variety", "5 * n_distinct < n_words", "10 * n_distinct >= 4 * n_words OR n_words >= 2000"),
]


def _count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _covered(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more, each counted once."""

    def count(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: (x["h"] == F.get(ordered, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(ordered, i - 1)["h"])),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        begin = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            begin,
            lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(s - a["last"], F.lit(window))).alias("n")),
            lambda a: a["n"],
        )

    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    return let(F.sort_array(pairs), count)


def base_features(docs: DataFrame, window: int = 5) -> DataFrame:
    """Counts of every whole text: one row per row of ``docs``, narrow, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NO_GAP)))
    pieces = docs.select("doc_id", text.alias("text"), F.split(text, WORD_GAP).alias("pieces"), lines.alias("lines"))
    split = pieces.select("doc_id", "text", "lines", F.size("pieces").alias("pieces"), F.array_remove("pieces", "").alias("words"))
    spans = F.sequence(F.lit(0), F.size("words") - window)
    hashed = F.when(
        F.size("words") > window,
        F.transform(spans, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(window)])),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("pieces") + 1).cast("long").alias("word_chars"),  # one gap before each later piece
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("text"), MARKS).alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count_of(F.col("text"), "A-Z").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        hashed.alias("hashes"),
    )
    again = F.col("hashes").isNotNull() & (F.size(F.array_distinct("hashes")) < F.size("hashes"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_marks",
        "n_lines",
        "n_dup_lines",
        "n_capitals",
        "n_distinct",
        F.when(again, _covered(F.col("hashes"), window)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def votes(features: DataFrame) -> DataFrame:
    """Add one column ``v_<rule>`` per rule and the number ``pattern`` of all votes."""
    out = features
    for name, bad, good in RULES:
        out = out.withColumn(f"v_{name}", F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)))
    code = F.lit(0)
    for k, (name, _, _) in enumerate(RULES):
        code = code + (F.col(f"v_{name}") + 1) * 3**k
    return out.withColumn("pattern", code.cast("int"))


#: Texts that are never kept; the label model learns from the others.
BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def fit(voted: DataFrame, model: WeakSupervision) -> DataFrame:
    """Posterior of each vote pattern: (pattern, posterior, accuracies), <= 3**8 rows.

    All sums run in the order of ``pattern``, so the result is the same for any
    partitioning of the corpus.
    """
    m = len(RULES)
    tally = voted.groupBy("pattern").agg(F.count_if(~F.expr(BASE_FAILED)).cast("double").alias("n"))
    digits = [F.pmod(F.floor(F.col("pattern") / 3**k), F.lit(3)).cast("int") - 1 for k in range(m)]
    one = tally.select(F.struct("pattern", "n", F.array(*digits).alias("v")).alias("row"))
    one = one.agg(F.array_sort(F.collect_list("row")).alias("rows"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(model.least_accuracy)), F.lit(model.most_accuracy))
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r))

    def posterior(row: Column, state: Column) -> Column:
        # a vote weighs by how much likelier it is from a good text than from a bad one
        odds = F.aggregate(
            F.zip_with(row["v"], state["acc"], lambda v, a: F.when(v == 1, F.log(a["good"] / (1 - a["bad"]))).when(v == -1, F.log((1 - a["good"]) / a["bad"])).otherwise(0.0)),
            F.log(state["good"] / (1 - state["good"])),
            lambda total, x: total + x,
        )
        return 1 / (1 + F.exp(-odds))

    def step(state: Column, _: Column) -> Column:
        def accuracy(weighed: Column, k: Column, vote: int, first: float, weight: Callable[[Column], Column]) -> Column:
            right = total(weighed, lambda r: F.when(F.get(r["v"], k) == vote, weight(r)).otherwise(0.0))
            cast = total(weighed, lambda r: F.when(F.get(r["v"], k) != 0, weight(r)).otherwise(0.0))
            return clamp((first + right) / (1.0 + cast))

        def update(weighed: Column) -> Column:
            good = total(weighed, lambda r: r["n"] * r["w"]) / F.greatest(total(weighed, lambda r: r["n"]), F.lit(1.0))
            acc = F.transform(
                F.sequence(F.lit(0), F.lit(m - 1)),
                lambda k: F.struct(
                    accuracy(weighed, k, 1, model.first_good, lambda r: r["n"] * r["w"]).alias("good"),
                    accuracy(weighed, k, -1, model.first_bad, lambda r: r["n"] * (1 - r["w"])).alias("bad"),
                ),
            )
            return F.struct(F.least(F.greatest(good, F.lit(0.01)), F.lit(0.99)).alias("good"), acc.alias("acc"))

        weighed = F.transform(F.col("rows"), lambda r: F.struct(r["n"].alias("n"), r["v"].alias("v"), posterior(r, state).alias("w")))
        return let(weighed, update)

    first = F.struct(F.lit(model.first_good).alias("good"), F.lit(model.first_bad).alias("bad"))
    start = F.struct(F.lit(0.8).alias("good"), F.array(*[first] * m).alias("acc"))
    fitted = one.where(F.size("rows") > 0).select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(model.iterations)), start, step).alias("state"))
    each = fitted.select(F.explode("rows").alias("row"), "state")
    return each.select(F.col("row.pattern").alias("pattern"), posterior(F.col("row"), F.col("state")).alias("posterior"), F.col("state.acc").alias("accuracies"))


def quality_rules(docs: DataFrame, model: WeakSupervision | None = None) -> DataFrame:
    """Score every document of ``docs(doc_id, text)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality and the votes. The counts are written once to the
    shared folder, so that the texts are read once.
    """
    model = model or WeakSupervision()
    voted = materialize(votes(base_features(docs, model.window)), "quality")
    fitted = fit(voted, model).select("pattern", "posterior")
    failed = F.expr(BASE_FAILED)
    return voted.join(F.broadcast(fitted), "pattern").select(  # at most 3**8 rows
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= model.keep_from)).alias("kept"),
        F.round("posterior", 6).alias("quality"),
        *[f"v_{name}" for name, _, _ in RULES],
    )


def oracle(model: WeakSupervision | None = None) -> str:
    """DuckDB SQL for :func:`quality_rules`; the iterations are written out."""
    model = model or WeakSupervision()
    m = len(RULES)
    vote = ",\n".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{name}" for name, bad, good in RULES)
    code = " + ".join(f"(v_{name} + 1) * {3**k}" for k, (name, _, _) in enumerate(RULES))
    names = [f"v_{name}" for name, _, _ in RULES]
    parts = [f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS l FROM d),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
  SELECT doc_id, unnest(range(1, len(w) - {model.window - 2})) AS p, unnest(list_transform(range(1, len(w) - {model.window - 2}), lambda i: list_slice(w, i, i + {model.window - 1}))) AS gram FROM s)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {model.window})) AS q FROM g WHERE n > 1) GROUP BY 1),
f AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(text, '[^{MARKS}]+', '', 'g'))::BIGINT AS n_marks, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
  len(list_distinct(w))::BIGINT AS n_distinct, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN r USING (doc_id)),
v AS (SELECT *, ({code})::INT AS pattern FROM (SELECT *, {vote} FROM f)),
t AS MATERIALIZED (SELECT pattern, {", ".join(names)}, (count(*) FILTER (NOT {BASE_FAILED}))::DOUBLE AS n FROM v GROUP BY ALL),
p0 AS (SELECT 0.8::DOUBLE AS good, {", ".join(f"{model.first_good}::DOUBLE AS g{k}, {model.first_bad}::DOUBLE AS b{k}" for k in range(m))})"""]

    def odds(p: str) -> str:
        vote = [f"CASE {x} WHEN 1 THEN ln({p}.g{k} / (1 - {p}.b{k})) WHEN -1 THEN ln((1 - {p}.g{k}) / {p}.b{k}) ELSE 0 END" for k, x in enumerate(names)]
        return f"ln({p}.good / (1 - {p}.good)) + " + " + ".join(vote)

    def accuracy(x: str, vote: int, first: float, weight: str) -> str:
        ratio = f"({first} + sum(CASE WHEN {x} = {vote} THEN {weight} ELSE 0 END)) / (1 + sum(CASE WHEN {x} <> 0 THEN {weight} ELSE 0 END))"
        return f"least(greatest({ratio}, {model.least_accuracy}), {model.most_accuracy})"

    for i in range(model.iterations):
        acc = ", ".join(f"{accuracy(x, 1, model.first_good, 'n * w')} AS g{k}, {accuracy(x, -1, model.first_bad, 'n * (1 - w)')} AS b{k}" for k, x in enumerate(names))
        parts.append(f"e{i} AS MATERIALIZED (SELECT t.*, 1 / (1 + exp(-({odds(f'p{i}')}))) AS w FROM t, p{i})")
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT least(greatest(sum(n * w) / greatest(sum(n), 1), 0.01), 0.99) AS good, {acc} FROM e{i})")
    last = f"p{model.iterations}"
    parts.append(f"z AS MATERIALIZED (SELECT t.pattern, 1 / (1 + exp(-({odds(last)}))) AS posterior FROM t, {last})")
    return (
        ",\n".join(parts)
        + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  (NOT failed AND posterior >= {model.keep_from}) AS kept, round(posterior, 6) AS quality, {", ".join(names)}
FROM (SELECT *, {BASE_FAILED} AS failed FROM v) JOIN z USING (pattern)"""
    )
