"""How quality filters overlap: what each removes first, again, alone, and of the good.

Five filters judge every whole text; a document's failures are a set of letters:

A: under ``least_words`` words; B: few distinct words; C: many capitals ``A-Z``;
D: any of ``symbols``; E: the same text as a row with a smaller doc_id, table-wide.

Words are exploded and aggregated by (row, word), then by row, for totals and distinct
words; the other failures are joined to them, and 32 conditional counts a part (one for
each set of failures) give the figures of all orders of the filters.

Null and empty texts have no words; they fail A and no other, but E as copies of each
other. Rows without doc_id are never copies, and nothing is a copy of them. Repeated rows
count once each; they are no copies of each other, as none has a smaller id. Parts are
the values of ``lang``, null as the empty string. Labels may hold an id several times:
one row with the label is enough. Other columns are ignored, so clashing names do no
harm. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, words
from trackweave.llm.graphs import salted_join

LETTERS = "ABCDE"
SETS = range(1 << len(LETTERS))
ORDERS = ["".join(p) for p in permutations(LETTERS)]


@dataclass(frozen=True)
class AuditedFilters:
    """Limits of the filters; B and C are per cent."""

    least_words: int = 200
    least_distinct: int = 50
    most_capitals: int = 3
    symbols: str = "#$%&*|"


def word_totals(texts: DataFrame) -> DataFrame:
    """(k, h, n_words, n_distinct) of each key of texts(k, h, text).

    Rows that share a key have one text. Texts are dealt by key once; both aggregates keep
    to that. An empty string stands for each row, so that sums can be divided by the rows.
    """
    dealt = texts.repartition("k", "h")
    exploded = dealt.select("k", "h", F.explode(F.array_append(words(F.col("text")), "")).alias("word"))
    of_word = exploded.groupBy("k", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    row = F.col("word") == ""
    summed = of_word.groupBy("k", "h").agg(F.sum(F.when(~row, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(row, F.col("n"))).alias("rows"), F.count_if(~row).alias("n_distinct"))
    return summed.select("k", "h", F.expr("n div rows").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, model: AuditedFilters | None = None) -> DataFrame:
    """(doc_id, part, failed) of every row of docs(doc_id, text, lang); bit i of ``failed`` is letter i."""
    m = model or AuditedFilters()
    # totals depend on the text alone, so a null id may share the key of another row with this text
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "h": F.xxhash64("text")})
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = base.select(
        *["doc_id", "part", "k", "h", F.sha2("text", 256).alias("name")],
        (100 * capitals > m.most_capitals * F.length("text")).alias("c"),
        F.rlike("text", F.lit("[" + "".join("\\" + s for s in m.symbols) + "]")).alias("d"),
    )
    flags = materialize(flags, "audit")
    ids = flags.where("doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    found = salted_join(flags, ids.where("last > first").select("name", "first"), "name", "left")
    found = found.join(word_totals(base.select("k", "h", "text")), ["k", "h"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = [n < m.least_words, 100 * distinct < m.least_distinct * n, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return found.select("doc_id", "part", "h", bits.alias("failed"))


def failure_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: arrays n, good and toxic of 32 counts each, by set of failures."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id are dealt by their text; they meet no label
    spread = failed.withColumn("z", F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(0))
    marked = spread.join(known.withColumn("z", F.lit(0).cast("long")), ["doc_id", "z"], "left")
    sums = [F.count_if((F.col("failed") == s) & extra).alias(f"{name}{s}") for name, extra in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for s in SETS]
    counted = marked.groupBy("part").agg(*sums)
    return counted.select("part", *[F.array(*[f"{name}{s}" for s in SETS]).alias(name) for name in ("n", "good", "toxic")])


def _total(counts: str, fits: Column) -> Column:
    """The sum over sets of failures of ``counts``, where the array ``fits`` says so."""
    return F.aggregate(F.zip_with(counts, fits, lambda n, f: F.when(f, n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def filter_audit(docs: DataFrame, labels: DataFrame, model: AuditedFilters | None = None) -> DataFrame:
    """One row per part, order of the filters and step.

    Counts of documents: kept (after the step), removed (by it), redundant (fails its
    filter, removed before), unique_fails (fails its filter only), good_lost, toxic_lost
    (removed here and labelled so), shapley (removed by its filter, summed over all orders).
    """
    counts = failure_counts(failures(docs, model), labels)
    orders = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))

    def bits(length: Column) -> Column:
        place = lambda x: F.instr(F.col("filter_order"), x)
        return sum((F.when(place(x) <= length, 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))

    steps = steps.withColumns({"before": bits(F.col("step") - 1), "own": bits(F.col("step")) - bits(F.col("step") - 1)})
    sets = F.array(*map(F.lit, SETS))
    fails = lambda s: s.bitwiseAND(F.col("own")) != 0
    gone = lambda s: s.bitwiseAND(F.col("before")) != 0
    removed = F.transform(sets, lambda s: fails(s) & ~gone(s))
    # of the orders, a set of k failures is removed by each of its filters in one of k
    share = F.array(*[F.lit(factorial(len(LETTERS)) // max(1, s.bit_count())).cast("long") for s in SETS])
    return steps.select(
        *["part", "filter_order", F.col("step").cast("int").alias("step")],
        _total("n", F.transform(sets, lambda s: ~fails(s) & ~gone(s))).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", F.transform(sets, lambda s: fails(s) & gone(s))).alias("redundant"),
        _total("n", F.transform(sets, lambda s: s == F.col("own"))).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        F.aggregate(F.zip_with(F.zip_with("n", share, lambda n, x: n * x), F.transform(sets, fails), lambda n, f: F.when(f, n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def oracle(model: AuditedFilters | None = None) -> str:
    m = model or AuditedFilters()
    sums = ", ".join(f"count(*) FILTER (failed = {s}) AS n{s}, count(*) FILTER (failed = {s} AND good) AS good{s}, count(*) FILTER (failed = {s} AND toxic) AS toxic{s}" for s in SETS)
    long = " UNION ALL ".join(f"SELECT part, {s} AS failed, n{s} AS n, good{s} AS good, toxic{s} AS toxic FROM counted" for s in SETS)
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    order = " || ".join(f"p{i}.x" for i in range(5))
    differ = " AND ".join(f"p{i}.x <> p{j}.x" for i in range(5) for j in range(i))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
    firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
    known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (
        SELECT w.doc_id, part, (CASE WHEN len(words) < {m.least_words} THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * len(list_distinct(words)) < {m.least_distinct} * len(words) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > {m.most_capitals} * length(w.text) THEN 4 ELSE 0 END)
            + (CASE WHEN regexp_matches(w.text, '[{m.symbols}]') THEN 8 ELSE 0 END)
            + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS failed
        FROM w JOIN firsts ON w.text = firsts.text),
    marked AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN known USING (doc_id)),
    counted AS (SELECT part, {sums} FROM marked GROUP BY part),
    long AS ({long}),
    letter(x, bit) AS (VALUES {letters}),
    orders AS (SELECT {order} AS filter_order FROM letter p0, letter p1, letter p2, letter p3, letter p4 WHERE {differ}),
    steps AS (
        SELECT filter_order, CAST(step AS INTEGER) AS step, (SELECT bit FROM letter WHERE x = filter_order[step]) AS own,
            coalesce((SELECT sum(bit) FROM letter WHERE position(x IN filter_order) < step), 0)::BIGINT AS before
        FROM orders, range(1, 6) r(step)),
    figures AS (
        SELECT part, filter_order, step, own,
            sum(CASE WHEN failed & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN failed & own <> 0 AND failed & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM long, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM figures
    """
