"""How far sources of one language are apart in their words.

The language keeps the terms that enough of its documents hold. A group (language and
source) gives each kept term the smoothed share ``p``; two groups differ by the sum of
``floor((p - q)^2 / (p + q))`` over all kept terms. Most counts of a group are zero, so
each pair starts at the number of terms times the value of two zero counts, and an
inverted index corrects it: postings with equal counts once for each other source, as if
the term were missing there, and two postings of one term once for their pair. Only
corrections that aren't zero go on. All arithmetic is on whole numbers.

Null text, language and source read as empty strings; they are groups like others.
Groups without any kept term have count zero everywhere. Repeated rows count as documents
each. Ties of a rank go by the item's bytes. Columns that are not used are ignored, so
clashing names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, release_memory
from trackweave.llm.graphs import SALTS, salted_join

#: Letters of ASCII and all characters beyond it, read from lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Divergence:
    """``documents``: least number of documents of a kept term; ``top``: terms reported a group.

    ``block`` sources of a language meet in one cell of a term; ``held`` terms at most are
    counted in a Python worker before they are sent on.
    """

    documents: int = 10
    top: int = 10
    block: int = 64
    held: int = 300_000


def term_counts(docs: DataFrame, model: Divergence) -> DataFrame:
    """(lang, source, term, n, docs) summed within tasks; a null term stands for the group itself."""
    empty = F.lit("")
    texts = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    held = model.held
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in seen.items():
                terms = pa.array([None, *n], pa.binary()).cast(pa.string())
                rows = len(terms)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), rows), pa.repeat(pa.scalar(source), rows), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(of.__getitem__, n)], pa.int64())], schema=schema)
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, of = seen.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.as_py().lower())  # bytes: only A-Z change
                before = len(n)
                n.update(terms)
                of.update(set(terms))
                size += len(n) - before
                if size >= held:
                    yield from flush()
                    size = 0
        yield from flush()
        release_memory()

    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, model: Divergence) -> DataFrame:
    """(lang, source, term, n, total) of kept terms, ``total`` over the language; a null term for each group."""
    dealt = term_counts(docs, model).repartition("lang", "term")
    counted = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = counted.withColumns({"total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term)})
    return summed.where((F.col("in_docs") >= model.documents) | F.col("term").isNull()).select("lang", "source", "term", "n", "total")


def share(n: str, of: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (of + 2 terms))."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10, 0)) * cast({n} + 2 AS decimal(20, 0))) div cast(greatest({of} + 2 * {terms}, 1) AS decimal(20, 0))")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(index: DataFrame, model: Divergence) -> DataFrame:
    """(lang, source, total, terms, zero, blocks, lang_total) of every group; ``zero`` is the share of a zero count."""
    own = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = index.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("total").alias("total"))
    of = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    of = own.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / model.block).cast("int").alias("blocks")).join(of, "lang", "left")
    none = {"terms": F.coalesce("terms", F.lit(0)), "lang_total": F.coalesce("lang_total", F.lit(0))}
    found = salted_join(own, of, "lang").withColumns(none)
    return found.withColumn("zero", share("0", "total", "terms"))


def with_others(rows: DataFrame, all_groups: DataFrame, *keys: str) -> DataFrame:
    """Each row of ``rows(lang, source, ...)`` with each other source of its language, rows dealt over salts."""
    others = all_groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    others = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    return dealt.join(others, ["lang", "_salt"]).where("source <> other").drop("_salt")


def pair_values(index: DataFrame, all_groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language."""
    both = lambda s, o: (F.least(s, o).alias("a"), F.greatest(s, o).alias("b"))
    zero, other_zero, p = F.col("zero"), F.col("other_zero"), F.col("p")
    start = with_others(all_groups, all_groups, "source").where("source < other")
    start = start.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("terms") * apart(zero, other_zero)).alias("value"))
    # a posting against sources without the term: equal counts of a source have equal corrections
    equal = index.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("n"))
    single = with_others(equal, all_groups, "source", "p").select("lang", *both("source", "other"), (F.col("n") * (apart(p, other_zero) - apart(zero, other_zero))).alias("value"))
    # two postings of a term: what both together change beyond their own corrections
    cells = index.withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("near", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.groupBy("lang", "term", F.least("own", "near").alias("lo"), F.greatest("own", "near").alias("hi")).agg(F.collect_list(F.struct("source", "own", "p", "zero")).alias("met"))
    cells = cells.select("lang", "lo", "hi", "met", F.explode("met").alias("x"))
    later = lambda y: (y["source"] > F.col("x")["source"]) & ((F.col("lo") == F.col("hi")) | (y["own"] != F.col("x")["own"]))
    pairs = cells.select("lang", "x", F.explode(F.filter("met", later)).alias("y"))
    x, y = F.col("x"), F.col("y")
    change = apart(x["p"], y["p"]) - apart(x["p"], y["zero"]) - apart(x["zero"], y["p"]) + apart(x["zero"], y["zero"])
    double = pairs.select("lang", x["source"].alias("a"), y["source"].alias("b"), change.alias("value"))
    return start.unionByName(single.where("value <> 0")).unionByName(double.where("value <> 0")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, model: Divergence | None = None) -> DataFrame:
    """Ranked distances between sources (part ``pair``) and the terms that mark a source (``term``).

    docs(text, lang, source) -> lang, source, part, item, value, rank: for a pair the item
    is the other source, all ranks; for a term it is one that the group has more often
    than its language, ranks up to ``top``.
    """
    m = model or Divergence()
    index = materialize(postings(docs, m), "postings")
    known = materialize(groups(index, m), "groups")
    full = salted_join(index.where("term IS NOT NULL").withColumnRenamed("total", "term_total"), known, ["lang", "source"])
    full = materialize(full.withColumn("p", share("n", "total", "terms")), "index")
    q = share("term_total", "lang_total", "terms")
    marks = full.withColumn("q", q).where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m.top)
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pair_values(full, known).withColumn("way", way).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(marks)


def oracle(model: Divergence | None = None) -> str:
    m = model or Divergence()
    p = lambda n, of, v: f"1 + ({SCALE}::HUGEINT * ({n} + 2)) // greatest({of} + 2 * {v}, 1)"
    f = lambda a, b: f"(({a} - {b}) * ({a} - {b})) // ({a} + {b})"
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents),
    e AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= {m.documents}),
    langs AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    counted AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY lang, source, term),
    full_counts AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, kept.total FROM g JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM full_counts),
    shares AS (SELECT s.*, {p("n", "own", "v")} AS p, {p("s.total", "langs.total", "v")} AS q FROM sized s JOIN langs USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum({f("x.p", "y.p")}), 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY a.lang, a.source, b.source),
    marks AS (SELECT lang, source, term AS item, ({f("p", "q")})::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM marks)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {m.top}
    """
