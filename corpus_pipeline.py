"""The corpus pipeline: five stages over ``documents``, each the whole output of the one before.

A row goes only if a stage's rule says so: texts without a letter or in no known
language, all but the first document of each group of near duplicates, and texts of
which nothing is left. Mixing repeats documents of small sources and drops none.

Stages read and return the columns of ``documents``; further columns are dropped. Null
and empty texts are in no language and go in the first stage; an empty table stays
empty. Rows without doc_id come last in their groups, lose no bytes and are mixed like
others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm import bpe, jaccard, langid, mixing, suffixes
from trackweave.llm.common import scratch_path, table
from trackweave.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the best possible rank agreement a text is in no known language.
LEAST_SCORE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    model = langid.Profiles()
    judged = langid.detect(docs, langid.fit(docs, model), model, [c for c in COLUMNS if c != "text"] + ["text"])
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def row_key() -> Column:
    """A name of a whole row; only exact repeats share it."""
    # null fields are left out of the JSON, so a null differs from an empty string
    return F.md5(F.to_json(F.struct(*[c for c in COLUMNS if c != "text"], F.md5(F.col("text").cast("binary")).alias("text"))).cast("binary"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, once: the one the group is named after.

    Rows without doc_id come last in their groups. Different rows that share a doc_id
    stay or go together.
    """
    # in place of a missing id one above all others, alike for exact repeats only
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(row_key()), 2)
    named = docs.withColumn("name", F.coalesce("doc_id", F.when(F.col("doc_id").isNull(), own)))
    groups = jaccard.jaccard_components(named.select(F.col("name").alias("doc_id"), "text"))
    first = groups.groupBy(F.col("doc_id").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("first")).where("first")
    kept = named.join(first.select("name", "rows"), "name")
    order = Window.partitionBy("name", "key").orderBy("name")
    once = kept.where("rows > 1").withColumn("key", row_key()).withColumn("r", F.row_number().over(order)).where("r = 1")
    return kept.where("rows = 1").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that a document with a smaller id has, too; emptied texts go."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "text", "n_chars")]
    cut = suffixes.remove_repeats(docs, carry=rest)
    # bytes are cut inside characters at times; what is left of such a character goes, and
    # a U+FFFD of the text is written as \x01b meanwhile (\x01 as \x01a)
    put = lambda c, *pairs: c if not pairs else put(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    whole = put(F.make_valid_utf8(put(F.col("kept").cast("string"), ("\x01", "\x01a"), ("\ufffd", "\x01b"))), ("\ufffd", ""), ("\x01b", "\ufffd"), ("\x01a", "\x01"))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("kept").cast("string"))
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    left = cut.select("doc_id", text.alias("text"), F.from_json("carried", kinds).alias("c")).select("doc_id", "text", "c.*")
    return left.where(F.rlike("text", F.lit(r"[^\x09-\x0D\x20]"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them: once at least, small sources up to twice."""
    keyed = docs.withColumn("key", row_key())
    uses = mixing.mix(keyed, carry=("key",)).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("uses"))
    # the uses of exact repeats are summed, so one row of them stands for all
    order = Window.partitionBy("key").orderBy("key")
    once = keyed.withColumn("r", F.row_number().over(order)).where("r = 1")
    many = once.join(uses, "key")
    return many.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("uses")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), and hashes of them and of the text that they decode to."""
    coded = bpe.bpe_encode(docs, vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Suffix arrays and BPE can't be stated in SQL; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
