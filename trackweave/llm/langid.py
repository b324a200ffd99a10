"""Language identification by rank-order profiles.

Each language's profile is the ``size`` most frequent letter n-grams (1 to 3
letters, words set off by spaces) of its training texts. A document's own most
frequent n-grams are ranked alike (ties by the n-gram) and each is out of place by
the distance of the two ranks, or by ``size`` if the profile lacks it. The language
with the least total wins, ties by name; the score is 1 less the total's share of
the greatest possible one.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if
there is nothing to learn from. Rows with a null language teach nothing. Very long
texts are counted whole. Repeated rows are judged alike; an empty table gives an
empty result.

Profiles are fitted on a bounded sample: about ``fit_docs`` documents a language,
drawn by a hash of their ids. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import release_memory

UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    size: int = 400
    fit_docs: int = 3000
    folds: int = 4
    held_out_fold: int = 2


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in each worker."""
    if not _LETTERS:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of 1 to 3 characters as integers, 21 bits a character; 0 is a gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes[~letter_table()[codes]] = 0
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return codes[:0]
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    # three characters take 63 bits; shorter grams are negative, so that lengths do not mix
    return np.concatenate((codes[codes != 0] - (1 << 50), two - (1 << 49), three[codes[1:-1] != 0]))


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent values, ties by value."""
    return values[np.lexsort((values, -counts))[:size]]


def distance(top: np.ndarray, profile: np.ndarray, size: int) -> int:
    """How far the ranked grams are out of place against a profile."""
    order = np.argsort(profile)
    at = np.searchsorted(profile, top, sorter=order)
    place = order[np.minimum(at, len(profile) - 1)]
    found = profile[place] == top
    return int(np.where(found, np.minimum(np.abs(place - np.arange(len(top))), size), size).sum())


def held_out(doc_id: Column, model: Profiles) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % model.folds == model.held_out_fold


def fit(docs: DataFrame, model: Profiles) -> dict[str, np.ndarray]:
    """Profiles of all languages in ``docs(doc_id, text, lang)``.

    The driver gets the label set and ``size`` n-grams a label, nothing that grows
    with the number of documents.
    """
    known = docs.where(~F.coalesce(held_out(F.col("doc_id"), model), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: min(1.0, model.fit_docs / r.n) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in total:
                    was, m = total[lang]
                    values, at = np.unique(np.concatenate((was, values)), return_inverse=True)
                    n = np.bincount(at, np.concatenate((m, n)), len(values)).astype(np.int64)
                total[lang] = (values, n)
        for lang, (values, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= model.size).collect()
    by: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        by.setdefault(r.lang, []).append((r.place, r.gram))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64) for lang, rows in sorted(by.items())}


def judge(text: str | None, profiles: dict[str, np.ndarray], size: int) -> tuple[str, float]:
    found = grams(text) if text else np.empty(0, np.int64)
    if not len(found) or not profiles:
        return UNKNOWN, 0.0
    top = ranked(*np.unique(found, return_counts=True), size)
    far = {lang: distance(top, profile, size) for lang, profile in profiles.items()}
    best = min(far, key=lambda x: (far[x], x))
    return best, round(1 - far[best] / (len(top) * size), 6)


def detect(docs: DataFrame, profiles: dict[str, np.ndarray], model: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, judged from the text alone; no shuffle."""
    size = model.size
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                judged = [judge(x, profiles, size) for x in part.column(0).to_pylist()]
                more = [pa.array([x for x, _ in judged], pa.string()), pa.array([s for _, s in judged], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], [*keep, "lang_pred", "score"])
        release_memory()

    return docs.select("text", *keep).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Profiles | None = None) -> DataFrame:
    """Fit on ``docs(doc_id, text, lang)`` and judge each of its rows.

    Returns doc_id, held_out, lang_pred and score.
    """
    model = model or Profiles()
    profiles = fit(docs, model)
    judged = detect(docs, profiles, model, ["doc_id"])
    return judged.select("doc_id", F.coalesce(held_out(F.col("doc_id"), model), F.lit(False)).alias("held_out"), "lang_pred", "score")
