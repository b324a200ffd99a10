"""Benchmark passages in training texts, by a suffix automaton of the benchmark.

Items are lower-cased (A-Z) and cut into words; a window is ``window`` consecutive words of
an item, or the whole of a shorter one. A generalised suffix automaton over the words of
all items knows every run of words of an item. Each text runs through it word by word with
the length of the longest run that ends there: from ``window`` words on, all words of the
run lie in windows; a shorter item is found where its state, or one that follows from it
by suffix links, is passed with its whole length. So every occurrence is found, in one
pass, without copies of the windows.

The automaton goes to the executors as the items' words, in blocks of at most about
``block_words`` words: items are cut into pieces that overlap by a window less one word,
and pieces are dealt to blocks by hash. Texts are run against one block after another.
Hit runs are removed from a text; a text of which more than ``most_covered`` per cent of
the words are hit is dropped as a whole.

Null and empty texts have no words and no hits; so have items without words. Items with
equal ids count once, and equal items with other ids count each; a null item_id reads as
the empty string. Repeated rows are judged alike. Columns that are not used are ignored,
so clashing names do no harm. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, release_memory

#: Words of lower-cased UTF-8: digits, letters of ASCII, all characters beyond it.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Decontamination:
    """``most_covered`` per cent of hit words make a text go as a whole."""

    window: int = 10
    most_covered: int = 50
    block_words: int = 200_000
    piece_words: int = 5_000


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of words; state 0 is the empty run."""

    def __init__(self, window: int):
        self.window = window
        self.after: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: Items of a state's runs of ``window`` words, and (words, item) of whole shorter items.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.reports: list[tuple[int, tuple[tuple[int, str], ...]]] = []

    def _state(self, length: int, after: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.after.append(after)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: bytes, found: int) -> int:
        """The state of exactly the runs of ``at`` and ``word``, cut off from longer ones."""
        if self.length[found] == self.length[at] + 1:
            return found
        part = self._state(self.length[at] + 1, dict(self.after[found]), self.link[found])
        self.link[found] = part
        while at >= 0 and self.after[at].get(word) == found:
            self.after[at][word] = part
            at = self.link[at]
        return part

    def add(self, words: list[bytes]) -> None:
        at = 0
        for w in words:
            if (known := self.after[at].get(w)) is not None:
                at = self._split(at, w, known)
                continue
            new = self._state(self.length[at] + 1, {}, 0)
            while at >= 0 and w not in self.after[at]:
                self.after[at][w] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, w, self.after[at][w])
            at = new

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) after each word that ends a run of an item."""
        after, link, length = self.after, self.link, self.length
        state = n = 0
        step = after[0]
        for k, w in enumerate(words):
            to = step.get(w)
            if to is None:
                if not state:
                    continue
                while to is None and state:
                    state = link[state]
                    to = after[state].get(w)
                n = length[state]
                if to is None:
                    step, n = after[0], 0
                    continue
            state, n, step = to, n + 1, after[to]
            yield k, state, n

    def name(self, words: list[bytes], item: str, whole: bool) -> None:
        """Tell the states which item their windows belong to; all items must have been added."""
        if whole and len(words) < self.window:
            *_, (_, state, _) = self.walk(words)
            self.short.setdefault(state, []).append((len(words), item))
            return
        for _, state, n in self.walk(words):
            if n >= self.window:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                self.items.setdefault(state, set()).add(item)

    def close(self) -> None:
        """For each state: the one of its window, and the shorter items that end with it."""
        self.reports = [(-1, ())] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.reports[self.link[s]]
            window = up[0] if up[0] >= 0 else s if s in self.items else -1
            self.reports[s] = (window, (*self.short.get(s, ()), *up[1]))

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Runs [first, end) of hit words and the items found."""
        runs: list[list[int]] = []
        windows: set[int] = set()
        found: set[str] = set()
        reports, window = self.reports, self.window
        for k, state, n in self.walk(words):
            at, short = reports[state]
            reach = 0
            if n >= window:
                windows.add(at)
                reach = n
            for size, item in short:
                if size <= n:
                    found.add(item)
                    reach = max(reach, size)
            if reach:
                first = k + 1 - reach
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append([first, k + 1])
        return runs, found.union(*map(self.items.__getitem__, windows))


def automaton(pieces: list[tuple[str, bytes, bool]], window: int) -> SuffixAutomaton:
    """The automaton of pieces (item, its words with spaces, whether it is the whole item)."""
    made = SuffixAutomaton(window)
    cut = [(item, text.split(b" "), whole) for item, text, whole in pieces]
    for _, words, _ in cut:
        made.add(words)
    for item, words, whole in cut:
        made.name(words, item, whole)
    made.close()
    return made


def item_pieces(items: DataFrame, m: Decontamination) -> DataFrame:
    """(item, words, n, whole) of items(item_id, text), long ones in overlapping pieces."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    # the last piece has a window at least, if the item has one
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (m.window - 1), F.lit(1)), F.lit(m.piece_words))
    piece = F.slice("w", F.col("start"), m.piece_words + m.window - 1)
    return cut.withColumn("start", F.explode(starts)).select("item", F.array_join(piece, " ").alias("words"), F.size(piece).alias("n"), (F.size("w") < m.window).alias("whole"))


HIT = "runs array<struct<first:int,end:int,from:int,to:int>>, items array<string>"


def _pass(docs: DataFrame, pieces: list[tuple[str, bytes, bool]], m: Decontamination) -> DataFrame:
    """docs(..., text as binary, last) with n_words, runs and items of one block in place of the text."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    keys = [f for f in docs.schema.fields if f.name != "text"]
    window = m.window
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(held.value, window)
        for batch in batches:
            counts, runs, items = [], [], []
            for value in batch.column(batch.num_columns - 1):
                text = (value.as_py() or b"").lower()
                words = WORD.findall(text)
                hit, found = made.hits(words)
                if hit:  # bytes of each run
                    at = [(x.start(), x.end()) for x in WORD.finditer(text)]
                    hit = [(a, b, at[a][0], at[b - 1][1]) for a, b in hit]
                counts.append(len(words))
                runs.append([dict(zip(("first", "end", "from", "to"), x, strict=True)) for x in hit])
                items.append(sorted(found))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in keys], "n_words", "runs", "items"])
        release_memory()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return docs.select(*[f.name for f in keys], "text").mapInArrow(run, f"{kinds}, n_words long, {HIT}")


def _joined_runs(runs: Column) -> Column:
    """Runs in order, those that touch or overlap made one."""

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], r["end"]).alias("end"), last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))
        meets = (F.size(done) > 0) & (r["first"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<first:int,end:int,from:int,to:int>>"), step)


def find_hits(docs: DataFrame, items: DataFrame, model: Decontamination | None = None) -> DataFrame:
    """doc_id, h (of the text), n_words, runs (words and bytes, ordered, apart) and items of every row.

    A block of items is at the driver at a time; blocks after the first send on only texts
    with hits, and runs are then merged by text.
    """
    m = model or Decontamination()
    pieces = materialize(item_pieces(items, m), "items")
    blocks = max(1, -(-int(pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // m.block_words))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def block(k: int) -> DataFrame:
        rows = pieces.where(F.col("block") == k).select("item", "words", "whole").collect()  # bounded by block_words
        return _pass(texts, sorted((r.item, r.words.encode(), r.whole) for r in rows), m)

    first = block(0)
    if blocks == 1:
        return first
    # equal texts have equal runs, so one row of each text is enough
    first = materialize(first, "hits")
    parts = first.where("size(runs) > 0").select("doc_id", "h", "runs", "items")
    for k in range(1, blocks):
        parts = parts.unionByName(materialize(block(k).where("size(runs) > 0").select("doc_id", "h", "runs", "items"), "hits"))
    id_ = F.coalesce(F.col("doc_id"), F.lit(-1))
    merged = parts.groupBy(id_.alias("k"), "h").agg(_joined_runs(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = first.select("doc_id", id_.alias("k"), "h", "n_words").join(merged, ["k", "h"], "left")
    return found.select("doc_id", "h", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (x.split(" ", 1) for x in HIT.split(", "))])


def hit_words() -> Column:
    return F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])


def decontaminate(docs: DataFrame, items: DataFrame, model: Decontamination | None = None) -> DataFrame:
    """doc_id, kept (the text without hit runs), n_words, n_hit, items, dropped.

    ``kept`` is null where the text is null or dropped. Runs are cut from the first byte of
    their first word to the last of their last.
    """
    m = model or Decontamination()
    hits = find_hits(docs, items, m).dropDuplicates(["doc_id", "h"]).withColumn("k", F.coalesce("doc_id", F.lit(-1)))
    # a null text and an empty one share a key, but a null id and -1 must not meet twice
    hits = hits.dropDuplicates(["k", "h"]).drop("doc_id")
    rows = docs.select("doc_id", "text").withColumns({"k": F.coalesce("doc_id", F.lit(-1)), "h": F.xxhash64(F.coalesce("text", F.lit("")))})
    both = rows.join(hits, ["k", "h"], "left")
    n_hit = hit_words()
    dropped = 100 * n_hit > m.most_covered * F.col("n_words")
    data = F.col("text").cast("binary")
    begin = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    part: Callable[[Column, Column], Column] = lambda a, r: F.struct(r["to"].alias("at"), F.concat(a["out"], F.substring(data, a["at"] + 1, r["from"] - a["at"])).alias("out"))
    rest = F.aggregate("runs", begin, part, lambda a: F.concat(a["out"], F.substring(data, a["at"] + 1, F.octet_length(data))))
    kept = F.when(~dropped, F.when(F.size("runs") > 0, rest.cast("string")).otherwise(F.col("text")))
    return both.select("doc_id", kept.alias("kept"), "n_words", n_hit.alias("n_hit"), "items", dropped.alias("dropped"))


def oracle(model: Decontamination | None = None) -> str:
    m = model or Decontamination()
    w = m.window

    def cut(rows: str) -> str:
        return f"SELECT id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {rows}"

    return f"""
    WITH d AS ({cut("(SELECT doc_id AS id, text FROM documents)")}),
    b AS ({cut("(SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, text FROM benchmark)")}),
    windows AS (
        SELECT DISTINCT id, least(len(w), {w}) AS size, array_to_string(list_slice(w, p, p + least(len(w), {w}) - 1), ' ') AS run
        FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {w} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    runs AS (SELECT places.id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS run FROM places, sizes WHERE p + size - 1 <= len(w)),
    met AS (SELECT DISTINCT runs.id, p, runs.size, windows.id AS item FROM runs JOIN windows ON runs.size = windows.size AND runs.run = windows.run),
    covered AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT id, unnest(range(p, p + size)) AS q FROM met) GROUP BY id),
    found AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
    SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered ON d.id = covered.id LEFT JOIN found ON d.id = found.id
    """
