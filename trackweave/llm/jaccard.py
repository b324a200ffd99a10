"""Exact n-gram Jaccard self-join by vertical partitioning.

Texts become sets of word shingles, kept as fingerprints: of 64 bits, then the
fragment and 48 bits. The fingerprints'
order is the global n-gram order; it is cut into fragments, and each map task sends
one packed row to each fragment. There, shingles of one text alone are dropped; the
others go back to their texts, which so learn each shingle's frequency. A text with
too few shared shingles cannot link to any; the others keep their rarest shared
shingles as a prefix, one of which any partner must hold (prefix filter).

Equal sets are one class from the start, so copies are never paired. Pairs of classes
are verified as the method says: each of ``segments`` fragments counts its partial
overlap of the pair and the parts are summed per pair. Which pairs are counted comes
in two steps, so that large groups of near copies do not emit all their pairs. First
each class meets a few heads of its prefix lists; links found there contract classes
to components. Then only classes of lists with several components are left, and the
smaller component's class asks the larger one's. They meet in tiles: a block of the
asked and a chunk of the asking, of bounded size, and their partial overlaps travel as
packed counts, one row for an asking class, a tile and a fragment. No pair is dropped:
those of different components that share a prefix shingle are all counted. Links
inside a component are not needed to find it.

Null and empty texts have empty sets and link with nothing; texts shorter than a
shingle are one shingle. Repeated rows and equal texts share a class. A null doc_id
is kept but is never the name of a component unless all its copies are null. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, release_memory, shuffle_partitions
from trackweave.llm.graphs import components, salted_join

WORD_CACHE = 300_000
PACK_DOCS = 4096
PACK_SHINGLES = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardJoin:
    shingle: int = 5
    percent: int = 75
    segments: int = 8
    sample: int = 16  # lists of each class for candidates of the first kind, times heads
    #: Heads of a list, least length of a list, candidates of a class, for each round.
    rounds: tuple[tuple[int, int, int], ...] = ((1, 2, 1), (8, 16, 8))
    block: int = 100_000  # shingles of the asked classes of a tile
    chunk: int = 50_000  # and of the asking ones


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, size: int, of: _WordHash) -> np.ndarray:
    """Sorted distinct fingerprints of a text's shingles (uint64)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    each = np.fromiter(map(of.__getitem__, words), np.uint64, n)
    total = each[: n - size + 1].copy()
    for k in range(1, size):
        total *= STEP
        total += each[k : n - size + 1 + k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def _fragment(values: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the global order each fingerprint lies in."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


#: Up to so many fragments their number stands for the upper 16 of a fingerprint's 64 bits; beyond, all 64 are sent.
SHORT_PARTS = 1 << 15


def _upper_kind(parts: int) -> type:
    return np.uint16 if parts <= SHORT_PARTS else np.uint32


PACK_SCHEMA = "part int, kind int, a binary, b binary, c binary"
DOC, CLASS, SHINGLE = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, a, b, c = zip(*rows, strict=True) if rows else ((),) * 5
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((part, kind, a, b, c), kinds, strict=True)], ["part", "kind", "a", "b", "c"])


def _split(order_by: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(part, slices...) of arrays grouped by a small part number."""
    order = np.argsort(order_by, kind="stable")
    edges = np.searchsorted(order_by[order], np.arange(n + 1))
    arrays = tuple(x[order] for x in arrays)
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), *(x[edges[k] : edges[k + 1]] for x in arrays)


def _pack(docs: DataFrame, model: JaccardJoin, parts: int) -> DataFrame:
    size = model.shingle
    upper_kind = _upper_kind(parts)

    def flush(ids: list, classes: list, sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc = np.array([x or 0 for x in ids], np.int64)
        missing = np.array([x is None for x in ids], np.uint8)
        cls = np.array(classes, np.int64)
        n = np.array([len(sets[c]) if c in sets else 0 for c in classes], np.int32)
        out = [(p, DOC, d.tobytes() + m.tobytes(), c.tobytes(), k.tobytes()) for p, d, m, c, k in _split(doc % parts, parts, doc, missing, cls, n)]
        own = np.fromiter(sets, np.int64, len(sets))
        lens = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        out += [(p, CLASS, c.tobytes(), k.astype(np.int32).tobytes(), b"") for p, c, k in _split(own % parts, parts, own, lens)]
        if len(own):
            every = np.concatenate(list(sets.values()))
            index = np.repeat(np.arange(len(own)), lens).astype(np.uint16)
            for p, values, at in _split(_fragment(every, parts), parts, every, index):
                used, at = np.unique(at, return_inverse=True)
                upper = (values >> np.uint64(32)).astype(upper_kind)
                out.append((p, SHINGLE, values.astype(np.uint32).tobytes() + upper.tobytes(), at.astype(np.uint16).tobytes(), own[used].tobytes()))
        yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _WordHash()
        ids: list = []
        classes: list[int] = []
        sets: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), size, of)
                name = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0
                ids.append(doc)
                classes.append(name)
                if len(found) and name not in sets:
                    sets[name] = found
                    total += len(found)
                if len(ids) >= PACK_DOCS or total >= PACK_SHINGLES:
                    yield from flush(ids, classes, sets)
                    ids, classes, sets, total = [], [], {}, 0
        if ids:
            yield from flush(ids, classes, sets)
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACK_SCHEMA)


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """In each fragment: drop shingles of one class alone, send the others with their frequency to their classes."""
    upper_kind = _upper_kind(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owners = [], []
        for batch in batches:
            rest = []
            for part, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == SHINGLE:
                    at = np.frombuffer(b, np.uint16)
                    lower, upper = np.frombuffer(a, np.uint32, len(at)), np.frombuffer(a, upper_kind, len(at), 4 * len(at))
                    above = np.uint64(part << 48 if upper_kind is np.uint16 else 0)
                    values.append(above | upper.astype(np.uint64) << np.uint64(32) | lower)
                    owners.append(np.frombuffer(c, np.int64)[at])
                else:
                    rest.append((part, kind, a, b, c))
            if rest:
                yield _rows(rest)
        if not values:
            return
        h, own = np.concatenate(values), np.concatenate(owners)
        values.clear(), owners.clear()
        order = np.argsort(h)
        h, own = h[order], own[order]
        same = h[1:] == h[:-1]
        some = np.concatenate((same, [False])) | np.concatenate(([False], same))
        h, own = h[some], own[some]
        order = np.lexsort((own, h))  # packs may repeat a class
        h, own = h[order], own[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))[: len(h)]
        h, own = h[new], own[new]
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        keep = n[at] > 1
        h, own, n = h[keep], own[keep], n[at][keep].astype(np.int32)
        yield _rows([(p, SHINGLE, x.tobytes(), o.tobytes(), k.tobytes()) for p, x, o, k in _split(own % parts, parts, h, own, n)])
        del h, own, n, at, order
        release_memory()

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, PACK_SCHEMA)


GATHERED = "doc_id long, class long, n int, alone int, segments array<array<long>>, prefix array<long>"


def _gather(shared: DataFrame, model: JaccardJoin, parts: int) -> DataFrame:
    """Per class: its shared shingles by segment, and its prefix; also a row for every document."""
    percent, cuts = model.percent, model.segments
    top = parts << 16 if parts <= SHORT_PARTS else 1 << 32  # above the upper halves of all fingerprints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*columns: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "class", "n", "alone", "segments", "prefix"])

        size: dict[int, int] = {}
        h, own, often = [], [], []
        for batch in batches:
            for _, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == DOC:
                    m = len(b) // 8
                    missing = np.frombuffer(a, np.uint8)[8 * m :]
                    ids = [None if x else int(d) for d, x in zip(np.frombuffer(a, np.int64, m), missing, strict=True)]
                    names = [int(x) if k else None for x, k in zip(np.frombuffer(b, np.int64), np.frombuffer(c, np.int32), strict=True)]
                    yield out(ids, names, np.frombuffer(c, np.int32).tolist(), *[[None] * m] * 3)
                elif kind == CLASS:
                    size.update(zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int32).tolist(), strict=True))
                else:
                    h.append(np.frombuffer(a, np.uint64))
                    own.append(np.frombuffer(b, np.int64))
                    often.append(np.frombuffer(c, np.int32))
        if not h:
            return
        hs, owns, ns = np.concatenate(h), np.concatenate(own), np.concatenate(often)
        order = np.argsort(owns, kind="stable")
        hs, owns, ns = hs[order], owns[order], ns[order]
        starts = np.flatnonzero(np.concatenate(([True], owns[1:] != owns[:-1])))
        ends = np.append(starts[1:], len(owns))
        rows: list[tuple] = []
        for s, e in zip(starts, ends, strict=True):
            name = int(owns[s])
            n = size[name]
            least = -(-percent * n // 100)
            room = (n - least + 1) - (n - int(e - s))  # shingles of this class alone come first in its prefix
            if room <= 0:
                continue
            mine, freq = hs[s:e], ns[s:e]
            alone = n - int(e - s)
            first = mine[np.lexsort((mine, freq))[:room]]
            mine = np.sort(mine)
            at = np.searchsorted((mine >> np.uint64(32)).astype(np.int64) * cuts // top, np.arange(cuts + 1))
            signed = mine.view(np.int64)
            rows.append((None, name, n, alone, [signed[at[k] : at[k + 1]] for k in range(cuts)], first.view(np.int64)))
            if len(rows) >= 500:
                yield out(*map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield out(*map(list, zip(*rows, strict=True)))

    return shared.repartitionById(parts, F.col("part")).mapInArrow(run, GATHERED)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that link: partial overlaps counted by segment, summed per pair."""
    cut = sets.select("class", "n", F.posexplode("segments").alias("segment", "part")).where(F.size("part") > 0)
    left = pairs.join(cut.select(F.col("class").alias("a"), F.col("n").alias("na"), "segment", F.col("part").alias("pa")), "a")
    right = cut.select(F.col("class").alias("b"), "segment", F.col("n").alias("nb"), F.col("part").alias("pb"))
    partial = left.join(right, ["b", "segment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("k"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return summed.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def _rooted(posted: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Add each class's root and the number of classes that its component has."""
    if roots is None:
        return posted.withColumn("root", F.col("class")).withColumn("size", F.lit(1).cast("long"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    known = salted_join(roots, sizes, "root")
    return posted.join(known, "class", "left").withColumn("root", F.coalesce("root", "class")).withColumn("size", F.coalesce("size", F.lit(1)))


def _close(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _stars(sets: DataFrame, roots: DataFrame | None, model: JaccardJoin, heads: int, crowd: int, tries: int) -> DataFrame:
    """For each class, heads of other components that most of its sampled lists have.

    The lists are those of the ``sample`` most frequent prefix shingles that have at
    least ``crowd`` classes; each is cut by hash into as many parts as ``heads``, with a
    head each. A component's class asks only heads of larger components, up to ``tries``
    a class; what they miss is left to :func:`_tiles`.
    """
    lists_each = max(1, model.sample // heads)
    sample = F.slice("prefix", F.greatest(F.size("prefix") - lists_each + 1, F.lit(1)), lists_each)
    posted = _rooted(sets.select("class", "n", F.explode(sample).alias("shingle")), roots)
    order = F.xxhash64("class", F.lit(heads))
    lists = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("size", "root")).alias("top"))
    posted = salted_join(posted, lists.where((F.col("m") >= crowd) & (F.col("lo") < F.col("hi"))).select("shingle", "top"), "shingle")
    part = posted.groupBy("shingle", F.pmod(order, F.lit(heads)).alias("part")).agg(F.min(F.struct(order.alias("o"), "class", "n", "root", "size")).alias("h"))
    found = part.groupBy("shingle").agg(F.collect_list(F.struct(F.col("h.class").alias("b"), F.col("h.n").alias("nb"), F.col("h.root").alias("rb"), F.col("h.size").alias("sb"))).alias("heads"))
    asking = posted if heads == 1 else posted.where(F.struct("size", "root") < F.col("top"))
    met = salted_join(asking.drop("top"), found, "shingle").select("class", "n", "root", "size", F.inline("heads"))
    other = F.struct("size", "root") < F.struct("sb", "rb") if heads > 1 else F.col("root") != F.col("rb")
    counted = met.where(other & _close(F.col("n"), F.col("nb"), model.percent)).groupBy(F.col("class").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"))
    best = counted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "b")), asc=False), 1, tries).alias("best"))
    return best.select("a", F.explode(F.transform("best", lambda x: x["b"])).alias("b"))


def _visits(sets: DataFrame, roots: DataFrame | None, model: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """Who must still be compared with whom: (class, n, root, size, home) of classes that ask, and of those asked.

    A list that holds classes of several components is open. Each class is asked at one
    place, its home: the longest of its open lists. It asks at the homes of all larger
    components' classes that share an open list with it, once at each, so a pair never
    becomes a row. Homes are longer than the list they are met in, so a list knows at most
    as many as the root of the number of postings. Of two sizes x and y that link at least ``least`` shingles are shared,
    so one of them is among the first x - least + 1 of the one, in the order of frequency.
    """
    percent = model.percent
    posted = sets.select("class", "n", "alone", F.posexplode("prefix").alias("at", "shingle"))
    posted = _rooted(posted.select("class", "n", (F.col("alone") + F.col("at")).alias("at"), "shingle"), roots)
    posted = materialize(posted, "jaccard-lists")
    lists = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    posted = salted_join(posted, lists.select("shingle", "m"), "shingle")
    asked = posted.groupBy("class", "n", "root", "size").agg(F.max(F.struct("m", "shingle"))["shingle"].alias("home"))
    asked = materialize(asked, "jaccard-homes")
    known = salted_join(posted.select("class", "n", "root", "size", "shingle"), asked.select("class", "home"), "class")
    places = known.groupBy("shingle", "home").agg(F.max(F.struct("size", "root")).alias("top"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    by_list = places.groupBy("shingle").agg(F.collect_list(F.struct("home", "top", "least_n", "most_n")).alias("places"))
    met = salted_join(posted.drop("m"), by_list, "shingle")
    # the smallest partner that may link leaves the most room in the order of frequency
    smallest = lambda p: F.greatest(p["least_n"], F.ceil(percent * F.col("n") / 100))
    may = lambda p: (
        (F.struct("size", "root") < p["top"])
        & (100 * F.col("n") >= percent * p["least_n"])
        & (100 * p["most_n"] >= percent * F.col("n"))
        & (F.col("at") <= F.col("n") - F.ceil(percent * (F.col("n") + smallest(p)) / (100 + percent)))
    )
    homes = F.transform(F.filter("places", may), lambda p: p["home"])
    asks = met.select("class", "n", "root", "size", homes.alias("homes")).where(F.size("homes") > 0)
    asks = asks.groupBy("class", "n", "root", "size").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
    return asks.withColumn("home", F.explode("homes")).drop("homes"), asked


TILE = ["home", "block", "chunk"]
ROWS = "home long, block int, chunk int, segment int, asks boolean, class long, n int, root long, size long, part array<long>"
PARTIAL = "home long, block int, chunk int, class long, n int, root long, size long, partner array<int>, k array<int>, names array<long>, sizes array<int>, roots array<long>, weights array<long>"


def _dealt(rows: DataFrame, asks: DataFrame, asked: DataFrame, model: JaccardJoin) -> DataFrame:
    """Rows of classes at homes, dealt to tiles of a block of asked and a chunk of asking classes each.

    A tile's sides have some ``block`` and ``chunk`` shingles, so no tile grows with its list.
    """
    pieces = lambda df, size, name: df.groupBy("home").agg(F.ceil(F.sum("n") / size).cast("int").alias(name))
    sizes = pieces(asked, model.block, "blocks").join(pieces(asks, model.chunk, "chunks"), "home")
    number = lambda of: F.pmod(F.xxhash64("class"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    one = salted_join(asked, sizes, "home").withColumn("block", number("blocks")).withColumn("chunk", each("chunks")).withColumn("asks", F.lit(False))
    two = salted_join(asks, sizes, "home").withColumn("chunk", number("chunks")).withColumn("block", each("blocks")).withColumn("asks", F.lit(True))
    columns = [*TILE, "asks", "class", "n", "root", "size"]
    return one.select(*columns).unionByName(two.select(*columns)).join(rows, "class")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches in tables of whole groups, some ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        start = n if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if start < n:
            yield table.slice(0, start)
            held = table.slice(start).combine_chunks().to_batches()
            n -= start
    if n:
        yield pa.Table.from_batches(held)


def _ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of each row's group, in a table that is sorted by group."""
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(), np.repeat(np.arange(table.num_rows), lens)


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


MATCHES = 500_000


def overlaps(group: np.ndarray, asks: np.ndarray, values: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking row, asked row, common values) of all pairs of one group with any, in order of the asking row.

    ``group`` and ``asks`` are by row; ``values`` are the rows' sets. Works through the
    asking rows in slices of some ``MATCHES`` matches.
    """
    order = np.lexsort((values, group[row]))
    values, row = values[order], row[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (group[row[1:]] != group[row[:-1]])))
    code = np.cumsum(new) - 1
    theirs = ~asks[row]
    asked_code, asked_row = code[theirs], row[theirs]
    first = np.searchsorted(asked_code, np.arange(code[-1] + 2)) if len(code) else np.zeros(1, np.int64)
    own_code, own_row = code[~theirs], row[~theirs]
    by_row = np.argsort(own_row, kind="stable")
    own_code, own_row = own_code[by_row], own_row[by_row]
    met = first[own_code + 1] - first[own_code]
    own_code, own_row, met = own_code[met > 0], own_row[met > 0], met[met > 0]
    total = np.concatenate(([0], np.cumsum(met)))
    ends = np.append(np.flatnonzero(own_row[1:] != own_row[:-1]) + 1, len(own_row))
    s = 0
    while s < len(own_row):
        e = int(ends[max(np.searchsorted(total[ends], total[s] + MATCHES, side="right") - 1, np.searchsorted(ends, s, side="right"))])
        n = met[s:e]
        begin = np.repeat(first[own_code[s:e]] - (total[s:e] - total[s]), n)
        theirs = asked_row[begin + np.arange(total[e] - total[s])]
        who, rank = np.unique(own_row[s:e], return_inverse=True)
        base = np.searchsorted(group, group[who])  # first row of each one's group
        partner = theirs - np.repeat(base[rank], n)
        width = int(partner.max()) + 1
        pair = np.repeat(rank * width, n) + partner
        if len(who) * width <= 8 * len(pair):
            k = np.bincount(pair)
            pair = np.flatnonzero(k)
            k = k[pair]
        else:
            pair, k = np.unique(pair, return_counts=True)
        yield who[pair // width], base[pair // width] + pair % width, k
        s = e


def _partial(dealt: DataFrame) -> DataFrame:
    """Overlaps of a tile's pairs in one fragment: a row for each asking class, and one for the asked."""
    keys = [*TILE, "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in PARTIAL.split(",")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]]
        for table in _groups(batches, keys, 2000):
            group, asks = _ids(table, keys), table.column("asks").to_numpy()
            at = {k: table.column(k).to_numpy() for k in (*keys, "class", "n", "root", "size")}
            start = np.searchsorted(group, group)  # first row of each row's group
            partner = np.arange(len(group)) - start
            values, row = _flat(table, "part")
            for a, b, k in overlaps(group, asks, values, row):
                who, own = np.unique(a, return_inverse=True)
                pairs = [_lists(own, len(who), partner[b], pa.int32()), _lists(own, len(who), k, pa.int32())]
                own_columns = [pa.array(at[c][who], t) for c, t in zip(names[:7], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*own_columns, *pairs, *[pa.nulls(len(who), t) for t in kinds[9:]]], names)
            # one fragment tells who the asked classes are, in the order of the rows
            head = at["segment"] == 0
            first = np.flatnonzero(head & (start == np.arange(len(group))))
            if len(first):
                owner = np.searchsorted(first, start[head])
                lists = [_lists(owner, len(first), at[c][head], t) for c, t in (("class", pa.int64()), ("n", pa.int32()), ("root", pa.int64()), ("size", pa.int64()))]
                own_columns = [pa.array(at[c][first], t) if c in TILE else pa.nulls(len(first), t) for c, t in zip(names[:7], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*own_columns, *[pa.nulls(len(first), t) for t in kinds[7:9]], *lists], names)
        release_memory()

    by = [F.col(c) for c in keys]
    columns = [x.strip().split()[0] for x in ROWS.split(",")]
    return dealt.select(*columns).repartition(*by).sortWithinPartitions(*by, "asks", "class").mapInArrow(run, PARTIAL)


def _summed(partial: DataFrame, percent: int) -> DataFrame:
    """The links(a, b) of each tile, one to a component: partial overlaps summed per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, TILE, 500):
            group = _ids(table, TILE)
            name, theirs = _flat(table, "names")
            n, root, size = (_flat(table, c)[0] for c in ("sizes", "roots", "weights"))
            theirs = group[theirs]
            begin = np.searchsorted(theirs, np.arange(group[-1] + 1))  # where the asked classes of each group start
            at, row = _flat(table, "partner")
            k, _ = _flat(table, "k")
            own = {c: table.column(c).fill_null(0).to_numpy() for c in ("class", "n", "root", "size")}
            # rows of one group and class follow each other
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (own["class"][1:] != own["class"][:-1])))
            asker = np.cumsum(new) - 1
            lead = np.flatnonzero(new)
            # a cell for each asking and asked class of a tile, tile by tile
            asked = np.diff(np.append(begin, len(name)))[group[lead]]
            cell = np.concatenate(([0], np.cumsum(asked)))
            total = np.bincount(cell[asker[row]] + at, weights=k, minlength=cell[-1])
            pair = np.flatnonzero(total)
            total = total[pair].astype(np.int64)
            a = np.searchsorted(cell, pair, side="right") - 1
            b = begin[group[lead[a]]] + pair - cell[a]
            a = lead[a]
            smaller = (own["size"][a] < size[b]) | (own["size"][a] == size[b]) & (own["root"][a] < root[b])
            good = smaller & (100 * total >= percent * (own["n"][a].astype(np.int64) + n[b] - total))
            a, b = a[good], b[good]
            _, first = np.unique(np.stack((a, root[b])), axis=1, return_index=True) if len(a) else (None, np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own["class"][a[first]], pa.int64()), pa.array(name[b[first]], pa.int64())], ["a", "b"])
        release_memory()

    by = [F.col(c) for c in TILE]
    return partial.repartition(*by).sortWithinPartitions(*by, F.col("class").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _tiles(sets: DataFrame, roots: DataFrame | None, model: JaccardJoin) -> DataFrame:
    """All links between components that are not connected yet, one at least of any two components that have some."""
    asks, asked = _visits(sets, roots, model)
    asks = materialize(asks, "jaccard-asks")
    # an empty fragment has a row, too: the order of the rows must be alike in all
    cut = sets.select("class", F.posexplode("segments").alias("segment", "part"))
    return _summed(_partial(_dealt(cut, asks, asked, model)), model.percent)


def jaccard_components(docs: DataFrame, model: JaccardJoin | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of every row of docs(doc_id, text)."""
    model = model or JaccardJoin()
    parts = shuffle_partitions(docs.sparkSession)
    gathered = materialize(_gather(_shared(_pack(docs, model, parts), parts), model, parts), "jaccard")
    members = gathered.where(F.col("segments").isNull()).select("doc_id", "class", "n")
    sets = gathered.where(F.col("segments").isNotNull()).select("class", "n", "alone", "prefix", "segments")
    links, roots = None, None
    for heads, crowd, tries in model.rounds:
        found = materialize(_verify(_stars(sets, roots, model, heads, crowd, tries), sets, model.percent), "jaccard-stars")
        links = found if links is None else links.union(found)
        roots = components(links, "jaccard-components", rounds=2).withColumnsRenamed({"node": "class", "label": "root"})
    last = materialize(_tiles(sets, roots, model), "jaccard-links")
    links = last if links is None else links.union(last)
    joined = components(links, "jaccard-components").withColumnsRenamed({"node": "class", "label": "root"})

    # names: the least doc_id of each component
    least = members.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = salted_join(named.select("class", "root"), names, "root").select("class", "component_id")
    whole = salted_join(members, by_class, "class", "left")
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")
