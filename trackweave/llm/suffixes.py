"""Removal of long repeated strings across documents with a family of suffix arrays.

Every byte string of ``length`` bytes that also starts in a document with a smaller
doc_id is removed, judged on the input; overlaps count and matches stay inside
documents. The work is done in fragments of the suffix space and in three rounds:

1. Each such string (window) has an anchor: its least ``anchor``-byte string by a
   hash. Neighbouring windows with the same anchor form a run. Runs go to a fragment
   by their anchor's hash; where runs of two documents are equal (in two independent
   hashes of 48 and 64 bits), the later one is removed as a whole, which settles the
   inside of every match.
2. Runs that share an anchor but differ (the ends of matches) fetch their bytes.
3. In each fragment the windows of those runs are suffixes, cut to ``length`` bytes,
   of an index family: batches in doc_id order get suffix arrays, are merge-scanned
   against the existing levels, and levels of equal size merge geometrically.

Texts are packed and compressed once and shuffled once, to a bucket of documents;
rounds 2 and the final cut meet them there.

Null texts are empty; texts shorter than ``length`` keep all bytes. A null doc_id is
neither smaller nor larger than another: such rows keep all bytes and cause no
removal. Rows with equal doc_id do not remove each other's bytes; equal rows are
treated alike. Texts of any length are cut in pieces that overlap. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import release_memory, shuffle_partitions

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
PACK_BYTES = 2_000_000
PACK_DOCS = 8_000
PLACE = 24  # bits for a position in a pack


@dataclass(frozen=True)
class LongRepeats:
    length: int = 50
    anchor: int = 20
    batch: int = 1 << 12  # windows that join a family at a time

    def __post_init__(self) -> None:
        if not 16 <= self.anchor <= min(24, self.length):  # three loads of 8 bytes must cover an anchor
            raise ValueError("anchor must be 16 to 24 bytes and fit into length")


def row_key(doc_id: int, data: bytes) -> int:
    """Names a row in the shuffles; rows with equal id and text share it."""
    return xxhash.xxh3_64_intdigest(data, seed=doc_id & (2**64 - 1)) - (1 << 63)


def runs(data: bytes, starts: np.ndarray, ends: np.ndarray, model: LongRepeats) -> tuple[np.ndarray, ...]:
    """Anchor hash (64 bits), first window and number of windows of every run in pieces of ``data``."""
    n, k, length = len(data), model.anchor, model.length
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    padded = data + bytes(k + length + 8)
    load = lambda at: np.ndarray((n,), "<u8", padded, at, (1,))
    h = load(0) * ODD[0]
    h += load(8) * ODD[1]
    h += load(k - 8) * ODD[2]
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << PLACE) - 1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(window):
        return (np.empty(0, np.uint64), window, window)
    at = anchor[window]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, len(at)))
    name = h[at[first]]
    name = (name ^ (name >> np.uint64(31))) * ODD[0]
    return name, window[first], count


#: Up to so many fragments their number stands for the upper 16 of a name's 64 bits; beyond, all 64 are sent.
SHORT_PARTS = 1 << 15
PAGE = 16  # bits for a position in a page of a text


def _fragment(name: np.ndarray, n: int) -> np.ndarray:
    return ((name >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _home(name: np.ndarray, n: int) -> np.ndarray:
    """The fragment of names as :func:`_load_split` reads them."""
    return (name >> np.uint64(48)).astype(np.int64) if n <= SHORT_PARTS else _fragment(name, n)


def _small(values: np.ndarray, most: int) -> np.ndarray:
    """The values as the shortest unsigned numbers that hold ``most``."""
    return values.astype(np.min_scalar_type(most))


def _parts(by: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(by, kind="stable")
    edges = np.searchsorted(by[order], np.arange(n + 1))
    sorted_ = [x[order] for x in arrays]
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), *(x[edges[k] : edges[k + 1]] for x in sorted_)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays, one after the other, each with its kind and length."""
    return b"".join(b"%-4s%12d" % (x.dtype.str[1:].encode(), x.size) + x.tobytes() for x in arrays)


def _load(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = blob[at : at + 4].decode().strip(), int(blob[at + 4 : at + 16])
        dtype = np.dtype("<" + kind)
        out.append(np.frombuffer(blob, dtype, n, at + 16))
        at += 16 + n * dtype.itemsize
    return out


def _join(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(_load, blobs), strict=True)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True) if rows else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


SCHEMA = "part int, kind int, blob binary"
WHOLE, ASKED = 0, 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes, bytes]]]:
    """Rows (doc_id, text, what is carried along) in packs of bounded size (a single text may be larger)."""
    pack: list[tuple[int | None, bytes, bytes]] = []
    size = 0
    for batch in batches:
        more = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
        for doc, text, extra in zip(batch.column(0), batch.column(1), more, strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if pack and (size + len(data) > PACK_BYTES or len(pack) >= PACK_DOCS):
                yield pack
                pack, size = [], 0
            pack.append((doc.as_py(), data, extra.as_py().encode() if extra is not None else b""))
            size += len(data)
    if pack:
        yield pack


def _texts(docs: DataFrame, buckets: int, carry: list[str]) -> DataFrame:
    """Documents packed by bucket and compressed, with the columns to carry along as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for pack in _pieces(batches):
            by: dict[int, list[tuple[int | None, bytes, int, bytes]]] = {}
            for doc, data, extra in pack:
                key = row_key(doc or 0, data)
                by.setdefault(key % buckets, []).append((doc, data, key, extra))
            rows = []
            for bucket, own in by.items():
                ids = np.array([x[0] or 0 for x in own], np.int64)
                missing = np.array([x[0] is None for x in own], np.uint8)
                keys = np.array([x[2] for x in own], np.int64)
                lens, more = (np.array([len(x[k]) for x in own], np.int64) for k in (1, 3))
                body, extra = (np.frombuffer(b"".join(x[k] for x in own), np.uint8) for k in (1, 3))
                rows.append((bucket, WHOLE, press.compress(_dump(ids, missing, keys, lens, body, more, extra))))
            yield _batch(rows)

    extra = [F.to_json(F.struct(*carry)).alias("carried")] if carry else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), *extra).mapInArrow(run, SCHEMA)


def _anchors(docs: DataFrame, model: LongRepeats, parts: int) -> DataFrame:
    """Round 1, map side: every run, packed by fragment."""
    most = (1 << PLACE) - 4 * model.length
    upper_kind = np.uint16 if parts <= SHORT_PARTS else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _pieces(batches):
            known = [(d, x) for d, x, _ in pack if d is not None and len(x) >= model.length]
            keys = np.array([row_key(d, x) for d, x in known], np.int64)
            ids = np.array([d for d, _ in known], np.int64)
            whole = sum(len(x) for _, x in known)
            if whole <= most:
                groups = [[(k, 0, x) for k, (_, x) in enumerate(known)]]
            else:  # one text fills the pack: cut it, with overlap
                groups = [[(k, at, x[at : at + most + model.length - 1])] for k, (_, x) in enumerate(known) for at in range(0, len(x), most)]
            for group in groups:
                if not group:
                    continue
                data = b"".join(x for _, _, x in group)
                ends = np.cumsum([len(x) for _, _, x in group])
                starts = np.concatenate(([0], ends[:-1]))
                name, first, count = runs(data, starts, ends, model)
                piece = np.searchsorted(ends, first, side="right")
                place = first - starts[piece] + np.array([at for _, at, _ in group], np.int64)[piece]
                digest = xxhash.xxh3_64_intdigest
                stop = first + count + model.length - 1
                body = np.fromiter((digest(data[s:e]) for s, e in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first))
                pages = int(place.max() >> PAGE) + 1 if len(place) else 1
                row = np.array([k for k, _, _ in group], np.int64)[piece] * pages + (place >> PAGE)
                place = (place & ((1 << PAGE) - 1)).astype(np.uint16)
                count = _small(count, model.length - model.anchor + 1)
                rows = []
                for p, nm, bd, rw, pl, ct in _parts(_fragment(name, parts), parts, name, body, row, place, count):
                    used, at = np.unique(rw, return_inverse=True)
                    upper = (nm >> np.uint64(32)).astype(upper_kind)
                    rows.append((p, WHOLE, _dump(nm.astype(np.uint32), upper, bd, _small(at, len(used)), pl, ct) + b"|" + _dump(ids[used // pages], keys[used // pages], used % pages)))
                yield _batch(rows)
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _compare(anchors: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Round 1, fragments: whole runs to remove, and runs whose bytes are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                columns.append(_load_split(blob, part))
        if not columns:
            return
        name, body, doc, key, place, count = (np.concatenate(x) for x in zip(*columns, strict=True))
        columns.clear()
        order = np.argsort(name)
        sorted_name = name[order]
        same = sorted_name[1:] == sorted_name[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        del sorted_name, same
        name, body, doc, key, place, count = (x[order] for x in (name, body, doc, key, place, count))
        if not len(name):
            return
        edge = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(edge, len(name)))
        several = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
        keep = np.repeat(several, size)
        name, body, doc, key, place, count = (x[keep] for x in (name, body, doc, key, place, count))
        if not len(name):
            return
        order = np.lexsort((doc, body, name))
        name, body, doc, key, place, count = (x[order] for x in (name, body, doc, key, place, count))
        new_name = np.concatenate(([True], name[1:] != name[:-1]))
        new_body = new_name | np.concatenate(([True], body[1:] != body[:-1]))
        group = np.cumsum(new_body) - 1
        later = doc > doc[np.flatnonzero(new_body)][group]
        bodies = np.add.reduceat(new_body.astype(np.int64), np.flatnonzero(new_name))
        asked = ~later & (bodies[np.cumsum(new_name) - 1] > 1)
        rows = [(b, WHOLE, _dump(k, p, p + c)) for b, k, p, c in _parts(key[later] % buckets, buckets, key[later], place[later].astype(np.int64), count[later].astype(np.int64))]
        rows += [(b, ASKED, _dump(n, k, p, c)) for b, n, k, p, c in _parts(key[asked] % buckets, buckets, name[asked], key[asked], place[asked].astype(np.int64), count[asked])]
        yield _batch(rows)
        del name, body, doc, key, place, count
        release_memory()

    return anchors.repartitionById(parts, F.col("part")).mapInArrow(run, SCHEMA)


def _load_split(blob: bytes, part: int) -> list[np.ndarray]:
    """Arrays of one packed row of runs: name, body, doc, key, place, count."""
    arrays, at = [], 0
    for _ in range(6):
        kind, n = blob[at : at + 4].decode().strip(), int(blob[at + 4 : at + 16])
        dtype = np.dtype("<" + kind)
        arrays.append(np.frombuffer(blob, dtype, n, at + 16))
        at += 16 + n * dtype.itemsize
    ids, keys, pages = _load(blob[at + 1 :])
    lower, upper, body, row, place, count = arrays
    above = np.uint64(part << 48 if upper.dtype.itemsize == 2 else 0)
    name = above | upper.astype(np.uint64) << np.uint64(32) | lower
    return [name, body, ids[row], keys[row], (pages[row] << PAGE) + place, count]


def _unpack(table: pa.Table) -> dict[tuple[int, bool], tuple[int | None, bytes, list[bytes]]]:
    """(key, null id) -> (doc_id, text, what each equal row carries) of a bucket."""
    out: dict[tuple[int, bool], tuple[int | None, bytes, list[bytes]]] = {}
    press = zstandard.ZstdDecompressor()
    for blob in table.column("blob").to_pylist():
        ids, missing, keys, lens, body, more, extra = _load(press.decompress(blob))
        cut = lambda sizes, whole: [whole[e - n : e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
        for i, m, k, data, own in zip(ids.tolist(), missing.tolist(), keys.tolist(), cut(lens, body.tobytes()), cut(more, extra.tobytes()), strict=True):
            out.setdefault((k, bool(m)), (None if m else i, data, []))[2].append(own)
    return out


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each key, sorted, with those that touch or overlap made one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.cumsum(new) - 1
    reach = int(end.max()) + 1
    highest = np.maximum.accumulate(end + rank * reach) - rank * reach  # the furthest end so far in each key
    first = new.copy()
    first[1:] |= start[1:] > highest[:-1]
    at = np.flatnonzero(first)
    return key[at], start[at], highest[np.append(at[1:], len(key)) - 1]


def _fetch(texts: DataFrame, found: DataFrame, model: LongRepeats, parts: int) -> DataFrame:
    """Round 2: bytes of the runs asked for; whole runs become intervals and pass on."""
    length = model.length
    width = -(-(length - model.anchor + length) // 8) * 8

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.column("kind").to_pylist() if right.num_rows else []
        blobs = right.column("blob").to_pylist() if right.num_rows else []
        rows: list[tuple[int, int, bytes]] = []
        if whole := [b for b, k in zip(blobs, kinds, strict=True) if k == WHOLE]:
            key, first, last = _join(whole)
            spans = merged(key, first, last + length - 1)
            rows.append((int(spans[0][0]) % parts, WHOLE, _dump(*spans)))
        if asked := [b for b, k in zip(blobs, kinds, strict=True) if k == ASKED]:
            name, key, place, count = _join(asked)
            own = _unpack(left)
            own = {k: v for (k, missing), v in own.items() if not missing}
            keys = np.array(sorted(own), np.int64)
            lens = np.array([len(own[k][1]) for k in keys.tolist()], np.int64)
            begin = np.concatenate(([0], np.cumsum(lens)))
            ids = np.array([own[k][0] for k in keys.tolist()], np.int64)
            data = np.frombuffer(b"".join(own[k][1] for k in keys.tolist()) + bytes(width), np.uint8)
            at = np.searchsorted(keys, key)
            for p, nm, ky, pl, ct, row in _parts(_home(name, parts), parts, name, key, place, count, at):
                context = data[(begin[row] + pl)[:, None] + np.arange(width)]
                context[np.arange(width) >= (ct.astype(np.int64) + length - 1)[:, None]] = 0
                rows.append((p, ASKED, _dump(nm, ky, ids[row], pl, ct, context.ravel())))
        return pa.Table.from_batches([_batch(rows)])

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, SCHEMA)


class SuffixFamily:
    """Suffix arrays of geometric sizes over byte strings of one length.

    A level holds distinct strings in byte order, each with the smallest doc_id that
    has it. A batch gets its own suffix array, is merge-scanned against all levels and
    joins them as the least; levels of equal size (or a smaller one above a larger)
    merge, so that their number grows with the logarithm of the number of batches.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def array(strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings in order, their smallest doc_id, and the place of each string among them."""
        keys, place = np.unique(strings, return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, place, doc)
        return keys, least, place

    def add(self, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest doc_id known for each of the batch's strings (bytes), itself included."""
        keys, own, place = self.array(strings, doc)
        least = own.copy()
        for level, docs in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            least = np.where(level[at] == keys, np.minimum(least, docs[at]), least)
        new = (keys, own)
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            new = self.merge(self.levels.pop(), new)
        self.levels.append(new)
        return least[place]

    @classmethod
    def merge(cls, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return cls.array(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))[:2]


def window_hashes(context: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of each row of bytes."""
    base = int(ODD[1])
    total = np.zeros((len(context), context.shape[1] + 1), np.uint64)
    for k in range(context.shape[1]):
        total[:, k + 1] = total[:, k] * ODD[1] + context[:, k] + np.uint64(1)
    out = total[:, length:] - total[:, :-length] * np.uint64(pow(base, length, 2**64))
    out ^= out >> np.uint64(32)
    out *= ODD[3]
    return out ^ (out >> np.uint64(29))


def match_windows(name: np.ndarray, doc: np.ndarray, count: np.ndarray, context: np.ndarray, model: LongRepeats, family: SuffixFamily | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows that also start in a document with a smaller doc_id."""
    length = model.length
    order = np.lexsort((name, doc))
    family = family or SuffixFamily()
    hashes = window_hashes(context, length)
    row, window = np.nonzero(np.arange(hashes.shape[1]) < count[:, None])
    value = hashes[row, window]
    ranked = np.sort(value)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(again):
        return row[:0], window[:0]
    at = np.minimum(np.searchsorted(again, value), len(again) - 1)
    keep = again[at] == value  # a string met once cannot be a match
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    row, window = row[keep], window[keep]
    by_doc = np.argsort(place[row], kind="stable")
    row, window = row[by_doc], window[by_doc]
    hits = np.zeros(len(row), bool)
    for s in range(0, len(row), model.batch):
        r, w = row[s : s + model.batch], window[s : s + model.batch]
        text = np.ascontiguousarray(context[r[:, None], w[:, None] + np.arange(length)])
        hits[s : s + model.batch] = family.add(text.view(f"S{length}").ravel(), doc[r]) < doc[r]
    return row[hits], window[hits]


def _suffixes(fetched: DataFrame, model: LongRepeats, parts: int, buckets: int) -> DataFrame:
    """Round 3: the suffix family of each fragment; out come intervals by bucket."""
    length = model.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, whole = [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (whole if kind == WHOLE else asked).append(blob)
        rows: list[tuple[int, int, bytes]] = []
        if whole:
            key, start, end = _join(whole)
            rows += [(b, WHOLE, _dump(*x)) for b, *x in _parts(key % buckets, buckets, key, start, end)]
        if asked:
            name, key, doc, place, count, context = _join(asked)
            asked.clear()
            order = np.argsort(name)
            edges = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
            context = context.reshape(len(name), -1)
            found = []
            # groups of whole anchors, some ten thousand runs at a time, so that memory stays small
            cuts = edges[np.unique(np.searchsorted(edges, np.arange(0, len(name), 40_000)).clip(0, len(edges) - 1))]
            cuts = np.unique(np.concatenate(([0], cuts, [len(name)])))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[s:e]
                row, window = match_windows(name[own], doc[own], count[own].astype(np.int64), context[own], model)
                start = place[own][row] + window
                found.append(merged(key[own][row], start, start + length))
            key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
            rows += [(b, WHOLE, _dump(*x)) for b, *x in _parts(key % buckets, buckets, key, start, end)]
            del context, found, order
        yield _batch(rows)
        release_memory()

    return fetched.repartitionById(parts, F.col("part")).mapInArrow(run, SCHEMA)


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, carried string"


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("carried", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int]]] = {}
        if right.num_rows:
            for k, s, e in zip(*(x.tolist() for x in merged(*_join(right.column("blob").to_pylist()))), strict=True):
                by.setdefault(k, []).append((s, e))
        ids, sizes, cuts, kept, extra = [], [], [], [], []
        for (key, missing), (doc, data, copies) in _unpack(left).items():
            own = [] if missing else by.get(key, [])
            rest = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(data)], strict=True)) if own else data
            for one in copies:
                ids.append(doc), sizes.append(len(data)), kept.append(rest), extra.append(one.decode() if one else None)
                cuts.append([{"start": s, "end": e} for s, e in own])
        return pa.table([ids, sizes, cuts, kept, extra], schema=kinds)

    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, model: LongRepeats | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans removed, bytes kept, carried) of every row of docs(doc_id, text).

    ``carried`` is a JSON object of the columns ``carry``, which so need no later join.
    """
    model = model or LongRepeats()
    parts = shuffle_partitions(docs.sparkSession)
    buckets = parts
    texts = _texts(docs, buckets, carry or [])
    found = _compare(_anchors(docs, model, parts), parts, buckets)
    spans = _suffixes(_fetch(texts, found, model, parts), model, parts, buckets)
    return _cut(texts, spans)
