"""Media columns: documents as images in archives, read back by a Spark data source.

``write_archives`` turns texts into lossless 8-bit RGB images (PNG, 64 pixels or 192
samples a row) and appends them as members of archive files under a directory.
``ArchiveSource`` (format ``member_archive``) reads such a directory: the planner cuts
the files into byte ranges, each range reads the members that start in it, and the
payloads stream through Arrow in batches. A member whose bytes fail its checksum is
read again from its own offset, without reading others again.

An archive is a header and members, each after the file's 16-byte marker: id, whether
the id is null, bytes of the text, length and checksum of the image, image. Files count
only once the job has committed them to the manifest, so lost tasks leave no trace.

Null texts are empty; every payload is padded with spaces to a positive multiple of
192 bytes. Repeated rows become members of their own; an empty table gives an archive
without members. Columns other than doc_id and text are ignored. Very long texts are
one member each.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAGIC = b"MARC0001"
HEAD = struct.Struct("<qBqQI")
MANIFEST = "_members.json"
FORMAT = "member_archive"
BATCH_BYTES = 4_000_000
ENCODED = "doc_id long, n_bytes long, media binary"
MEMBERS = "doc_id long, n_bytes long, file string, offset long, media binary"


def pad(data: bytes) -> bytes:
    size = max(ROW, -(-len(data) // ROW) * ROW)
    return data.ljust(size, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit RGB image of the payload, 192 samples a row, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    body = np.zeros((len(rows), ROW + 1), np.uint8)
    body[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, body, shape = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("broken image chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], 3 * shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and spread of the samples, and a 64-bit hash of 64 blocks against the mean."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    edges = np.arange(64) * len(samples) // 64
    sums = np.add.reduceat(samples, edges)
    sizes = np.diff(np.append(edges, len(samples)))
    total = int(samples.sum())
    bits = sums * len(samples) > total * sizes
    spread = int((samples * samples).sum()) * len(samples) - total * total
    hashed = int("".join("1" if b else "0" for b in bits), 2)
    return f"{len(samples) // ROW}:{1000 * total // len(samples)}:{1000 * spread // len(samples) ** 2}:{hashed:016x}"


@dataclass
class _Written(WriterCommitMessage):
    file: str = ""
    size: int = 0


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name, marker, size, out = f"{uuid.uuid4().hex}.arc", uuid.uuid4().bytes, 0, None
        for batch in iterator:
            for doc, n, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(MAGIC + marker)
                    size = len(MAGIC) + len(marker)
                head = HEAD.pack(doc or 0, doc is None, n, len(media), zlib.crc32(media))
                out.write(marker + head + media)
                size += len(marker) + len(head) + len(media)
        if out is None:
            return _Written()
        out.close()
        return _Written(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        known = []
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                known = json.loads(f.read())
        files = known + [[m.file, m.size] for m in messages if m is not None and m.file]
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, attempts: int):
        self.path, self.split_bytes, self.attempts = path, split_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        return [_Range(name, at, min(size, at + self.split_bytes)) for name, size in files for at in range(0, size, self.split_bytes)]

    def member(self, store: fs.FileSystem, path: str, offset: int, marker: bytes) -> tuple[int | None, int, bytes, int]:
        """(doc_id, bytes of text, image, next offset) of the member at an offset, with its own retries."""
        problem: Exception | None = None
        for attempt in range(self.attempts):
            try:
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    head = f.read(len(marker) + HEAD.size)
                    doc, missing, n, length, check = HEAD.unpack_from(head, len(marker))
                    media = f.read(length)
                    if head[: len(marker)] != marker or len(media) != length or zlib.crc32(media) != check:
                        raise OSError(f"broken member at {path}:{offset}")
                    return (None if missing else doc), n, media, offset + len(head) + length
            except (OSError, struct.error) as e:
                problem = e
                time.sleep(0.1 * attempt)
        raise OSError(f"member at {path}:{offset} could not be read in {self.attempts} attempts") from problem

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without members has no ranges
            return
        store, root = fs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.file}"
        names = ["doc_id", "n_bytes", "file", "offset", "media"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        with store.open_input_file(path) as f:
            size = f.size()
            head = f.read(len(MAGIC) + 16)
            if head[: len(MAGIC)] != MAGIC:
                raise OSError(f"{path} is not an archive")
            marker = head[len(MAGIC) :]
            at = self.first(f, max(partition.start, len(head)), partition.end, size, marker)
            held = 0
            while at is not None and at < min(partition.end, size):
                try:
                    f.seek(at)
                    lead = f.read(len(marker) + HEAD.size)
                    doc, missing, n, length, check = HEAD.unpack_from(lead, len(marker))
                    media = f.read(length)
                    if lead[: len(marker)] != marker or zlib.crc32(media) != check:
                        raise OSError(f"broken member at {path}:{at}")
                    found = ((None if missing else doc), n, media, at + len(lead) + length)
                except (OSError, struct.error):
                    found = self.member(store, path, at, marker)
                rows.append((found[0], found[1], partition.file, at, found[2]))
                held += len(found[2])
                at = found[3]
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    @staticmethod
    def first(f: io.IOBase, start: int, end: int, size: int, marker: bytes) -> int | None:
        """The offset of the first member that starts in [start, end)."""
        step, at = 1 << 20, start
        while at < min(end, size):
            f.seek(at)
            found = f.read(step + len(marker) - 1).find(marker)
            if found >= 0:
                return at + found if at + found < end else None
            at += step
        return None


class ArchiveSource(DataSource):
    """Options: path, split_bytes (of a partition), attempts (for each member)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("split_bytes", 8 << 20)), int(self.options.get("attempts", 3)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options["path"])


def write_archives(docs: DataFrame, path: str) -> None:
    """Encode docs(doc_id, text) as images and append them to the archives under ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                media = [encode_png(pad(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs.sparkSession.dataSource.register(ArchiveSource)
    coded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ENCODED)
    coded.write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)


def with_features(members: DataFrame) -> DataFrame:
    """Decode members: doc_id, n_bytes, media, payload and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [decode_png(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(map(feature, payload), pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, ENCODED + ", payload binary, feature string")
