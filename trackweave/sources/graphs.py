"""Graphs and detections on storage: Parquet, a text format for graphs, text files of detections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    arcs.write.mode("overwrite").parquet(f"{path}/arcs")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")


def write_lgf(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """Text files that make one file in the graph format if put one after the other.

    A section of nodes(node, timestep[, traxel]) and one of arcs(src, dst) with the
    frames of both ends. Written in parallel; arc labels are distinct and rise.
    """
    held = ["traxel"] if "traxel" in nodes.columns else []
    line = lambda *cells: F.concat(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), "\t"), F.lit("\t"))
    frame = lambda end: nodes.select(F.col("node").alias(end), F.col("timestep").alias(f"{end}_t"))
    placed = arcs.select("src", "dst").join(frame("src"), "src", "left").join(frame("dst"), "dst", "left")
    zero = F.lit(0).cast("long")
    heads = nodes.sparkSession.createDataFrame([(0, "@nodes"), (1, "\t".join(["label", "timestep", *held, ""])), (3, "@arcs"), (4, "\t\tlabel\tfrom_timestep\tto_timestep\t")], "part int, line string")
    rows = nodes.select(F.lit(2).alias("part"), F.col("node").cast("long").alias("a"), zero.alias("b"), line(F.col("node"), F.col("timestep"), *map(F.col, held)).alias("line"))
    label = F.monotonically_increasing_id()
    links = placed.select("src", "dst", line(F.col("src"), F.col("dst"), label, F.col("src_t"), F.col("dst_t")).alias("line"))
    rows = rows.unionByName(links.select(F.lit(5).alias("part"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), "line"))
    rows = rows.unionByName(heads.select("part", zero.alias("a"), zero.alias("b"), "line"))
    rows.orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)


def read_lgf(spark: SparkSession, path: str, traxels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, timestep[, traxel]), arcs(src, dst)) of a file or a folder in that format.

    Every line tells by its number of cells what it is, so files of any size are read in
    parallel.
    """
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.rlike(F.get("c", F.lit(0)), F.lit("^-?[0-9]+$")))
    cell = lambda k, kind, name: F.get("c", F.lit(k)).cast(kind).alias(name)
    more = [cell(2, "long", "traxel")] if traxels else []
    nodes = cells.where(F.size("c") <= 4).select(cell(0, "long", "node"), cell(1, "int", "timestep"), *more)
    return nodes, cells.where(F.size("c") > 4).select(cell(0, "long", "src"), cell(1, "long", "dst"))


class TextDetections(DataSource):
    """Format ``text_detections``: lines ``timestep id key=v,v,... key=v,...``; files are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "text_detections"

    def schema(self) -> str:
        return "timestep int, id long, features map<string,array<float>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TextReader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, place = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                if line.strip():
                    t, i, *rest = line.split()
                    yield int(t), int(i), {k: [float(x) for x in v.split(",") if x] for k, _, v in (r.partition("=") for r in rest)}


def write_text_detections(rows: DataFrame, path: str) -> None:
    """One line a detection, as many files as there are partitions."""
    pairs = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: v.cast("string")), ",")))
    rows.select(F.concat_ws(" ", F.col("timestep").cast("string"), F.col("id").cast("string"), F.array_join(pairs, " "))).write.mode("overwrite").text(path)


#: What a text archive starts with, and how it writes a detection up to its
#: features (number, id, frame, number of features), the first one and others, and the scales of its position.
ARCHIVE_HEAD = "22 serialization::archive 9 0 2 {} 0 0 0 0 "
ARCHIVE_FIRST = r"22 serialization::archive [0-9]+ [0-9]+ [0-9]+ [0-9]+ 0 0 0 ([0-9]+) ([0-9]+) (-?[0-9]+) 0 0 ([0-9]+) 0 (?:0 0 )?"
ARCHIVE_DETECTION = r"([0-9]+) ([0-9]+) (-?[0-9]+) ([0-9]+) 0 "
ARCHIVE_LOCATOR = r"([0-9]+) (?:0 0 )?([^ ]+) ([^ ]+) ([^ ]+) [0-9]+ ([^ ]+)"
#: Which values of a feature are its position.
POSITIONS = {"com": 0, "com_corrected": 0, "intmaxpos": 1}
ARCHIVED = "file string, number long, timestep int, id long, features map<string,array<float>>, scale array<double>, locator string"


def archived(line: str) -> tuple | None:
    """(number, timestep, id, features, scale, locator) of a line: a detection or, with null features, its locator."""
    if found := re.match(ARCHIVE_FIRST, line) or re.match(ARCHIVE_DETECTION, line):
        number, id_, timestep, many = map(int, found.groups())
        at, features = found.end(), {}
        for _ in range(many):  # the length says where a name ends, so any name can be read
            length, _, rest = line[at:].partition(" ")
            name = rest[: int(length)]
            at += len(length) + 1 + int(length) + 1
            n = line[at:].partition(" ")[0]
            at += len(n) + 3  # a version, 0, stands before the values
            values = line[at:].split(" ", int(n))[: int(n)]
            at += sum(map(len, values)) + len(values)
            features[name] = [float(x) for x in values]
        # the locator's number is one more, but for the first
        return number + (number > 0), timestep, id_, features, None, None
    if found := re.match(ARCHIVE_LOCATOR, line):
        number, *scale, name = found.groups()
        return int(number), None, None, None, [float(x) for x in scale], name
    return None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Detections (timestep, id, features, locator, scale, x, y, z) of text archives, positions scaled as they say.

    A detection's line is followed by that of its locator; both carry numbers that belong
    together, so lines of large files can be read apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *found) for file, line in zip(*map(pa.Array.to_pylist, batch.columns), strict=True) if (found := archived(line))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            features = pa.array([None if x is None else list(x.items()) for x in columns[4]], pa.map_(pa.string(), pa.list_(pa.float32())))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), None, pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([features if kind is None else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [x.split()[0] for x in ARCHIVED.split(", ")])

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    found = lines.mapInArrow(run, ARCHIVED)
    # both lines of a detection in one row
    whole = found.groupBy("file", "number").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("timestep", "id", "features", "locator", "scale")]).where("features IS NOT NULL")
    start = F.coalesce(*[F.when(F.col("locator") == n, F.lit(k)) for n, k in POSITIONS.items()], F.lit(0))
    value = lambda k: F.get(F.col("features")[F.col("locator")], start + k).cast("double") * F.get("scale", F.lit(k))
    return whole.select("timestep", "id", "features", "locator", "scale", *[value(k).alias(axis) for k, axis in enumerate("xyz")])


def write_archive(rows: DataFrame, path: str, files: int = 1) -> None:
    """Text archives of rows(timestep, id, features[, locator, scale]), each detection in one of ``files`` files by hash.

    Without a locator positions are ``com``, without scales they are 1.
    """
    locator = F.coalesce(F.col("locator"), F.lit("com")) if "locator" in rows.columns else F.lit("com")
    scale = F.coalesce(F.col("scale"), F.array(*[F.lit(1.0)] * 3)) if "scale" in rows.columns else F.array(*[F.lit(1.0)] * 3)
    written = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    text = lambda name: F.concat_ws(" ", F.length(name).cast("string"), name)
    pair = lambda e: F.concat_ws(" ", text(e["key"]), F.size(e["value"]).cast("string"), F.lit("0"), F.when(F.size(e["value"]) > 0, F.array_join(F.transform(e["value"], written), " ")))
    features = F.array_join(F.transform(F.array_sort(F.map_entries("features")), pair), " ")  # empty values leave no gap
    file = F.pmod(F.xxhash64("timestep", "id"), F.lit(files)).cast("int")
    placed = rows.select(file.alias("file"), "timestep", "id", features.alias("f"), F.size("features").cast("string").alias("n"), locator.alias("l"), F.array_join(F.transform(scale, written), " ").alias("s"))
    of = Window.partitionBy("file")
    placed = placed.withColumns({"r": F.row_number().over(of.orderBy("timestep", "id")), "all": F.count(F.lit(1)).over(of)})
    first, number = F.col("r") == 1, 2 * F.col("r") - 3
    key = lambda *more: F.concat_ws(" ", *[c if isinstance(c, Column) else F.lit(c) for c in more])
    id_, t = F.col("id").cast("string"), F.col("timestep").cast("string")
    before, after = ARCHIVE_HEAD.split("{}")
    head = F.concat(F.lit(before), F.col("all").cast("string"), F.lit(after), key(id_, t, "0 0", F.col("n"), "0 0 0", F.col("f"), "3 1 0"))
    line = F.when(first, head).otherwise(key(number.cast("string"), id_, t, F.col("n"), "0", F.col("f"), "3"))
    where = F.when(first, key("0 0 0", F.col("s"), text(F.col("l")), "1 0")).otherwise(key((number + 1).cast("string"), F.col("s"), text(F.col("l"))))
    lines = placed.select("file", "r", F.posexplode(F.array(line, where)).alias("p", "value"))
    lines.repartition(files, "file").sortWithinPartitions("file", "r", "p").select("file", "value").write.partitionBy("file").text(path)
