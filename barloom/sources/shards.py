"""Image shards: .npy files of a fixed number of windows with an appended manifest, as a data source that Spark writes and reads.

A folder holds shards/images_<number>.npy, float32 arrays (rows, channels, height, width), and manifest/, Parquet parts with a row for each window. Tasks
write to a folder of their own run; only the driver's commit moves files to their places: shards first, numbered on from the highest
there is, then the manifest parts, whose names carry the number of their first shard. Readers go by the manifest, so a run that fails, or is killed
half way through its commit, adds no row. What a task sends to the driver is three short values, not its rows.

Single rows are fetched by their place in a file: `fetch` sends (shard, idx_in_shard) pairs to the tasks that hold a shard's file open.
"""

from __future__ import annotations

import io
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "image_shards"
SHARD_ROWS = 2048
#: Columns of the manifest besides the shard, the row within it and what a writer's frame has of its own.
SHAPE = ("c", "h", "w")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is a mounted folder."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.is_file)


def shard_name(number: int) -> str:
    return f"images_{number:04d}.npy"


def _shards(fs: pafs.FileSystem, root: str) -> list[int]:
    found = (re.fullmatch(r"images_(\d+)\.npy", n) for n in _names(fs, f"{root}/shards"))
    return sorted(int(m[1]) for m in found if m)


@dataclass
class _Written(WriterCommitMessage):
    part: str
    shards: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.rows, self.run = options["path"], int(options.get("shard_rows", SHARD_ROWS)), uuid.uuid4().hex
        self.shape = tuple(int(options[k]) for k in SHAPE)
        self.meta = [f.name for f in schema.fields if f.name != "image"]
        self.schema = schema

    def write(self, batches):
        fs, root = _fs(self.path)
        part = uuid.uuid4().hex
        folder = f"{root}/_run-{self.run}"
        fs.create_dir(folder, recursive=True)
        held, tables, shards = [], [], 0

        def flush(rows):
            nonlocal shards
            table = pa.Table.from_batches(rows)
            image = table.column("image").combine_chunks()
            flat = image.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            out = io.BytesIO()
            np.save(out, flat.reshape(table.num_rows, *self.shape))
            with fs.open_output_stream(f"{folder}/{part}-{shards}.npy") as f:
                f.write(out.getbuffer())
            n = table.num_rows
            mine = table.select(self.meta)
            for name, values in (("_local", [shards] * n), ("idx_in_shard", range(n)), *((k, [v] * n) for k, v in zip(SHAPE, self.shape))):
                mine = mine.append_column(name, pa.array(values, pa.int32()))
            tables.append(mine)
            shards += 1

        n = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                some = whole.slice(at, self.rows - n)
                held.append(some)
                at, n = at + some.num_rows, n + some.num_rows
                if n == self.rows:
                    flush(held)
                    held, n = [], 0
        if n:
            flush(held)
        if tables:
            pq.write_table(pa.concat_tables(tables), f"{folder}/{part}.parquet", filesystem=fs)
        return _Written(part, shards)

    def commit(self, messages):
        fs, root = _fs(self.path)
        done = [m for m in messages if m is not None and m.shards]  # in the order of the partitions
        fs.create_dir(f"{root}/shards", recursive=True)
        fs.create_dir(f"{root}/manifest", recursive=True)
        number, parts = max(_shards(fs, root), default=-1) + 1, []
        for m in done:
            parts.append((m.part, number))
            for k in range(m.shards):
                fs.move(f"{root}/_run-{self.run}/{m.part}-{k}.npy", f"{root}/shards/{shard_name(number + k)}")
            number += m.shards
        for part, first in parts:
            fs.move(f"{root}/_run-{self.run}/{part}.parquet", f"{root}/manifest/from-{first}-{part}.parquet")
        if not _names(fs, f"{root}/manifest"):  # no row yet: the columns at least
            whole = to_arrow_schema(self.schema)
            fields = [*(whole.field(c) for c in self.meta), *(pa.field(c, pa.int32()) for c in ("_local", "idx_in_shard", *SHAPE))]
            pq.write_table(pa.schema(fields).empty_table(), f"{root}/manifest/from-0-{uuid.uuid4().hex}.parquet", filesystem=fs)
        self.abort(messages)

    def abort(self, messages):
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_run-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_run-{self.run}")


@dataclass
class _Shard(InputPartition):
    number: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        fs, root = _fs(self.path)
        return [_Shard(k) for k in _shards(fs, root)]

    def read(self, partition):
        for idx, image in _rows(self.path, partition.number, None) if partition is not None else ():
            yield partition.number, idx, image.ravel().tolist()


class ImageShards(DataSource):
    """format("image_shards"): reads (shard, idx_in_shard, image) of every shard file; appends rows with an `image` of c * h * w floats."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "shard int, idx_in_shard int, image array<float>"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("shards are appended; write to a new folder to begin anew")
        return _Writer(self.options, schema)


def _rows(path: str, number: int, wanted):
    """(idx, array) of a shard's rows, all or the wanted ones, each read from its own place in the file."""
    fs, root = _fs(path)
    with fs.open_input_file(f"{root}/shards/{shard_name(number)}") as f:
        version = np.lib.format.read_magic(f)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start, size = f.tell(), int(np.prod(shape[1:])) * dtype.itemsize
        for idx in range(shape[0]) if wanted is None else wanted:
            if 0 <= idx < shape[0]:
                yield idx, np.frombuffer(f.read_at(size, start + idx * size), dtype).reshape(shape[1:])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageShards)


def write_shards(images: DataFrame, path: str, channels: tuple[str, ...], side: int, shard_rows: int = SHARD_ROWS) -> None:
    """Append images (with a column of side * side floats for each channel, and any others for the manifest) to the shards at path.

    A partition fills shards of `shard_rows` rows, the last one with what is left, in the order of its rows; a task holds one shard. Rows
    without some channel are left out. The folder must be one that all executors reach.
    """
    register(images.sparkSession)
    meta = [c for c in images.columns if c not in channels]
    whole = images.filter(" and ".join(f"`{c}` is not null" for c in channels))
    rows = whole.select(*meta, F.concat(*[F.col(c).cast("array<float>") for c in channels]).alias("image"))
    out = rows.write.format(FORMAT).mode("append").option("path", path).option("shard_rows", shard_rows)
    for k, v in zip(SHAPE, (len(channels), side, side)):
        out = out.option(k, v)
    out.save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows with `shard` and `relpath`."""
    parts = spark.read.option("mergeSchema", "true").parquet(f"{path}/manifest")
    first = F.regexp_extract(F.col("_metadata.file_name"), r"^from-(\d+)-", 1).cast("int")
    rows = parts.withColumn("shard", first + F.col("_local")).drop("_local")
    return rows.withColumn("relpath", F.format_string("shards/images_%04d.npy", "shard"))


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (shard, idx_in_shard, ...) with `image`, `c`, `h`, `w`: each row read from its place in its shard; rows of no shard go.

    Rows are dealt by shard and stretch of a shard, so a file is opened by few tasks and a shard that is asked for much by several.
    """
    spark = wanted.sparkSession
    fs, root = _fs(path)
    known = spark.createDataFrame([(k,) for k in _shards(fs, root)], "shard int")  # a row for each file
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields]
    shard, idx = wanted.columns.index("shard"), wanted.columns.index("idx_in_shard")
    names = [*wanted.columns, "image", *SHAPE]

    def read(batches):
        for batch in batches:
            at, images, shapes = [], [], []
            numbers, places = batch.column(shard).to_numpy(), batch.column(idx).to_numpy()
            for number in np.unique(numbers):
                mine = np.flatnonzero(numbers == number)
                mine = mine[np.argsort(places[mine], kind="stable")]
                by = {i: a for i, a in _rows(path, int(number), sorted(set(places[mine].tolist())))}
                for k in mine:
                    if places[k] in by:
                        at.append(k), images.append(by[places[k]].ravel()), shapes.append(by[places[k]].shape)
            part = batch.take(pa.array(at, pa.int64()))
            flat = pa.array(np.concatenate(images) if images else np.empty(0, np.float32), pa.float32())
            cuts = pa.array(np.cumsum([0, *map(len, images)]), pa.int32())
            shape = np.array(shapes, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, flat), *(pa.array(shape[:, k]) for k in range(3))], names=names)

    dealt = wanted.filter("idx_in_shard is not null").join(known, "shard", "left_semi").select(*wanted.columns)
    dealt = dealt.repartition("shard", F.floor(F.col("idx_in_shard") / 256)).sortWithinPartitions("shard", "idx_in_shard")
    return dealt.mapInArrow(read, ", ".join([*columns, "image array<float>", *(f"{k} int" for k in SHAPE)]))
