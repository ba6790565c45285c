"""Arrow (Feather) files as a data source: a partition for some record batches of a file, and only the columns asked for.

The driver and the planning of a query read footers only; batches are read by the tasks that need them, in the form they come in, so no table
passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from .shards import _fs

FORMAT = "feather"
#: Rows that a partition has about, by the mean of its file.
PARTITION_ROWS = 1 << 20


def _files(path: str) -> list[str]:
    fs, root = _fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
    out = sorted(i.path for i in found if i.is_file and i.base_name[0] not in "._" and i.extension in ("feather", "arrow"))
    if not out:
        raise ValueError(f"no Arrow file at {path}")
    return out


def _open(path: str, file: str, columns: list[str] | None = None):
    source = _fs(path)[0].open_input_file(file)
    try:
        reader = ipc.open_file(source)
    except pa.ArrowInvalid as e:
        raise ValueError(f"{file} is no Arrow file (the first Feather format isn't read)") from e
    if columns is None:
        return reader
    names = reader.schema.names
    return ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns if c in names]))


@dataclass
class _Batches(InputPartition):
    file: str
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, schema: StructType):
        self.path, self.rows, self.schema = path, rows, schema

    def partitions(self):
        out = []
        for file in _files(self.path):
            reader = _open(self.path, file)
            n = reader.num_record_batches
            each = max(1, reader.get_batch(0).num_rows) if n else 1
            step = max(1, self.rows // each)
            out += [_Batches(file, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, partition):
        if partition is None:  # no batches at all
            return
        want = to_arrow_schema(self.schema)
        reader = _open(self.path, partition.file, want.names)
        for k in range(partition.first, partition.stop):
            batch = reader.get_batch(k)
            columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in want]
            yield pa.RecordBatch.from_arrays(columns, schema=want)


class ArrowFiles(DataSource):
    """format("feather"): a file, or all .feather and .arrow files under a folder, with the first one's columns (missing ones of others are null).

    Options: `columns`, the names to read, separated by commas; `partition_rows`.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        path = self.options["path"]
        whole = _open(path, _files(path)[0]).schema
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        lost = [c for c in asked if c not in whole.names]
        if lost:
            raise ValueError(f"no columns {lost} among {whole.names}")
        plain = pa.schema([f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in whole if not asked or f.name in asked])
        return from_arrow_schema(plain)

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("partition_rows", PARTITION_ROWS)), schema)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The table of Arrow files, read in partitions of record batches; with columns only these are read."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format(FORMAT).option("path", path).option("partition_rows", partition_rows)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
