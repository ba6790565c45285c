"""WARC files as a data source: one partition a file, one record at a time by its Content-Length; written with one gzip member for each record.

Reading never holds more than a record, so a file's size bounds nothing, and record boundaries are those of the headers, whatever the
payload holds. Members of a compressed file may hold one record or several. Tasks write to a folder of their own run; the
driver's commit moves whole files to their places, so a run that fails adds none, and a task that is run again none twice. Paths are those of
pyarrow's file systems; a path without a scheme is a folder that all executors reach.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "warc_files"
CRLF = b"\r\n"
SCHEMA = (
    "file string, at long, type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, block_digest string, header string, block string, raw binary"
)
#: Columns of a record and the header fields they are read from.
NAMED = {
    "type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "block_digest": "warc-block-digest",
}
#: A header longer than this is taken for damage.
LONGEST_HEADER = 1 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


class _Members(io.RawIOBase):
    """The bytes of a gzip file of any number of members, from a stream, a piece at a time."""

    def __init__(self, source):
        self.source, self.engine, self.left = source, None, b""

    def readable(self):
        return True

    def readinto(self, into):
        while True:
            piece, self.left = self.left or self.source.read(1 << 16), b""
            if not piece:
                if self.engine is not None:
                    raise EOFError("the last member is cut short")
                return 0
            self.engine = self.engine or zlib.decompressobj(31)
            out = self.engine.decompress(piece, len(into))
            if self.engine.eof:
                self.left, self.engine = self.engine.unused_data, None
            else:
                self.left = self.engine.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)


def _head(stream) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header as it stands and its fields in lower case, the first of each name; None at the end."""
    line = stream.readline(LONGEST_HEADER)
    while line in (b"\r\n", b"\n"):
        line = stream.readline(LONGEST_HEADER)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no record begins here")
    lines, size, fields, last = [line], len(line), {}, None
    while True:
        line = stream.readline(LONGEST_HEADER)
        size += len(line)
        if not line.endswith(b"\n") or size > LONGEST_HEADER:
            raise ValueError("the header does not end")
        if line in (b"\r\n", b"\n"):
            return b"".join(lines), fields
        lines.append(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        if last in fields:
            last = None
        else:
            fields[last] = value.strip()


def _decoded(block: bytes, content_type: str | None) -> str:
    """A block as text: an HTTP payload by the charset that its head names, everything else and unknown charsets as UTF-8."""
    head, gap, payload = block.partition(CRLF + CRLF)
    if not (content_type or "").lower().startswith("application/http") or not gap:
        return block.decode("utf-8", "replace")
    named = re.search(rb"(?im)^content-type:[^\r\n]*charset=[\"']?([a-z0-9_.:-]+)", head)
    try:
        text = payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    return head.decode("utf-8", "replace") + "\r\n\r\n" + text


def records(stream, kinds: frozenset[str] = frozenset()):
    """(place, fields, header, block) of each record of a stream of plain bytes, or of those of some types; others are passed over."""
    at = 0
    while (head := _head(stream)) is not None:
        header, fields = head
        if not re.fullmatch(r"\d+", fields.get("content-length", "")):
            raise ValueError(f"record {at} has no length")
        size = int(fields["content-length"])
        if not kinds or fields.get("warc-type", "").lower() in kinds:
            block = stream.read(size)
            got = len(block)
        else:
            block, got = None, 0
            while got < size and (piece := stream.read(min(size - got, 1 << 20))):
                got += len(piece)
        if got < size:
            raise ValueError(f"record {at} is cut short")
        if block is not None:
            yield at, fields, header, block
        at += 1


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kinds = frozenset(k.strip().lower() for k in options.get("types", "").split(",") if k.strip())
        self.skip = options.get("damaged", "fail") == "skip"

    def partitions(self):
        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_File(root)]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: -(i.size or 0)) if i.is_file and re.search(r"\.warc(\.gz)?$", i.base_name) and "/_run-" not in i.path]

    def read(self, partition):
        if partition is None:
            return
        fs, _ = _fs(self.path)
        with fs.open_input_stream(partition.path, compression=None) as source:
            stream = io.BufferedReader(_Members(source) if partition.path.endswith(".gz") else source, 1 << 16)
            try:
                for at, fields, header, block in records(stream, self.kinds):
                    named = [fields.get(n) for n in NAMED.values()]
                    yield (partition.path, at, *named, header.decode("utf-8", "replace"), _decoded(block, fields.get("content-type")), block)
            except (ValueError, EOFError, zlib.error) as e:
                if not self.skip:
                    raise ValueError(f"{partition.path}: {e}") from e


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options, schema):
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.gzip = options.get("compression", "gzip") == "gzip"
        if "record" not in schema.fieldNames():
            raise ValueError("a column `record` with whole records is needed")

    def write(self, rows):
        fs, root = _fs(self.path)
        out, name = None, f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
        for row in rows:
            if row["record"] is None:
                continue
            if out is None:
                fs.create_dir(f"{root}/_run-{self.run}", recursive=True)
                out = fs.open_output_stream(f"{root}/_run-{self.run}/{name}", compression=None)
            record = row["record"].encode() if isinstance(row["record"], str) else bytes(row["record"])
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            whole = record + CRLF + CRLF
            out.write(engine.compress(whole) + engine.flush() if self.gzip else whole)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/_run-{self.run}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_run-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_run-{self.run}")


class WarcFiles(DataSource):
    """format("warc_files"): reads and appends .warc and .warc.gz files."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are appended; write to a new folder to begin anew")
        return _Writer(self.options, schema)


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("response",), damaged: str = "fail") -> DataFrame:
    """The records of the WARC files at path (a file, or a folder with all below it), those of `types` only (empty: all).

    file and at say where a record is (its number in the file, from 0); header is its header as it stands, raw its block, block the same as text: an
    HTTP payload by its charset, anything else as UTF-8, with U+FFFD for what cannot be read. Fields that a record lacks are null. Records
    with equal fields stay as often as they are there. A file in which a record is cut short, or has no length, fails, or with damaged="skip" gives the records
    before that place. A folder without files gives an empty table. The columns are what `derivatives` takes.
    """
    spark.dataSource.register(WarcFiles)
    return spark.read.format(FORMAT).option("types", ",".join(types)).option("damaged", damaged).load(path)


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Append the records (column `record`, string or binary, without the closing line ends) as files, one for each partition; null ones are left out."""
    derived.sparkSession.dataSource.register(WarcFiles)
    derived.select("record").write.format(FORMAT).mode("append").option("compression", compression).save(path)
