"""WARC files: responses read with their own headers, written with a gzip member for each record, damage, odd payloads."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import warc


def record(kind, name, block, *lines, end=b"\r\n\r\n"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", *lines, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + end


HTTP = b"Content-Type: application/http; msgtype=response"
TRAP = b"<p>one\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc</p>"
BLOCKS = {
    b"info": (b"warcinfo", b"software: x\r\n", ()),
    b"a": (b"response", b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Own: 1\r\n\r\n<p>caf\xe9</p>", (HTTP, b"WARC-Target-URI: http://a/", b"WARC-Date: 2021-05-06T07:08:09Z", b"WARC-Payload-Digest: sha1:AAA", b"WARC-Block-Digest: sha1:BBB")),
    b"req": (b"request", b"GET / HTTP/1.1\r\n\r\n", (b"WARC-Concurrent-To: <a>",)),
    b"trap": (b"response", b"HTTP/1.1 200 OK\r\n\r\n" + TRAP, (HTTP, b"warc-target-uri:   http://b/", b"X-Folded: 1", b"\t2")),
    b"empty": (b"response", b"", (HTTP,)),
    b"bytes": (b"response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\n\xff\x00<p>x</p>", (HTTP,)),
}
ALL = [record(kind, name, block, *lines) for name, (kind, block, lines) in BLOCKS.items()]


def test_read_and_derive(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, ALL)))
    (tmp_path / "in" / "deep" / "two.warc").write_bytes(b"".join(ALL))
    (tmp_path / "in" / "deep" / "three.warc.gz").write_bytes(gzip.compress(b"".join(ALL)))
    (tmp_path / "in" / "none.warc.gz").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_bytes(b"no")
    got = warc.read_warc(spark, str(tmp_path / "in"))
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        kind, block, lines = BLOCKS[r.record_id[1:-1].encode()]
        assert bytes(r.raw) == block and r.type == "response" and r.header.startswith("WARC/1.0\r\n")
    one = {r.record_id: r for r in rows if r.file.endswith("one.warc.gz")}
    assert [one[f"<{n}>"].at for n in ("a", "trap", "empty", "bytes")] == [1, 3, 4, 5]
    assert one["<a>"].block.endswith("\r\n\r\n<p>café</p>") and one["<trap>"].target_uri == "http://b/" and one["<bytes>"].block.endswith("�\x00<p>x</p>")
    assert one["<trap>"].date is None and one["<empty>"].block == ""
    made = {(r.refers_to, r.kind): r for r in warc.derivatives(got.filter("file like '%two.warc'").withColumn("kind", F.lit("clash"))).collect()}
    assert len(made) == 8
    meta = made["<a>", "metadata"].record
    for line in ("http-status: 404", "http-header: X-Own: 1", "source-payload-digest: sha1:AAA", "source-block-digest: sha1:BBB", "WARC-Refers-To-Date: 2021-05-06T07:08:09Z"):
        assert f"{line}\r\n" in meta
    assert made["<a>", "conversion"].record.endswith("\r\n\r\ncafé") and made["<a>", "conversion"].payload_digest == "sha1:AAA"
    assert f"source-block-digest: sha256:{hashlib.sha256(BLOCKS[b'trap'][1]).hexdigest()}\r\n" in made["<trap>", "metadata"].record
    assert warc.read_warc(spark, str(tmp_path / "in"), ()).count() == 18
    (tmp_path / "void").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "void")).count() == 0


def test_a_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}/", "<p>é</p>" * (i * 400)) for i in range(40)], "page_id long, url string, html string").repartition(3)
    derived = warc.derivatives(warc.page_responses(pages))
    path = str(tmp_path / "out")
    warc.write_warc(derived, path)
    warc.write_warc(derived.filter("false"), path)
    files = list((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(f.name.endswith(".warc.gz") for f in files)
    members = 0
    for f in files:
        left = f.read_bytes()
        while left:
            engine = zlib.decompressobj(31)
            text = engine.decompress(left)
            assert engine.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            left, members = engine.unused_data, members + 1
    assert members == 80
    back = warc.read_warc(spark, path, ("metadata", "conversion")).select("type", "record_id", "refers_to", "block_digest", "block")
    want = derived.select("kind", "record_id", "refers_to", "block_digest", F.expr(r"substring(record, instr(record, '\r\n\r\n') + 4)"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="append"):
        derived.select("record").write.format("warc_files").mode("overwrite").save(path)


@pytest.mark.parametrize("ending", [b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"no record", record(b"response", b"z", b"12345", end=b"")[:-2], b"WARC/1.0\r\nContent-Le"])
def test_damage(spark, tmp_path, ending):
    (tmp_path / "x.warc").write_bytes(ALL[1] + ending)
    with pytest.raises(Exception, match="x.warc"):
        warc.read_warc(spark, str(tmp_path)).collect()
    assert [r.record_id for r in warc.read_warc(spark, str(tmp_path), damaged="skip").collect()] == ["<a>"]
    (tmp_path / "x.warc").unlink()
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(ALL[1]) + gzip.compress(ALL[3])[:-12])
    assert [r.record_id for r in warc.read_warc(spark, str(tmp_path / "y.warc.gz"), damaged="skip").collect()][:1] == ["<a>"]
