"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Both derivatives are computed from the response's own row with built-in functions, so the operator is one narrow
pass: nothing is shuffled, a lost executor costs its own partitions, and memory is bounded by one record.
Identifiers are name-based (a hash of the source identifier and the kind), so reruns and retries
write equal records.

    responses: record_id, target_uri, date, block [, payload_digest, block_digest]
    derived:   kind, record_id, refers_to, target_uri, date, payload_digest, block_digest, content_length, record

`block` is an HTTP response: status line, header lines, an empty line, payload. `record` is a whole WARC/1.1
record without its two closing line ends; `warcfiles` adds those when it writes, and reads responses from WARC files.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .warcfiles import read_warc, write_warc  # noqa: F401  (the sources and sinks of this operator)

CRLF = "\r\n"
#: Elements that end a line of text.
BLOCKS = "p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|section|aside|main|header|footer|nav|title|blockquote|pre|form"
#: (pattern, replacement), in order: what isn't text, line ends, other tags.
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script[ \t\r\n\f]*>|<style[^>]*>.*?</style[ \t\r\n\f]*>"
BREAKS = rf"(?i)</?(?:{BLOCKS})(?:[ \t\r\n\f/][^>]*)?>"
TAGS = r"</?[a-zA-Z!?][^>]*>"
#: Character references and links as the SQL knows them; the ampersand comes last. The operator resolves these and more.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
LINK = r'(?i)<a[ \t\r\n\f][^>]*?href[ \t]*=[ \t]*"([^"]*)"'
#: Named references (with a semicolon), the frequent ones first, and numbers that stand for other characters (as HTML has it).
NAMED = {e[1:-1]: c for e, c in ENTITIES if e[1] != "#"} | {n[:-1]: c for n, c in sorted(html5.items()) if n.endswith(";") and n != "nbsp;"}
C1 = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
RENUMBERED = {160: " "} | {n: c for n, c in C1.items() if c != "\ufffd"}
#: White space in a tag, an attribute other than href, and a link: its value is quoted either way or not at all. Possessive, so
#: time and stack stay small.
WS = r"[ \t\r\n\f]"
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\r\n\f"'>][^ \t\r\n\f>]*+)"""
NAME = r"[^ \t\r\n\f/>][^ \t\r\n\f/>=]*+"
HREF = rf"(?i)<a(?=[ \t\r\n\f/])(?:[ \t\r\n\f/]*+(?!href{WS}*+=){NAME}(?:{WS}*+={WS}*+{VALUE})?+)*+[ \t\r\n\f/]*+href{WS}*+={WS}*+({VALUE})"


#: A reference beyond the frequent ones of ENTITIES.
RARE = f"&(?!(?:{'|'.join(e[1:-1] for e, _ in ENTITIES)});)[#a-zA-Z][a-zA-Z0-9]*;"


def once(value: Column, use) -> Column:
    """use(value), where value is computed a single time however often use names it."""
    return F.transform(F.array(value), use)[0]


def resolved(text: Column) -> Column:
    """Text with its character references resolved once, from left to right; unknown ones stay as they are."""

    def frequent(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(name), F.lit(char))
        return t

    return once(text, lambda t: F.when(F.regexp_like(t, F.lit(RARE)), all_resolved(t)).otherwise(frequent(t)))


def all_resolved(text: Column) -> Column:
    table = F.str_to_map(F.lit("\x02".join(f"{n}\x01{c}" for n, c in NAMED.items())), F.lit("\x02"), F.lit("\x01"))
    renumbered = F.create_map(*[F.lit(x) for pair in RENUMBERED.items() for x in pair])

    def number(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+", "")
        n = F.when(F.length(short) <= 7, F.conv(F.concat(F.lit("0"), short), base, 10).cast("int")).otherwise(F.lit(0))
        n = F.when((n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)
        return F.coalesce(renumbered[n], F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"\A(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        char = (
            F.when(F.regexp_like(name, F.lit("^#[0-9]")), number(F.substring(name, F.lit(2), F.length(name)), 10))
            .when(F.startswith(name, F.lit("#")), number(F.substring(name, F.lit(3), F.length(name)), 16))
            .when(name != "", table[name])
        )
        return F.coalesce(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    return once(F.split(text, "&"), lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), one), "")))


def outlinks(html: Column) -> Column:
    """The href of each anchor as it is written, without its quotes."""
    bare = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), bare)


def html_text(html: Column) -> Column:
    """Visible text: one line for each block element, runs of blanks as one, no empty lines."""
    t = F.regexp_replace(html, HIDDEN, " ")
    t = F.regexp_replace(t, BREAKS, "\n")
    t = F.regexp_replace(t, TAGS, "")
    t = F.regexp_replace(resolved(t), r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def name_id(*parts: Column) -> Column:
    """A record identifier made from a name: the same parts give the same identifier."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def http_block(payload: Column, content_type: str = "text/html; charset=utf-8") -> Column:
    """An HTTP response around a payload; null counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF), body)


def derivatives(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response: its `metadata` and its `conversion` record, after the columns named in carry.

    Both refer to the source (WARC-Refers-To with its target and date) and hold the digest of its payload as given, or as
    computed where the source has none; the same holds for the block's digest in the metadata. The metadata record's fields keep the source's status, header lines,
    digests and links. A null block counts as empty, a block without an empty line as head only; a null
    identifier gives derivatives named after an empty one, without WARC-Refers-To; null targets and dates leave their
    lines out. Repeated responses give equal records as often as they come in. An empty table gives an empty one;
    other columns of responses are not looked at.
    """
    given = lambda c: F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string")
    block = F.coalesce(F.col("block"), F.lit(""))
    at = F.instr(block, CRLF + CRLF)
    rows = responses.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)],
        F.col("record_id").alias("_id"), F.col("target_uri").alias("_uri"), F.col("date").alias("_date"), given("payload_digest").alias("_given"), given("block_digest").alias("_given_block"), block.alias("_block"),
        F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(block).alias("_head"),
        F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(F.lit("")).alias("_payload"),
    )
    rows = rows.withColumns({"_pd": F.coalesce("_given", digest(F.col("_payload"))), "_lines": F.split("_head", CRLF)})
    head = F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))
    many = lambda name, values: F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))), "")
    fields = F.concat(
        _line("http-status", F.nullif(F.regexp_extract("_head", r"^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit(""))),
        many("http-header", head),
        _line("source-payload-digest", F.col("_pd")),
        _line("source-block-digest", F.coalesce("_given_block", digest(F.col("_block")))),
        _line("source-payload-length", F.octet_length("_payload").cast("string")),
        many("outlink", outlinks(F.col("_payload"))),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("type"), html_text(F.col("_payload")).alias("content")),
    )
    keys = [f"_k{i}" for i in range(len(carry))]
    out = rows.select(*keys, "_id", "_uri", "_date", "_pd", F.explode(made).alias("d"))
    out = out.select(*keys, "_id", "_uri", "_date", "_pd", "d.*").withColumns(
        {"_new": name_id(F.coalesce("_id", F.lit("")), F.col("kind")), "_bd": digest(F.col("content")), "_size": F.octet_length("content").cast("long")}
    )
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", F.col("_new")),
        _line("WARC-Refers-To", F.col("_id")),
        _line("WARC-Refers-To-Target-URI", F.col("_uri")),
        _line("WARC-Refers-To-Date", F.col("_date")),
        _line("WARC-Target-URI", F.col("_uri")),
        _line("WARC-Date", F.col("_date")),
        _line("WARC-Payload-Digest", F.col("_pd")),
        _line("WARC-Block-Digest", F.col("_bd")),
        _line("Content-Type", F.col("type")),
        _line("Content-Length", F.col("_size").cast("string")),
    )
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, carry)],
        "kind", F.col("_new").alias("record_id"), F.col("_id").alias("refers_to"), F.col("_uri").alias("target_uri"), F.col("_date").alias("date"),
        F.col("_pd").alias("payload_digest"), F.col("_bd").alias("block_digest"), F.col("_size").alias("content_length"),
        F.concat(header, F.lit(CRLF), "content").alias("record"),
    )


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html), named after page and address, with page_id kept."""
    name = name_id(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.lit("response"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http_block(F.col("html")).alias("block"))


def _sql(text: str) -> str:
    """A SQL string literal; line ends are written as chr() calls."""
    parts = text.replace("'", "''").replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'")
    return f"('{parts}')"


_UUID = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
for _name, _char in ENTITIES:
    _TEXT = f"replace({_TEXT}, {_sql(_name)}, {_sql(_char)})"
_TEXT = f"trim(regexp_replace(regexp_replace({_TEXT}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
_N = "chr(13) || chr(10)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|response') AS h
  FROM pages
), r AS (
  SELECT page_id, url, html, {_UUID} AS id, '2024-01-01T00:00:00Z' AS d,
         'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || strlen(html) AS h2
  FROM p
), s AS (
  SELECT *, 'sha256:' || sha256(html) AS pd,
         'sha256:' || sha256('HTTP/1.1 200 OK' || {_N} || h1 || {_N} || h2 || {_N} || {_N} || html) AS sd
  FROM r
), c AS (
  SELECT page_id, url, id, d, pd, 'metadata' AS kind, 'application/warc-fields' AS type,
         'http-status: 200' || {_N} || 'http-header: ' || h1 || {_N} || 'http-header: ' || h2 || {_N}
         || 'source-payload-digest: ' || pd || {_N} || 'source-block-digest: ' || sd || {_N}
         || 'source-payload-length: ' || strlen(html) || {_N}
         || list_aggregate(list_transform(regexp_extract_all(html, '{LINK}', 1), lambda x: 'outlink: ' || x || {_N}) || [''], 'string_agg', '') AS content
  FROM s
  UNION ALL
  SELECT page_id, url, id, d, pd, 'conversion', 'text/plain', {_TEXT} FROM s
), n AS (
  SELECT *, md5(id || '|' || kind) AS h, 'sha256:' || sha256(content) AS bd, strlen(content)::BIGINT AS size FROM c
), m AS (SELECT *, {_UUID} AS rid FROM n)
SELECT page_id, kind, rid AS record_id, id AS refers_to, url AS target_uri, d AS date, pd AS payload_digest,
       bd AS block_digest, size AS content_length,
       'WARC/1.1' || {_N} || 'WARC-Type: ' || kind || {_N} || 'WARC-Record-ID: ' || rid || {_N}
       || 'WARC-Refers-To: ' || id || {_N} || coalesce('WARC-Refers-To-Target-URI: ' || url || {_N}, '')
       || 'WARC-Refers-To-Date: ' || d || {_N} || coalesce('WARC-Target-URI: ' || url || {_N}, '') || 'WARC-Date: ' || d || {_N}
       || 'WARC-Payload-Digest: ' || pd || {_N} || 'WARC-Block-Digest: ' || bd || {_N} || 'Content-Type: ' || type || {_N}
       || 'Content-Length: ' || size || {_N} || {_N} || content AS record
FROM m
"""
