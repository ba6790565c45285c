"""Ranked lexical search over a two-level quantised index.

The index holds one row for each document with a term that some query asks for: its length, those terms, how often each occurs (the second
level, for exact scores) and, for each, its impact rounded up to one byte (the first level). A search goes over blocks of documents: summed
bytes give an upper bound of every document's score for every query, and byte minus one a lower bound. The k-th highest lower bound (or
exact score found so far) is what a document must reach with its upper bound; all that do are rescored exactly in whole numbers, so ties
at the k-th place are decided by the scores and ids themselves.

The score of a document is the sum over a query's terms of w * ((S * tf) div (1000 * tf + 12 * m)), where S is `SCALE`, w falls with the number of documents
that hold the term and m grows with the document's length. An impact is below S / 1000, so `STEP` is the same for all terms.

Scale: the texts are read once, in a narrow pass. The index is laid out by document: no list of a frequent word is gathered anywhere, and
a task gives at most k rows for each query whatever it reads. Numbers over all documents are map-side combined counts. Queries are taken in blocks, so what is
broadcast (their terms and weights) is bounded; a block of more terms than `BLOCK_TERMS` is one query that has them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import release, small_batches, staged

#: Results for a query, and the scale of impacts.
TOP, SCALE = 20, 1_000_000_000
#: Width of a step of the byte impacts: 255 of them reach beyond the highest impact.
STEP = -(-(SCALE // 1000) // 255)
#: Queries and distinct terms of a block of queries.
BLOCK_QUERIES, BLOCK_TERMS = 512, 1 << 17
#: Pairs of a posting and a query, and documents, of a block; bytes of a stretch of a long text.
BLOCK_PAIRS, BLOCK_DOCS, STRETCH = 1 << 20, 1024, 1 << 20

#: For bytes.translate: letters and digits (A-Z lowered) and all bytes of other characters stay, the rest become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(data: bytes):
    """Lists of the terms of a UTF-8 text, a stretch at a time."""
    clean, at = data.translate(TERM_BYTES), 0
    while len(clean) - at > STRETCH:
        stop = clean.find(b" ", at + STRETCH)
        if stop < 0:
            break
        yield clean[at:stop].split()
        at = stop
    yield clean[at:].split()


def term_counts(data: bytes) -> Counter:
    out = Counter()
    for part in terms(data):
        out.update(part)
    return out


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (q, item, term, times): the terms of each row of queries; q numbers the rows that have any. Rows that share an id are queries of their own."""

    def count(batches):
        for batch in batches:
            for item, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    found = term_counts(text.encode())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(found), pa.int64()), pa.array([item] * len(found), batch.column(0).type), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                        names=["row", "item", "term", "times"],
                    )

    kind = queries.schema[id_col].dataType.simpleString()
    rows = staged(queries.select(F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string")), "queries")
    return staged(rows.mapInArrow(tk.tidy(count), f"row long, item {kind}, term binary, times long"), "query-terms")


def query_blocks(asked: DataFrame):
    """(rows from, rows to) of queries in blocks of at most BLOCK_QUERIES queries and, unless it is one, BLOCK_TERMS terms.

    A running sum over one short row for each query says where blocks end.
    """
    start, size, terms_held, last = None, 0, 0, None
    for r in asked.groupBy("row").agg(F.count("*").alias("n")).orderBy("row").toLocalIterator():
        if size and (size == BLOCK_QUERIES or terms_held + r.n > BLOCK_TERMS):
            yield start, last
            start, size, terms_held = None, 0, 0
        start = r.row if start is None else start
        size, terms_held, last = size + 1, terms_held + r.n, r.row
    if size:
        yield start, last


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, terms, tfs) for each document with a term: how many it has, and which of the vocabulary (as numbers, ascending) how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of queries

    def build(batches):
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for a, z, data, off in tk.slices(batch.column(1)):
                raw = data.tobytes()
                row, size, found = [], [], []
                for k in range(z - a):
                    held, n = Counter(), 0
                    for part in terms(raw[off[k] : off[k + 1]]):
                        n += len(part)
                        held.update(map(number.get, part))
                    if n:
                        held.pop(None, None)
                        row.append(a + k)
                        size.append(n)
                        found.append(sorted(held.items()))
                cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                flat = np.array([p for f in found for p in f], np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(flat[:, k], t)) for k, t in ((0, pa.int32()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(size, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(tk.tidy(build), f"id {kind}, n long, terms array<int>, tfs array<long>")


def length_factor(n, docs, words):
    """m of a document with n terms, among `docs` documents with `words` terms together."""
    return 100 - 25 + (25 * n * docs) // words


def impact(tf, m):
    """What one occurrence count is worth, before the term's weight."""
    return (SCALE * tf) // (1000 * tf + 12 * m)


def quantised(index: DataFrame, docs: int, words: int) -> DataFrame:
    """The index with `impacts`: for each of a document's terms, its impact rounded up to a byte."""

    def level(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            tfs = batch.column("tfs")
            m = np.repeat(length_factor(n, docs, words), tfs.value_lengths().to_numpy())
            byte = -(-impact(tfs.flatten().to_numpy(), m) // STEP)
            edges = np.concatenate([[0], np.cumsum(tfs.value_lengths().to_numpy())])
            raw = byte.astype(np.uint8).tobytes()
            yield batch.append_column("impacts", pa.array([raw[a:z] for a, z in zip(edges, edges[1:])], pa.binary()))

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(tk.tidy(level), f"id {kind}, n long, terms array<int>, tfs array<long>, impacts binary")


class Weights:
    """The terms of a block of queries by number: which queries ask for a term, and with what weight (times the term's w)."""

    def __init__(self, n_queries: int, n_terms: int, term: np.ndarray, query: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.n_queries = n_queries
        self.query, self.weight = query[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def times(self) -> np.ndarray:
        """How many queries ask for each term."""
        return np.diff(self.start)

    def spread(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_rows: int, lower: bool = False):
        """Sums over postings (row, term, value) of value * weight for each row and query, and with `lower` of (value - 1) * weight."""
        times = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        cell = np.repeat(row, times) * self.n_queries + self.query[at]
        total = np.zeros(n_rows * self.n_queries, np.int64)
        np.add.at(total, cell, np.repeat(value, times) * self.weight[at])
        if not lower:
            return total.reshape(n_rows, self.n_queries)
        less = np.zeros_like(total)
        np.add.at(less, cell, self.weight[at])
        return total.reshape(n_rows, -1), less.reshape(n_rows, -1)


class Best:
    """The k best (score, id) of each query so far, and the score that a bound must reach."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.found = k, [[] for _ in range(n_queries)]
        self.bar = np.ones(n_queries, np.int64)  # scores of 0 are not wanted

    def offer(self, query: int, scored) -> None:
        have = sorted([*self.found[query], *scored], key=lambda p: (-p[0], p[1] is None, p[1] or 0))[: self.k]
        self.found[query] = have
        if len(have) == self.k:
            self.bar[query] = max(self.bar[query], have[-1][0])


def _search(index: DataFrame, weights: Weights, docs: int, words: int, k: int) -> DataFrame:
    """(q, id, score): the k best documents of each task for each query."""
    shared = index.sparkSession.sparkContext.broadcast(weights)

    def block(best: Best, w: Weights, ids, n, term, tf, byte, sizes) -> None:
        row = np.repeat(np.arange(len(sizes)), sizes)
        upper, one = w.spread(row, term, byte, len(sizes), lower=True)
        lower = np.where(upper > 0, (upper - one) * STEP, 0)
        upper *= STEP
        if len(sizes) > k:
            kth = np.partition(lower, len(sizes) - k, axis=0)[len(sizes) - k]
        elif len(sizes) == k:
            kth = lower.min(axis=0)
        else:
            kth = 0
        reach = upper >= np.maximum(best.bar, kth)[None, :]
        rows = np.flatnonzero(reach.any(axis=1))  # exact scores of every document that reaches the bar of some query
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, len(rows), 256):
            some = rows[a : a + 256]
            at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in some])
            own = np.repeat(np.arange(len(some)), sizes[some])
            m = np.repeat(length_factor(n[some], docs, words), sizes[some])
            exact = w.spread(own, term[at], impact(tf[at], m), len(some))
            for q in np.flatnonzero(reach[some].any(axis=0)):
                hit = np.flatnonzero(reach[some, q] & (exact[:, q] >= best.bar[q]))
                if len(hit):
                    best.offer(q, [(int(exact[h, q]), ids[some[h]]) for h in hit])

    def run(batches):
        w = shared.value
        best = Best(w.n_queries, k)
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            lengths = batch.column("terms").value_lengths().to_numpy()
            asked = w.times()[batch.column("terms").flatten().to_numpy()]
            edges = np.concatenate([[0], np.cumsum(asked)])[np.concatenate([[0], np.cumsum(lengths)])]
            a = 0
            while a < batch.num_rows:
                z = max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK_PAIRS, side="right")) - 1)
                z = min(z, a + BLOCK_DOCS, batch.num_rows)
                part = batch.slice(a, z - a)
                flat = lambda c: part.column(c).flatten().to_numpy().astype(np.int64)
                byte = np.frombuffer(b"".join(part.column("impacts").to_pylist()), np.uint8).astype(np.int64)
                block(best, w, part.column("id").to_pylist(), part.column("n").to_numpy(), flat("terms"), flat("tfs"), byte, lengths[a:z])
                a = z
        for q, found in enumerate(best.found):
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(found), pa.int32()), pa.array([i for _, i in found], kind), pa.array([s for s, _ in found], pa.int64())], names=["q", "id", "score"]
                )

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(tk.tidy(run), f"q int, id {kind}, score long")


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 for each row of queries, rank 1 first, ties by ascending id.

    Terms are maximal runs of letters and digits of ASCII (A-Z lower-cased) and all other characters beyond it. Null and empty texts have none:
    such documents are never found and count nowhere, such queries give no rows. Repeated rows of docs are documents of their own, with a
    place each; rows of queries that share an id are ranked apart. Null document ids come after others of the same score; ids are whole numbers. With an empty
    table on either side the result is empty. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = query_terms(queries, item_col, item_text)
    item_type, id_type = queries.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    parts = [_block(docs, asked.filter(F.col("row").between(a, z)), k, id_col, text_col) for a, z in query_blocks(asked)]
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score) for the queries of one block, whose terms the driver and every task hold."""
    rows = asked.toPandas()  # at most BLOCK_QUERIES queries and BLOCK_TERMS terms
    vocabulary = sorted(set(map(bytes, rows["term"])))
    number = {t: i for i, t in enumerate(vocabulary)}
    place = {r: i for i, r in enumerate(sorted(set(rows["row"])))}
    index = staged(postings(docs, id_col, text_col, vocabulary), "postings")
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        held[r["t"]] = r["count"]
    w = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(h) + 1))) for h in held], np.int64)
    term = np.array([number[bytes(t)] for t in rows["term"]], np.int64)
    query = np.array([place[r] for r in rows["row"]], np.int64)
    weights = Weights(len(place), len(vocabulary), term, query, rows["times"].to_numpy(np.int64) * w[term])
    found = _search(quantised(index, total.docs, max(total.words, 1)), weights, total.docs, max(total.words, 1), k)
    found = staged(found, "found")
    release(index)
    # a number of the block back to the query's id: at most BLOCK_QUERIES rows
    items = asked.groupBy("row").agg(F.first("item").alias("item")).select("item", (F.row_number().over(Window.orderBy("row")) - 1).alias("q"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(items), "q").select("item", "rank", "id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
lengths AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // words AS m FROM sizes, total),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
  GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 20
"""
