"""Vector codes: each vector is cut into equal parts, and each part is written as the number of its nearest codebook entry.

Codebooks are fitted by the filtering form of Lloyd's algorithm in whole numbers. Every partition cuts its vectors into blocks and
builds, for each part position, a kd-tree over a block's parts with the bounding box, count and sum of every node; the trees are written once and
read in each round. A round walks them from the root with the entries that may still be nearest to a node's points: an entry is out
when another one is nearer at the corner of the box that favours the first most. A node with one entry left is assigned whole by its
cached count and sum; only leaves with several left look at points. A task gives sums for at most PARTS * ENTRIES entries.

Scale: the codebooks are the only thing that goes through the driver (ENTRIES vectors, whatever the table holds). Sums are map-side combined.
The trees are a staged table, so a lost executor's share is read again, not fitted again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import small_batches, staged

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x is held as floor(UNIT * x).
UNIT = 1024
#: Vectors of a block, and of a leaf of its trees.
BLOCK, LEAF = 8192, 16

_TREE = "array<struct<order:binary,points:binary,lo:binary,hi:binary,sums:binary>>"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): the vectors that have only finite components, as whole numbers."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * UNIT)).alias("v"))


def _splits(n: int) -> list[np.ndarray]:
    """Where the nodes of each level start (and n): halves of halves down to leaves."""
    edges = [np.array([0, n])]
    while np.diff(edges[-1]).max() > LEAF:
        e = edges[-1]
        out = np.empty(2 * len(e) - 1, np.int64)
        out[::2], out[1::2] = e, (e[:-1] + e[1:]) // 2
        edges.append(out)
    return edges


class Tree:
    """A kd-tree over whole-number points: `order` sorts them by leaf; boxes and sums of the nodes, level after level from the root."""

    def __init__(self, order, points, lo, hi, sums):
        self.order, self.points, self.lo, self.hi, self.sums = order, points, lo, hi, sums
        self.edges = _splits(len(order))

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        """x: int64, a row for each point. Nodes are halved at the median of their widest side."""
        order, boxes = np.arange(len(x)), []
        edges = _splits(len(x))
        for level, e in enumerate(edges):
            here = x[order]
            lo, hi = np.minimum.reduceat(here, e[:-1]), np.maximum.reduceat(here, e[:-1])
            boxes.append((lo, hi, np.add.reduceat(here, e[:-1])))
            if level + 1 < len(edges):
                node = np.repeat(np.arange(len(e) - 1), np.diff(e))
                side = (hi - lo).argmax(axis=1)[node]
                order = order[np.lexsort((here[np.arange(len(x)), side], node))]
        return cls(order, x[order], *(np.concatenate(b) for b in zip(*boxes)))

    def nearest(self, book: np.ndarray, exact_floats: bool, whole=None, single=None) -> None:
        """Find the nearest row of book for every point, ties to the lower one, and report it.

        whole(nodes, start, stop, entries): points start..stop of the order have that entry each, for arrays of nodes (their places in
        sums); single(places, entries): one point each.
        """
        kind = np.float64 if exact_floats else np.int64  # products in doubles where they are exact
        book = book.astype(kind)
        norm, far = (book * book).sum(axis=1), (np.inf if exact_floats else np.iinfo(np.int64).max)
        nodes, left, base = np.zeros(1, np.int64), np.ones((1, len(book)), bool), 0
        for level, e in enumerate(self.edges):
            lo, hi = self.lo[base + nodes].astype(kind), self.hi[base + nodes].astype(kind)
            best = np.where(left, norm - (lo + hi) @ book.T, far).argmin(axis=1)
            by = np.argsort(best, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(best[by])) + 1):
                z = best[rows[0]]
                away = book - book[z]
                reach = hi[rows] @ np.maximum(away, 0).T + lo[rows] @ np.minimum(away, 0).T
                lead = norm - norm[z] - 2 * reach  # how much nearer the best entry is, at the corner where that is least
                left[rows] &= ~((lead > 0) | ((lead == 0) & (np.arange(len(book)) > z)[None, :]))
            alone = left.sum(axis=1) == 1
            if alone.any():
                whole(base + nodes[alone], e[nodes[alone]], e[nodes[alone] + 1], left[alone].argmax(axis=1))
            nodes, left = nodes[~alone], left[~alone]
            if not len(nodes):
                return
            if level + 1 < len(self.edges):
                base += len(e) - 1
                nodes, left = np.repeat(2 * nodes, 2), np.repeat(left, 2, axis=0)
                nodes[1::2] += 1
        for a in range(0, len(nodes), 128):
            some = nodes[a : a + 128]
            count = e[some + 1] - e[some]
            at = np.repeat(e[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            d = norm - 2 * (self.points[at].astype(kind) @ book.T)
            single(at, np.where(np.repeat(left[a : a + 128], count, axis=0), d, far).argmin(axis=1))


def sums_of(tree: Tree, book: np.ndarray, exact_floats: bool, count: np.ndarray, total: np.ndarray) -> None:
    """Add the tree's points to the count and componentwise total of their nearest entries."""

    def whole(nodes, start, stop, entries):
        np.add.at(count, entries, stop - start)
        np.add.at(total, entries, tree.sums[nodes])

    def single(at, entries):
        np.add.at(count, entries, 1)
        np.add.at(total, entries, tree.points[at])

    tree.nearest(book, exact_floats, whole, single)


def codes_of(tree: Tree, book: np.ndarray, exact_floats: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point, as the points were given."""
    placed = np.empty(len(tree.order), np.int64)

    def whole(nodes, start, stop, entries):
        for a, z, k in zip(start, stop, entries):
            placed[a:z] = k

    def single(at, entries):
        placed[at] = entries

    tree.nearest(book, exact_floats, whole, single)
    out, error = np.empty_like(placed), np.empty_like(placed)
    out[tree.order] = placed
    error[tree.order] = ((tree.points - book[placed]) ** 2).sum(axis=1)
    return out, error


def _trees(vectors: DataFrame, dim: int, width: np.dtype) -> DataFrame:
    """(ids, labels, parts): a row for each block of a partition, with a tree for each part position."""

    def block(ids, labels, x):
        parts = []
        for p in range(PARTS):
            t = Tree.build(np.ascontiguousarray(x[:, p * dim // PARTS : (p + 1) * dim // PARTS]))
            small = {k: getattr(t, k).astype(width).tobytes() for k in ("points", "lo", "hi")}
            parts.append({"order": t.order.astype(np.int32).tobytes(), "sums": t.sums.tobytes(), **small})
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        kind = pa.list_(pa.struct([(k, pa.binary()) for k in ("order", "points", "lo", "hi", "sums")]))
        return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([parts], kind)], names=["ids", "labels", "parts"])

    def build(batches):
        held, n = [], 0

        def flush(rows):
            ids, labels = (pa.concat_arrays([b.column(k) for b in rows]) for k in (0, 1))
            return block(ids, labels, np.concatenate([b.column(2).flatten().to_numpy() for b in rows]).reshape(-1, dim))

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                part = whole.slice(at, BLOCK - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == BLOCK:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(tk.tidy(build), f"ids array<{types['id']}>, labels array<{types['label']}>, parts {_TREE}")


def _read(batches, dim: int, width: np.dtype):
    """(ids, labels, trees) of each block."""
    d = dim // PARTS
    for batch in batches:
        for k in range(batch.num_rows):
            grid = lambda raw, t: np.frombuffer(raw, t).reshape(-1, d).astype(np.int64)
            trees = [
                Tree(np.frombuffer(p["order"], np.int32), grid(p["points"], width), grid(p["lo"], width), grid(p["hi"], width), grid(p["sums"], np.int64))
                for p in batch.column("parts")[k].as_py()
            ]
            yield batch.column("ids")[k].values, batch.column("labels")[k].values, trees


def _moved(trees: DataFrame, books: list[np.ndarray], dim: int, width: np.dtype, exact_floats: bool) -> list[np.ndarray]:
    """The codebooks after one round: floor(sum / count) of the parts nearest to each entry; entries without any stay."""
    shared, d, k = trees.sparkSession.sparkContext.broadcast(books), dim // PARTS, len(books[0])

    def run(batches):
        count, total = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, d), np.int64)
        for _, _, found in _read(batches, dim, width):
            for p, tree in enumerate(found):
                sums_of(tree, shared.value[p], exact_floats, count[p], total[p])
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * d, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    sums = trees.select("parts", "ids", "labels").mapInArrow(tk.tidy(run), "part int, entry int, n long, sums array<long>")
    every = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(d)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in every.toLocalIterator():  # at most PARTS * ENTRIES rows
        out[r.part][r.entry] = [s // r.n for s in r["sums"]]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector with finite components only.

    Components are whole numbers floor(1024 * x); parts are PARTS equal consecutive stretches. A part position's codebook starts as that part of the
    ENTRIES vectors of smallest id (nulls last, equal ids by their components; fewer if the table has fewer) and moves `rounds` times to the floored means
    of the parts nearest to its entries, ties to the lower entry. code holds the entries of the last assignment in two hex digits each, error the squared distances
    over all parts, label_error the errors of all rows with that label (null is one of them).

    Null vectors and such with null or non-finite components are dropped, and so are vectors of another length than most have (the greater of equally
    frequent ones), or one that PARTS does not divide. Repeated rows are coded each. A table without vectors gives an empty result. Components whose squared
    distances may not fit a long are an error. Other columns are not looked at, whatever their names.
    """
    spark = df.sparkSession
    small_batches(spark)
    vectors = whole_vectors(df, id_col, vector_col, label_col)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    shapes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.greatest(c, -c)))).alias("top"))
    shape = shapes.filter(f"dim > 0 and dim % {PARTS} = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None:
        return spark.createDataFrame([], f"`{id_col}` {types['id']}, code string, error long, label_error long, codebooks_sha256 string")
    dim, most = shape.dim, 16 * (shape.top + 1) ** 2 * shape.dim
    if most >= 1 << 63:
        raise ValueError(f"components up to {shape.top / UNIT} have squared distances beyond a long")
    exact_floats = most < 1 << 53
    width = np.dtype(next(t for t in (np.int16, np.int32, np.int64) if shape.top <= np.iinfo(t).max))
    vectors = vectors.filter(F.size("v") == dim)
    first = np.array([r.v for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()], np.int64)
    books = [np.ascontiguousarray(first[:, p * dim // PARTS : (p + 1) * dim // PARTS]) for p in range(PARTS)]
    trees = staged(_trees(vectors, dim, width), "trees")
    for _ in range(rounds):
        books = _moved(trees, books, dim, width, exact_floats)
    shared = spark.sparkContext.broadcast(books)

    def code(batches):
        for ids, labels, found in _read(batches, dim, width):
            got = [codes_of(tree, shared.value[p], exact_floats) for p, tree in enumerate(found)]
            text = np.stack([c.astype(np.uint8) for c, _ in got], axis=1).tobytes().hex()
            each = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(each, pa.string()), pa.array(sum(e for _, e in got))], names=["id", "label", "code", "error"])

    coded = staged(trees.select("ids", "labels", "parts").mapInArrow(tk.tidy(code), f"id {types['id']}, label {types['label']}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))  # a row for each label; the planner knows its size
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 4 AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
places AS (SELECT vec_id, v, d, unnest(range(4 * d)) AS k FROM kept),
comp AS MATERIALIZED (SELECT vec_id, k // d AS p, k % d AS i, v[k + 1] AS x FROM places),
b0 AS MATERIALIZED (
  SELECT p, e, i, x FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256) USING (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 256 + e) AS m FROM (
    SELECT vec_id, p, e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM comp c JOIN b{r} b USING (p, i) GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT p, e, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM b{r} LEFT JOIN (SELECT p, m % 256 AS e, i, sum(x)::BIGINT AS s, count(*) AS n FROM comp JOIN a{r} USING (vec_id, p) GROUP BY ALL) USING (p, e, i))""")
    last = f"""coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
    return ",\n".join([*steps, last])


#: Vectors of one length and with distinct ids; all distances are formed, so it is for small tables.
ORACLE = _oracle()
