"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature is `ROWS` minima of its word shingles, b bits each; two texts with Jaccard similarity
s differ in about (1-s) of them. The join finds every pair whose signatures differ in fewer than
`chunks * (errors + 1)` places: cut into `chunks` pieces, two such signatures have, by the pigeonhole
principle, a piece with at most `errors` differences, and both are indexed under every way to blank that
many places of each piece, so they share a key. (Pairs somewhat beyond that distance are found with
high probability as well: at similarity 0.8 the chance to share no key is about 2e-5.) Pairs are then
confirmed on the full shingle sets.

Scale: copies collapse to one class first. A bucket, the texts under one key, is never expanded into
pairs: its members are compared with one hub, which joins groups of near copies at once. Only where that
leaves a bucket in several components is the rest compared, in square blocks of bounded size inside tasks:
first by signature, which returns the texts that are still in doubt (not pairs), then those by full sets,
which returns a spanning forest of the links. So what leaves a task is linear in its rows. Every key lookup is a map-side combined aggregate and an equi-join, so a hot key is split by AQE.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .scratch import small_batches, staged

#: Signature places, pieces they are cut into, and differences enumerated within a piece.
ROWS, CHUNKS, ERRORS = 40, 8, 1
#: Bits kept of each minimum.
BITS = 16
#: Signature differences beyond which a pair isn't confirmed: 4.3 standard deviations above the mean at 0.8.
FAR = 19
#: Rows of a block when the rest of a bucket is compared, items of one when it is by sets, and items multiplied at once.
BLOCK, BLOCK_ITEMS, STRETCH = 2048, 60_000, 1024
#: Ids up to which a table of them is broadcast to pick their texts (8 bytes each).
BROADCAST_IDS = 1 << 21

U = np.uint64
_SEEDS = tk.mix(np.arange(1, 2 * ROWS + 1, dtype=U) * U(0xD6E8FEB86659FD93))


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of `size` words; a shorter text with words is one shingle."""
    data = tk.LOWER[data]
    start, stop, row = tk.words(data, off)
    if not len(start):
        return np.empty(0, U), np.empty(0, np.int64)
    word = tk.text_hash(data, tk.prefix_hash(tk.BYTE_CODE[data]), start, stop)
    n = len(word)
    mult = tk.mix(np.arange(1, size + 1, dtype=U) * U(tk.BASE)) | U(1)
    full = np.zeros(max(n - size + 1, 0), dtype=U)
    for k in range(size):
        full += word[k : k + len(full)] * mult[k]
    same = row[: len(full)] == row[size - 1 :] if len(full) else np.empty(0, bool)
    per = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((per > 0) & (per < size))
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    whole = np.zeros(len(short), dtype=U)
    for k in range(size - 1):
        at = short[per[short] > k]
        whole[per[short] > k] += word[first[at] + k] * mult[k]
    whole += per[short].astype(U) * U(0xA0761D6478BD642F)  # a whole text isn't the start of a longer one
    hashes = tk.mix(np.concatenate([full[same], whole]))
    rows = np.concatenate([row[: len(full)][same], short])
    order = np.argsort(rows, kind="stable") if len(short) else slice(None)
    return hashes[order], rows[order]


def distinct_shingles(data, off, size):
    """The same, each hash once per row, ascending within a row."""
    hashes, rows = shingle_hashes(data, off, size)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


def prints_of(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """(n, 2) numbers: a 128-bit print of each set of hashes, the sets starting at heads."""
    return np.stack([np.add.reduceat(tk.mix(hashes ^ U(s)), heads) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1).astype("<u8")


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, print, sig) for each row: set size, 128-bit print of the set, signature.

    A text without words has size 0 and a null print and signature.
    """

    def sketch(batches):
        for batch in batches:
            for a, z, data, off in tk.slices(batch.column(1)):
                hashes, rows = distinct_shingles(data, off, size)
                n = np.bincount(rows, minlength=z - a)
                has = np.flatnonzero(n)
                heads = np.concatenate([[0], np.cumsum(n[has])[:-1]]).astype(np.int64)
                sig = np.zeros((z - a, ROWS), dtype="<u2")
                prints = np.zeros((z - a, 2), dtype="<u8")
                if len(has):
                    for k in range(ROWS):
                        low = np.minimum.reduceat((hashes ^ _SEEDS[k]) * (_SEEDS[ROWS + k] | U(1)), heads)
                        sig[has, k] = (tk.mix(low) >> U(64 - BITS)).astype("<u2")
                    prints[has] = prints_of(hashes, heads)
                full = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, z - a),
                        pa.array(n, pa.int64()),
                        pa.array([p.tobytes() if f else None for p, f in zip(prints, full)], pa.binary()),
                        pa.array([s.tobytes() if f else None for s, f in zip(sig, full)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "print", "sig"],
                )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        tk.tidy(sketch), "id long, n_shingles long, print binary, sig binary"
    )


def shingle_sets(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, print, items array<long>): the full set of each text that has words, for confirming."""

    def build(batches):
        for batch in batches:
            for a, z, data, off in tk.slices(batch.column(1)):
                hashes, rows = distinct_shingles(data, off, size)
                n = np.bincount(rows, minlength=z - a)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                cuts = np.concatenate([[0], np.cumsum(n[has])])
                items = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))
                prints = pa.array([p.tobytes() for p in prints_of(hashes, cuts[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(has)), prints, items], names=["id", "print", "items"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(tk.tidy(build), "id long, print binary, items array<long>")


def index_keys(sigs: DataFrame, chunks: int, errors: int) -> DataFrame:
    """(id, key): one row for each piece and each way to blank `errors` of its places."""
    from itertools import combinations

    width = ROWS // chunks
    part = lambda c, blank: F.xxhash64(
        F.lit(c), *(F.lit(p) for p in blank), *(F.substring("sig", 2 * (c * width + p) + 1, 2) for p in range(width) if p not in blank)
    )
    keys = [part(c, blank) for c in range(chunks) for blank in combinations(range(width), errors)]
    return sigs.select("id", F.explode(F.array(*keys)).alias("key"))


def grouped(batches, keys: int, solve):
    """Hand each run of rows with equal first `keys` columns to solve, over batches sorted by them.

    Columns are numpy arrays (of arrays for nested ones); runs are cut at the edges of groups only.
    """
    held: list = []

    def flush(rows):
        cols = [np.concatenate(c) for c in zip(*rows)]
        edge = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            edge |= c[1:] != c[:-1]
        cut = np.flatnonzero(edge) + 1
        for a, z in zip([0, *cut], [*cut, len(cols[0])]):
            yield from solve([c[a:z] for c in cols])

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            cols = []
            for c in part.columns:
                if pa.types.is_integer(c.type):
                    cols.append(c.to_numpy(zero_copy_only=False))
                elif pa.types.is_list(c.type):  # an array for each row, empty where null
                    stop = np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    out = np.empty(len(c), object)
                    out[:] = np.split(c.flatten().to_numpy(zero_copy_only=False), stop[:-1]) if len(c) > 1 else [c.flatten().to_numpy(zero_copy_only=False)]
                    cols.append(out)
                else:
                    cols.append(np.fromiter(c.to_pylist(), dtype=object, count=len(c)))
            edge = np.zeros(part.num_rows - 1, bool)
            for c in cols[:keys]:
                edge |= c[1:] != c[:-1]
            new = np.flatnonzero(edge) + 1
            if held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], cols[:keys])):
                yield from flush(held)
                held = []
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from flush([*held, [c[:last] for c in cols]])
                held = []
            held.append([c[last:] for c in cols])
    if held:
        yield from flush(held)


def _dealt(rows: DataFrame, key: str, blocks, columns: list[str]) -> DataFrame:
    """Deal the rows of a key into blocks and bring each pair of blocks together: (key, i, j, mine, *columns)."""
    out = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = out.select(key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *columns)
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _doubtful(rows: DataFrame) -> DataFrame:
    """(hub, id): texts with a partner within FAR in another component, from (hub, id, component, sig, n)."""

    def solve(cols):
        hub, i, j, mine, ids, comp, raw = cols
        sig = np.frombuffer(b"".join(raw), dtype="<u2").reshape(-1, ROWS)
        left, right = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
        seen = np.zeros(len(ids), bool)
        for k in range(0, len(left), 64):
            l = left[k : k + 64]
            hit = (sig[l][:, None, :] != sig[right][None, :, :]).sum(axis=2) <= FAR
            hit &= comp[l][:, None] != comp[right][None, :]
            seen[l] |= hit.any(axis=1)
            seen[right] |= hit.any(axis=0)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(hub[seen]), pa.array(ids[seen])], names=["hub", "id"])

    dealt = _dealt(rows, "hub", F.ceil(F.col("n") / BLOCK).cast("int"), ["id", "component", "sig"])
    return dealt.mapInArrow(tk.tidy(lambda batches: grouped(batches, 3, solve)), "hub long, id long").distinct()


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links among the texts of each hub, from (hub, id, items, total, n).

    total is the number of items of all the hub's n texts; a block is bounded in both. Full sets are intersected in the task as products of
    0/1 matrices over the items that stand in several of them, a stretch of items at a time.
    """

    def solve(cols):
        _, i, j, mine, ids, items = cols
        left, right = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
        size = np.array([len(x) for x in items])
        row = np.repeat(np.arange(len(ids)), size)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in items])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        code = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
        often = np.bincount(code)[code] > 1
        row = row[often]
        code = np.unique(code[often], return_inverse=True)[1]
        common = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, int(code[-1]) + 1 if len(code) else 0, STRETCH):
            s, e = np.searchsorted(code, [a, a + STRETCH])
            m = np.zeros((len(ids), STRETCH), np.float32)
            m[row[s:e], code[s:e] - a] = 1
            common += m[left] @ m[right].T
        hit = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        label = ids.copy()
        while hit.any():  # smallest id connected within this pair of blocks
            new = label.copy()
            low = np.where(hit, label[right][None, :], np.iinfo(np.int64).max).min(axis=1)
            new[left] = np.minimum(new[left], low)
            low = np.where(hit, new[left][:, None], np.iinfo(np.int64).max).min(axis=0)
            new[right] = np.minimum(new[right], low)
            if (new == label).all():
                break
            label = new
        far = label != ids
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(label[far])], names=["a", "b"])

    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_ITEMS), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = _dealt(rows, "hub", blocks, ["id", "items"])
    return dealt.mapInArrow(tk.tidy(lambda batches: grouped(batches, 3, solve)), "a long, b long").distinct()


def _sets_of(members: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Staged (id, items) of the classes among members: the set of a row with the class's least document id and its print."""
    wanted = staged(classes.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("class"), F.col("least").alias("id"), "print"), "ids")
    some, ids = wanted, wanted.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:  # else the texts are shuffled to their ids
        some, ids = F.broadcast(some), F.broadcast(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    sets = shingle_sets(texts, "id", "text", size).join(some, ["id", "print"]).select(F.col("class").alias("id"), "items")
    return staged(sets.dropDuplicates(["id"]), "sets")

def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose full sets satisfy 100 * |A and B| >= percent * |A or B|."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    chunks: int = CHUNKS,
    errors: int = ERRORS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of df.

    A text's set is its distinct shingles of `size` words (runs of other characters than space and
    U+0009..U+000D, A-Z lower-cased); a text with fewer words is one shingle. Texts are linked when their
    sets have a Jaccard similarity of percent/100 or more. component_id is the smallest id reachable by
    links, itself included; kept says whether that is its own id.

    Null and empty texts and texts without words have size 0 and link with nothing. A row with a null id
    is not linked: its component_id is null and it is kept. Rows that share an id count as one document: what
    any of their texts is linked with is in their component.
    Ties cannot arise: every choice is by smallest id. An empty table gives an empty result. Other
    columns of df are not looked at, whatever their names.
    """
    small_batches(df.sparkSession)
    base = staged(sketches(df, id_col, text_col, size), "sketches")
    linkable = base.filter("id is not null and print is not null")
    # from here on an id is the number of a class of equal sets, fixed by being written; documents may share an id
    classes = linkable.groupBy("print").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("least"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), "least", "sig", "print"), "classes")
    sigs = classes.select("id", "sig")

    keys = index_keys(sigs, chunks, errors)
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = staged(keys.join(buckets, "key"), "members")
    hubs = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = hubs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"
    )
    apart = sum(
        (F.substring("sa", 2 * k + 1, 2) != F.substring("sb", 2 * k + 1, 2)).cast("int") for k in range(ROWS)
    )
    # texts are shuffled once: the sets of all that share a key with another one
    sets = _sets_of(members, classes, df, id_col, text_col, size)
    links = staged(_confirmed(staged(near.filter(apart <= FAR).select("a", "b"), "near"), sets, percent), "links")
    first = staged(components(links, "a", "b"), "first")

    held = members.filter("n > 2").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    # the buckets of one hub hold much the same texts and are compared together
    rest = staged(held.join(split, "key").select("hub", "id", "component").distinct(), "rest")
    rest = rest.join(rest.groupBy("hub").agg(F.count("*").alias("n")), "hub").join(sigs, "id").select("hub", "id", "component", "sig", "n")
    doubt = staged(_doubtful(rest), "doubt")
    full = doubt.join(sets, "id")
    totals = doubt.join(sets.select("id", F.size("items").alias("k")), "id").groupBy("hub").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    more = staged(_within(full.join(totals, "hub"), percent), "more")
    final = components(links.unionByName(more), "a", "b")

    # rows that share an id hold their classes together
    same = linkable.select(F.col("id").alias("doc"), "print").join(classes.select("print", "id"), "print").select("doc", "id")
    ties = same.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    crossed = same.join(ties.filter("a <> b"), "doc").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    if not ties.filter("a <> b").isEmpty():
        final = components(links.unionByName(more).unionByName(crossed), "a", "b")
    final = classes.select("id", "least").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = final.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = ties.select("doc", F.col("a").alias("id")).join(final.select("id", "component"), "id").join(least, "component").select(F.col("doc").alias("id"), "component_id")
    out = base.join(placed, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
