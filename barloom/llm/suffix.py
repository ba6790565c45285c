"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte is removed if a string of `length` bytes that covers it also starts somewhere else in the corpus.

Partitioning. Every window of `length` bytes is dealt by its minimizer, the least hash among its `GRAM`-byte
substrings: equal windows have equal minimizers, and neighbouring windows mostly share theirs, so a text is
cut into runs of windows (about one for every 69 bytes) and a run is one row. A run whose minimizer
appears nowhere else has no repeats; if all runs of a minimizer are the same text, all their windows
are repeats; in neither case is any text moved. Only where one minimizer has different runs (or a run repeats
itself) are one copy of each distinct run's bytes gathered by minimizer.

Within a task the gathered texts are cut into shards. Symbols are `SYMBOL`-byte strings, read at every
phase, so depth `length` is length/SYMBOL symbols. Each shard gets its Burrows-Wheeler transform; all shards are
merged by iterative interleave refinement: the vector saying which shard each row of the merged order comes
from is refined once per symbol of depth by passing it through the shards' transforms, which never looks at
the texts again and never re-sorts suffixes. The refinement also yields the common prefix of neighbouring
rows; rows that still share a block at full depth form the repeated intervals.

Hot groups: a minimizer with more than `hot` bytes of distinct runs is not gathered. Its windows are hashed and counted
one by one with map-side combining, so a passage that a third of all documents holds in ever new surroundings
stays distributed. A text longer than a slice is read in stretches of windows, so what a task holds is bounded in bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import release, small_batches, staged

#: Length of a repeat in bytes; of the substrings whose least hash deals it; of a symbol.
LENGTH, GRAM, SYMBOL = 200, 64, 25
#: Bytes of a shard, and of the shards merged at once (a group is never cut).
SHARD, MERGE = 1 << 17, 1 << 19
#: Bytes of the distinct runs of one minimizer beyond which they are too many for one task and their windows are counted one by one.
HOT = 1 << 20

U = np.uint64
_NO_ID = -(1 << 63)


# --- runs of windows with one minimizer -------------------------------------------------------------


def runs(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(minimizer, row, start, windows, text hash, repeats itself) of each run in the texts data[off]."""
    n, wide = len(data), length - gram + 1
    grams, windows = n - gram + 1, n - length + 1
    if windows <= 0:
        return None
    prefix = tk.prefix_hash(tk.BYTE_CODE[data])
    h = tk.mix((prefix[gram:] - prefix[:grams]) * tk.powers(tk.BASE_INV, n + 1)[:grams])
    pad = np.full((-grams) % wide + wide, ~U(0), dtype=U)
    blocks = np.concatenate([h, pad]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    fits = np.arange(windows) + length <= off[row + 1]
    edge = np.ones(windows, bool)
    edge[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], windows)
    start, stop = start[fits[start]], stop[fits[start]]
    if not len(start):
        return None
    again = np.zeros(len(start), bool)
    view = np.lib.stride_tricks.sliding_window_view(h, wide)
    for k in range(0, len(start), 4096):
        a, z = start[k : k + 4096], stop[k : k + 4096] - 1
        value = least[a][:, None]
        first = a + (view[a] == value).argmax(axis=1)
        last = z + wide - 1 - (view[z] == value)[:, ::-1].argmax(axis=1)
        again[k : k + 4096] = first != last
    text = tk.text_hash(data, prefix, start, stop - 1 + length)
    return least[start], row[start], start - off[row[start]], stop - start, text, again


def keyed(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(did, uid, text, _c0, ...): did stands for a null id too, uid tells rows that share an id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("uid"), text.alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])


def _stretches_of(column: pa.Array, length: int):
    """(first row, row after the last, byte offset, bytes, offsets): slices of rows; a longer text comes in stretches of its windows."""
    for a, z, data, off in tk.slices(column):
        if len(data) <= 2 * tk.SLICE_BYTES:
            yield a, z, 0, data, off
            continue
        for at in range(0, len(data), tk.SLICE_BYTES):  # one text alone; a run ends with its stretch
            part = data[at : at + tk.SLICE_BYTES + length - 1]
            yield a, z, at, part, np.array([0, len(part)])


def run_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for a, z, first, data, off in _stretches_of(batch.column(2), length):
                got = runs(data, off, length, gram)
                if got is None:
                    continue
                least, row, start, n, text, again = got
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least.view(np.int64)), pa.array(text.view(np.int64)),
                        batch.column(0).slice(a, z - a).take(take), batch.column(1).slice(a, z - a).take(take),
                        pa.array(start + first, pa.int32()), pa.array(n, pa.int32()), pa.array(again),
                    ],
                    names=["m", "th", "did", "uid", "start", "n", "again"],
                )

    return docs.select("did", "uid", "text").mapInArrow(tk.tidy(cut), "m long, th long, did long, uid long, start int, n int, again boolean")


# --- shard transforms and their merge ---------------------------------------------------------------


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers below 2**32, as a counting sort of 16-bit digits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if x.size and x.max() > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """The Burrows-Wheeler transform of some texts to a bounded depth, over a given symbol alphabet."""

    def __init__(self, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, depth: int):
        """symbol[p]: code at p; after[p], before[p]: the positions a symbol on and back, or -1.

        A position without one after it has an end symbol, which stands nowhere else.
        """
        self.ends = int((after < 0).sum())
        rank, done = symbol, 1
        nxt = np.where(after < 0, np.arange(len(after)), after)
        while done < depth:
            follow = np.where(after < 0, 0, rank[nxt] + 1)
            key = rank.astype(np.int64) << 32 | follow
            order = np.argsort(key)
            new = np.empty(len(key), bool)
            new[:1] = True
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(new) - 1
            after = np.where(after < 0, -1, after[nxt])  # twice as far
            nxt = np.where(after < 0, np.arange(len(after)), after)
            done *= 2
        self.order = stable_order(rank).astype(np.int32)
        back = before[self.order]
        self.transform = np.where(back < 0, -1, symbol[back])


def merge(shards: list[Shard], ends: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms: (shard of each merged row, symbols each row shares with the row before it).

    ends: the number of end symbols; their codes come first and each occurs once. The shared prefix is
    exact below `depth` and `depth` where it is that or more.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.order) for s in shards])
    transform = np.concatenate([s.transform for s in shards])
    front = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.ends for s in shards])
    block = np.zeros(len(source), np.int32)
    shared = np.full(len(source), depth, np.int32)
    shared[:1] = 0
    for step in range(depth):
        symbol = np.empty(len(source), np.int32)
        symbol[np.argsort(source, kind="stable")] = transform
        order = np.flatnonzero(symbol >= 0).astype(np.int32)
        order = order[stable_order(symbol[order])]
        symbol, block = symbol[order], block[order]
        edge = np.ones(len(source), bool)
        edge[ends + 1 :] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        source = np.concatenate([front, source[order]])
        shared[edge & (shared == depth)] = step
        block = np.cumsum(edge, dtype=np.int32)
    return source, shared


def _numbered(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The rank of the string of `size` bytes at each start among the distinct ones, in the order of their hashes."""
    prefix, hashes = tk.prefix_hash(tk.BYTE_CODE[data]), np.empty(len(start), U)
    for k in range(0, len(start), SHARD):
        part = start[k : k + SHARD]
        hashes[k : k + SHARD] = tk.range_hash(prefix, part, part + size)
    del prefix
    order = np.argsort(hashes).astype(np.int32)
    hashes = hashes[order]
    new = np.zeros(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank


def repeated_starts(texts: list[np.ndarray], length: int, symbol: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each text, whether the `length` bytes at each of its window starts also start elsewhere in texts."""
    depth = length // symbol
    close = np.zeros(1, np.uint8)  # a place behind each text, for the empty suffix
    data = np.concatenate([x for t in texts for x in (t, close)])
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    n, at = len(data), np.arange(len(data), dtype=np.int32)  # positions and codes are far below 2**31
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
    whole = at + symbol < off[row + 1]
    code = np.empty(n, np.int32)
    ends = int((~whole).sum())
    code[~whole] = np.arange(ends)
    code[whole] = ends + _numbered(data, at[whole], symbol)
    shards, starts, first = [], [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + shard, side="right")) - 1)
        a, z = off[first], off[last]
        here = np.arange(z - a, dtype=np.int32)
        after = np.where(whole[a:z], here + symbol, -1)
        before = np.where(at[a:z] - symbol >= off[row[a:z]], here - symbol, -1)
        made = Shard(code[a:z], after, before, depth)
        shards.append(made)
        starts.append(made.order + int(a))
        first = last
    source, shared = merge(shards, ends, depth)
    merged = np.empty(n, np.int32)
    merged[np.argsort(source, kind="stable")] = np.concatenate(starts)
    same = shared >= depth
    hit = np.zeros(n, bool)
    hit[merged[same]] = True
    hit[merged[:-1][same[1:]]] = True
    return [hit[a : max(a, z - length)] for a, z in zip(off[:-1], off[1:])]


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each run of true."""
    d = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first = np.flatnonzero(d == 1)
    return first, np.flatnonzero(d == -1) - first


def _merged(texts: DataFrame, length: int, symbol: int) -> DataFrame:
    """(m, th, first, count): repeated window starts within each distinct run, from (m, th, bytes)."""
    dealt = texts.repartition("m").sortWithinPartitions("m", "th")

    def solve(rows):
        hits = repeated_starts([r[2] for r in rows], length, symbol)
        m, th, first, count = [], [], [], []
        for r, hit in zip(rows, hits):
            f, c = stretches(hit)
            m += [r[0]] * len(f)
            th += [r[1]] * len(f)
            first += f.tolist()
            count += c.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int64()), pa.array(th, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32())],
            names=["m", "th", "first", "count"],
        )

    def run(batches):
        held, size, seen = [], 0, None
        for batch in batches:
            for m, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (m, th) == held[-1][:2]:
                    continue
                if size >= MERGE and m != seen:
                    yield solve(held)
                    held, size = [], 0
                held.append((m, th, np.frombuffer(text, np.uint8)))
                size, seen = size + len(text), m
        if held:
            yield solve(held)

    return dealt.mapInArrow(tk.tidy(run), "m long, th long, first int, count int")


def _counted(texts: DataFrame, length: int) -> DataFrame:
    """The same for hot groups: every window's hash is counted on its own."""

    def windows(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                raw = [np.frombuffer(t, np.uint8) for t in part.column(2).to_pylist()]
                if not raw:
                    continue
                off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
                row = np.repeat(np.arange(len(raw)), [max(0, len(t) - length + 1) for t in raw])
                at = np.concatenate([np.arange(a, max(a, z - length + 1)) for a, z in zip(off[:-1], off[1:])])
                prefix = tk.prefix_hash(tk.BYTE_CODE[np.concatenate(raw)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(at - off[row], pa.int32()), pa.array(tk.range_hash(prefix, at, at + length).view(np.int64))],
                    names=["m", "th", "first", "w"],
                )

    each = texts.dropDuplicates(["m", "th"]).mapInArrow(tk.tidy(windows), "m long, th long, first int, w long")
    often = each.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    hit = each.join(often, "w", "left_semi")
    # neighbouring windows of a run become one stretch
    island = F.col("first") - F.row_number().over(Window.partitionBy("m", "th").orderBy("first"))
    return hit.select("m", "th", "first", island.alias("k")).groupBy("m", "th", "k").agg(F.min("first").alias("first"), F.count("*").cast("int").alias("count")).drop("k")


# --- the operator -----------------------------------------------------------------------------------


def repeated_ranges(docs: DataFrame, length: int, gram: int, symbol: int, hot: int) -> DataFrame:
    """(did, uid, ranges array<struct<a, n>>): n windows from byte a on are repeats."""
    table = staged(run_table(docs, length, gram), "runs")
    by_text = F.count("*").alias("c"), F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("again").alias("self")
    stats = table.groupBy("m").agg(*by_text).filter("c > 1 or self")
    found = staged(table.join(stats.select("m", (F.expr("lo <> hi") | F.col("self")).alias("mixed")), "m"), "repeats")
    release(table)

    whole = found.filter("not mixed")
    mixed = found.filter("mixed")
    distinct = mixed.groupBy("m", "th").agg(F.count("*").alias("c"), F.min(F.struct("did", "uid", "start", "n")).alias("one"))
    distinct = staged(distinct, "distinct")
    sizes = distinct.groupBy("m").agg(F.sum(F.col("one.n") + F.lit(length - 1).cast("long")).alias("bytes"))
    wanted = distinct.join(sizes, "m").select("m", "th", (F.col("bytes") > hot).alias("hot"), "one.*")
    lists = wanted.groupBy("did", "uid").agg(F.collect_list(F.struct("m", "th", "hot", "start", "n")).alias("cuts"))

    def fetch(batches):
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py().encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["m"] for c in cuts], pa.int64()), pa.array([c["th"] for c in cuts], pa.int64()), pa.array([c["hot"] for c in cuts]),
                        pa.array([data[c["start"] : c["start"] + c["n"] + length - 1] for c in cuts], pa.binary()),
                    ],
                    names=["m", "th", "hot", "bytes"],
                )

    texts = docs.join(lists, ["did", "uid"]).select("text", "cuts").mapInArrow(tk.tidy(fetch), "m long, th long, hot boolean, bytes binary")
    texts = staged(texts, "texts")
    part = ["m", "th", "bytes"]
    inner = _merged(texts.filter("not hot").select(*part), length, symbol)
    if not texts.filter("hot").isEmpty():
        inner = inner.unionByName(_counted(texts.filter("hot").select(*part), length))
    inner = staged(inner, "inner")
    release(texts)

    often = distinct.filter("c > 1").select("m", "th")
    place = lambda a, n: F.struct(a.cast("int").alias("a"), n.cast("int").alias("n"))
    itself = F.array(place(F.col("start"), F.col("n"))).alias("r")
    # a distinct run's stretches in one list, bounded by its length: the join gives a row for each run, not for each stretch
    within = inner.groupBy("m", "th").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    parts = F.transform("parts", lambda p: place(F.col("start") + p["first"], p["count"])).alias("r")
    ranges = (
        whole.select("did", "uid", itself)
        .unionByName(mixed.join(often, ["m", "th"], "left_semi").select("did", "uid", itself))
        .unionByName(mixed.join(within, ["m", "th"]).select("did", "uid", parts))
    )
    # one list for each document, bounded by its own length
    return ranges.groupBy("did", "uid").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def _spans(size: int, ranges, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, bytes) of each maximal removed run of a text of `size` bytes."""
    if not ranges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.array([r["a"] for r in ranges])
    z = a + np.array([r["n"] for r in ranges]) + length - 1
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, a, 1)
    np.add.at(d, z, -1)
    return stretches(np.cumsum(d)[:-1] > 0)


def removal(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    symbol: int = SYMBOL,
    hot: int = HOT,
    digests: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_text) for every row; with digests, kept_sha256 in its place.

    Texts are UTF-8 bytes, null counting as empty; repeats never cross texts; overlapping occurrences count; all is
    judged on the input. Texts shorter than `length` lose nothing. Repeated rows are copies of each other, so
    both lose what they share; ids may be null or repeat. An empty table gives an empty result. Columns named in carry
    follow, others of df are not looked at. kept_sha256 is of the exact remaining bytes; kept_text drops a character of
    which a byte was removed, so that it is valid text.
    """
    if length % symbol or gram > length:
        raise ValueError("length must be a multiple of symbol, and gram at most length")
    small_batches(df.sparkSession)
    docs = keyed(df, id_col, text_col, carry)
    ranges = staged(repeated_ranges(docs, length, gram, symbol, hot), "ranges")
    last = "kept_sha256" if digests else "kept_text"
    extra = [f"_c{i}" for i in range(len(carry))]

    def finish(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode()
                first, size = _spans(len(data), found, length)
                keep, at = [], 0
                for a, n in zip(first.tolist(), size.tolist()):
                    keep.append(data[at:a])
                    at = a + n
                keep.append(data[at:])
                if digests:
                    value = hashlib.sha256(b"".join(keep)).hexdigest()
                else:
                    value = "".join(k.decode("utf-8", "ignore") for k in keep)
                out.append((len(data), int(size.sum()), len(first), value))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), *batch.columns[3:]],
                names=["did", "n_bytes", "n_removed", "n_spans", last, *extra],
            )

    joined = docs.join(ranges, ["did", "uid"], "left").select("did", "text", "ranges", *extra)
    kinds = "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in extra)
    out = joined.mapInArrow(tk.tidy(finish), f"did long, n_bytes long, n_removed long, n_spans long, {last} string{kinds}")
    names = [F.col(c).alias(name) for c, name in zip(extra, carry)]
    return out.select(F.nullif(F.col("did"), F.lit(_NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", last, *names)
