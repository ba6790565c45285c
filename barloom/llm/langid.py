"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter array serves all languages: each slot holds a bitmask with one bit for each language (eight to a slice), so
one probe of an n-gram returns every language that contains it (the bitwise and of its slots). A text's score for a
language is the number of its n-grams whose mask has that language's bit, corrected for the rate at which a bit is set
by chance; the highest corrected count decides.

Training counts n-grams with Spark over a bounded sample of labelled rows (`sample` rows a language, those of lowest id
hash) and sets the filter's bits by a bitwise aggregate over slots, so what comes to the driver is the filter itself,
whose size is a parameter and doesn't grow with the data. Prediction is one pass over the rows where they are: nothing is
shuffled, and only texts go to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import small_batches

#: Lengths of n-grams; a boundary counts as one character.
SIZES = (2, 3, 4, 5)
#: Slots of the filter (a power of two) and probes for each n-gram.
SLOTS, PROBES = 1 << 22, 2
#: Labelled rows used for each language, give or take those that share the last hash prefix.
SAMPLE = 4000
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate anywhere.
SHARE = 0.1
#: A text is in a known language if this share of its n-grams, corrected for chance, belongs to one language. The lowest share of any
#: document with a letter is 0.53 in the tables at hand (sf0.001 to sf0.1, check_s, check_h). A filter with fewer n-grams than
#: LEAST for every language has seen too little to reject a text.
FLOOR, LEAST = 0.1, 1000
#: Code points handled at once.
STEP = 1 << 18

U = np.uint64
_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Lower-case letter for each code point, 0 for what isn't a letter."""
    if not _fold:
        _fold.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32))
    return _fold[0]


def _gram_part(code: np.ndarray, row: np.ndarray, stop: int):
    """(n, hash, row) of the n-grams that start before `stop`."""
    code = code.astype(U)
    acc = code * U(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            return
        acc = (acc[: len(code) - n + 1] ^ (acc[: len(code) - n + 1] >> U(29))) * U(0xBF58476D1CE4E5B9) + code[n - 1 :]
        if n not in SIZES:
            continue
        inner = np.ones(len(acc), bool)  # boundaries only at the ends
        inner[stop:] = False
        for k in range(1, n - 1):
            inner &= code[k : k + len(acc)] != 0
        if n == 2:
            inner &= (code[:-1] != 0) | (code[1:] != 0)
        inner &= row[: len(acc)] == row[n - 1 :]
        yield n, tk.mix(acc[inner] * U(0x94D049BB133111EB) + U(n)), row[: len(acc)][inner]


def gram_hashes(texts: list[str], rows: np.ndarray):
    """Yield (n, hash, row) for all n-grams of letters and boundaries that hold a letter."""
    parts = [("\n" + t + "\n").encode("utf-32-le", "surrogatepass") for t in texts]
    code = fold()[np.frombuffer(b"".join(parts), dtype="<u4")]
    sizes = np.array([len(p) // 4 for p in parts])
    keep = np.ones(len(code), bool)  # runs of boundaries count as one
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    keep[np.cumsum(sizes) - sizes] = True
    row = np.repeat(rows.astype(np.int32), sizes)[keep]
    code = code[keep]
    for a in range(0, len(code), STEP):  # more than one step only for a single word of that length
        z = a + STEP + max(SIZES) - 1
        yield from _gram_part(code[a:z], row[a:z], STEP)


def pieces(texts: list[str | None]):
    """(texts, their rows) by about STEP characters; a longer text is cut before a character that is no letter, so no n-gram is lost."""
    part, rows, held = [], [], 0
    for k, t in enumerate(texts):
        t, at = t or "", 0
        while True:
            to = at + STEP - held
            while to < len(t) and fold()[ord(t[to])]:
                to += 1
            part.append(t[at:to])
            rows.append(k)
            held += to - at + 2 if to < len(t) else len(t) - at + 2
            at = to
            if held >= STEP:
                yield part, np.array(rows)
                part, rows, held = [], [], 0
            if at >= len(t):
                break
    if part:
        yield part, np.array(rows)


class Filter:
    """The bit-sliced filter: slices[s][slot] has the bits of languages 8s .. 8s+7."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.slices = np.zeros((-(-len(langs) // 8), SLOTS), dtype=np.uint8)
        self.chance = np.zeros(len(langs))
        self.grams = 0  # of the language that has the most, by the slots set

    @staticmethod
    def slots(hashes: np.ndarray) -> list[np.ndarray]:
        step = hashes >> U(32) | U(1)
        return [((hashes + U(k) * step) & U(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]

    def close(self) -> Filter:
        for k in range(len(self.langs)):
            share = np.mean((self.slices[k // 8] >> np.uint8(k % 8)) & 1)
            self.chance[k] = share**PROBES
            self.grams = max(self.grams, int(-np.log1p(-min(share, 1 - 1 / SLOTS)) * SLOTS / PROBES))
        return self

    def counts(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """(rows, languages) numbers of n-grams whose mask has the language's bit."""
        out = []
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        slots = self.slots(hashes)
        for part in self.slices:
            mask = part[slots[0]]
            for at in slots[1:]:
                mask &= part[at]
            out.append(np.bincount(rows * np.int64(256) + mask, minlength=n * 256).reshape(n, 256) @ bits)
        return np.concatenate(out, axis=1)[:, : len(self.langs)]


def slot_columns(gram: Column) -> list[Column]:
    """The slots of `Filter.slots` for a column of hashes (as longs): low bits only, so nothing overflows."""
    low = F.lit(SLOTS - 1).cast("long")
    step = F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(low)
    return [(gram.bitwiseAND(low) + k * step).bitwiseAND(low).cast("int") for k in range(PROBES)]


def sampled_ids(ids: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """((_id, _lang) of about `sample` ids of lowest hash for each _lang, all languages by falling number of rows).

    Two counts, of the first and then the next 12 bits of the hash, find the prefix at which a language has its sample,
    so no language is ranked in one task; ids that share that last prefix are all taken.
    """
    spark, last = ids.sparkSession, 4095
    h = F.xxhash64(F.col("_id"), F.lit(11))
    ids = ids.withColumns({"_p": F.shiftrightunsigned(h, 52).cast("int"), "_q": (F.shiftrightunsigned(h, 40) % (last + 1)).cast("int")})

    def reached(counted: DataFrame, place: str, have: Column) -> DataFrame:
        """Where, among at most 4096 prefixes of a language, its running count reaches the sample, and the count before."""
        run = Window.partitionBy("_lang").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        told = counted.withColumn("_upto", F.sum("count").over(run) + have)
        short = F.max(F.when(F.col("_upto") < sample, F.col("_upto")))
        return told.groupBy("_lang").agg(F.min(F.when(F.col("_upto") >= sample, F.col(place))).alias("_cut"), F.coalesce(short, F.lit(0)).alias("_have"), F.sum("count").alias("_rows"))

    # one row for each language
    one = reached(ids.groupBy("_lang", "_p").count(), "_p", F.lit(0)).fillna(last, ["_cut"]).collect()
    table = spark.createDataFrame([tuple(r) for r in one], "_lang string, _cut int, _have long, _rows long")
    inside = ids.join(F.broadcast(table), "_lang").filter("_p = _cut")
    two = reached(inside.groupBy("_lang", "_have", "_q").count(), "_q", F.col("_have")).select("_lang", F.coalesce("_cut", F.lit(last)).alias("_last"))
    cuts = table.join(two, "_lang", "left").select("_lang", "_cut", F.coalesce("_last", F.lit(last)).alias("_last"))
    kept = ids.join(F.broadcast(cuts), "_lang").filter("_p < _cut or (_p = _cut and _q <= _last)").select("_id", "_lang").distinct()
    return kept, [r["_lang"] for r in sorted(one, key=lambda r: (-r["_rows"], r["_lang"]))]


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Filter:
    """Fit the filter to a sample of the rows of df with a label and an id; they may be none.

    The sample of each language is its rows of lowest id hash, about `sample` of them, or all it has; rows without text
    among them teach nothing. Every n-gram of the sample that tells a language from others counts.
    """
    small_batches(df.sparkSession)
    labelled = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).filter("_lang is not null and _id is not null")
    ids, langs = sampled_ids(labelled.select("_id", "_lang"), sample)
    out = Filter(langs)
    if not langs:
        return out
    # bounded: about `sample` ids for each language
    texts = labelled.join(F.broadcast(ids), ["_id", "_lang"], "left_semi").select("_lang", "_text")

    @tk.tidy
    def count(batches):
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for text, rows in pieces(batch.column(1).to_pylist()):
                for n, hashes, row in gram_hashes(text, rows):
                    for name in sorted(set(lang[rows])):
                        own, many = np.unique(hashes[lang[row] == name], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(own), pa.string()), pa.array(np.full(len(own), n), pa.int32()), pa.array(own.view(np.int64)), pa.array(many, pa.int64())],
                            names=["lang", "n", "gram", "seen"],
                        )

    seen = texts.mapInArrow(count, "lang string, n int, gram long, seen long").groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen"))
    totals = seen.groupBy("lang", "n").agg(F.sum("seen").alias("all"))  # languages x sizes
    rate = seen.join(F.broadcast(totals), ["lang", "n"]).withColumn("rate", F.col("seen") / F.col("all"))
    rate = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram")))  # a row for each language at most
    order = df.sparkSession.createDataFrame([(name, k) for k, name in enumerate(langs)], "lang string, place int")
    best = rate.filter((F.col("seen") >= 2) & (F.col("rate") >= SHARE * F.col("top"))).join(F.broadcast(order), "lang").select("place", "gram")
    bit = F.expr("shiftleft(1, place % 8)")
    masks = best.select(F.floor(F.col("place") / 8).cast("int").alias("slice"), bit.alias("bit"), F.explode(F.array(*slot_columns(F.col("gram")))).alias("slot"))
    got = masks.groupBy("slice", "slot").agg(F.bit_or("bit").cast("short").alias("mask")).toArrow()  # bounded by the filter's slots
    out.slices[got["slice"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.uint8)
    return out.close()


def identified(df: DataFrame, fitted: Filter, text_col: str = "text") -> Column:
    """struct<lang_pred, score, grams, hits> of a text column of df; only the texts go to Python.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if no language was learned. score is the
    winner's share of the corrected counts, 0 to 1; a text with letters whose n-grams no language contains gets the
    language with the most labelled rows and score 0. Ties go to that order too. grams: the text's n-grams, hits: the
    winner's corrected count.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # fixed size: SLOTS bytes for every 8 languages

    def predict(texts):
        f = shared.value
        n = len(texts)
        total, hits = np.zeros(n), np.zeros((n, len(f.langs)))
        for part, rows in pieces(texts.to_pylist()):
            for _, hashes, row in gram_hashes(part, rows):
                first, last = rows[0], rows[-1] + 1
                total[first:last] += np.bincount(row - first, minlength=last - first)
                if f.langs:
                    hits[first:last] += f.counts(hashes, row - first, last - first)
        fair = np.maximum((hits - f.chance * total[:, None]) / (1 - f.chance), 0)
        # within a text, what all languages hold alike says nothing
        base = fair.min(axis=1, keepdims=True) if len(f.langs) > 1 else np.zeros((n, 1))
        best = fair.argmax(axis=1) if f.langs else np.zeros(n, int)
        rest = (fair - base).sum(axis=1) if f.langs else np.zeros(n)
        top = (fair - base)[np.arange(n), best] if f.langs else np.zeros(n)
        score = np.divide(top, rest, out=np.zeros(n), where=rest > 0)
        names = [f.langs[b] if t and f.langs else "und" for b, t in zip(best, total)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(total > 0, score, 0.0)), pa.array(total), pa.array(fair.max(axis=1, initial=0.0))],
            names=["lang_pred", "score", "grams", "hits"],
        )

    @F.arrow_udf("lang_pred string, score double, grams double, hits double")
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield predict(texts)
        finally:
            tk.give_back()

    # nondeterministic in name only: else a filter on the result would be pushed below it and run it twice
    return over.asNondeterministic()(F.col(text_col))


def identify(df: DataFrame, fitted: Filter, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, lang_pred, score, ...) for every row of df, whole texts, nothing shuffled; see `identified`.

    Repeated rows and null ids come out as they came in; other columns are not looked at.
    """
    told = df.select(F.col(id_col), *more, identified(df, fitted, text_col).alias("_told"))
    return told.select(*[c for c in told.columns if c != "_told"], "_told.lang_pred", "_told.score")


def recognised(df: DataFrame, fitted: Filter, text_col: str = "text", lang_col: str | None = None, floor: float = FLOOR) -> DataFrame:
    """The rows of df, with all their columns, whose text is in a learned language; a null lang_col becomes the language found.

    Texts without a letter are not, nor are texts of which no language holds a `floor` of the n-grams. If no
    language was learned, or too little of all, there is nothing to tell by, and all texts with a letter stay.
    """
    name = "_told"
    while name in df.columns:
        name += "_"
    got = df.withColumn(name, identified(df, fitted, text_col))
    told = F.col(name)
    held = told["hits"] >= floor * told["grams"] if fitted.grams >= LEAST else F.lit(True)
    got = got.filter((told["grams"] > 0) & held)
    found = {lang_col: F.coalesce(F.col(lang_col), F.when(told["lang_pred"] != "und", told["lang_pred"]))} if lang_col and fitted.langs else {}
    return got.withColumns(found).select(*df.columns)


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learn from the rows that aren't held out, predict all.

    Rows with a null label, id or text teach nothing; a null id is not held out. Any number of languages is learned. Without any labelled row every
    prediction is `und`. See `identified` for the other cases.
    """
    fitted = learn(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return identify(df, fitted, id_col, text_col, held_out(id_col).alias("held_out"))
