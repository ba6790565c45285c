"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources share `share` of all words by weight; a target stops at `repeats` times its source's size
   and the excess is shared again by weight until none is above. Sorting sources by size per weight turns this
   into a prefix of capped sources, found with running sums.
2. Quotas: blocks of `block` words go to sources, then a source's blocks to its shards, each to the highest
   quotient v / (2s + 1). A party's number of seats is within a known distance of its fair share, so only
   the few quotients around that are ranked, never one for each block.
3. Selection: a source's rows are dealt to shards of bounded words and rows by a hash of the id, so one source with a third of
   all words, or of all rows, empty ones too, is many shards. Within a shard rows stand in seeded order and are cut into blocks; a quota of q blocks
   takes every block q // blocks times, and q % blocks once more: those from a seeded block on, around the end. As
   rows already stand in random order that is a random choice of rows, and at most three of them are cut.

Only per-source rows meet in one task (their number is that of sources, not of documents); everything else is
partitioned by shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

#: Words of a block, words and rows of a shard, and the seed of the selection.
BLOCK, SHARD, ROWS, SEED = 16, 1 << 20, 1 << 16, 2026
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: A run of characters other than space and U+0009..U+000D, and one of these.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a string column; 0 for null."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, SPACE))).cast("long")


def seeded(seed: int, *cols):
    """A hash of some columns, the same on every run."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def sainte_lague(parties: DataFrame, by: list[str], order: list, votes: str, seats: str) -> DataFrame:
    """parties with a column `quota`: `seats` (one number for each group `by`) dealt by highest v / (2s + 1).

    Ties go to the party that comes first by `order`. Parties without votes get nothing. With V votes, N seats and P
    parties in a group, Webster's divisor is within P/2N of V/N, so a quota is within P*v/2V + 1/2 of N*v/V:
    seats below that are sure, and only those up to it are ranked.
    """
    group = Window.partitionBy(*by)
    own = parties.withColumns(
        {
            "_all": F.sum(votes).over(group),
            "_parties": F.count("*").over(group),
            "_place": F.row_number().over(group.orderBy(*order)),
        }
    )
    fair = F.when(F.col("_all") > 0, F.col(seats) * F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    reach = F.when(F.col("_all") > 0, F.col("_parties") * F.col(votes) / (2 * F.col("_all"))).otherwise(F.lit(0.0)) + 1.5
    own = own.withColumns(
        {
            "_sure": F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(fair - reach))).otherwise(0).cast("long"),
            "_most": F.when(F.col(votes) > 0, F.ceil(fair + reach)).otherwise(0).cast("long"),
        }
    )
    own = own.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    seat = own.filter(F.col("_most") > F.col("_sure")).withColumn("_s", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col(votes) / (2 * F.col("_s") + 1)), "_place", "_s"))
    won = seat.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left")).groupBy(*by, "_place").agg(F.count("*").alias("_won"))
    out = own.join(won, [*by, "_place"], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_all", "_parties", "_place", "_sure", "_most", "_left", "_won")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size), one row for each source; other columns follow.

    sid numbers the sources by code point, null last; their weights repeat in that order.
    """
    one = Window.partitionBy(F.lit(1))  # rows are sources
    named = sizes.withColumn("sid", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % n + 1).cast("int"))
    named = named.withColumns({"weight": weight, "cap": (repeats * F.col("source_size")).cast("double")})
    named = named.withColumn("total", F.sum("source_size").over(one) * F.lit(share))
    rising = one.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    # what a weight of one gets if all sources before this one are capped and this and the later ones aren't
    named = named.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    named = named.withColumn("level", F.max(open_).over(one))
    fair = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return named.select("sid", "source", "source_size", fair.alias("target"), *[c for c in sizes.columns if c not in ("source", "source_size")])


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard: int = SHARD,
    shard_rows: int = ROWS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, taken, parts) for every row of df.

    size: words of the text (null: 0); taken: words the mix takes of the row, repeats counted, at most
    `repeats` times its size; parts array<struct<first, words, times>>: which words (from 0) how often.
    A null source is a source of its own, the last one. Null and empty texts, and every row of an
    empty table or of a source without words, take 0. Rows that repeat, or share an id, are taken one by one; their
    order is by a seeded hash of id and text, so a rerun gives the same. Columns named in carry follow, others of df are not looked at.
    """
    text = F.col(text_col)
    # the text's own hash, not the text, tells rows with one id apart: only numbers are shuffled
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("mark"), *kept)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    table = targets(sizes, weights, share, repeats).withColumn("shards", shards).drop("source_rows")
    table = table.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long")).withColumn("all", F.lit(1))
    table = sainte_lague(table, ["all"], ["sid"], "target", "seats").withColumnRenamed("quota", "source_quota").drop("seats", "all")
    table = staged(table, "sources")

    by_id = seeded(seed, F.col("id"), F.col("mark"))
    placed = rows.withColumn("order", by_id).join(table.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")))
    words = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats"))
    quotas = sainte_lague(words, ["sid"], ["shard"], "words", "seats").select("sid", "shard", "words", "quota")

    here = Window.partitionBy("sid", "shard")
    joined = placed.join(quotas, ["sid", "shard"])
    seq = here.orderBy("order", "id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("stop", F.sum("size").over(seq)).withColumn("start", F.col("stop") - F.col("size"))
    blocks = F.ceil(F.col("words") / block)
    # equal blocks over the shard, the last one short; a quota never exceeds `repeats` rounds
    quota = F.least(F.col("quota"), repeats * blocks)
    joined = joined.withColumns({"rounds": F.when(blocks > 0, F.floor(quota / blocks)).otherwise(0), "extra": F.when(blocks > 0, quota % blocks).otherwise(0)})
    words, size, start, stop = F.col("words"), F.col("size"), F.col("start"), F.col("stop")
    begin = F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), blocks)).otherwise(0)
    end = begin + F.col("extra")
    a, z = begin * block, F.least(F.least(end, blocks) * block, words)
    ahead = F.greatest(F.lit(0), F.least(stop, z) - F.greatest(start, a))
    around = F.greatest(F.lit(0), F.least(stop, F.greatest(F.lit(0), end - blocks) * block) - start)
    part = lambda first, n, times: F.struct(first.cast("long").alias("first"), n.cast("long").alias("words"), times.cast("long").alias("times"))
    parts = F.array(part(F.lit(0), size, F.col("rounds")), part(F.lit(0), around, F.lit(1)), part(F.greatest(F.lit(0), a - start), ahead, F.lit(1)))
    return joined.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("rounds") * size + ahead + around).cast("long").alias("taken"),
        F.filter(parts, lambda p: (p["words"] > 0) & (p["times"] > 0)).alias("parts"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def taken_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of `mix(..., carry=(text_col, ...))` as often as they are taken, cut to the words taken.

    A row taken whole keeps its text; of a cut one the words are joined by blanks. Rows of which nothing is taken go.
    """
    each = mixed.withColumn("_p", F.explode("parts")).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_p.times"))))
    words = F.split(F.btrim(F.col(text_col), F.lit(" \t\n\x0b\x0c\r")), SPACE)
    cut = F.array_join(F.slice(words, (F.col("_p.first") + 1).cast("int"), F.col("_p.words").cast("int")), " ")
    return each.withColumn(text_col, F.when(F.col("_p.words") == F.col("size"), F.col(text_col)).otherwise(cut)).drop("_p", "_again")
