"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; the ledger keeps the measurements and one bit for each
rule that failed. A policy is a version with two masks: texts that fail any rule of `reject`, or `limit` or more rules of
`doubt`, are dropped. Applying a policy is then bitwise work over small rows. Comparing versions and computing ablations (the whole policy again with
one rule's bit cleared) need only the counts of the ledger's patterns; no text is read again.

Everything is built-in DataFrame functions; nothing is shuffled to build the ledger or apply a policy.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    fails: str  # SQL over the measurements


#: Bit k of the ledger is rule k. Rules are only ever appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("no_words", "n_words = 0"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("some_repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("some_symbols", "10 * n_symbols > n_words"),
)


class Policy(NamedTuple):
    reject: tuple[str, ...]
    doubt: tuple[str, ...] = ()
    limit: int = 1


BASE = ("too_few_words", "repeated_windows")
POLICIES = {
    "v1": Policy(BASE),
    "v2": Policy((*BASE, "no_words", "long_words", "short_words", "symbols", "repeated_lines")),
    "v3": Policy((*BASE, "no_words", "long_words", "short_words", "symbols"), ("repeated_lines", "some_repeated_windows", "some_symbols"), 3),
}
CURRENT = "v3"


def mask(names) -> int:
    """The bits of some rules."""
    place = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << place[n] for n in set(names))


def _words(text: Column) -> Column:
    plain = F.btrim(text, F.lit(SPACES))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    Words are runs of other characters than space and U+0009..U+000D; a window is three words in a row, equal
    windows are found by sorting a text's own window hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = df.select(F.col(id_col), text.alias("_t"), _words(text).alias("_w"))
    at = at.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_w").cast("long"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_h") - 3),
        lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)),
    )
    at = at.withColumn("_x", F.when(F.size("_h") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # windows equal to a neighbour in that order, by place
    at = at.withColumn("_s", F.when(F.size(F.array_distinct("_x")) < F.size("_x"), pairs))
    same = lambda p, k: F.coalesce(F.get("_s", k)["x"] == p["x"], F.lit(False))
    twice = F.filter(F.transform("_s", lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    at = at.withColumn("_l", lines)
    kept_chars = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    return at.select(
        id_col,
        "n_words",
        (F.length("_t") - kept_chars(SPACES)).cast("long").alias("word_chars"),
        kept_chars(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`measured` plus `failures`, a long with bit k set where rule k failed.

    A null text counts as empty: all measurements are 0. Null ids and repeated rows come out as they came in. An
    empty table gives an empty ledger. Other columns of df are not looked at, whatever their names.
    """
    found = measured(df, id_col, text_col)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(0).cast("long"))
    return found.withColumn("failures", bits)


def _rejects(policy: Policy, failures: Column | None = None) -> Column:
    failures = F.col("failures") if failures is None else failures
    hard = failures.bitwiseAND(F.lit(mask(policy.reject)).cast("long")) != 0
    if not policy.doubt:
        return hard
    return hard | (F.bit_count(failures.bitwiseAND(F.lit(mask(policy.doubt)).cast("long"))) >= policy.limit)


def verdicts(found: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed and kept by one policy."""
    return found.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0).withColumn(
        "kept", ~F.col("base_failed") & ~_rejects(policy)
    )


def patterns(found: DataFrame) -> DataFrame:
    """(failures, n): how many texts have each set of failures; a row for each of the at most 2**len(RULES) sets, combined before the shuffle."""
    return found.groupBy("failures").agg(F.count("*").alias("n"))


def versions(found: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """(version, n, dropped, any_failure) for each policy, from the patterns of the ledger; nothing for an empty one."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), _rejects(p).alias("drop")) for v, p in sorted(policies.items())]))
    return (
        patterns(found)
        .select("failures", "n", each.alias("p"))
        .groupBy("p.version")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p.drop"), F.col("n")).otherwise(0)).alias("dropped"), F.bit_or("failures").alias("any_failure"))
    )


def ablations(found: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """(version, rule, failed, alone): texts that fail each rule of a policy, and that the policy drops but keeps once the rule's bit is cleared.

    From the patterns of the ledger; nothing for an empty one.
    """
    each = []
    for v, p in sorted(policies.items()):
        for name in dict.fromkeys((*p.reject, *p.doubt)):
            bit = F.lit(mask([name])).cast("long")
            fails = F.col("failures").bitwiseAND(bit) != 0
            spared = _rejects(p) & ~_rejects(p, F.col("failures").bitwiseAND(F.bitwise_not(bit)))
            each.append(F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), fails.alias("fails"), spared.alias("spared")))
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    rows = patterns(found).select("n", F.explode(F.array(*each)).alias("r"))
    return rows.groupBy("r.version", "r.rule").agg(total("r.fails").alias("failed"), total("r.spared").alias("alone"))


_CASES = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))
LEDGER_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (SELECT *, ({_CASES})::BIGINT AS failures FROM m)"""
ORACLE = f"""{LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & {mask(BASE)}) <> 0 AS base_failed,
       (failures & {mask(BASE) | mask(POLICIES[CURRENT].reject)}) = 0
         AND bit_count(failures & {mask(POLICIES[CURRENT].doubt)}) < {POLICIES[CURRENT].limit} AS kept,
       failures
FROM f
"""
_policy_rows = ", ".join(f"('{v}', {mask(p.reject)}, {mask(p.doubt)}, {p.limit})" for v, p in POLICIES.items())
_rule_rows = ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(RULES))
_POLICY_SQL = f"""{LEDGER_SQL}, p(version, hard, soft, most) AS (VALUES {_policy_rows}), r(rule, bit) AS (VALUES {_rule_rows})"""
VERSIONS_ORACLE = f"""{_POLICY_SQL}
SELECT version, count(*) AS n, count(*) FILTER ((failures & hard) <> 0 OR bit_count(failures & soft) >= most) AS dropped, bit_or(failures) AS any_failure
FROM f, p GROUP BY version"""
ABLATIONS_ORACLE = f"""{_POLICY_SQL}
SELECT version, rule, count(*) FILTER ((failures & bit) <> 0) AS failed,
       count(*) FILTER (((failures & hard) <> 0 OR bit_count(failures & soft) >= most)
         AND (failures & hard & ~bit) = 0 AND bit_count(failures & soft & ~bit) < most) AS alone
FROM f, p, r WHERE ((hard | soft) & bit) <> 0 GROUP BY version, rule"""
