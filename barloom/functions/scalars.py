"""Column expressions shared by the operators. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
SELL_WORDS = ("sell", "ask", "offer", "short", "s", "-1", "sellshort", "sell-side", "sell_side")
#: Fixed values: (limit, divisor of what lies at or above it) by rule, largest first; below all limits values are seconds.
EPOCH_RULES = {
    "ticks": ((1e18, 1e6), (1e15, 1e3), (1e12, 1.0)),
    "coarse": ((1e14, 1e6), (1e12, 1.0)),
    "index": ((1e14, 1e6), (1e11, 1.0)),
    "millis": ((float("-inf"), 1.0),),
}


def number(col: Column) -> Column:
    """A double, null where it can't be read as one."""
    return col.try_cast("double")


def epoch_ms(col: Column, rule: str = "ticks") -> Column:
    """Milliseconds since 1970 of seconds, milli-, micro- or nanoseconds, or of ISO text; null if unreadable."""
    n = number(col)
    out = F.lit(None).cast("double")
    limits = EPOCH_RULES[rule]
    case = None
    for least, by in limits:
        case = F.when(n >= least, n / by) if case is None else case.when(n >= least, n / by)
    out = case if rule == "millis" else case.otherwise(n * 1000)
    return F.coalesce(F.round(out).cast("long"), F.unix_millis(F.try_to_timestamp(col.cast("string"))))


def is_true(col: Column) -> Column:
    """1 for positive numbers and the words for true, else 0."""
    n = number(col.cast("string"))
    return F.when(n.isNotNull(), n > 0).otherwise(F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*TRUE_WORDS), F.lit(False))).cast("byte")


def maker_from_side(col: Column) -> Column:
    """1 where the side is a sale."""
    return F.coalesce(F.lower(F.trim(col)).isin(*SELL_WORDS), F.lit(False)).cast("byte")


def month(us: Column) -> Column:
    """yyyy-MM of microseconds since 1970."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def month_in(path: Column) -> Column:
    """The first yyyy-mm in a file name, or unknown."""
    found = F.regexp_extract(path, r"(20\d{2}-\d{2})", 1)
    return F.when(found == "", "unknown").otherwise(found)


def symbol_in(path: Column) -> Column:
    """The symbol that a kline file name starts with."""
    return F.regexp_extract(path, r"([A-Z0-9]+)-1m-[^/]*$", 1)


def run_tag(stem: Column) -> Column:
    """SYMBOL_yyyy-mm of a file stem: the last word before the first month, in capitals; the stem as it is where it has no month or nothing before it.

    Words are parted by _ and -; those and blanks at the end of what comes before the month are not looked at.
    """
    month = F.regexp_extract(stem, r"(20\d{2}-\d{2})", 1)
    before = F.regexp_replace(F.regexp_extract(stem, r"^(.*?)20\d{2}-\d{2}", 1), r"[_\- ]+$", "")
    symbol = F.upper(F.element_at(F.split(before, r"[_\-]+"), -1))
    return F.when((month == "") | (symbol == ""), stem).otherwise(F.concat_ws("_", symbol, month))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def logits(probs: Column, least: float = 1e-6) -> Column:
    """Logarithms of probabilities held between `least` and 1 - least; of two classes the log odds of the last."""
    held = F.transform(probs, lambda p: F.greatest(F.least(p, F.lit(1 - least)), F.lit(least)))
    odds = F.transform(F.slice(held, -1, 1), lambda p: F.ln(p / (1 - p)))
    return F.when(F.size(held) == 2, F.concat(F.array(F.lit(0.0)), odds)).otherwise(F.transform(held, lambda p: F.ln(p)))


def calendar(us: Column) -> list[Column]:
    """Sine and cosine of the time of day and of the day of the week (Monday first)."""
    import math

    ts = F.timestamp_micros(us)
    day = (F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600) * (2 * math.pi / 24)
    week = F.weekday(ts) * (2 * math.pi / 7)
    return [F.sin(day).alias("tod_sin"), F.cos(day).alias("tod_cos"), F.sin(week).alias("dow_sin"), F.cos(week).alias("dow_cos")]


def hour(us: Column) -> Column:
    return F.hour(F.timestamp_micros(us))


def confidence(probs: Column) -> dict[str, Column]:
    """p_pos, p_neg and conf of an array of class probabilities: its last, its first and its largest."""
    return {"p_pos": F.element_at(probs, -1), "p_neg": F.element_at(probs, 1), "conf": F.array_max(probs)}


def class_probabilities(columns: list[str]) -> Column:
    """The array of probabilities of a table of predictions: its prob_* columns, else the softmax of its logits_* columns."""
    found = [c for c in columns if c.startswith("prob_")]
    if found:
        return F.array(*[F.col(c).cast("double") for c in found])
    found = [c for c in columns if c.startswith("logits_")]
    if not found:
        raise ValueError(f"no prob_ or logits_ columns among {columns}")
    return softmax(F.array(*[F.col(c).cast("double") for c in found]))


def end_us(columns: list[str], horizon_us: int, time: str = "us") -> Column:
    """When an event ends: the first of the known end columns, else its time and what it took to hit, else its time and the horizon."""
    ends = [F.col(c) for c in ("end_us", "end_ts", "t1", "vertical_time", "t_vert", "t_end") if c in columns]
    took = [F.col(time) + (F.col("time_to_hit_sec") * 1_000_000).cast("long")] if "time_to_hit_sec" in columns else []
    return (ends or [F.coalesce(*took, F.col(time) + horizon_us)])[0]


def event_reason(reason: Column) -> Column:
    """End reasons with the horizon written as `vertical`."""
    return F.when(reason == "t1", "vertical").otherwise(reason)


def seconds_between(first_us: Column, last_us: Column) -> Column:
    return (last_us - first_us) / 1e6
