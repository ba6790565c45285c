"""The registered queries over the test tables, each with its DuckDB equivalent where SQL can express it.

The table events is read as ticks: its type is the symbol, its value the price, each trade of quantity one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, bars, decisions, folds, imaging, indicators, policy, selection, synthetic, touch, weights
from ..sources import ticks as T
from ..sources.staging import staged

THRESHOLD = 100_000  # cents
HOUR, DAY = 3_600_000_000, 86_400_000_000
WIN, LOSS = 50.5, 18.4
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def R6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _ticks(spark, sf_dir):
    return T.event_ticks(spark, sf_dir)


def _bars(spark, sf_dir):
    return bars.numbered(bars.dollar_bars(_ticks(spark, sf_dir), THRESHOLD))


def _atr_bars(spark, sf_dir):
    """Bars with their average true range, written once: labels read them as entries, as paths and as ends."""
    return staged(indicators.atr(_bars(spark, sf_dir)), "bars")


def _events(spark, sf_dir):
    """Events with overlapping lives: each lasts from 0 to 26 hours."""
    t = _ticks(spark, sf_dir)
    return t.select("symbol", F.col("seq").alias("eid"), "us", (F.col("us") + (F.col("seq") % 27) * HOUR).alias("end_us"), "price")


def _predictions(spark, sf_dir):
    """Probabilities and outcomes that follow from the event's id and value."""
    t = _ticks(spark, sf_dir)
    p = (F.col("seq") * 7919) % 1000 / 1000.0
    q = (F.col("seq") * 104729) % 1000 / 1000.0
    return t.select("symbol", F.col("seq").alias("eid"), "us", p.alias("p"), q.alias("q"), (F.col("cents") % 3 == 0).cast("int").alias("y"), (F.col("cents") % 3 - 1).cast("int").alias("out"))


TICKS = """t AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS seq, value AS price, 1.0::DOUBLE AS qty, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value > 0)"""
BARS = f"""{TICKS}, b0 AS (SELECT *, CAST(floor((SUM(cents) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) - 1) / {THRESHOLD}) AS BIGINT) AS bar_id FROM t),
b1 AS (SELECT symbol, bar_id, max(us) AS us, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, sum(qty) AS qty, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS ticks FROM b0 GROUP BY symbol, bar_id),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, bar_id) - 1 AS pos FROM b1 QUALIFY bar_id < max(bar_id) OVER (PARTITION BY symbol) OR cents >= {THRESHOLD})"""
TR = f"""{BARS}, tr AS (SELECT *, greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
atr AS (SELECT x.*, y.y AS atr FROM tr x JOIN (WITH RECURSIVE r AS (SELECT symbol, pos, tr AS y FROM tr WHERE pos = 0 UNION ALL SELECT n.symbol, n.pos, r.y * (1 - 1 / 14.0::DOUBLE) + n.tr / 14.0::DOUBLE FROM r JOIN tr n ON n.symbol = r.symbol AND n.pos = r.pos + 1) FROM r) y USING (symbol, pos))"""
EVENTS = f"{TICKS}, e AS (SELECT symbol, seq AS eid, us, us + (seq % 27) * {HOUR} AS end_us, price FROM t)"
PRED = f"{TICKS}, p AS (SELECT symbol, seq AS eid, us, (seq * 7919) % 1000 / 1000.0::DOUBLE AS p, (seq * 104729) % 1000 / 1000.0::DOUBLE AS q, CAST(cents % 3 = 0 AS INT) AS y, CAST(cents % 3 - 1 AS INT) AS out FROM t)"
BAR_COLUMNS = "symbol, bar_id, us, open, high, low, close, qty, cents, ticks"


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM b")
def dollar_bars(spark, sf_dir):
    return bars.dollar_bars(_ticks(spark, sf_dir), THRESHOLD)


@query(f"""WITH {TICKS}, d AS (SELECT symbol, us // {DAY} AS day, sum(cents)::DOUBLE AS c FROM t GROUP BY ALL)
SELECT symbol, round(greatest(least(quantile_cont(c, 0.5) / 12, 200000.0), 50000.0), 4) AS threshold_cents FROM d GROUP BY symbol""")
def adaptive_threshold(spark, sf_dir):
    return bars.adaptive_threshold(_ticks(spark, sf_dir), THRESHOLD, 12, 2.0).select("symbol", F.round("threshold_cents", 4).alias("threshold_cents"))


@query(f"""WITH {TICKS} SELECT symbol, us // {HOUR} * {HOUR} AS start_us, max(us) AS us, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low,
arg_max(price, (us, seq)) AS close, sum(qty) AS qty, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS ticks FROM t GROUP BY symbol, us // {HOUR}""")
def time_bars(spark, sf_dir):
    return bars.time_bars(_ticks(spark, sf_dir), HOUR)


@query(f"""WITH {TICKS} SELECT symbol, strftime(make_timestamp(us), '%Y-%m-%d') AS day, arg_min(price, (us, seq)) AS open, arg_max(price, (us, seq)) AS close, count(*) AS ticks FROM t GROUP BY ALL""")
def streaming_daily_bars(spark, sf_dir):
    from ..streaming import bars as stream

    t = _ticks(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    return stream.time_bars(t, "1 day").select("symbol", F.date_format("start", "yyyy-MM-dd").alias("day"), "open", "close", "ticks")


@query("""SELECT event_id, CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS timestamp, value::FLOAT AS price, 2.0::FLOAT AS qty, CAST(event_type = 'purchase' AS TINYINT) AS is_buyer_maker
FROM events WHERE value > 0""")
def normalised_ticks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = e.select(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("Time"), F.col("value").cast("string").alias("P"), (F.col("value") * 2).cast("string").alias("Quote_Qty"),
        F.when(F.col("event_type") == "purchase", " SELL ").otherwise("buy").alias("Side"), F.col("event_id").alias("_id"),
    )
    return T.normalise(raw).withColumnRenamed("_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END
- CASE WHEN event_id % 50 = 7 AND event_type = 'purchase' THEN 1600000000000 ELSE 0 END AS timestamp FROM events WHERE value > 0""")
def ticks_by_file_unit(spark, sf_dir):
    """Times whose unit the median of a file tells: some early ones among microseconds would be taken for milliseconds by themselves."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    early = F.when(F.col("event_id") % 50 == 7, 1_600_000_000_000_000).otherwise(0)
    at = F.when(F.col("event_type") == "purchase", us - us % 1000 - early).when(F.col("event_type") == "view", F.floor(us / 1000)).otherwise(F.floor(us / 1_000_000))
    raw = e.select(at.cast("string").alias("t"), F.col("value").cast("string").alias("p"), F.lit("1").alias("size"), F.col("event_type").alias("_file"), F.col("event_id").alias("_id"))
    return T.normalise(raw, rule="median").select(F.col("_id").alias("event_id"), "timestamp")


@query("""WITH d AS (SELECT o_orderstatus AS label, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate IS NOT NULL), k AS (SELECT label, count(*) AS n FROM d WHERE month <> '1995-03' GROUP BY label)
SELECT label, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percent FROM k""")
def month_dropped(spark, sf_dir):
    """The mix of classes without one month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_orderstatus").alias("label"))
    return decisions.label_shares(T.without_month(o, "1995-03"))


@query("""WITH l AS (SELECT l_returnflag AS flag, l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, epoch_ms(l_shipdate) // 86400000 AS day,
row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT flag, a, b, c, d, max(day - n) OVER (PARTITION BY flag ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS bumped FROM l""")
def monotonic_bump(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86_400_000)
    rows = line.select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d"), day.alias("day"))
    return bars.bump(rows, ["flag"], ["day", "a", "b", "c", "d"], "day", F.col("day")).drop("day")


@query(f"WITH {TR} SELECT symbol, pos, {R6('tr', 'atr')} FROM atr")
def average_true_range(spark, sf_dir):
    return indicators.atr(_bars(spark, sf_dir)).select("symbol", "pos", *r6("tr", "atr"))


@query(f"""WITH {TR}, v AS (SELECT symbol, pos, lag(atr) OVER (PARTITION BY symbol ORDER BY pos) / close AS v FROM atr)
SELECT symbol, pos, round(coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS vol FROM v""")
def atr_volatility(spark, sf_dir):
    return indicators.atr_vol(_bars(spark, sf_dir)).select("symbol", "pos", *r6("vol"))


@query(f"""WITH {BARS}, x AS (SELECT symbol, pos, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 0) AS x FROM b),
s AS (WITH RECURSIVE r AS (SELECT symbol, pos, x AS m, x * x AS q, 1.0::DOUBLE AS w2 FROM x WHERE pos = 0
  UNION ALL SELECT n.symbol, n.pos, r.m * (31 / 33.0::DOUBLE) + n.x * (2 / 33.0::DOUBLE), r.q * (31 / 33.0::DOUBLE) + n.x * n.x * (2 / 33.0::DOUBLE), r.w2 * (31 / 33.0::DOUBLE) ** 2 + (2 / 33.0::DOUBLE) ** 2
  FROM r JOIN x n ON n.symbol = r.symbol AND n.pos = r.pos + 1) SELECT symbol, pos, CASE WHEN pos > 0 THEN sqrt(greatest(q - m * m, 0) / (1 - w2)) END AS s FROM r),
p AS (SELECT symbol, pos, lag(s) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM s),
f AS (SELECT symbol, pos, first_value(p IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM p)
SELECT symbol, pos, round(coalesce(last_value(nullif(p, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), 0), 6) AS vol FROM f""")
def ewma_volatility(spark, sf_dir):
    return indicators.ewma_vol(_bars(spark, sf_dir)).select("symbol", "pos", *r6("vol"))


@query(f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret FROM b),
y AS (SELECT *, CASE WHEN pos >= 4 THEN stddev_samp(coalesce(ret, 0)) OVER r END AS vol_r, CASE WHEN count(ret) OVER g >= 2 THEN stddev_samp(ret) OVER g END AS v,
  last_value(close) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN CURRENT ROW AND {6 * HOUR} FOLLOWING) / close - 1 AS ret_f
  FROM x WINDOW r AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING), g AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW))
SELECT symbol, pos, round(first_value(vol_r IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS vol_m, round(lag(v) OVER (PARTITION BY symbol ORDER BY pos), 6) AS vol_t, {R6('ret_f')}, CAST(hour(make_timestamp(us)) AS INT) AS hour FROM y""")
def regime_features(spark, sf_dir):
    rows = indicators.window_vol(indicators.rolling_vol(_bars(spark, sf_dir), 20), DAY)
    rows = indicators.forward_return(rows, 6 * HOUR)
    return rows.select("symbol", "pos", *r6("vol_m", "vol_t", "ret_f"), S.hour(F.col("us")).alias("hour"))


def _sides(spark, sf_dir):
    """Purchases, and the prices of the same user's other events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("eid"), "event_type", "value")
    return e.filter("event_type = 'purchase'").select("user", "us", "eid"), e.filter("event_type <> 'purchase'").select("user", "us", F.col("value").alias("seen"))


SIDES = """e AS (SELECT user_id AS user, epoch_us(ts) AS us, event_id AS eid, event_type, value FROM events), l AS (SELECT user, us, eid FROM e WHERE event_type = 'purchase'),
r AS (SELECT user, us, max(value) AS seen FROM e WHERE event_type <> 'purchase' GROUP BY ALL)"""


@query(f"""WITH {SIDES} SELECT l.user, l.us, l.eid, CASE WHEN l.us - r.us <= {DAY} THEN r.us END AS us_right, CASE WHEN l.us - r.us <= {DAY} THEN seen END AS seen FROM l ASOF LEFT JOIN r ON l.user = r.user AND l.us >= r.us""")
def asof_backward(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.asof(left, right, ["user"], "us", "seen", DAY)


@query(f"""WITH {SIDES}, x AS (SELECT l.*, r.us AS ub, r.seen AS sb FROM l ASOF LEFT JOIN r ON l.user = r.user AND l.us >= r.us),
y AS (SELECT x.*, r.us AS uf, r.seen AS sf FROM x ASOF LEFT JOIN r ON x.user = r.user AND x.us <= r.us)
SELECT user, us, eid, CASE WHEN ub IS NULL OR uf - us < us - ub THEN uf ELSE ub END AS us_right, CASE WHEN ub IS NULL OR uf - us < us - ub THEN sf ELSE sb END AS seen FROM y""")
def asof_nearest(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.asof(left, right, ["user"], "us", "seen", how="nearest")


@query(f"""WITH {BARS} SELECT symbol, pos, least(count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY - 1} FOLLOWING), count(*) OVER (PARTITION BY symbol) - 1) AS t1 FROM b""")
def horizon_index(spark, sf_dir):
    return asof.horizon(_bars(spark, sf_dir), DAY).select("symbol", "pos", "t1")


def _touch_sql(source: str, first: str, high: str, low: str, both: str) -> str:
    """SQL of a bar labeler over `source` (symbol, pos, t1, close, up, dn)."""
    return f""", m AS (SELECT s.symbol, s.pos, min(x.pos) AS hit FROM {source} s JOIN b x ON x.symbol = s.symbol AND x.pos BETWEEN s.pos + {first} AND s.t1 AND (x.{high} >= s.up OR x.{low} <= s.dn) GROUP BY ALL),
j AS (SELECT s.symbol, s.pos, s.t1, m.hit, s.close, s.up, s.dn, x.{high} AS h, x.{low} AS l FROM {source} s LEFT JOIN m USING (symbol, pos) LEFT JOIN b x ON x.symbol = s.symbol AND x.pos = m.hit),
o AS (SELECT symbol, pos, coalesce(hit, t1) AS t_end, CASE WHEN hit IS NULL THEN 0 WHEN h >= up AND l <= dn THEN {both} WHEN h >= up THEN 1 ELSE -1 END AS label, hit IS NOT NULL AND h >= up AND l <= dn AND ({both}) = 0 AS dropped FROM j)
SELECT symbol, pos, t_end, CAST(label AS INT) AS label, CASE WHEN dropped THEN 'dropped' WHEN label = 1 THEN 'pt' WHEN label = -1 THEN 'sl' ELSE 't1' END AS reason FROM o"""


ROWS_T1 = "least(pos + 20, max(pos) OVER (PARTITION BY symbol)) AS t1"
LABELS = ("symbol", "pos", "t_end", "label", "reason")


def _rows_horizon(spark, sf_dir, n: int):
    b = staged(_bars(spark, sf_dir), "bars")
    last = b.groupBy("symbol").agg(F.max("pos").alias("_last"))
    return b, b.join(last, "symbol").withColumn("t1", F.least(F.col("pos") + n, F.col("_last"))).drop("_last")


@query(f"WITH {BARS}, s AS (SELECT *, {ROWS_T1}, close * 1.8::DOUBLE AS up, close * 0.5::DOUBLE AS dn FROM b)" + _touch_sql("s", "1", "close", "close", "1"))
def triple_barrier_close(spark, sf_dir):
    b, rows = _rows_horizon(spark, sf_dir, 20)
    rows = rows.withColumns({"up": F.col("close") * 1.8, "dn": F.col("close") * 0.5})
    return touch.label_bars(rows, b, 20, close_only=True).select(*LABELS)


@query(f"WITH {BARS}, s AS (SELECT *, {ROWS_T1}, close * 1.8::DOUBLE AS up, close * 0.5::DOUBLE AS dn FROM b)" + _touch_sql("s", "1", "high", "low", "CASE WHEN abs(up - close) <= abs(close - dn) THEN 1 ELSE -1 END"))
def triple_barrier_ohlc(spark, sf_dir):
    b, rows = _rows_horizon(spark, sf_dir, 20)
    rows = rows.withColumns({"up": F.col("close") * 1.8, "dn": F.col("close") * 0.5})
    return touch.label_bars(rows, b, 20, rule="nearest").select(*LABELS)


@query(f"WITH {BARS}, s AS (SELECT *, {ROWS_T1}, close * 1.8::DOUBLE AS up, close * 0.5::DOUBLE AS dn FROM b)" + _touch_sql("s", "0", "high", "low", "CASE WHEN abs(h - up) <= abs(l - dn) THEN 1 ELSE -1 END"))
def triple_barrier_overshoot(spark, sf_dir):
    b, rows = _rows_horizon(spark, sf_dir, 20)
    rows = rows.withColumns({"up": F.col("close") * 1.8, "dn": F.col("close") * 0.5})
    return touch.label_bars(rows, b, 20, start=0, rule="nearest", nearest="overshoot").select(*LABELS)


@query(f"""WITH {BARS}, v AS (SELECT symbol, us, (high - low) / close AS vol FROM b WHERE hour(make_timestamp(us)) < 12), mid AS (SELECT symbol, quantile_cont(vol, 0.5) AS mid FROM v GROUP BY symbol),
f AS (SELECT b.*, coalesce(last_value(vol IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), mid) AS vol FROM b LEFT JOIN v USING (symbol, us) LEFT JOIN mid USING (symbol)),
s AS (SELECT *, least(count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY - 1} FOLLOWING), count(*) OVER (PARTITION BY symbol) - 1) AS t1,
close * (1 + 0.01::DOUBLE * vol) AS up, close * (1 - 0.008::DOUBLE * vol) AS dn FROM f)""" + _touch_sql("s", "1", "close", "close", "1"))
def triple_barrier_explicit(spark, sf_dir):
    """Closes against barriers by a volatility that is known before noon only, up to an explicit horizon."""
    b = staged(_bars(spark, sf_dir), "bars")
    known = b.filter(S.hour(F.col("us")) < 12).select("symbol", "us", ((F.col("high") - F.col("low")) / F.col("close")).alias("vol"))
    rows = touch.barriers(asof.horizon(touch.with_vol(b, known), DAY), 0.01, 0.008, "vol")
    return touch.label_bars(rows, b, 32, close_only=True).select(*LABELS)


def _labels_sql(valid: str, minutes: int, start: int, winner: str) -> str:
    """SQL of the labeler with diagnostics over `valid`, a select of the bars with up and dn: l (symbol, i, pos, us, ..., label, reason, t_end)."""
    return f"""WITH {TR}, v AS ({valid}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM v),
s AS (SELECT *, least(count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {minutes * 60_000_000 - 1} FOLLOWING), last) AS t1 FROM n),
m AS (SELECT s.symbol, s.i, min(x.i) AS hit FROM s JOIN s x ON x.symbol = s.symbol AND x.i BETWEEN s.i + {start} AND greatest(s.t1, s.i + {start}) AND (x.high >= s.up OR x.low <= s.dn) WHERE s.i < s.last GROUP BY ALL),
j AS (SELECT s.*, m.hit, x.high >= s.up AS u, x.low <= s.dn AS d FROM s LEFT JOIN m USING (symbol, i) LEFT JOIN s x ON x.symbol = s.symbol AND x.i = m.hit),
r AS (SELECT *, CASE WHEN i = last THEN '' WHEN hit IS NULL THEN 't1' WHEN u AND d THEN '{winner}' WHEN u THEN 'pt' ELSE 'sl' END AS reason FROM j),
l AS (SELECT *, CASE reason WHEN 'pt' THEN 1 WHEN 'sl' THEN -1 ELSE 0 END AS label, CASE WHEN reason IN ('pt', 'sl') THEN hit WHEN reason = 't1' THEN greatest(t1, i + {start}) ELSE i END AS t_end FROM r)"""


MINUTES = 2 * DAY // 60_000_000
ATR_SETTINGS = {"barriers": {"mode": "atr", "pt_mult": 1.5, "sl_mult": 0.5}, "horizon": {"minutes": MINUTES}}
PERCENT_SETTINGS = {"barriers": {"mode": "percent", "up": 0.8, "down": 0.5}, "horizon": {"minutes": MINUTES}, "allow_same_bar_touch": False, "same_bar_resolution": "sl_wins"}
ATR_VALID = """SELECT * FROM (SELECT *, close + 1.5::DOUBLE * greatest(a, abs(close) * 1e-12) AS up, close - 0.5::DOUBLE * greatest(a, abs(close) * 1e-12) AS dn
  FROM (SELECT *, lag(atr) OVER (PARTITION BY symbol ORDER BY pos) AS a FROM atr) WHERE a IS NOT NULL) WHERE up > close AND dn < close"""
CLOCK = _labels_sql(ATR_VALID, MINUTES, 0, "dropped")
DIAGNOSED = "symbol, pos, t_end, label, reason"


def _clock_labels(spark, sf_dir):
    return touch.diagnostics(_atr_bars(spark, sf_dir), ATR_SETTINGS)


@query(CLOCK + f" SELECT {DIAGNOSED} FROM l")
def triple_barrier_clock(spark, sf_dir):
    return _clock_labels(spark, sf_dir).select(*LABELS)


@query(_labels_sql("SELECT * FROM (SELECT *, close * (1 + 0.8::DOUBLE) AS up, close * (1 - 0.5::DOUBLE) AS dn FROM atr) WHERE up > close AND dn < close", MINUTES, 1, "sl") + f" SELECT {DIAGNOSED} FROM l")
def triple_barrier_percent(spark, sf_dir):
    """Barriers in percent, looked at from the next bar on; a bar that touches both is a loss."""
    return touch.diagnostics(_bars(spark, sf_dir), PERCENT_SETTINGS).select(*LABELS)


@query("WITH RECURSIVE" + CLOCK[4:] + """, walk AS (SELECT symbol, 0::BIGINT AS i FROM l WHERE i = 0 AND last > 0 UNION ALL SELECT w.symbol, l.t_end + 3 FROM walk w JOIN l ON l.symbol = w.symbol AND l.i = w.i WHERE l.t_end + 3 < l.last)
SELECT l.symbol, l.pos, CASE WHEN w.i IS NULL AND l.i < l.last THEN l.i ELSE t_end END AS t_end, CASE WHEN w.i IS NULL THEN 0 ELSE label END AS label, CASE WHEN w.i IS NULL AND l.i < l.last THEN 'dropped' ELSE reason END AS reason
FROM l LEFT JOIN walk w ON w.symbol = l.symbol AND w.i = l.i""")
def exclusive_events(spark, sf_dir):
    """Events that do not overlap, with two bars between them; those in between are dropped."""
    return touch.diagnostics(_atr_bars(spark, sf_dir), ATR_SETTINGS | {"exclusive_events": True, "min_gap_bars": 2}).select(*LABELS)


@query(f"""WITH {TICKS}, e AS (SELECT symbol, seq AS eid, us, price * 1.6::DOUBLE AS up, price * 0.6::DOUBLE AS dn FROM t),
m AS (SELECT e.symbol, e.eid, min(x.us) AS hit FROM e JOIN t x ON x.symbol = e.symbol AND x.us > e.us AND x.us <= e.us + {DAY} AND (x.price >= e.up OR x.price <= e.dn) GROUP BY ALL),
f AS (SELECT m.symbol, m.eid, m.hit, max(x.price) AS hi FROM m JOIN t x ON x.symbol = m.symbol AND x.us = m.hit GROUP BY ALL)
SELECT e.symbol, e.eid, CAST(CASE WHEN hit IS NULL THEN 2 WHEN hi >= up THEN 1 ELSE 0 END AS INT) AS label, coalesce(hit, e.us + {DAY}) AS event_end_us FROM e LEFT JOIN f USING (symbol, eid)""")
def tick_labels(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    e = t.select("symbol", F.col("seq").alias("eid"), "us", (F.col("price") * 1.6).alias("up"), (F.col("price") * 0.6).alias("dn"))
    return touch.label_ticks(e, t, DAY).select("symbol", "eid", "label", "event_end_us")


_CONC = f"""WITH {EVENTS}, d AS (SELECT symbol, edge, sum(d) AS d FROM (SELECT symbol, us AS edge, 1 AS d FROM e WHERE end_us > us UNION ALL SELECT symbol, end_us, -1 FROM e WHERE end_us > us) GROUP BY ALL),
c AS (SELECT symbol, edge, sum(d) OVER (PARTITION BY symbol ORDER BY edge) AS c, row_number() OVER (PARTITION BY symbol ORDER BY edge) AS n FROM d),
p AS (SELECT symbol, edge, n, coalesce(sum(1.0::DOUBLE / greatest(c, 1)) OVER w, 0) AS inv, coalesce(sum(c::DOUBLE) OVER w, 0) AS tot FROM c WINDOW w AS (PARTITION BY symbol ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT e.*, (b.inv - a.inv) / (b.n - a.n) AS mi, (b.tot - a.tot) / (b.n - a.n) AS mc FROM e LEFT JOIN p a ON a.symbol = e.symbol AND a.edge = e.us AND e.end_us > e.us LEFT JOIN p b ON b.symbol = e.symbol AND b.edge = e.end_us AND e.end_us > e.us)"""


@query(_CONC + ", w AS (SELECT symbol, eid, coalesce(mi, 1) AS w FROM u) SELECT symbol, eid, round(w / avg(w) OVER (), 6) AS weight FROM w")
def uniqueness_weights(spark, sf_dir):
    return weights.uniqueness(_events(spark, sf_dir)).select("symbol", "eid", *r6("weight"))


@query(_CONC.replace("end_us > us UNION", "end_us >= us UNION").replace("-1 FROM e WHERE end_us > us)", "-1 FROM e WHERE end_us >= us)") + """, z AS (SELECT symbol, edge, c FROM c)
SELECT u.symbol, eid, round(1 / greatest(coalesce(mc, z.c, 1), 1), 6) AS weight FROM u LEFT JOIN z ON z.symbol = u.symbol AND z.edge = u.us""")
def concurrency_weights(spark, sf_dir):
    return weights.mean_concurrency_weight(_events(spark, sf_dir)).select("symbol", "eid", *r6("weight"))


@query(f"""WITH {PRED}, n AS (SELECT y, count(*) AS n FROM p GROUP BY y), c AS (SELECT y, (1.0::DOUBLE / n) / avg(1.0::DOUBLE / n) OVER () AS cw FROM n)
SELECT eid, p.y, round(cw, 6) AS class_w, round(cw * (1 + p), 6) AS sample_w FROM p JOIN c ON p.y = c.y""")
def class_sample_weights(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("w", 1 + F.col("p"))
    return weights.class_weights(rows, "y", "w").select("eid", "y", *r6("class_w", "sample_w"))


@query(f"""WITH {EVENTS}, k AS (SELECT *, ntile(5) OVER (ORDER BY us, eid) - 1 AS own FROM e), g AS (SELECT own AS fold, min(us) AS t0, max(end_us) AS t1 FROM k GROUP BY own)
SELECT eid, CAST(fold AS INT) AS fold, CASE WHEN own = fold THEN 'val' ELSE 'train' END AS split FROM k, g
WHERE own = fold OR NOT ((us < t1 AND end_us > t0) OR (us >= t1 AND us < t1 + {DAY}))""")
def purged_kfold(spark, sf_dir):
    return folds.purged_kfold(_events(spark, sf_dir), 5, DAY)


@query(f"""WITH {EVENTS}, k AS (SELECT *, ((row_number() OVER (ORDER BY end_us, eid) - 1) * 5 + 4) // count(*) OVER () AS own FROM e), g AS (SELECT own AS fold, min(end_us) AS lo, max(end_us) AS hi FROM k GROUP BY own)
SELECT eid, CAST(fold AS INT) AS fold, CASE WHEN end_us BETWEEN lo AND hi THEN 'val' ELSE 'train' END AS split FROM e, g
WHERE end_us BETWEEN lo AND hi OR us > hi + {HOUR // 2} OR end_us < lo - {HOUR}""")
def embargo_folds(spark, sf_dir):
    return folds.embargo_folds(_events(spark, sf_dir), 5)


FORWARD = [("2024-01-01", "2024-01-11", "2024-01-11", "2024-01-16"), ("2024-01-01", "2024-01-16", "2024-01-16", "2024-01-21")]


@query(f"""WITH {EVENTS}, g(fold, a, b, c, d) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}')" for i, (a, b, c, d) in enumerate(FORWARD))}),
x AS (SELECT eid, fold, strftime(make_timestamp(us), '%Y-%m-%d') AS day, g.* EXCLUDE (fold) FROM e, g)
SELECT eid, fold, CASE WHEN day >= a AND day < b THEN 'train' ELSE 'val' END AS split FROM x WHERE (day >= a AND day < b) OR (day >= c AND day < d)""")
def walk_forward_folds(spark, sf_dir):
    return folds.walk_forward(_events(spark, sf_dir), FORWARD)


_MOVES = f"""WITH {TR}, v AS (SELECT symbol, pos, us, (max(high) OVER w - close) / atr AS mfe, (close - min(low) OVER w) / atr AS mae FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))"""


def _moves(spark, sf_dir):
    return policy.excursions(indicators.atr(_bars(spark, sf_dir)), 10)


@query(_MOVES + f" SELECT symbol, pos, {R6('mfe', 'mae')} FROM v")
def excursions(spark, sf_dir):
    return _moves(spark, sf_dir).select("symbol", "pos", *r6("mfe", "mae"))


LEVELS = (0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)


@query(_MOVES + " SELECT symbol, " + ", ".join(f"round(quantile_cont(mfe, {q}), 6) AS q{str(q)[2:]}" for q in LEVELS) + " FROM v GROUP BY symbol")
def excursion_quantiles(spark, sf_dir):
    names = {f"q{str(q)[2:]}": q for q in LEVELS}
    return selection.quantiles(_moves(spark, sf_dir), ["symbol"], "mfe", names).select("symbol", *r6(*names))


@query(_MOVES + """, q AS (SELECT quantile_cont(mfe, 0.05) AS lo, quantile_cont(mfe, 0.95) AS hi FROM v) SELECT symbol, pos, round(greatest(least(mfe, hi), lo), 6) AS mfe FROM v, q WHERE mfe IS NOT NULL""")
def winsorised_excursions(spark, sf_dir):
    return policy.winsorised(_moves(spark, sf_dir).filter("mfe is not null"), "mfe", 0.05).select("symbol", "pos", *r6("mfe"))


def _wq(value: str, q: float, group: str) -> str:
    return f"""(SELECT {group} AS g, arg_min(CASE WHEN pc IS NULL OR c = pc THEN x ELSE px + (x - px) * ({q} * a - pc) / (c - pc) END, x) AS r FROM (
  SELECT *, lag(x) OVER w AS px, lag(c) OVER w AS pc FROM (SELECT *, sum(wt) OVER (PARTITION BY {group} ORDER BY x) AS c, sum(wt) OVER (PARTITION BY {group}) AS a FROM
  (SELECT {group}, {value} AS x, sum(1.0::DOUBLE + pos % 3) AS wt FROM v WHERE {value} IS NOT NULL GROUP BY ALL)) WINDOW w AS (PARTITION BY {group} ORDER BY x)) WHERE c >= {q} * a GROUP BY ALL)"""


LEAST = 100  # groups below it take the levels of all


@query(_MOVES + f""", n AS (SELECT symbol, count(*) AS n FROM v GROUP BY symbol), every AS (SELECT * REPLACE ('all' AS symbol) FROM v), gt AS {_wq('mfe', 0.7, 'symbol').replace('FROM v ', 'FROM every ')}, gs AS {_wq('mae', 0.4, 'symbol').replace('FROM v ', 'FROM every ')}
SELECT symbol, n, round(greatest(least(CASE WHEN n >= {LEAST} THEN t.r ELSE gt.r END, 50.0), 0.1), 6) AS tp_mult, round(greatest(least(CASE WHEN n >= {LEAST} THEN s.r ELSE gs.r END, 50.0), 0.1), 6) AS sl_mult
FROM n JOIN {_wq('mfe', 0.7, 'symbol')} t ON t.g = symbol JOIN {_wq('mae', 0.4, 'symbol')} s ON s.g = symbol, gt, gs""")
def barrier_policy(spark, sf_dir):
    rows = staged(_moves(spark, sf_dir).withColumn("weight", 1.0 + F.col("pos") % 3), "moves")
    return policy.levels(rows, "symbol", 0.7, 0.4, LEAST, (0.1, 50.0)).select("symbol", "n", *r6("tp_mult", "sl_mult"))


@query(f"""WITH {PRED}, g AS (SELECT i * (1 / 200.0::DOUBLE) AS th, i FROM range(201) r(i)), a AS (SELECT symbol, i, th, count(*) AS n, avg(y) AS precision FROM p JOIN g ON p.p >= th GROUP BY ALL),
v AS (SELECT *, precision * {WIN} - (1 - precision) * {LOSS} AS ev FROM a WHERE n >= 50)
SELECT symbol, round(th, 3) AS threshold, n, round(precision, 6) AS precision, round(ev, 6) AS ev FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ev DESC, i) = 1""")
def ev_threshold_sweep(spark, sf_dir):
    return decisions.ev_sweep(_predictions(spark, sf_dir), ["symbol"], 200, WIN, LOSS, 50).select("symbol", F.round("threshold", 3).alias("threshold"), "n", *r6("precision", "ev"))


@query(f"""WITH {PRED}, s AS (SELECT p, count(*) AS c, sum(y) AS s FROM p GROUP BY p), k AS (SELECT s, sum(s) OVER w / (sum(c) OVER w)::DOUBLE AS pr FROM s WINDOW w AS (ORDER BY p DESC)), z AS (SELECT sum(y)::DOUBLE AS pos, count(*) AS n FROM p)
SELECT any_value(n)::BIGINT AS n, round(any_value(pos / n), 6) AS base, round(sum(s * pr) / any_value(pos), 6) AS average_precision, round(sum(s * pr) / any_value(pos) / any_value(pos / n), 6) AS lift, round({LOSS} / ({WIN} + {LOSS}), 6) AS breakeven FROM k, z""")
def precision_recall(spark, sf_dir):
    return decisions.precision_recall(_predictions(spark, sf_dir), WIN, LOSS).select("n", *r6("base", "average_precision", "lift", "breakeven"))


@query(f"""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, (o_orderkey * 7919) % 1000 / 1000.0::DOUBLE AS p, CAST(o_custkey % 3 = 0 AS INT) AS y FROM orders),
a AS (SELECT month, count(*) FILTER (p >= 0.97) AS n, coalesce(avg(y) FILTER (p >= 0.97), 0) AS pr FROM d GROUP BY month)
SELECT month, n, round(pr, 6) AS precision, round(CASE WHEN n > 0 THEN pr * {WIN} - (1 - pr) * {LOSS} ELSE 0 END, 6) AS ev FROM a""")
def monthly_ev(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("p"), (F.col("o_custkey") % 3 == 0).cast("int").alias("y"))
    return decisions.ev_by(rows, "month", 0.97, WIN, LOSS).select("month", "n", *r6("precision", "ev"))


THRESHOLDS, CONFIDENCES = np.linspace(0.5, 0.9, 17).tolist(), np.linspace(0.0, 0.9, 19).tolist()
PNL_GRID = f"""WITH {PRED}, g AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), h AS (SELECT unnest({CONFIDENCES})::DOUBLE AS confidence),
a AS (SELECT threshold, confidence, out, CAST(p >= threshold AS INT) - CAST(q >= threshold AS INT) AS a FROM p, g, h WHERE greatest(p, q) >= confidence),
r AS (SELECT threshold, confidence, CASE WHEN a = out THEN 1 ELSE -1 END - 0.0001::DOUBLE AS r FROM a),
z AS (SELECT threshold, confidence, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM r GROUP BY ALL), s AS (SELECT *, mean / (sd + 1e-9) * sqrt(252 * 24 * 60) AS sharpe FROM z)"""


def _pnl_grid(spark, sf_dir):
    rows = _predictions(spark, sf_dir).select(F.col("p").alias("p_pos"), F.col("q").alias("p_neg"), F.greatest("p", "q").alias("conf"), F.col("out").alias("label"))
    return decisions.pnl_grid(rows, THRESHOLDS, CONFIDENCES, 1.0)


@query(PNL_GRID + " SELECT round(threshold, 6) AS threshold, round(confidence, 6) AS confidence, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sharpe, 3) AS sharpe FROM s")
def pnl_threshold_grid(spark, sf_dir):
    return _pnl_grid(spark, sf_dir).select(*r6("threshold", "confidence"), "n", *r6("mean", "sd"), F.round("sharpe", 3).alias("sharpe"))


@query(PNL_GRID + " SELECT round(threshold, 6) AS threshold, round(confidence, 6) AS confidence, round(sharpe, 3) AS sharpe, round(mean, 6) AS mean, n FROM s ORDER BY round(s.sharpe, 9) DESC, s.threshold, s.confidence LIMIT 1")
def pnl_best_threshold(spark, sf_dir):
    grid = _pnl_grid(spark, sf_dir).withColumn("sharpe", F.round("sharpe", 9))  # equal counts are equal figures
    return decisions.best_point(grid).select(*r6("threshold", "confidence"), F.round("sharpe", 3).alias("sharpe"), *r6("mean"), "n")


@query(f"""WITH {BARS}, x AS (SELECT symbol, pos, (close * 0.01 + 100)::DOUBLE AS price, (pos * 7 % 10) / 10.0::DOUBLE AS a, (pos * 3 % 10) / 10.0::DOUBLE AS z FROM b),
y AS (SELECT *, CASE WHEN greatest(a, 0.45, z) < 0.58 THEN 0 WHEN a = greatest(a, 0.45, z) THEN 1 WHEN greatest(a, 0.45, z) = 0.45 THEN 0 ELSE -1 END AS position FROM x),
r AS (SELECT *, position * coalesce((price - lag(price) OVER w) / price, 0) - 0.00055::DOUBLE * abs(position - coalesce(lag(position) OVER w, 0)) AS pnl FROM y WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
q AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol ORDER BY pos)) AS equity FROM r)
SELECT symbol, pos, CAST(position AS INT) AS position, {R6('pnl', 'equity')}, round(1 - equity / max(equity) OVER (PARTITION BY symbol ORDER BY pos), 6) AS drawdown FROM q""")
def pnl_equity(spark, sf_dir):
    rows = _bars(spark, sf_dir).select("symbol", "pos", (F.col("close") * 0.01 + 100).alias("price"), ((F.col("pos") * 7 % 10) / 10.0).alias("a"), ((F.col("pos") * 3 % 10) / 10.0).alias("z"))
    rows = rows.withColumn("position", decisions.positions(F.col("a"), F.lit(0.45), F.col("z"), 0.58))
    return decisions.equity(rows, ["symbol"], ["pos"], 3.5, 2.0).select("symbol", "pos", "position", *r6("pnl", "equity", "drawdown"))


@query(f"WITH {PRED}, n AS (SELECT out AS label, count(*) AS n FROM p GROUP BY out) SELECT label, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percent FROM n")
def label_shares(spark, sf_dir):
    return decisions.label_shares(_predictions(spark, sf_dir).withColumnRenamed("out", "label"))


@query(f"""WITH {PRED} SELECT symbol, count(*) FILTER (out = -1) AS n_m1, count(*) FILTER (out = 0) AS n_0, count(*) FILTER (out = 1) AS n_1, count(*) AS total,
round(100.0::DOUBLE * n_m1 / total, 2) AS pct_m1, round(100.0::DOUBLE * n_0 / total, 2) AS pct_0, round(100.0::DOUBLE * n_1 / total, 2) AS pct_1 FROM p GROUP BY symbol""")
def label_pivot(spark, sf_dir):
    return decisions.label_pivot(_predictions(spark, sf_dir), "symbol", [-1, 0, 1], "out")


@query(f"""WITH {PRED}, x AS (SELECT symbol, greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12) AS pt, greatest(least(q, 4.0), 0.25) AS w FROM p)
SELECT symbol, round(avg(-ln(pt) * w), 6) AS ce, round(avg((1 - pt) ** 2 * -ln(pt) * w), 6) AS focal FROM x GROUP BY symbol""")
def weighted_losses(spark, sf_dir):
    p_true = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    ce, focal = (decisions.cross_entropy(p_true, F.col("q"), g, 0.25, 4.0) for g in (0.0, 2.0))
    return _predictions(spark, sf_dir).groupBy("symbol").agg(F.round(F.avg(ce), 6).alias("ce"), F.round(F.avg(focal), 6).alias("focal"))


GRID = [0.5, 1.0, 2.0, 4.0, 8.0]


@query(f"""WITH {PRED}, z AS (SELECT ln(greatest(least(p, 0.999999), 0.000001) / (1 - greatest(least(p, 0.999999), 0.000001))) AS z, y FROM p)
SELECT t AS temperature, round(avg(ln(1 + exp(z / t * (1 - 2 * y)))), 6) AS nll FROM z, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY t""")
def temperature_scaling(spark, sf_dir):
    z = F.get(S.logits(F.array(1 - F.col("p"), F.col("p"))), 1)
    return decisions.temperatures(_predictions(spark, sf_dir).select(z.alias("z"), "y"), GRID).select("temperature", *r6("nll"))


@query(f"""WITH {TICKS} SELECT seq AS eid, round(sin(2 * pi() * (us // 1000000 % 86400) / 86400.0), 6) + 0.0 AS tod_sin, round(cos(2 * pi() * (us // 1000000 % 86400) / 86400.0), 6) + 0.0 AS tod_cos,
round(sin(2 * pi() * (isodow(make_timestamp(us)) - 1) / 7.0), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(make_timestamp(us)) - 1) / 7.0), 6) + 0.0 AS dow_cos FROM t""")
def calendar_features(spark, sf_dir):
    return _ticks(spark, sf_dir).select(F.col("seq").alias("eid"), *S.calendar(F.col("us"))).select("eid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("tod_sin", "tod_cos", "dow_sin", "dow_cos")])


@query(f"""WITH {BARS}, w AS (SELECT symbol, pos AS start, us AS t0_us, list(close) OVER v AS x, last(us) OVER v AS t1_us FROM b WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) - 1 AS n FROM w WHERE len(x) = 16 AND start % 4 = 0)
SELECT symbol, start, t0_us, t1_us, n // 2048 AS shard, n % 2048 AS idx_in_shard, start + 15 AS bar_pos, round(list_sum(x), 4) AS total,
round(list_max(list_transform(x, lambda c: (c - quantile_x.m) / quantile_x.i)), 6) AS top FROM f, LATERAL (SELECT quantile_cont(u, 0.5) AS m, CASE WHEN quantile_cont(u, 0.75) = quantile_cont(u, 0.25) THEN 1.0 ELSE quantile_cont(u, 0.75) - quantile_cont(u, 0.25) END AS i FROM (SELECT unnest(x) AS u)) quantile_x""")
def window_manifest(spark, sf_dir):
    rows = imaging.manifest(imaging.windows(_bars(spark, sf_dir), 16, 4))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("symbol", "start", "t0_us", "t1_us", "shard", "idx_in_shard", "bar_pos", F.round(total, 4).alias("total"), F.round(F.array_max(imaging.scaled(F.col("values"))), 6).alias("top"))


@query()
def window_images(spark, sf_dir):
    return imaging.images(imaging.windows(_bars(spark, sf_dir), 16, 4), 8, rp=True, cwt=True)


REGATHERED = (f"""WITH {TICKS} SELECT symbol, us // {HOUR} * {HOUR} // 1000 AS open_time, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close,
CAST(greatest(4, least(60, count(*))) AS BIGINT) AS ticks, round(sum(qty), 4) AS volume FROM t GROUP BY symbol, us // {HOUR}""")


@query(REGATHERED)
def kline_ticks_regathered(spark, sf_dir):
    """Hourly bars turned into synthetic ticks and back: prices and volumes return."""
    b = bars.time_bars(_ticks(spark, sf_dir), HOUR)
    k = b.select("symbol", F.floor(F.col("start_us") / 1000).alias("open_time"), (F.floor(F.col("start_us") / 1000) + 3_599_999).alias("close_time"), "open", "high", "low", "close", F.col("qty").alias("volume"), F.col("ticks").alias("trades"), (F.col("qty") / 2).alias("taker_buy_volume"))
    made = synthetic.kline_ticks(k)
    return made.groupBy("symbol", "open_time").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.count("*").alias("ticks"), F.round(F.sum("qty"), 4).alias("volume")
    )


@query(REGATHERED)
def kline_table_function(spark, sf_dir):
    """The same by a table function called from SQL, a partition for each symbol and day."""
    from ..functions import tablefns

    tablefns.register(spark)
    b = bars.time_bars(_ticks(spark, sf_dir), HOUR)
    k = b.select("symbol", F.floor(F.col("start_us") / 1000).alias("open_time"), (F.floor(F.col("start_us") / 1000) + 3_599_999).alias("close_time"), "open", "high", "low", "close", F.col("qty").alias("volume"), F.col("ticks").alias("trades"), (F.col("qty") / 2).alias("taker_buy_volume"), F.floor(F.col("start_us") / DAY).alias("day"))
    return spark.sql("""SELECT symbol, open_time, min_by(price, k) AS open, max(price) AS high, min(price) AS low, max_by(price, k) AS close, count(*) AS ticks, round(sum(qty), 4) AS volume
        FROM kline_ticks(TABLE({k}) PARTITION BY (symbol, day) ORDER BY (open_time), 60) GROUP BY symbol, open_time""", k=k)


@query(f"""WITH {EVENTS}, k AS (SELECT eid, ntile(5) OVER (ORDER BY us, eid) - 1 AS fold FROM e) SELECT k.eid, CAST(fold AS INT) AS fold, CAST(eid % 3 AS INT) AS label, CASE WHEN eid % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS sample_w FROM k""")
def materialised_folds(spark, sf_dir):
    e = _events(spark, sf_dir)
    val = folds.purged_kfold(e, 5).filter("split = 'val'").select("eid", "fold")
    labels = e.select("eid", (F.col("eid") % 3).cast("int").alias("label"))
    return folds.materialise(val, labels, e.filter("eid % 2 = 0").select("eid", F.lit(0.5).alias("weight")))


@query(f"WITH {TICKS} SELECT symbol, seq FROM t ORDER BY md5('7/' || seq), seq LIMIT 500")
def seeded_sample(spark, sf_dir):
    return policy.seeded_sample(_ticks(spark, sf_dir), 500, "seq").select("symbol", "seq")


@query(f"WITH {TICKS} SELECT symbol, seq FROM t ORDER BY -ln(greatest(('0x' || substr(md5('7/' || seq), 1, 13))::BIGINT / {float(1 << 52)}, {2.0**-53})) / price, seq LIMIT 500")
def weighted_sample(spark, sf_dir):
    return policy.weighted_sample(_ticks(spark, sf_dir), 500, "seq", "price").select("symbol", "seq")


@query(f"""WITH {TICKS}, c AS (SELECT symbol, seq, cents, sum(cents) OVER (ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS z, sum(cents) OVER () AS total FROM t),
d AS (SELECT draw, CAST(floor(('0x' || substr(md5('7/' || draw), 1, 13))::BIGINT / {float(1 << 52)} * (SELECT any_value(total) FROM c)::DOUBLE) AS BIGINT) AS u FROM range(2000) r(draw))
SELECT draw, symbol, seq FROM d JOIN c ON u >= z - cents AND u < z""")
def weighted_draws(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    return policy.weighted_draws(t, 2000, ["us", "seq"], "cents", F.floor(F.col("us") / DAY)).select("draw", "symbol", "seq")
