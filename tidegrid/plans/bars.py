"""Queries of the bar, grid and concentration operators (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import bars as d
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query

STRICT = ["ticker", "day", "size", "et_min"]
#: Regular hours as a dense grid, minutes 330 to 719 from the pre-market's start.
GRID = """
, grid AS (
  SELECT e.ticker, e.event_date, m.minute_index, coalesce(volume, 0)::BIGINT AS volume, first_price, last_price
  FROM event_list e CROSS JOIN (SELECT unnest(range(330, 720)) AS minute_index) m
  LEFT JOIN day_bars b ON b.ticker = e.ticker AND b.event_date = e.event_date AND b.minute_index = m.minute_index),
filled AS (
  SELECT *, last_value(last_price IGNORE NULLS) OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS filled FROM grid)
"""
DECAY = GRID + """
, ends AS (SELECT *, coalesce(first_value(first_price) OVER w, first_value(last_price IGNORE NULLS) OVER w) AS start, last_value(last_price IGNORE NULLS) OVER w AS stop FROM filled
  WINDOW w AS (PARTITION BY ticker, event_date ORDER BY minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
decay AS (SELECT ticker, event_date, minute_index, coalesce(abs(ln(filled / start)), 0) / nullif(abs(ln(stop / start)), 0) AS realized, coalesce(stop = start, true) AS is_undefined FROM ends)
"""


def grid(v):
    bounds = v.event_list.select(*KEYS, F.lit(330).cast("long").alias("start"), F.lit(720).cast("long").alias("stop"))
    return d.dense_grid(v.day_bars, bounds, KEYS)


@query("d1_minute_bars", "SELECT * FROM bars")
def _(v):
    return v.bars


@query("d2_excluded_share", """
, n AS (SELECT ticker, event_date, count(*) FILTER (WHERE segment IN ('premarket', 'rth', 'post')) AS n_inside, count(*) AS n FROM seg GROUP BY 1, 2)
SELECT ticker, event_date, n_inside, n - n_inside AS n_outside, (n - n_inside) / n AS outside_share FROM n
""")
def _(v):
    return d.excluded_share(d.built_bars(v.trades, v.spine, KEYS), KEYS)


@query("d3_verify_bars", """
, k AS (SELECT count(*) AS n, min(minute_index) AS m, min(segment) AS s FROM bars GROUP BY ticker, event_date, session_offset, minute_index)
SELECT count(*) FILTER (WHERE n > 1) AS duplicate_keys, count(*) FILTER (WHERE m NOT BETWEEN 0 AND 959) AS out_of_range,
  count(*) FILTER (WHERE s NOT IN ('premarket', 'rth', 'post')) AS bad_labels FROM k
""")
def _(v):
    return d.verify_bars(v.bars, KEYS)


@query("d4_dup_prints_approx")
def _(v):
    return d.dup_prints_approx(v.trades, ["ticker"], STRICT, ["ticker", "day", "et_min"])


@query("d4_dup_prints_of_bars")
def _(v):
    built = d.built_bars(v.trades, v.spine.filter("session_offset = 0"), KEYS, {"strict": STRICT, "loose": ["ticker", "day", "et_min"]})
    return d.dup_prints_of_bars(built, ["ticker"])


@query("d5_dup_prints_exact", """
SELECT ticker, count(*) AS n, count(*) - count(DISTINCT (day, size, et_min)) AS dup_strict, count(*) - count(DISTINCT (day, et_min)) AS dup_loose FROM trades GROUP BY 1
""")
def _(v):
    return d.dup_prints_exact(v.trades, ["ticker"], STRICT, ["ticker", "day", "et_min"])


@query("d6_row_cap_scan", """
, c AS (SELECT count(*) AS n FROM trades GROUP BY ticker, et_date)
SELECT n, count(*) AS events, n % 10 = 0 AS is_round FROM c GROUP BY n HAVING count(*) >= 3 OR n % 10 = 0
""")
def _(v):
    return d.row_cap_scan(v.trades.groupBy("ticker", "et_date").agg(F.count(F.lit(1)).alias("n")), step=10)


@query("d7_dense_grid", GRID + "SELECT * FROM grid")
def _(v):
    return grid(v)


@query("d8_forward_fill", GRID + "SELECT * FROM filled")
def _(v):
    return d.forward_fill(grid(v), KEYS)


@query("d9_concentration_curve", GRID + """
, s AS (SELECT *, coalesce(abs(ln(last_price / lag(last_price) OVER (PARTITION BY ticker, event_date ORDER BY minute_index))), 0) AS step FROM filled)
SELECT ticker, event_date, minute_index, row_number() OVER r / count(*) OVER w AS time_share,
  sum(volume) OVER r / nullif(sum(volume) OVER w, 0) AS volume_share, sum(step) OVER r / nullif(sum(step) OVER w, 0) AS path_share
FROM s WINDOW w AS (PARTITION BY ticker, event_date), r AS (PARTITION BY ticker, event_date ORDER BY minute_index ROWS UNBOUNDED PRECEDING)
""")
def _(v):
    return d.concentration_curve(grid(v), KEYS)


@query("d10_min_window_minutes", GRID + """
, p AS (SELECT *, sum(volume) OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS cum, sum(volume) OVER (PARTITION BY ticker, event_date) AS total FROM grid),
x AS (SELECT * FROM p WHERE total > 0), w AS (SELECT ticker, event_date, count(*) AS whole FROM grid GROUP BY 1, 2),
m AS (SELECT a.ticker, a.event_date, min(b.minute_index - a.minute_index + 1) AS minutes
FROM x a JOIN x b ON a.ticker = b.ticker AND a.event_date = b.event_date AND b.minute_index >= a.minute_index AND b.cum >= a.cum - a.volume + 0.5 * a.total GROUP BY 1, 2)
SELECT ticker, event_date, coalesce(minutes, whole) AS minutes FROM w LEFT JOIN m USING (ticker, event_date)
""")
def _(v):
    return d.min_window_minutes(grid(v), KEYS, 0.5)


@query("d11_opportunity_decay", DECAY + """
SELECT ticker, event_date, min(minute_index) FILTER (WHERE realized >= 0.5) AS minute_at_level, max(is_undefined) AS is_undefined FROM decay GROUP BY 1, 2
""")
def _(v):
    return d.half_life(d.opportunity_decay(grid(v), KEYS), KEYS)


@query("d11_decay_after_cutoff", DECAY.replace("OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS filled FROM grid", "OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS filled FROM grid WHERE minute_index >= 345") + """
SELECT ticker, event_date, min(minute_index) FILTER (WHERE realized >= 0.5) AS minute_at_level, max(is_undefined) AS is_undefined FROM decay GROUP BY 1, 2
""")
def _(v):
    return d.half_life(d.opportunity_decay(grid(v), KEYS, least_minute=345), KEYS)


@query("d11_anchored_decay", GRID + """
, c AS (SELECT ticker, event_date, arg_max(last_price, minute_index) AS anchor FROM bars WHERE session_offset = -1 AND segment IN ('premarket', 'rth') GROUP BY 1, 2), t AS (SELECT ticker, event_date, max(high) AS high FROM day_bars GROUP BY 1, 2),
a AS (SELECT f.*, anchor, high, coalesce(ln(high / anchor) > 0, false) AS fine FROM filled f LEFT JOIN c USING (ticker, event_date) LEFT JOIN t USING (ticker, event_date))
SELECT ticker, event_date, minute_index, CASE WHEN fine THEN coalesce(ln(filled / anchor), 0) / ln(high / anchor) END AS realized, NOT fine AS is_undefined FROM a
""")
def _(v):
    anchor = d.anchor_close(v.bars, KEYS).select(*KEYS, "anchor_price")
    high = d.high_time_of_day(v.day_bars, KEYS).select(*KEYS, "day_high")
    return d.anchored_decay(grid(v).join(anchor, KEYS, "left").join(high, KEYS, "left"), KEYS, "anchor_price", "day_high")


POOLED = DECAY + ", pooled AS (SELECT minute_index, quantile_cont(realized, 0.5) AS median FROM decay GROUP BY 1)\n"


@query("d12_pooled_crossing", POOLED + "SELECT min(minute_index) FILTER (WHERE median >= 0.5) AS minute_at_level FROM pooled")
def _(v):
    return d.pooled_crossing(d.pooled_minute_quantiles(d.opportunity_decay(grid(v), KEYS), "realized"))


@query("d12_pooled_minute_quantiles", DECAY + """
SELECT minute_index, count(realized) AS n, quantile_cont(realized, 0.25) AS q25, quantile_cont(realized, 0.5) AS median, quantile_cont(realized, 0.75) AS q75 FROM decay GROUP BY 1
""")
def _(v):
    return d.pooled_minute_quantiles(d.opportunity_decay(grid(v), KEYS), "realized")


@query("d13_segment_shares", """
SELECT ticker, event_date, coalesce(sum(volume) FILTER (WHERE segment = 'premarket'), 0) / sum(volume) AS premarket_share,
  coalesce(sum(volume) FILTER (WHERE segment = 'rth'), 0) / sum(volume) AS rth_share, coalesce(sum(volume) FILTER (WHERE segment = 'post'), 0) / sum(volume) AS post_share
FROM day_bars GROUP BY 1, 2
""")
def _(v):
    return d.segment_shares(v.day_bars, KEYS)


@query("d14_anchor_close", """
SELECT ticker, event_date, arg_max(last_price, minute_index) AS anchor_price, max(minute_index) AS anchor_minute
FROM bars WHERE session_offset = -1 AND segment IN ('premarket', 'rth') GROUP BY 1, 2
""")
def _(v):
    return d.anchor_close(v.bars, KEYS)


@query("d15_high_time_of_day", """
, h AS (SELECT ticker, event_date, max(high) AS day_high, min(minute_index) FILTER (WHERE high = m) AS high_minute
        FROM (SELECT *, max(high) OVER (PARTITION BY ticker, event_date) AS m FROM day_bars) GROUP BY 1, 2)
SELECT *, printf('%02d:%02d', (high_minute + 240) // 60, (high_minute + 240) % 60) AS high_clock, round((high_minute + 240) / 60, 6) AS high_hour FROM h
""")
def _(v):
    return d.high_time_of_day(v.day_bars, KEYS)


@query("d16_realized_at_minute", DECAY + """
, m AS (SELECT ticker, event_date, avg(minute_index) AS minute FROM day_bars WHERE segment = 'rth' GROUP BY 1, 2)
SELECT ticker, event_date, minute, round(minute)::BIGINT AS minute_index, realized FROM m LEFT JOIN decay d USING (ticker, event_date) WHERE d.minute_index = round(minute)
""")
def _(v):
    minutes = v.day_bars.filter("segment = 'rth'").groupBy(*KEYS).agg(F.avg("minute_index").alias("minute"))
    return d.realized_at_minute(d.opportunity_decay(grid(v), KEYS), minutes, KEYS)


@query("d17_reindex_clock", "SELECT ticker, event_date, minute_index - 330 AS minute_index, volume, last_price FROM day_bars WHERE segment = 'rth'")
def _(v):
    rows = d.reindex_clock(v.day_bars, v.spine.filter("session_offset = 0"), KEYS)
    return rows.select(*KEYS, "minute_index", "volume", "last_price")


@query("d17_decay_on_open_clock", DECAY.replace("(330, 720)) AS minute_index", "(0, 390)) AS minute_index").replace("b.minute_index = m.minute_index", "b.minute_index - 330 = m.minute_index AND b.segment = 'rth'") + """
SELECT ticker, event_date, min(minute_index) FILTER (WHERE realized >= 0.5) AS minute_at_level, max(is_undefined) AS is_undefined FROM decay GROUP BY 1, 2
""")
def _(v):
    rows = d.reindex_clock(v.day_bars, v.spine.filter("session_offset = 0"), KEYS)
    bounds = v.event_list.select(*KEYS, F.lit(0).cast("long").alias("start"), F.lit(390).cast("long").alias("stop"))
    return d.half_life(d.opportunity_decay(d.dense_grid(rows, bounds, KEYS), KEYS), KEYS)


@query("d18_tie_audit", """
, m AS (SELECT l_partkey AS ticker, epoch_us(l_shipdate) AS ts_ns, l_extendedprice AS price FROM lineitem),
x AS (SELECT *, min(ts_ns) OVER (PARTITION BY ticker) AS a, max(ts_ns) OVER (PARTITION BY ticker) AS z FROM m)
SELECT ticker, count(*) FILTER (WHERE ts_ns = a) > 1 AS first_tied, count(*) FILTER (WHERE ts_ns = z) > 1 AS last_tied,
  max(price) FILTER (WHERE ts_ns = a) - min(price) FILTER (WHERE ts_ns = a) AS first_range, max(price) FILTER (WHERE ts_ns = z) - min(price) FILTER (WHERE ts_ns = z) AS last_range
FROM x GROUP BY 1
""")
def _(v):
    from tidegrid.functions.clock import epoch_us

    rows = v.table("lineitem").select(F.col("l_partkey").alias("ticker"), epoch_us(F.col("l_shipdate")).alias("ts_ns"), F.col("l_extendedprice").alias("price"))
    return d.tie_audit(rows, ["ticker"])


@query("d19_vwap_running", """
SELECT ticker, event_date, minute_index, sum(notional) OVER r / sum(volume) OVER r AS vwap_running FROM day_bars
WINDOW r AS (PARTITION BY ticker, event_date ORDER BY minute_index ROWS UNBOUNDED PRECEDING)
""")
def _(v):
    return d.vwap_running(v.day_bars, KEYS).select(*KEYS, "minute_index", "vwap_running")


@query("d19_atr_bars", """
, p AS (SELECT *, lag(last_price) OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS prior FROM day_bars),
r AS (SELECT *, CASE WHEN prior IS NOT NULL THEN greatest(high - low, abs(high - prior), abs(low - prior)) END AS tr FROM p)
SELECT ticker, event_date, count(tr) AS n, CASE WHEN count(tr) >= 2 THEN avg(tr) ELSE stddev_pop(last_price) END AS atr FROM r GROUP BY 1, 2
""")
def _(v):
    return d.atr_bars(v.day_bars, KEYS)
