"""Queries of the as-of, anchor and return operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.frames import asof_join
from tidegrid.operators import bars as d
from tidegrid.operators import returns as e
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query

#: Buckets of as-of joins by ticker and day.
HOUR = 3_600_000_000_000
DET = """
, anchor AS (SELECT ticker, event_date, arg_min(first_price, minute_index) AS anchor_price FROM day_bars GROUP BY 1, 2),
det AS (SELECT ticker, event_date, any_value(anchor_price) AS anchor_price, min(minute_index) FILTER (WHERE high >= 1.1 * anchor_price) AS detection_minute, arg_min(segment, minute_index) FILTER (WHERE high >= 1.1 * anchor_price) AS segment
        FROM day_bars JOIN anchor USING (ticker, event_date) GROUP BY 1, 2)
"""
BIN = """CASE WHEN {m} < 330 THEN 'premarket (04:00-09:30)' WHEN {m} < 390 THEN 'open-10:30' WHEN {m} < 480 THEN '10:30-12:00' WHEN {m} < 600 THEN '12:00-14:00'
  WHEN {m} < 720 THEN '14:00-16:00' WHEN {m} IS NOT NULL THEN 'post (16:00-20:00)' END"""
ANCHORS = """
, span AS (SELECT ticker, event_date, min(minute_index) AS a, max(minute_index) AS z FROM day_bars GROUP BY 1, 2),
anc AS (SELECT ticker, event_date, n AS anchor, CASE WHEN m >= a THEN m END AS minute, m < a AS is_undefined
  FROM (SELECT ticker, event_date, a, 'open' AS n, 330 AS m FROM span UNION ALL SELECT ticker, event_date, a, 'noon', 480 FROM span
        UNION ALL SELECT ticker, event_date, a, 'last_print', z FROM span))
"""
CLOSES = ", closes AS (SELECT ticker, event_date, session_offset, arg_max(last_price, minute_index) AS close, count(*) AS bars FROM bars GROUP BY 1, 2, 3)\n"
MARK = CLOSES + """
, wide AS (SELECT ticker, event_date, max(close) FILTER (WHERE session_offset = -1) AS m1, max(close) FILTER (WHERE session_offset = 0) AS p0,
  max(close) FILTER (WHERE session_offset = 1) AS p1, max(close) FILTER (WHERE session_offset = 2) AS p2 FROM closes GROUP BY 1, 2)
"""


def anchor(v):
    return v.day_bars.groupBy(*KEYS).agg(F.min_by("first_price", "minute_index").alias("anchor_price"))


def detections(v):
    return e.detect_crossing(v.day_bars, anchor(v), KEYS, 1.1)


def anchors(v):
    return e.clock_anchors(v.day_bars, KEYS, {"open": 330, "noon": 480})


def closes(v):
    return e.session_closes(v.bars, KEYS, [-1, 0, 1, 2])


def marks(v):
    """One-session markouts with their era, bucket and flag."""
    rows = closes(v).select(*KEYS, e.markout(F.col("close_m1"), F.col("close_p0")).alias("markout"), e.era(F.col("event_date"), "2024-01-16").alias("era"))
    return rows.withColumn("flag", F.col("ticker") % 3 == 0)


MARKS = MARK + """
, marks AS (SELECT ticker, event_date, ln(p0 / m1) AS markout, CASE WHEN event_date < DATE '2024-01-16' THEN 'early' ELSE 'late' END AS era, ticker % 3 = 0 AS flag FROM wide)
"""


@query("e1_asof_join", """
SELECT t.ticker, t.et_date, t.ts_ns, t.seq, q.ts_ns AS quote_ts, q.seq AS quote_seq, q.bid, q.ask FROM trades t ASOF LEFT JOIN quotes q ON t.ticker = q.ticker AND t.et_date = q.et_date AND t.ts_ns >= q.ts_ns
""")
def _(v):
    quotes = v.quotes.select("ticker", "et_date", F.col("ts_ns").alias("quote_ts"), F.col("seq").alias("quote_seq"), "bid", "ask")
    return asof_join(v.trades.select("ticker", "et_date", "ts_ns", "seq"), quotes, ["ticker", "et_date"], "ts_ns", "quote_ts", "quote_seq", prefix="", span=HOUR)


@query("e1_asof_tolerance", """
, a AS (SELECT t.ticker, t.ts_ns, t.seq, q.ts_ns AS quote_ts, q.seq AS quote_seq, q.bid FROM trades t ASOF LEFT JOIN quotes q ON t.ticker = q.ticker AND t.ts_ns >= q.ts_ns)
SELECT ticker, ts_ns, seq, CASE WHEN ts_ns - quote_ts <= 1800000000000 THEN quote_seq END AS quote_seq, CASE WHEN ts_ns - quote_ts <= 1800000000000 THEN bid END AS bid FROM a
""")
def _(v):
    quotes = v.quotes.select("ticker", F.col("ts_ns").alias("quote_ts"), F.col("seq").alias("quote_seq"), "bid")
    made = asof_join(v.trades.select("ticker", "ts_ns", "seq"), quotes, ["ticker"], "ts_ns", "quote_ts", "quote_seq", prefix="", span=HOUR, tol=HOUR // 2)
    return made.drop("quote_ts")


@query("e2_asof_shifted", """
, s AS (SELECT ticker, et_date, seq, o AS offset_ns, ts_ns + o AS at_ns FROM trades CROSS JOIN (SELECT unnest([-60000000000, 0, 60000000000]) AS o))
SELECT s.ticker, s.seq, offset_ns, q.seq AS r_seq, q.bid AS r_bid FROM s ASOF LEFT JOIN quotes q ON s.ticker = q.ticker AND s.et_date = q.et_date AND s.at_ns >= q.ts_ns
""")
def _(v):
    made = e.asof_shifted(v.trades.select("ticker", "et_date", "ts_ns", "seq"), v.quotes.select("ticker", "et_date", "ts_ns", "seq", "bid"), ["ticker", "et_date"], "ts_ns", [-60_000_000_000, 0, 60_000_000_000], "seq", span=HOUR)
    return made.select("ticker", "seq", "offset_ns", "r_seq", "r_bid")


@query("e3_clock_anchors", ANCHORS + "SELECT * FROM anc")
def _(v):
    return anchors(v)


@query("e4_volume_rungs", """
, b AS (SELECT ticker, event_date, avg(volume) AS baseline FROM day_bars GROUP BY 1, 2),
c AS (SELECT *, sum(volume) OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS cum FROM day_bars)
SELECT ticker, event_date, min(minute_index) FILTER (WHERE cum >= baseline) AS rung_0, min(minute_index) FILTER (WHERE cum >= 4 * baseline) AS rung_1,
  min(minute_index) FILTER (WHERE cum >= 1000 * baseline) AS rung_2 FROM c JOIN b USING (ticker, event_date) GROUP BY 1, 2
""")
def _(v):
    return e.volume_rungs(v.day_bars, v.day_bars.groupBy(*KEYS).agg(F.avg("volume").alias("baseline")), KEYS, [1, 4, 1000])


@query("e5_horizon_prices", ANCHORS + """
, h AS (SELECT *, minute + horizon AS target FROM anc CROSS JOIN (SELECT unnest([0, 30, 60]) AS horizon))
SELECT h.ticker, h.event_date, anchor, minute, horizon, b.last_price AS price, b.last_price IS NULL AS is_undefined
FROM h ASOF LEFT JOIN day_bars b ON h.ticker = b.ticker AND h.event_date = b.event_date AND h.target >= b.minute_index
""")
def _(v):
    return e.horizon_prices(anchors(v), v.day_bars, KEYS, [30, 60])


@query("e5_close_horizons", ANCHORS + """
, s AS (SELECT ticker, event_date, session_offset, arg_max(last_price, minute_index) AS close, max(minute_index) AS last_minute FROM bars WHERE session_offset IN (0, 1, 2) GROUP BY 1, 2, 3),
p AS (SELECT anc.ticker, anc.event_date, anchor, minute, session_offset, CASE WHEN minute IS NOT NULL AND NOT (session_offset = 0 AND last_minute < minute) THEN close END AS price FROM anc JOIN s ON s.ticker = anc.ticker AND s.event_date = anc.event_date)
SELECT *, price IS NULL AS is_undefined FROM p
""")
def _(v):
    return e.close_horizons(anchors(v), e.session_ends(v.bars.filter("session_offset IN (0, 1, 2)"), KEYS), KEYS)


@query("e6_time_bin", "SELECT " + BIN.format(m="et_min - 240") + " AS bin, count(*) AS n, min(printf('%02d:%02d', et_min // 60, et_min % 60)) AS first_clock FROM trades GROUP BY 1")
def _(v):
    return v.trades.groupBy(e.time_bin(F.col("et_min") - 240).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(e.clock_text(F.col("et_min"))).alias("first_clock"))


@query("e7_detect_crossing", DET + "SELECT *, " + BIN.format(m="detection_minute") + " AS bin, anchor_price IS NULL AS is_undefined, anchor_price IS NOT NULL AND detection_minute IS NULL AS never_reaches FROM det")
def _(v):
    return detections(v)


@query("e8_poll_resolve", """
, a AS (SELECT ticker, event_date, arg_max(last_price, minute_index) AS anchor_price FROM bars WHERE session_offset = -1 AND segment = 'rth' GROUP BY 1, 2),
w AS (SELECT s.ticker, s.event_date, anchor_price, (epoch_us(s.event_date::TIMESTAMP) + (pre_min + 300)::BIGINT * 60000000) * 1000 AS start_ns, (epoch_us(s.event_date::TIMESTAMP) + (open_min + 300)::BIGINT * 60000000) * 1000 AS open_ns,
  (epoch_us(s.event_date::TIMESTAMP) + (close_min + 300)::BIGINT * 60000000) * 1000 AS close_ns, (epoch_us(s.event_date::TIMESTAMP) + (post_min + 300)::BIGINT * 60000000) * 1000 AS end_ns
  FROM spine s LEFT JOIN a USING (ticker, event_date) WHERE session_offset = 0),
h AS (SELECT w.*, threshold, (SELECT min(ts_ns) FROM trades t WHERE t.ticker = w.ticker AND t.et_date = w.event_date AND t.et_min >= 240 AND price >= threshold * anchor_price) AS cross_ns,
  EXISTS (SELECT 1 FROM trades t WHERE t.ticker = w.ticker AND t.et_date = w.event_date AND t.et_min >= 240) AS has_ticks FROM w CROSS JOIN (SELECT unnest([1.1, 1.5]::DOUBLE[]) AS threshold)),
p AS (SELECT *, CASE WHEN interval_s = 0 THEN cross_ns ELSE start_ns + ceil((cross_ns - start_ns) / (interval_s * 1e9))::BIGINT * interval_s * 1000000000 END AS seen_ns FROM h CROSS JOIN (SELECT unnest([0, 1, 60]) AS interval_s))
SELECT ticker, event_date, threshold, interval_s, cross_ns, seen_ns, CASE WHEN seen_ns < open_ns THEN 'premarket' WHEN seen_ns < close_ns THEN 'rth' WHEN seen_ns IS NOT NULL THEN 'post' END AS segment, seen_ns >= end_ns AS is_after_end,
  cross_ns IS NULL AS never_crosses, CASE WHEN anchor_price IS NULL THEN 'no_reference' WHEN NOT has_ticks THEN 'no_ticks' WHEN cross_ns IS NULL THEN 'below_threshold' END AS reason FROM p
""")
def _(v):
    from tidegrid.functions import clock

    ns = lambda c: clock.local_to_ns(clock.us_of(F.col("event_date"), F.col(c)))
    last = v.bars.filter("session_offset = -1 AND segment = 'rth'").groupBy(*KEYS).agg(F.max_by("last_price", "minute_index").alias("anchor_price"))
    bounds = {"start_ns": "pre_min", "open_ns": "open_min", "close_ns": "close_min", "end_ns": "post_min"}
    sessions = v.spine.filter("session_offset = 0").join(last, KEYS, "left").select(*KEYS, "anchor_price", *(ns(c).alias(n) for n, c in bounds.items()))
    ticks = v.trades.filter("et_min >= 240").withColumnRenamed("et_date", "event_date")
    return e.poll_resolve(ticks, sessions, KEYS, [1.1, 1.5], [0, 1, 60])


@query("e9_latency_prices", DET + """
, h AS (SELECT *, detection_minute + x AS target FROM det CROSS JOIN (SELECT unnest([0, 5, 30]) AS x) WHERE detection_minute IS NOT NULL),
p AS (SELECT h.ticker, h.event_date, x, last_price FROM h ASOF LEFT JOIN day_bars b ON h.ticker = b.ticker AND h.event_date = b.event_date AND h.target >= b.minute_index)
SELECT ticker, event_date, max(last_price) FILTER (WHERE x = 0) AS price_0, max(last_price) FILTER (WHERE x = 5) AS price_5, max(last_price) FILTER (WHERE x = 30) AS price_30 FROM p GROUP BY 1, 2
""")
def _(v):
    return e.latency_prices(detections(v), v.day_bars, KEYS, [0, 5, 30])


@query("e10_runway", DET + """
, h AS (SELECT ticker, event_date, max(high) AS day_high, min(minute_index) FILTER (WHERE high = m) AS high_minute
        FROM (SELECT *, max(high) OVER (PARTITION BY ticker, event_date) AS m FROM day_bars) GROUP BY 1, 2),
p AS (SELECT d.*, last_price AS detection_price FROM det d JOIN day_bars b ON b.ticker = d.ticker AND b.event_date = d.event_date AND minute_index = detection_minute)
SELECT ticker, event_date, high_minute - detection_minute AS runway_minutes, ln(day_high / detection_price) AS runway_log FROM p JOIN h USING (ticker, event_date)
""")
def _(v):
    price = v.day_bars.select(*KEYS, F.col("minute_index").alias("detection_minute"), F.col("last_price").alias("detection_price"))
    rows = detections(v).join(price, [*KEYS, "detection_minute"])
    return e.runway(rows, d.high_time_of_day(v.day_bars, KEYS), KEYS).select(*KEYS, "runway_minutes", "runway_log")


@query("e11_session_closes", CLOSES + """
SELECT ticker, event_date, max(close) FILTER (WHERE session_offset = -1) AS close_m1, max(bars) FILTER (WHERE session_offset = -1) AS bars_m1,
  max(close) FILTER (WHERE session_offset = 0) AS close_p0, max(bars) FILTER (WHERE session_offset = 0) AS bars_p0,
  max(close) FILTER (WHERE session_offset = 1) AS close_p1, max(bars) FILTER (WHERE session_offset = 1) AS bars_p1,
  max(close) FILTER (WHERE session_offset = 2) AS close_p2, max(bars) FILTER (WHERE session_offset = 2) AS bars_p2 FROM closes GROUP BY 1, 2
""")
def _(v):
    return closes(v)


@query("e11_session_ends", "SELECT ticker, event_date, session_offset, arg_max(last_price, minute_index) AS close, max(minute_index) AS last_minute, count(*) AS bars FROM bars GROUP BY 1, 2, 3")
def _(v):
    return e.session_ends(v.bars, KEYS)


@query("e12_markout", """
, x AS (SELECT ticker, event_date, arg_min(first_price, minute_index) FILTER (WHERE segment = 'rth') AS o, arg_max(last_price, minute_index) AS c FROM day_bars GROUP BY 1, 2)
SELECT ticker, count(ln(c / o)) AS n, quantile_cont(ln(c / o), 0.5) AS median_markout FROM x GROUP BY 1
""")
def _(v):
    rth = F.when(F.col("segment") == "rth", F.col("minute_index"))
    rows = v.day_bars.groupBy(*KEYS).agg(F.min_by("first_price", rth).alias("o"), F.max_by("last_price", "minute_index").alias("c"), F.count(rth).alias("n_rth"))
    moved = rows.withColumn("m", e.markout(F.when(F.col("n_rth") > 0, F.col("o")), F.col("c")))
    return moved.groupBy("ticker").agg(F.count("m").alias("n"), F.percentile("m", F.lit(0.5)).alias("median_markout"))


@query("e13_markout_grid", MARKS + """
, b AS (SELECT *, markout IS NOT NULL AS ok FROM marks), g AS (SELECT * FROM (SELECT DISTINCT ticker FROM marks) CROSS JOIN (SELECT DISTINCT era FROM marks) CROSS JOIN (SELECT unnest([true, false]) AS flag))
SELECT g.ticker, g.era, g.flag, count(markout) AS n, quantile_cont(markout, 0.25) AS q25, quantile_cont(markout, 0.5) AS median, quantile_cont(markout, 0.75) AS q75, count(markout) < 5 AS is_thin
FROM g LEFT JOIN marks m ON m.ticker = g.ticker AND m.era = g.era AND m.flag = g.flag GROUP BY 1, 2, 3
""")
def _(v):
    return e.markout_grid(marks(v), ["ticker", "era", "flag"], "markout", thin=5)


@query("e13_excluded_populations", MARKS + """
, p AS (SELECT *, CASE WHEN markout IS NULL THEN 'no_price' WHEN abs(markout) > 1.0 THEN 'extreme' ELSE 'included' END AS population FROM marks)
SELECT population, count(*) AS n, count(markout) AS n_defined, quantile_cont(markout, 0.5) AS median FROM p GROUP BY 1
""")
def _(v):
    return e.excluded_populations(marks(v), {"no_price": F.col("markout").isNull(), "extreme": F.abs("markout") > 1.0}, "markout")


@query("e14_axis_grid", DET + """
, z AS (SELECT ticker, event_date, max(minute_index) AS last_minute, arg_max(last_price, minute_index) AS close FROM day_bars GROUP BY 1, 2),
x AS (SELECT d.*, last_minute, close, latency, hold, detection_minute + latency AS t_in, detection_minute + latency + hold AS t_out FROM det d JOIN z ON z.ticker = d.ticker AND z.event_date = d.event_date
  CROSS JOIN (SELECT unnest([0, 5]) AS latency) CROSS JOIN (SELECT unnest([0, 10, 60]) AS hold) WHERE detection_minute IS NOT NULL),
i AS (SELECT x.*, CASE WHEN t_in <= last_minute THEN b.last_price END AS pi FROM x ASOF LEFT JOIN day_bars b ON x.ticker = b.ticker AND x.event_date = b.event_date AND x.t_in >= b.minute_index),
o AS (SELECT i.latency, CASE WHEN hold > 0 THEN hold END AS hold, CASE WHEN hold = 0 THEN 'fixed_exit' ELSE 'fixed_horizon' END AS grid, ln(CASE WHEN hold = 0 THEN close WHEN t_out <= last_minute THEN b.last_price END / pi) AS m
  FROM i ASOF LEFT JOIN day_bars b ON i.ticker = b.ticker AND i.event_date = b.event_date AND i.t_out >= b.minute_index)
SELECT grid, latency, hold, count(*) AS n, count(m) AS n_defined, quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.75) AS q75 FROM o GROUP BY 1, 2, 3
""")
def _(v):
    return e.axis_grid(detections(v), v.day_bars, KEYS, [0, 5], [10, 60])


@query("e15_log_decomposition", """
, x AS (SELECT ticker, event_date, arg_max(last_price, minute_index) FILTER (WHERE session_offset = -1 AND segment = 'rth') AS c, arg_max(last_price, minute_index) FILTER (WHERE session_offset = -1) AS p,
  arg_min(first_price, minute_index) FILTER (WHERE session_offset = 0) AS f, arg_max(last_price, minute_index) FILTER (WHERE session_offset = 0 AND minute_index <= 330) AS o
  FROM bars WHERE session_offset IN (-1, 0) GROUP BY 1, 2),
y AS (SELECT *, coalesce(c > 0 AND p > 0 AND f > 0 AND o > 0, false) AS fine FROM x),
l AS (SELECT ticker, event_date, CASE WHEN fine THEN ln(p / c) END AS prior_post, CASE WHEN fine THEN ln(f / p) END AS overnight, CASE WHEN fine THEN ln(o / f) END AS premarket, NOT fine AS is_undefined FROM y),
t AS (SELECT *, prior_post + overnight + premarket AS total FROM l)
SELECT *, CASE WHEN total > 0 THEN prior_post / total END AS share_prior_post, CASE WHEN total > 0 THEN overnight / total END AS share_overnight, CASE WHEN total > 0 THEN premarket / total END AS share_premarket, coalesce(total <= 0, false) AS share_undefined FROM t
""")
def _(v):
    return e.log_decomposition(v.bars, KEYS)


@query("e16_participation", ANCHORS + """
, n AS (SELECT * FROM anc WHERE anchor = 'noon'),
g AS (SELECT n.ticker, n.event_date, session_offset AS o, coalesce(sum(volume) FILTER (WHERE minute_index <= minute), 0) AS volume, sum(volume) AS whole FROM n
  JOIN bars b ON b.ticker = n.ticker AND b.event_date = n.event_date AND session_offset IN (-3, -2, -1, 0) GROUP BY 1, 2, 3),
p AS (SELECT n.ticker, n.event_date, coalesce(max(volume) FILTER (WHERE o = 0), 0)::BIGINT AS volume, quantile_cont(volume::DOUBLE, 0.5) FILTER (WHERE o < 0) AS clock_baseline,
  quantile_cont(whole::DOUBLE, 0.5) FILTER (WHERE o < 0) AS session_baseline, count(o) FILTER (WHERE o < 0) AS n_sessions FROM n LEFT JOIN g ON g.ticker = n.ticker AND g.event_date = n.event_date GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN avg((coalesce(clock_baseline, 0) = 0)::INT) OVER () > 0.2 THEN 'session' ELSE 'clock' END AS form FROM p)
SELECT *, ln((volume + 1) / (CASE WHEN form = 'session' THEN session_baseline ELSE clock_baseline END + 1)) AS participation FROM f
""")
def _(v):
    return e.participation_form(e.participation(v.bars, anchors(v).filter("anchor = 'noon'"), KEYS))


@query("e17_rank_buckets", MARKS + """
, r AS (SELECT *, row_number() OVER (ORDER BY markout, ticker, event_date) AS r, count(*) OVER () AS n FROM marks WHERE markout IS NOT NULL)
SELECT ticker, event_date, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(5 * (r - 1) / (n - 1)))::INTEGER END AS bucket FROM r
""")
def _(v):
    return e.buckets(marks(v), "markout", 5, KEYS).select(*KEYS, "bucket")


EXTREME = MARK + """
, u AS (SELECT ticker, event_date, 'close_m1->close_p0' AS pair, ln(p0 / m1) AS log_ratio FROM wide UNION ALL SELECT ticker, event_date, 'close_p0->close_p1', ln(p1 / p0) FROM wide),
c AS (SELECT k AS place, k::DOUBLE AS x, k::VARCHAR AS label FROM (SELECT unnest(range(2, 21)) AS k) UNION ALL SELECT k + 20, 1 / k, '1/' || k FROM (SELECT unnest(range(2, 21)) AS k)),
k AS (SELECT u.*, place, label, abs(exp(log_ratio) - x) / x AS deviation FROM u CROSS JOIN c WHERE log_ratio IS NOT NULL)
"""


def extremes(v):
    return e.cross_session_extreme(closes(v), KEYS, [("close_m1", "close_p0"), ("close_p0", "close_p1")], 0.69, 20, 0.05)


@query("e18_cross_session_extreme", EXTREME + """
SELECT ticker, event_date, pair, any_value(log_ratio) AS log_ratio, abs(any_value(log_ratio)) >= 0.69 AS is_large, arg_min(label, (deviation, place)) AS nearest, min(deviation) AS deviation, min(deviation) <= 0.05 AS is_integer_ratio FROM k GROUP BY 1, 2, 3
""")
def _(v):
    return extremes(v)


#: Bands of 5 % touch from 11 on; the log measure that they leave free within 0.18 is summed over a fine grid's exact cells.
@query("e19_band_null", EXTREME + """
, w AS (SELECT ln(1.05 / 0.95) AS w), b AS (SELECT k, ln(k) - w / 2 AS b0, ln(k) + w / 2 AS b1 FROM (SELECT unnest(range(2, 21)) AS k) CROSS JOIN w),
cl AS (SELECT c.k, c.b0, c.b1, ln(c.k) - 0.18 AS lo, ln(c.k) + 0.18 AS hi FROM b c WHERE c.k < (SELECT min(k) FROM b, w WHERE ln(1 + 1 / k) < w)),
cov AS (SELECT cl.k, sum(greatest(0, least(b.b1, coalesce(n.b0, 99), cl.hi) - greatest(b.b0, cl.lo))) AS covered FROM cl CROSS JOIN b LEFT JOIN b n ON n.k = b.k + 1 GROUP BY 1),
x AS (SELECT abs(log_ratio) AS u, EXISTS (SELECT 1 FROM b WHERE abs(log_ratio) BETWEEN b0 AND b1) AS inside FROM u WHERE log_ratio IS NOT NULL AND abs(log_ratio) >= 0.69),
n AS (SELECT cl.k, count(*) FILTER (WHERE u BETWEEN b0 AND b1) AS observed, count(*) FILTER (WHERE u BETWEEN lo AND hi AND NOT inside) AS n_off, any_value(hi - lo) AS width FROM cl LEFT JOIN x ON u BETWEEN least(lo, b0) AND greatest(hi, b1) GROUP BY 1),
e AS (SELECT n.k::INTEGER AS k, observed, n_off, n_off / (width - covered) * w AS raw FROM n JOIN cov USING (k) CROSS JOIN w)
SELECT k, observed, n_off, round(raw, 2) AS expected, observed - round(raw, 2) AS excess, CASE WHEN n_off > 0 THEN round(observed / raw, 2) END AS ratio FROM e
""")
def _(v):
    return e.band_null(extremes(v).filter("is_large"), 20, 0.05)


@query("e19_band_coverage", EXTREME + """
, t AS (SELECT max(abs(log_ratio)) AS top FROM k WHERE abs(log_ratio) >= 0.69), w AS (SELECT ln(1.05 / 0.95) / 2 AS half)
SELECT CASE WHEN top > 0.69 THEN (SELECT sum(greatest(0, least(ln(k) + half, top) - greatest(ln(k) - half, 0.69))) FROM (SELECT unnest(range(2, 21)) AS k) CROSS JOIN w) / (top - 0.69) END AS chance_coverage FROM t
""")
def _(v):
    return e.band_coverage(extremes(v).filter("is_large"), 0.69, 20, 0.05)


@query("e20_retracement", MARK + DET + """
, x AS (SELECT w.*, anchor_price AS a, m.high AS h, b.last_price AS p FROM wide w JOIN det d ON d.ticker = w.ticker AND d.event_date = w.event_date
  JOIN (SELECT ticker, event_date, max(high) AS high FROM day_bars GROUP BY 1, 2) m ON m.ticker = w.ticker AND m.event_date = w.event_date
  LEFT JOIN day_bars b ON b.ticker = w.ticker AND b.event_date = w.event_date AND b.minute_index = detection_minute),
u AS (SELECT ticker, event_date, a, h, p, 'p0' AS horizon, p0 AS c FROM x UNION ALL SELECT ticker, event_date, a, h, p, 'p1', p1 FROM x)
SELECT ticker, event_date, horizon, CASE WHEN c > 0 AND h > a THEN (h - c) / (h - a) END AS of_excursion, CASE WHEN c > 0 AND h > p THEN (h - c) / (h - p) END AS of_detection,
  CASE WHEN c > 0 THEN c < a END AS below_anchor, CASE WHEN c > 0 THEN c < p END AS below_detection, NOT coalesce(h > a, false) AS excursion_undefined, NOT coalesce(h > p, false) AS detection_undefined,
  NOT coalesce(c > 0, false) AS horizon_undefined, false AS is_contaminated FROM u
""")
def _(v):
    price = v.day_bars.select(*KEYS, F.col("minute_index").alias("detection_minute"), F.col("last_price").alias("detection_price"))
    high = v.day_bars.groupBy(*KEYS).agg(F.max("high").alias("high"))
    rows = closes(v).join(detections(v), KEYS).join(price, [*KEYS, "detection_minute"], "left").join(high, KEYS)
    return e.retracement(rows, KEYS, "anchor_price", "detection_price", "high", {"p0": "close_p0", "p1": "close_p1"})


@query("e21_sensitivity_variants", MARKS + """
, u AS (SELECT era, markout, 'all' AS variant FROM marks UNION ALL SELECT era, markout, 'flagged' FROM marks WHERE flag UNION ALL SELECT era, markout, 'unflagged' FROM marks WHERE NOT flag
  UNION ALL SELECT era, markout, 'trimmed' FROM marks WHERE abs(markout) <= 1.0),
m AS (SELECT era, variant, count(*) AS n, quantile_cont(markout, 0.5) AS median FROM u WHERE markout IS NOT NULL GROUP BY 1, 2)
SELECT *, sign(median) <> max(sign(median)) FILTER (WHERE variant = 'all') OVER (PARTITION BY era) AS sign_flips FROM m
""")
def _(v):
    return e.sensitivity_variants(marks(v), "markout", "flag", ["era"], 1.0)


@query("e22_monotonicity", MARKS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY event_date, ticker) % 5 AS bucket FROM marks WHERE markout IS NOT NULL),
m AS (SELECT era, bucket, quantile_cont(markout, 0.5) AS median FROM r GROUP BY 1, 2),
f AS (SELECT *, coalesce(median <= lag(median) OVER (PARTITION BY era ORDER BY bucket), true) AS falls FROM m)
SELECT era, bool_and(falls) AS is_non_increasing, arg_min(median, bucket) - arg_max(median, bucket) AS spread FROM f GROUP BY 1
""")
def _(v):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("era").orderBy("event_date", "ticker")) % 5
    rows = marks(v).filter("markout IS NOT NULL").withColumn("bucket", place)
    return e.monotonicity(e.cell_table(rows, ["era", "bucket"], "markout"), ["era"], "bucket")


@query("e23_runway_split", DET + """
, h AS (SELECT ticker, event_date, min(minute_index) FILTER (WHERE high = m) AS high_minute FROM (SELECT *, max(high) OVER (PARTITION BY ticker, event_date) AS m FROM day_bars) GROUP BY 1, 2),
r AS (SELECT high_minute - detection_minute AS x FROM det JOIN h USING (ticker, event_date) WHERE detection_minute IS NOT NULL)
SELECT floor(log10(x) / 0.25)::BIGINT AS bin, count(*) AS n FROM r WHERE x > 0 GROUP BY 1
""")
def _(v):
    rows = detections(v).join(d.high_time_of_day(v.day_bars, KEYS), KEYS).withColumn("x", F.col("high_minute") - F.col("detection_minute"))
    return e.runway_split(rows, "x", [0, 5, 60], 0.25)[1]


@query("e23_volume_at_detection", DET + """
SELECT d.ticker, d.event_date, (sum(volume) FILTER (WHERE minute_index <= detection_minute))::BIGINT AS volume_at_detection, sum(volume) FILTER (WHERE minute_index <= detection_minute) / sum(volume) AS volume_share
FROM det d JOIN day_bars b ON b.ticker = d.ticker AND b.event_date = d.event_date WHERE detection_minute IS NOT NULL GROUP BY 1, 2
""")
def _(v):
    return e.volume_at(v.day_bars, detections(v), KEYS)


@query("e24_kde_trough", """
, b AS (SELECT round(log10(volume) / 0.01) * 0.01 AS x, count(*) AS n FROM day_bars GROUP BY 1), s AS (SELECT min(x) AS lo, max(x) AS hi FROM b),
g AS (SELECT i, lo + (hi - lo) * i / 999 AS g FROM s CROSS JOIN (SELECT unnest(range(1000)) AS i)),
f AS (SELECT i, g, sum(n * exp(-((g - x) / 0.15) * ((g - x) / 0.15) / 2)) AS f FROM g CROSS JOIN b GROUP BY 1, 2),
t AS (SELECT *, lag(f) OVER (ORDER BY i) AS p, lead(f) OVER (ORDER BY i) AS q FROM f),
m AS (SELECT min(g) AS low_mode, max(g) AS high_mode, count(*) AS n FROM (SELECT * FROM t WHERE f > p AND f >= q ORDER BY f DESC, i LIMIT 2))
SELECT low_mode, high_mode, (SELECT arg_min(g, f) FROM f WHERE g > low_mode AND g < high_mode) AS trough, n = 2 AS is_bimodal FROM m
""")
def _(v):
    return e.kde_trough(v.day_bars, "volume")


@query("e25_era_split", "SELECT CASE WHEN event_date < DATE '2024-01-16' THEN 'early' ELSE 'late' END AS era, count(*) AS n FROM event_list GROUP BY 1")
def _(v):
    return v.event_list.groupBy(e.era(F.col("event_date"), "2024-01-16").alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query("i10_cell_table", MARKS + "SELECT era, flag, count(markout) AS n, quantile_cont(markout, 0.25) AS q25, quantile_cont(markout, 0.5) AS median, quantile_cont(markout, 0.75) AS q75, count(markout) < 100 AS is_thin FROM marks GROUP BY 1, 2")
def _(v):
    return e.cell_table(marks(v), ["era", "flag"], "markout")
