"""Queries of the quote, spread, signing and cost operators (F)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidegrid.functions import clock
from tidegrid.operators import calendar
from tidegrid.operators import quotes as q
from tidegrid.operators import returns
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query
from tidegrid.plans.returns import DET, HOUR, detections

DAY = ["ticker", "et_date"]
SEG = ["ticker", "et_date", "segment"]
LABEL = """
, ql AS (SELECT q.*, open_min, close_min, CASE WHEN is_early_close THEN close_min + 240 ELSE 1200 END AS post_min FROM quotes q JOIN calendar ON session_date = et_date),
qs AS (SELECT *, CASE WHEN et_min < 240 THEN 'outside_early' WHEN et_min < open_min THEN 'premarket' WHEN et_min < close_min THEN 'rth' WHEN et_min < post_min THEN 'post' ELSE 'outside_late' END AS segment FROM ql),
qe AS (SELECT *, (epoch_us(et_date::TIMESTAMP) + (CASE segment WHEN 'premarket' THEN open_min WHEN 'rth' THEN close_min WHEN 'post' THEN post_min END + 300)::BIGINT * 60000000) * 1000 AS segment_end_ns
       FROM qs WHERE segment IN ('premarket', 'rth', 'post')),
qd AS (SELECT *, greatest(0, least(coalesce(lead(ts_ns) OVER w, segment_end_ns), segment_end_ns) - ts_ns) AS duration_ns, (bid + ask) / 2 AS mid, ask - bid AS spread,
  NOT (bid IS NOT DISTINCT FROM lag(bid) OVER w AND ask IS NOT DISTINCT FROM lag(ask) OVER w) AS is_change,
  bid > ask AS is_crossed, bid = ask AS is_locked, bid <= 0 OR ask <= 0 AS is_nonpositive, bid_size = 0 OR ask_size = 0 AS is_zero_size,
  bid IS NULL OR ask IS NULL AS is_null_price, (bid IS NULL) <> (ask IS NULL) AS is_one_sided, coalesce(bid_size = 0, true) AS is_zero_bid, coalesce(ask_size = 0, true) AS is_zero_ask,
  coalesce(bid > ask OR bid IS NULL OR ask IS NULL OR bid <= 0 OR ask <= 0, false) AS is_hard, coalesce(bid = ask OR coalesce(bid_size = 0, true) OR coalesce(ask_size = 0, true), false) AS is_degraded
  FROM qe WINDOW w AS (PARTITION BY ticker, et_date, segment ORDER BY ts_ns, seq))
"""
def metrics_sql(name, grain):
    """Quote metrics at a grain of qd's columns."""
    return f"""
, {name} AS (SELECT {grain}, count(*) AS n_quotes, sum(duration_ns)::BIGINT AS duration_ns, count(*) FILTER (WHERE is_change) AS n_changes,
  sum(duration_ns) FILTER (WHERE is_hard) / nullif(sum(duration_ns), 0) AS unusable_share, sum(duration_ns) FILTER (WHERE is_locked) / nullif(sum(duration_ns), 0) AS locked_share,
  sum(spread * duration_ns) FILTER (WHERE NOT is_hard) / nullif(sum(duration_ns) FILTER (WHERE NOT is_hard), 0) AS tw_spread,
  sum(spread / nullif(mid, 0) * 10000 * duration_ns) FILTER (WHERE NOT is_hard) / nullif(sum(duration_ns) FILTER (WHERE NOT is_hard), 0) AS tw_spread_bp,
  sum(mid * duration_ns) FILTER (WHERE NOT is_hard) / nullif(sum(duration_ns) FILTER (WHERE NOT is_hard), 0) AS tw_mid FROM qd GROUP BY ALL)
"""


QM = LABEL + metrics_sql("qm", "ticker, et_date, segment")
MINUTE = [*SEG, "minute_index"]
QMM = metrics_sql("qmm", "ticker, et_date, segment, (et_min - 240)::BIGINT AS minute_index")
#: Trades in session segments, signed against the last usable quote of their segment.
SIGNED = LABEL + """
, tl AS (SELECT t.*, CASE WHEN et_min < open_min THEN 'premarket' WHEN et_min < close_min THEN 'rth' ELSE 'post' END AS segment, (et_min - 240)::BIGINT AS minute_index
  FROM trades t JOIN calendar ON session_date = et_date WHERE et_min >= 240 AND et_min < CASE WHEN is_early_close THEN close_min + 240 ELSE 1200 END),
qg AS (SELECT *, max(CASE WHEN is_change THEN ts_ns END) OVER (PARTITION BY ticker, et_date, segment ORDER BY ts_ns, seq) AS change_ns FROM qd WHERE NOT is_hard),
tq AS (SELECT t.*, b.ts_ns AS q_ns, b.seq AS q_seq, b.mid AS q_mid, b.change_ns FROM tl t ASOF LEFT JOIN qg b ON t.ticker = b.ticker AND t.et_date = b.et_date AND t.segment = b.segment AND t.ts_ns >= b.ts_ns),
sg AS (SELECT *, coalesce(nullif(sign(price - q_mid), 0), nullif(sign(price - lag(price) OVER (PARTITION BY ticker, et_date, segment ORDER BY ts_ns, seq)), 0))::INTEGER AS sign FROM tq)
"""
TM = SIGNED + """
, tm AS (SELECT ticker, et_date, segment, minute_index, count(*) AS n_trades, sum(size)::BIGINT AS volume, sum(abs(price - q_mid) * size) AS abs_distance_size, (sum(size) FILTER (WHERE sign IS NOT NULL))::BIGINT AS classified,
  sum(sign * size)::BIGINT AS signed_volume, count(*) FILTER (WHERE sign IS NULL) AS n_unclassified, count(*) FILTER (WHERE q_mid IS NULL) AS n_no_quote,
  floor(quantile_cont((ts_ns - change_ns)::DOUBLE, 0.5) / 1e6)::BIGINT AS age_p50, floor(quantile_cont((ts_ns - change_ns)::DOUBLE, 0.95) / 1e6)::BIGINT AS age_p95,
  avg(CASE WHEN ts_ns - change_ns > 1000000000 THEN 1.0::DOUBLE ELSE 0 END) AS share_over_1s, avg(CASE WHEN ts_ns - change_ns > 60000000000 THEN 1.0::DOUBLE ELSE 0 END) AS share_over_60s FROM sg GROUP BY 1, 2, 3, 4)
"""
CACHE = TM + QMM + """
, cache AS (SELECT * FROM qmm FULL JOIN tm USING (ticker, et_date, segment, minute_index)),
eff AS (SELECT ticker, et_date, minute_index, 2 * abs_distance_size / volume AS spread, 2 * abs_distance_size / volume / nullif(tw_mid, 0) AS share FROM cache WHERE n_trades > 0 AND volume > 0)
"""


def book(v):
    """Quotes in session segments with states and durations."""
    rows = calendar.label_segments(v.quotes, v.calendar).filter(F.col("segment").isin("premarket", "rth", "post"))
    return q.quote_durations(q.quote_states(rows), SEG)


def plain_book(v):
    return q.quote_states(v.quotes).withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def minutes(rows):
    return rows.withColumn("minute_index", F.col("et_min").cast("long") - 240)


def millis(rows, *columns):
    """Interpolated nanosecond quantiles as whole milliseconds, which both engines agree on."""
    return rows.withColumns({c: F.floor(F.col(c) / 1e6) for c in columns})


def signed(v):
    trades = calendar.label_segments(v.trades, v.calendar).filter(F.col("segment").isin("premarket", "rth", "post"))
    return q.sign_trades(minutes(trades.select(*SEG, "et_min", "ts_ns", "seq", "price", "size")), book(v), SEG)


def cache(v):
    trade_side = millis(q.trade_minute_metrics(signed(v), MINUTE), "age_p50", "age_p95")
    return q.quote_trade_cache(q.quote_minute_metrics(minutes(book(v)), MINUTE), trade_side, MINUTE)


@query("f1_quote_states", """
SELECT count(*) FILTER (WHERE bid > ask) AS crossed, count(*) FILTER (WHERE bid = ask) AS locked, count(*) FILTER (WHERE bid <= 0 OR ask <= 0) AS nonpositive, count(*) FILTER (WHERE bid_size = 0 OR ask_size = 0) AS zero_size,
  count(*) FILTER (WHERE bid > ask OR bid <= 0 OR ask <= 0) AS hard, count(*) FILTER (WHERE bid = ask OR bid_size = 0 OR ask_size = 0) AS degraded, ticker FROM quotes GROUP BY ticker
""")
def _(v):
    n = lambda c: F.count(F.when(F.col(f"is_{c}"), 1)).alias(c)
    return q.quote_states(v.quotes).groupBy("ticker").agg(*map(n, ("crossed", "locked", "nonpositive", "zero_size", "hard", "degraded")))


@query("f2_quote_durations", LABEL + "SELECT seq, duration_ns, mid, spread, is_change FROM qd")
def _(v):
    return book(v).select("seq", "duration_ns", "mid", "spread", "is_change")


@query("f3_session_ns_prefilter", "SELECT t.seq FROM trades t JOIN calendar ON session_date = et_date WHERE et_min >= open_min AND et_min < close_min")
def _(v):
    ns = lambda c: clock.local_to_ns(clock.us_of(F.col("session_date"), F.col(c)))
    spans = v.calendar.select(ns("open_min").alias("start_ns"), ns("close_min").alias("end_ns"))
    bounds = v.trades.select("ticker").distinct().join(F.broadcast(spans.agg(F.collect_list(F.struct("start_ns", "end_ns")).alias("s")))).select("ticker", F.inline("s"))
    return q.session_ns_prefilter(v.trades, bounds).select("seq")


@query("f4_quote_minute_metrics", LABEL + QMM + "SELECT * FROM qmm")
def _(v):
    return q.quote_minute_metrics(minutes(book(v)), MINUTE)


#: States and unions as conditions on qd.
FLAGS = {"hard": "is_hard", "degraded": "(NOT is_hard AND is_degraded)", "clean": "(NOT is_hard AND NOT is_degraded)"} | {s[3:]: s for s in q.STATES}


@query("f5_state_census", LABEL + "SELECT ticker, count(*) AS n_quotes, sum(duration_ns)::BIGINT AS duration_ns, " + ", ".join(f"count(*) FILTER (WHERE {c}) / count(*) AS {s}_rows, coalesce(sum(duration_ns) FILTER (WHERE {c}), 0) / nullif(sum(duration_ns), 0) AS {s}_time" for s, c in FLAGS.items()) + "".join(f", coalesce(sum(duration_ns) FILTER (WHERE {s} AND {t}), 0) / nullif(sum(duration_ns), 0) AS {s[3:]}_and_{t[3:]}_time" for s, t in itertools.combinations(q.STATES, 2)) + " FROM qd GROUP BY 1")
def _(v):
    return q.state_census(book(v), ["ticker"])


@query("f6_state_runs", LABEL + """
, fl AS (""" + " UNION ALL ".join(f"SELECT ticker, et_date, segment, ts_ns, seq, duration_ns, '{s}' AS state, coalesce({c}, false) AS flag FROM qd" for s, c in FLAGS.items() if s != "clean") + """),
c AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS ch FROM fl WINDOW w AS (PARTITION BY ticker, et_date, segment, state ORDER BY ts_ns, seq)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY ticker, et_date, segment, state ORDER BY ts_ns, seq) AS run FROM c),
s AS (SELECT ticker, et_date, segment, state, sum(duration_ns)::BIGINT AS ns FROM r WHERE flag GROUP BY ticker, et_date, segment, state, run)
SELECT ticker, et_date, segment, state, count(*) AS n, max(ns) AS longest, floor(quantile_cont(ns::DOUBLE, 0.5) / 1e6)::BIGINT AS p50, floor(quantile_cont(ns::DOUBLE, 0.95) / 1e6)::BIGINT AS p95, sum(ns)::BIGINT AS total FROM s GROUP BY 1, 2, 3, 4
""")
def _(v):
    return millis(q.state_runs(book(v), SEG), "p50", "p95")


@query("f7_book_runs", LABEL + """
, r AS (SELECT *, sum(CASE WHEN is_change THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, et_date, segment ORDER BY ts_ns, seq)::BIGINT AS run FROM qd)
SELECT ticker, et_date, segment, run, min(ts_ns) AS start_ns, sum(duration_ns)::BIGINT AS ns, count(*) AS n_quotes FROM r GROUP BY 1, 2, 3, 4
""")
def _(v):
    return q.book_runs(book(v), SEG)


@query("f7_book_age", LABEL + """
, a AS (SELECT t.ticker, t.ts_ns - c.ts_ns AS age FROM trades t ASOF LEFT JOIN (SELECT * FROM qd WHERE is_change) c ON t.ticker = c.ticker AND t.et_date = c.et_date AND t.ts_ns >= c.ts_ns)
SELECT ticker, count(age) AS n, quantile_cont(age::DOUBLE, 0.5) AS age_p50, avg((age > 1000000000)::INT) AS over_1s, avg((age > 60000000000)::INT) AS over_60s FROM a GROUP BY 1
""")
def _(v):
    rows = q.book_age(v.trades, book(v), DAY, HOUR)
    over = lambda s: F.avg((F.col("age_ns") > s * 1_000_000_000).cast("double"))
    return rows.groupBy("ticker").agg(F.count("age_ns").alias("n"), F.percentile("age_ns", F.lit(0.5)).alias("age_p50"), over(1).alias("over_1s"), over(60).alias("over_60s"))


@query("f8_quote_to_trade", """
, g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS gap FROM quotes),
a AS (SELECT ticker, et_date, count(*) AS n_quotes, quantile_cont(gap::DOUBLE, 0.5) AS gap_p50, quantile_cont(gap::DOUBLE, 0.95) AS gap_p95 FROM g GROUP BY 1, 2),
b AS (SELECT ticker, et_date, count(*) AS n_trades FROM trades GROUP BY 1, 2)
SELECT ticker, et_date, n_quotes, n_trades, floor(gap_p50 / 1e6)::BIGINT AS gap_p50, floor(gap_p95 / 1e6)::BIGINT AS gap_p95, n_quotes / n_trades AS quotes_per_trade FROM a LEFT JOIN b USING (ticker, et_date)
""")
def _(v):
    return millis(q.quote_to_trade(v.quotes, v.trades, DAY), "gap_p50", "gap_p95")


@query("f9_quoted_spread", QM + """
, i AS (SELECT *, tw_spread / nullif(tw_spread_bp, 0) * 10000 AS implied FROM qm),
m AS (SELECT segment, count(*) AS n, quantile_cont(tw_spread, 0.5) AS median_tw_spread, quantile_cont(tw_spread_bp, 0.5) AS median_tw_spread_bp, quantile_cont(implied, 0.5) AS median_implied_price FROM i GROUP BY 1)
SELECT *, median_tw_spread / nullif(median_tw_spread_bp, 0) * 10000 AS price_of_medians FROM m
""")
def _(v):
    return q.quoted_spread(book(v), ["segment"], DAY)


@query("f10_sign_trades", SIGNED + "SELECT seq, q_seq, sign FROM sg")
def _(v):
    return signed(v).select("seq", "q_seq", "sign")


@query("f11_trade_minute_metrics", TM + "SELECT * FROM tm")
def _(v):
    return millis(q.trade_minute_metrics(signed(v), MINUTE), "age_p50", "age_p95")


@query("f12_quote_trade_cache", CACHE + "SELECT * FROM cache")
def _(v):
    return cache(v)


@query("f13_alignment_sweep", """
, s AS (SELECT ticker, et_date, seq, price, o AS offset_ns, ts_ns + o AS at FROM trades CROSS JOIN (SELECT unnest([-3600000000000, 0, 3600000000000]) AS o)),
a AS (SELECT s.*, q.seq AS qs, bid, ask, coalesce(bid > ask OR bid <= 0 OR ask <= 0, false) AS hard FROM s ASOF LEFT JOIN quotes q ON s.ticker = q.ticker AND s.et_date = q.et_date AND s.at >= q.ts_ns)
SELECT offset_ns, count(*) AS n_trades, count(*) FILTER (WHERE qs IS NULL) AS n_no_quote, count(*) FILTER (WHERE qs IS NOT NULL AND hard) AS n_unusable, count(*) FILTER (WHERE NOT hard AND price >= bid AND price <= ask) AS n_at_or_inside,
  count(*) FILTER (WHERE NOT hard AND abs(price - bid) < 1e-9) AS n_at_bid, count(*) FILTER (WHERE NOT hard AND abs(price - ask) < 1e-9) AS n_at_ask, count(*) FILTER (WHERE NOT hard AND price > bid + 1e-9 AND price < ask - 1e-9) AS n_inside,
  count(*) FILTER (WHERE NOT hard AND price < bid - 1e-9) AS n_below_bid, count(*) FILTER (WHERE NOT hard AND price > ask + 1e-9) AS n_above_ask FROM a GROUP BY 1
""")
def _(v):
    return q.alignment_sweep(v.trades.select(*DAY, "ts_ns", "seq", "price"), plain_book(v), DAY, [-HOUR, 0, HOUR], HOUR)


@query("f14_effective_spread", SIGNED + """
SELECT ticker, et_date, count(*) AS n, quantile_cont(2 * abs(price - q_mid), 0.5) AS spread, quantile_cont(2 * abs(price - q_mid) / q_mid * 10000, 0.5) AS spread_bp FROM sg WHERE q_mid > 0 GROUP BY 1, 2
""")
def _(v):
    return q.effective_spread(signed(v), DAY)


#: Detections of the bars' day with their price, and the legs of the latency and hold grid.
FOUND = DET + """
, found AS (SELECT d.ticker, d.event_date AS et_date, detection_minute, b.last_price AS detection_price FROM det d JOIN day_bars b ON b.ticker = d.ticker AND b.event_date = d.event_date AND b.minute_index = detection_minute)
"""
LEGS = """
, z AS (SELECT ticker, event_date, max(minute_index) AS last_minute, max(high) AS day_high FROM day_bars GROUP BY 1, 2),
x AS (SELECT d.ticker, d.event_date, last_minute, day_high, latency, hold, detection_minute + latency AS entry_minute, detection_minute + latency + hold AS exit_minute FROM det d JOIN z ON z.ticker = d.ticker AND z.event_date = d.event_date
  CROSS JOIN (SELECT unnest([0, 5]) AS latency) CROSS JOIN (SELECT unnest([10, 60]) AS hold) WHERE detection_minute IS NOT NULL),
i AS (SELECT x.*, CASE WHEN entry_minute <= last_minute THEN b.last_price END AS pi FROM x ASOF LEFT JOIN day_bars b ON x.ticker = b.ticker AND x.event_date = b.event_date AND x.entry_minute >= b.minute_index),
legs AS (SELECT i.ticker, i.event_date AS et_date, latency, hold, entry_minute, exit_minute, pi, day_high, ln(CASE WHEN exit_minute <= last_minute THEN b.last_price END / pi) AS markout
  FROM i ASOF LEFT JOIN day_bars b ON i.ticker = b.ticker AND i.event_date = b.event_date AND i.exit_minute >= b.minute_index)
"""


def found(v):
    price = v.day_bars.select(*KEYS, F.col("minute_index").alias("detection_minute"), F.col("last_price").alias("detection_price"))
    return detections(v).select(*KEYS, "detection_minute").join(price, [*KEYS, "detection_minute"]).withColumnRenamed("event_date", "et_date")


@query("f14_effective_at_detection", CACHE + FOUND + """
, t AS (SELECT *, detection_minute + latency AS target FROM found CROSS JOIN (SELECT unnest([0, 5, 30]) AS latency)),
m AS (SELECT latency, 10000 * share AS bp, 100 * spread AS cents, spread / detection_price AS of_price FROM t ASOF LEFT JOIN eff e ON t.ticker = e.ticker AND t.et_date = e.et_date AND t.target >= e.minute_index)
SELECT latency, count(*) AS n, quantile_cont(bp, 0.25) AS bp_p25, quantile_cont(bp, 0.5) AS bp_p50, quantile_cont(bp, 0.75) AS bp_p75, quantile_cont(bp, 0.95) AS bp_p95,
  quantile_cont(cents, 0.25) AS cents_p25, quantile_cont(cents, 0.5) AS cents_p50, quantile_cont(cents, 0.75) AS cents_p75, quantile_cont(of_price, 0.5) AS of_price_p50 FROM m WHERE bp IS NOT NULL GROUP BY 1
""")
def _(v):
    return q.effective_cells(q.effective_at(found(v), cache(v), DAY, [0, 5, 30]), ["latency"])


@query("f15_cost_vs_capture", CACHE + DET + LEGS + """
, a AS (SELECT l.*, e.share AS si, e.spread AS di FROM legs l ASOF LEFT JOIN eff e ON l.ticker = e.ticker AND l.et_date = e.et_date AND l.entry_minute >= e.minute_index),
c AS (SELECT a.*, (si + e.share) / 2 AS cost, (di + e.spread) / 2 AS cost_currency, ln(day_high / pi) AS best FROM a ASOF LEFT JOIN eff e ON a.ticker = e.ticker AND a.et_date = e.et_date AND a.exit_minute >= e.minute_index),
k AS (SELECT *, CASE WHEN markout > 0 THEN multiple * cost / markout END AS of_realized, CASE WHEN markout IS NOT NULL AND best > 0 THEN multiple * cost / best END AS of_best,
  CASE WHEN cost IS NOT NULL AND markout > 0 THEN cost > markout END AS exceeds, coalesce(cost IS NOT NULL AND markout <= 0, false) AS nonpositive FROM c CROSS JOIN (SELECT unnest([1, 1.5, 2]::DOUBLE[]) AS multiple)),
g AS (SELECT latency, hold, multiple, count(*) AS n, count(of_realized) AS n_defined, quantile_cont(of_realized, 0.25) AS p25, quantile_cont(of_realized, 0.5) AS median, quantile_cont(of_best, 0.5) AS median_of_best,
  avg(exceeds::INT) AS exceeds_share, avg(nonpositive::INT) AS nonpositive_share, 10000 * quantile_cont(cost, 0.5) AS median_cost_bp, 100 * quantile_cont(cost_currency, 0.5) AS median_cost_cents FROM k GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_defined < 5 THEN 'too_thin' WHEN nonpositive_share > 0.5 THEN 'mostly_nonpositive' WHEN median >= 1 THEN 'cost_exceeds' WHEN p25 >= 0.5 THEN 'lower_quartile_high' ELSE 'lower_quartile_low' END AS verdict FROM g
""")
def _(v):
    legs = returns.axis_rows(detections(v), v.day_bars, KEYS, [0, 5], [10, 60]).filter("grid = 'fixed_horizon'").withColumnRenamed("event_date", "et_date")
    highs = v.day_bars.groupBy("ticker", F.col("event_date").alias("et_date")).agg(F.max("high").alias("day_high"))
    rows = q.cost_vs_capture(legs, cache(v), highs, DAY, [1, 1.5, 2])
    return q.cost_verdict(rows, ["latency", "hold"], thin=5)


@query("f16_impact", CACHE + """
, k AS (SELECT * FROM cache WHERE n_trades > 0 AND volume > 0 AND tw_mid > 0)
SELECT ticker, et_date, segment, minute_index, (lead(tw_mid, 2) OVER w - tw_mid) / tw_mid / nullif(sum(signed_volume) OVER (PARTITION BY ticker, et_date, segment ORDER BY minute_index ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) AS impact
FROM k WINDOW w AS (PARTITION BY ticker, et_date, segment ORDER BY minute_index)
""")
def _(v):
    return q.impact(cache(v), SEG, 2).select(*MINUTE, "impact")


@query("f17_venue_frequency", """
, s AS (SELECT 'bid' AS side, bid_size AS venue FROM quotes UNION ALL SELECT 'ask', ask_size FROM quotes), n AS (SELECT side, venue, count(*) AS n FROM s GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY side) AS share FROM n
""")
def _(v):
    return q.venue_frequency(v.quotes, {"bid": "bid_size", "ask": "ask_size"})


@query("f18_session_mismatch", "SELECT ticker, count(*) AS n, count(*) FILTER (WHERE day <> et_date) AS n_mismatch, count(*) FILTER (WHERE day <> et_date) / count(*) AS mismatch_share FROM trades GROUP BY 1")
def _(v):
    return q.session_mismatch(v.trades, ["ticker"], "day", "et_date")


@query("f18_clock_latency", LABEL + """
, c AS (SELECT segment, CASE WHEN seq % 50 > 0 THEN (seq % 97 - 3) * 1000000 END AS latency FROM qe)
SELECT segment, count(*) AS n_rows, count(*) - count(latency) AS n_missing, """ + ", ".join(f"quantile_cont(latency::DOUBLE, {x}) AS p{y}" for x, y in ((0.01, "01"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.99, "99"))) + """,
  min(latency) AS min_ns, max(latency) AS max_ns, avg(CASE WHEN latency < 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_negative FROM c GROUP BY 1
""")
def _(v):
    rows = book(v)
    other = F.when(F.col("seq") % 50 > 0, F.col("ts_ns") - (F.col("seq") % 97 - 3) * 1_000_000)
    return q.clock_latency(rows.withColumn("venue_ns", other), ["segment"], "venue_ns", "ts_ns")


@query("f17_exchange_identity", "SELECT ticker, count(DISTINCT bid_size) AS bid_venues, count(DISTINCT ask_size) AS ask_venues, avg((bid IS NOT NULL AND ask IS NOT NULL)::INT) AS two_sided_share FROM quotes GROUP BY 1")
def _(v):
    return q.exchange_identity(v.quotes, ["ticker"], "bid_size", "ask_size")


#: Times in steps of ten minutes, so that some are tied.
@query("f18_timestamp_quality", """
, t AS (SELECT ticker, ts_ns // 600000000000 AS t FROM trades), g AS (SELECT *, t - lag(t) OVER (PARTITION BY ticker ORDER BY t) AS gap FROM t)
SELECT ticker, min(gap) FILTER (WHERE gap > 0) AS gap_min, quantile_cont(gap::DOUBLE, 0.5) FILTER (WHERE gap > 0) AS gap_median, max(gap) AS gap_max, count(*) FILTER (WHERE gap = 0) AS n_zero, count(*) AS n_gaps FROM g WHERE gap IS NOT NULL GROUP BY 1
""")
def _(v):
    return q.timestamp_quality(v.trades.select("ticker", F.floor(F.col("ts_ns") / 600_000_000_000).alias("ts_ns")), ["ticker"])


@query("f18_order_agreement", """
, t AS (SELECT ticker, ts_ns // 600000000000 AS t, seq % 1000 AS s FROM trades), g AS (SELECT *, t - lag(t) OVER w AS dt, s - lag(s) OVER w AS ds FROM t WINDOW w AS (PARTITION BY ticker ORDER BY t, s))
SELECT ticker, count(*) AS n_pairs, avg((ds < 0)::INT) AS sequence_falls, avg((dt = 0)::INT) AS tied, count(*) FILTER (WHERE dt = 0 AND ds = 0) AS n_repeated FROM g WHERE dt IS NOT NULL GROUP BY 1
""")
def _(v):
    return q.order_agreement(v.trades.select("ticker", F.floor(F.col("ts_ns") / 600_000_000_000).alias("ts_ns"), (F.col("seq") % 1000).alias("seq")), ["ticker"])


@query("f19_storage_order_census", """
, g AS (SELECT *, (ts_ns < lag(ts_ns) OVER w)::INT AS t, (seq < lag(seq) OVER w)::INT AS s FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY seq * 7919 % 10007, seq))
SELECT ticker, count(t) AS n_pairs, avg(t) AS time_falls, avg(s) AS seq_falls FROM g GROUP BY 1
""")
def _(v):
    rows = v.trades.withColumn("position", F.struct((F.col("seq") * 7919 % 10007), F.col("seq")))
    return q.storage_order_census(rows, ["ticker"], "position")


CODES = """
, l AS (SELECT l_partkey, [l_linenumber % 3, l_suppkey % 4, l_linenumber % 3]::BIGINT[] AS codes FROM lineitem)
"""


def codes(v):
    return v.table("lineitem").select("l_partkey", F.array((F.col("l_linenumber") % 3).cast("long"), F.col("l_suppkey") % 4, (F.col("l_linenumber") % 3).cast("long")).alias("codes"))


@query("f20_list_code_census", CODES + """
, u AS (SELECT l_partkey, unnest(list_distinct(codes)) AS code FROM l), f AS (SELECT code, l_partkey, count(*) AS n FROM u GROUP BY 1, 2)
SELECT code, sum(n)::BIGINT AS n_rows, count(*) AS n_events FROM f GROUP BY 1
""")
def _(v):
    return q.list_code_census(codes(v), "codes", ["l_partkey"])


@query("f20_code_combinations", CODES + "SELECT array_to_string(list_sort(list_distinct(codes)), '+') AS combination, count(*) AS n FROM l GROUP BY 1")
def _(v):
    return q.code_combinations(codes(v), "codes")


@query("f21_ofi", """
, o AS (SELECT *, CASE WHEN lag(ts_ns) OVER w IS NULL THEN 0 ELSE
  CASE WHEN bid >= lag(bid) OVER w THEN bid_size - lag(bid_size) OVER w ELSE -lag(bid_size) OVER w END
  - CASE WHEN ask <= lag(ask) OVER w THEN ask_size - lag(ask_size) OVER w ELSE -lag(ask_size) OVER w END END AS ofi
  FROM quotes WHERE bid > 0 AND ask > 0 AND ask > bid WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq))
SELECT ticker, et_date, count(ofi) AS n, avg(ofi) AS mean, sum(ofi)::BIGINT AS total, max(ofi) AS max, avg((ofi > 0)::INT) FILTER (WHERE ofi <> 0) AS positive_share FROM o GROUP BY 1, 2
""")
def _(v):
    return q.ofi(v.quotes, DAY)
