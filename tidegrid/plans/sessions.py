"""Queries of the session calendar and coverage operators (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import calendar as c
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query

BITMAP = """
, seen AS (SELECT DISTINCT ticker, {date} AS session_date FROM {ticks}),
b AS (SELECT s.ticker, s.event_date, s.session_offset, CASE WHEN e.ticker IS NULL THEN 0 ELSE 1 END AS has
      FROM spine s LEFT JOIN seen e USING (ticker, session_date)),
bitmap AS (SELECT ticker, event_date, string_agg(has::VARCHAR, '' ORDER BY session_offset) AS bitmap,
           coalesce(list(session_offset ORDER BY session_offset) FILTER (WHERE has = 0), []) AS missing FROM b GROUP BY 1, 2)
"""


@query("c1_session_spine", "SELECT * FROM spine")
def _(v):
    return v.spine


@query("c2_et_local", "SELECT seq, et_date AS local_date, et_min::BIGINT AS local_min FROM trades")
def _(v):
    return c.with_local(v.trades).select("seq", "local_date", "local_min")


@query("c3_segment_label", """
, l AS (SELECT t.*, open_min, close_min, CASE WHEN is_early_close THEN close_min + 240 ELSE 1200 END AS post_min
        FROM trades t LEFT JOIN calendar ON session_date = et_date),
m AS (SELECT *, CASE WHEN open_min IS NULL THEN 'non_session' WHEN et_min < 240 THEN 'outside_early' WHEN et_min < open_min THEN 'premarket'
        WHEN et_min < close_min THEN 'rth' WHEN et_min < post_min THEN 'post' ELSE 'outside_late' END AS segment FROM l)
SELECT seq, segment, (epoch_us(et_date::TIMESTAMP) + (CASE segment WHEN 'premarket' THEN open_min WHEN 'rth' THEN close_min WHEN 'post' THEN post_min END + 300)::BIGINT * 60000000) * 1000 AS segment_end_ns FROM m
""")
def _(v):
    return c.label_segments(v.trades, v.calendar).select("seq", "segment", "segment_end_ns")


@query("c4_day_offset", "SELECT ticker, event_date, session_date, session_offset AS day_offset FROM spine")
def _(v):
    return c.day_offset(v.spine.select(*KEYS, "session_date"), KEYS)


@query("c5_session_bitmap", BITMAP.format(date="day", ticks="trades") + """
SELECT ticker, event_date, bitmap, array_to_string(missing, ',') AS missing, len(missing)::INTEGER AS n_missing, len(missing) = 0 AS is_full FROM bitmap
""")
def _(v):
    rows = c.session_bitmap(v.trades, v.spine, KEYS)
    return rows.withColumn("missing", F.concat_ws(",", F.col("missing").cast("array<string>")))


#: The archive of the fixture reaches from 9 to 26 January.
GAPS = BITMAP.format(date="et_date", ticks="trades") + """
, ob AS (SELECT DISTINCT ticker, et_date AS session_date FROM trades WHERE et_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-26' AND size > 30),
b3 AS (SELECT s.ticker, s.event_date, s.session_offset, s.session_date, o.ticker IS NOT NULL AS has FROM spine s LEFT JOIN ob o USING (ticker, session_date)),
g0 AS (SELECT ticker, event_date, coalesce(list(session_offset) FILTER (WHERE NOT has), []) AS missing, coalesce(bool_or(session_date < (SELECT min(session_date) FROM ob) OR session_date > (SELECT max(session_date) FROM ob)), false) AS is_edge, min(session_date) AS first_expected FROM b3 GROUP BY 1, 2),
gaps AS (SELECT *, CASE WHEN ticker = 3 AND event_date = DATE '2024-01-17' THEN 'calendar_residue' WHEN is_edge THEN 'archive_edge' WHEN len(missing) = 0 THEN 'unclassified' WHEN list_min(missing) >= 1 THEN 'forward_missing' WHEN list_max(missing) <= -1 THEN 'backward_missing' ELSE 'both_sides' END AS label FROM g0)
"""


def observed(v):
    rows = v.trades.filter("size > 30").select("ticker", F.col("et_date").alias("session_date"))
    return rows.filter(F.col("session_date").between(F.lit("2024-01-09").cast("date"), F.lit("2024-01-26").cast("date"))).distinct()


def gaps(v):
    seen = observed(v)
    bits = c.session_bitmap(seen, v.spine, KEYS, date="session_date").select(*KEYS, "missing")
    first = v.spine.groupBy(*KEYS).agg(F.min("session_date").alias("first_expected"))
    rows = bits.join(c.archive_edge(v.spine, seen, KEYS), KEYS).join(first, KEYS)
    residue = (F.col("ticker") == 3) & (F.col("event_date").cast("string") == "2024-01-17")
    return rows.withColumn("label", c.gap_label(F.col("missing"), F.col("is_edge"), residue))


@query("c6_gap_label", GAPS + "SELECT ticker, event_date, label FROM gaps")
def _(v):
    return gaps(v).select(*KEYS, "label")


@query("c7_seen_signature", GAPS + """
, s AS (SELECT ticker, min(session_date) AS first_seen, max(session_date) AS last_seen FROM ob GROUP BY 1)
SELECT g.ticker, event_date, label, first_seen, last_seen, coalesce(label = 'forward_missing' AND event_date = last_seen, false) AS is_last_seen, coalesce(label = 'backward_missing' AND first_seen > first_expected, false) AS is_listing FROM gaps g LEFT JOIN s USING (ticker)
""")
def _(v):
    return c.seen_signature(gaps(v).select(*KEYS, "label", "first_expected"), observed(v)).drop("first_expected")


@query("c8_merge_sides", BITMAP.format(date="day", ticks="trades") + BITMAP.format(date="day", ticks="quotes").replace("seen", "seen2").replace("b AS", "b2 AS").replace("FROM b ", "FROM b2 ").replace("bitmap AS (SELECT", "bitmap2 AS (SELECT") + """
SELECT ticker, event_date, t.bitmap AS trade_bitmap, len(t.missing) = 0 AS trade_full, q.bitmap AS quote_bitmap, len(q.missing) = 0 AS quote_full,
  CASE WHEN t.bitmap IS NULL THEN 'quotes_only' WHEN q.bitmap IS NULL THEN 'trades_only' ELSE 'both' END AS sides,
  coalesce(len(t.missing) = 0 AND len(q.missing) = 0, false) AS is_clean
FROM bitmap t FULL JOIN bitmap2 q USING (ticker, event_date)
""")
def _(v):
    sides = (c.session_bitmap(ticks, v.spine, KEYS) for ticks in (v.trades, v.quotes))
    return c.merge_sides(*sides, KEYS)


@query("c8_merge_sides_labels", BITMAP.format(date="day", ticks="trades") + BITMAP.format(date="day", ticks="quotes").replace("seen", "seen2").replace("b AS", "b2 AS").replace("FROM b ", "FROM b2 ").replace("bitmap AS (SELECT", "bitmap2 AS (SELECT") + """
, lab AS (SELECT ticker, event_date, 'runner' AS label FROM event_list WHERE magnitude > 100)
SELECT ticker, event_date, coalesce(len(t.missing) = 0 AND len(q.missing) = 0, false) AS is_clean, coalesce(label, 'plain') AS label FROM bitmap t FULL JOIN bitmap2 q USING (ticker, event_date) LEFT JOIN lab USING (ticker, event_date)
""")
def _(v):
    sides = (c.session_bitmap(ticks, v.spine, KEYS) for ticks in (v.trades, v.quotes))
    labels = v.event_list.filter("magnitude > 100").select(*KEYS, F.lit("runner").alias("label"))
    return c.merge_sides(*sides, KEYS, labels, {"label": "plain"}).select(*KEYS, "is_clean", "label")


HAS = """
, has AS (SELECT e.ticker, e.event_date, CASE WHEN e.event_date < DATE '2024-01-16' THEN 'early' ELSE 'late' END AS era, coalesce(bool_or(session_offset = 1), false) AS has_1, coalesce(bool_or(session_offset = 2), false) AS has_2, coalesce(bool_or(session_offset = 3), false) AS has_3
  FROM event_list e LEFT JOIN bars b ON b.ticker = e.ticker AND b.event_date = e.event_date GROUP BY 1, 2)
"""


def later(v):
    from tidegrid.operators.returns import era

    return c.later_sessions(v.event_list.select(*KEYS, era(F.col("event_date"), "2024-01-16").alias("era")), v.bars, KEYS)


@query("c9_later_sessions", HAS + "SELECT * FROM has")
def _(v):
    return later(v)


@query("c9_missing_rates", HAS + "SELECT era, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE NOT has_{o}) AS missing_{o}, avg((NOT has_{o})::INT) AS missing_{o}_rate" for o in (1, 2, 3)) + " FROM has GROUP BY 1")
def _(v):
    return c.missing_rates(later(v), ["era"])


@query("c9_survivorship", """
, l AS (SELECT ticker, max(n) AS last_n FROM trades JOIN numbered ON session_date = et_date GROUP BY 1)
SELECT ticker, event_date, (last_n - n)::INTEGER AS sessions_after, last_n > n AS survives
FROM event_list JOIN numbered ON session_date = event_date JOIN l USING (ticker)
""")
def _(v):
    return c.survivorship(v.event_list.select(*KEYS), v.trades, v.calendar)


@query("c10_coverage_stats", """
, g AS (SELECT *, minute_index - lag(minute_index) OVER (PARTITION BY ticker, event_date, segment ORDER BY minute_index) - 1 AS gap FROM day_bars)
SELECT ticker, event_date, count(*) FILTER (WHERE segment = 'rth') AS rth_bars, coalesce(max(gap) FILTER (WHERE segment = 'rth'), 0) AS longest_gap,
  1 - coalesce(sum(n_trades) FILTER (WHERE segment = 'rth'), 0) / sum(n_trades) AS outside_share, min(minute_index) AS first_minute, max(minute_index) AS last_minute
FROM g GROUP BY 1, 2
""")
def _(v):
    return c.coverage_stats(v.day_bars, KEYS)


@query("c11_zero_print_events", """
SELECT ticker, session_date AS event_date FROM (SELECT DISTINCT ticker FROM trades) CROSS JOIN calendar
WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.ticker = trades.ticker AND q.et_date = session_date)
""".replace("trades.ticker AND", "t.ticker AND").replace("FROM trades) CROSS", "FROM trades) t CROSS"))
def _(v):
    days = F.broadcast(v.calendar.agg(F.collect_list("session_date").alias("days")))
    expected = v.trades.select("ticker").distinct().join(days).select("ticker", F.explode("days").alias("event_date"))
    return c.zero_print_events(expected, v.quotes)


@query("c12_tz_mismatch_count", "SELECT ticker, count(*) AS n, count(*) FILTER (WHERE et_date <> day) AS n_mismatch FROM trades GROUP BY 1")
def _(v):
    return c.tz_mismatch_count(v.trades, ["ticker"])
