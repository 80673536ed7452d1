"""Queries of the event spine, key and scope operators (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import calendar
from tidegrid.operators import spine as b
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query

RULES = [(r"BRASS", "brass"), (r"^PROMO", "promo"), (r"STEEL$", "steel")]


def day(v, table, date):
    return v.table(table).withColumn("d", F.to_date(date))


@query("b1_canonical_events", """
SELECT o_custkey AS ticker, o_orderdate::DATE AS event_date, o_totalprice AS magnitude, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS layout,
  o_totalprice::DECIMAL(18, 2)::DOUBLE AS magnitude_key FROM orders
""")
def _(v):
    even = F.col("o_orderkey") % 2 == 0
    two = v.table("orders").select(F.col("o_custkey").alias("ticker"), F.when(even, F.to_date("o_orderdate")).alias("date"), F.when(~even, F.to_date("o_orderdate")).alias("event_date2"), F.when(even, F.col("o_totalprice")).alias("m1"), F.when(~even, F.col("o_totalprice")).alias("m2"))
    return b.canonical_events(two, {"event_date": "date", "magnitude": "m1"}, {"event_date": "event_date2", "magnitude": "m2"}).withColumn("magnitude_key", F.col("magnitude_key").cast("double"))


@query("b2_union_dedup_scans", """
, s AS (SELECT ticker, et_date, max(price) AS px, 0 AS scan FROM trades WHERE size > 60 GROUP BY 1, 2 UNION ALL SELECT ticker, et_date, min(price), 1 FROM trades GROUP BY 1, 2)
SELECT ticker, et_date, px, scan FROM s QUALIFY row_number() OVER (PARTITION BY ticker, et_date ORDER BY scan, px) = 1
""")
def _(v):
    scan = lambda rows, f: rows.groupBy("ticker", "et_date").agg(f("price").alias("px"))
    return b.union_dedup_scans([scan(v.trades.filter("size > 60"), F.max), scan(v.trades, F.min)], ["ticker", "et_date"])


@query("b3_bad_denominator", "SELECT ticker, event_date, CASE WHEN ticker > 7 THEN NULL ELSE ticker END < 2 OR magnitude >= 500 AS is_bad FROM event_list")
def _(v):
    return v.event_list.select(*KEYS, b.bad_denominator(F.when(F.col("ticker") <= 7, F.col("ticker")), F.col("magnitude"), 2, 500).alias("is_bad"))


@query("b4_side_ingested", "SELECT e.*, EXISTS (SELECT 1 FROM quotes q WHERE q.ticker = e.ticker AND q.et_date = e.event_date AND q.bid_size > 8) AS quotes_ingested FROM event_list e")
def _(v):
    side = v.quotes.filter("bid_size > 8").withColumnRenamed("et_date", "event_date")
    return b.side_ingested(v.event_list, side, KEYS, "quotes_ingested")


@query("b5_has_folder", "SELECT ticker, event_date, magnitude::DECIMAL(18, 2)::DOUBLE AS magnitude_key, ticker % 2 = 0 AS has_folder FROM event_list")
def _(v):
    events = v.event_list.select(*KEYS, F.col("magnitude").cast("decimal(18,2)").alias("magnitude_key"))
    name = F.concat_ws("_", "ticker", "event_date", F.when(F.col("ticker") % 2 == 0, F.col("magnitude_key").cast("string")).otherwise("n/a"))
    return b.has_folder(events, events.select(name.alias("folder")), r"^(\d+)_(\d{4}-\d{2}-\d{2})_(-?[\d.]+)$").withColumn("magnitude_key", F.col("magnitude_key").cast("double"))


@query("b6_left_join_flags", """
, h AS (SELECT ticker, et_date AS event_date, max(price) AS high FROM trades GROUP BY 1, 2), n AS (SELECT ticker, et_date AS event_date, count(*) AS n_quotes FROM quotes WHERE ask_size > 10 GROUP BY 1, 2)
SELECT e.*, high, n_quotes FROM event_list e LEFT JOIN h USING (ticker, event_date) LEFT JOIN n USING (ticker, event_date)
""")
def _(v):
    by = ["ticker", F.col("et_date").alias("event_date")]
    flags = [v.trades.groupBy(*by).agg(F.max("price").alias("high")), v.quotes.filter("ask_size > 10").groupBy(*by).agg(F.count(F.lit(1)).alias("n_quotes"))]
    return b.left_join_flags(v.event_list, flags, KEYS)


@query("b7_in_scope", "SELECT p_partkey, coalesce(p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'), false) AND NOT coalesce(p_size > 40, false) AS scoped FROM part")
def _(v):
    return v.table("part").select("p_partkey", b.in_scope(F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3"], [F.col("p_size") > 40]).alias("scoped"))


RULE_SQL = ", r AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS') THEN 'brass' WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, 'STEEL$') THEN 'steel' ELSE 'common' END AS kind, CASE WHEN regexp_matches(p_type, 'BRASS') THEN 1 WHEN regexp_matches(p_type, '^PROMO') THEN 2 WHEN regexp_matches(p_type, 'STEEL$') THEN 3 ELSE 0 END AS rule, p_size FROM part)\n"


@query("b8_classify_by_rules", RULE_SQL + "SELECT p_partkey, kind, rule::INTEGER AS rule FROM r")
def _(v):
    kind, rule = b.classify_by_rules(F.col("p_type"), RULES)
    return v.table("part").select("p_partkey", kind.alias("kind"), rule.alias("rule"))


@query("b9_filter_waterfall", """
, c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE size > 20) AS n1, count(*) FILTER (WHERE size > 20 AND price > 50) AS n2, count(*) FILTER (WHERE size > 20 AND price > 50 AND et_min >= 570) AS n3 FROM trades)
SELECT 1 AS step, 'size' AS filter, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS dropped FROM c UNION ALL SELECT 2, 'price', n1, n2, n1 - n2 FROM c UNION ALL SELECT 3, 'open', n2, n3, n2 - n3 FROM c
""")
def _(v):
    return b.filter_waterfall(v.trades, [("size", F.col("size") > 20), ("price", F.col("price") > 50), ("open", F.col("et_min") >= 570)])


@query("b10_dup_key_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return b.dup_key_check(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("b11_reconcile_keys", """
, a AS (SELECT DISTINCT ticker, et_date FROM trades WHERE size > 90), c AS (SELECT DISTINCT ticker, et_date FROM quotes WHERE ask_size > 10),
j AS (SELECT count(*) FILTER (WHERE a.ticker IS NOT NULL AND c.ticker IS NOT NULL) AS b, count(*) FILTER (WHERE c.ticker IS NULL) AS l, count(*) FILTER (WHERE a.ticker IS NULL) AS r FROM a FULL JOIN c ON a.ticker = c.ticker AND a.et_date = c.et_date)
SELECT b AS both, l AS only_left, r AS only_right, 100 * b / nullif(b + l, 0) AS left_pct, 100 * b / nullif(b + r, 0) AS right_pct FROM j
""")
def _(v):
    return b.reconcile_keys(v.trades.filter("size > 90"), v.quotes.filter("ask_size > 10"), ["ticker", "et_date"])


#: Folders of the events: some with a whole magnitude, twice, without a side, without a date, or not there at all.
FOLDERS = """
, f0 AS (SELECT *, (ticker * 7 + day(event_date)) % 11 AS r FROM event_list),
folders AS (SELECT CASE WHEN r = 10 THEN NULL ELSE event_date END AS event_date, ticker, CASE WHEN r = 1 THEN floor(magnitude)::BIGINT::VARCHAR WHEN r = 9 THEN 'n/a' ELSE printf('%.2f', magnitude) END AS magnitude_text, r NOT IN (3, 5) AS has_trades, r NOT IN (4, 5) AS has_quotes
  FROM (SELECT *, unnest(range(CASE r WHEN 2 THEN 2 WHEN 6 THEN 0 ELSE 1 END)) AS copy FROM f0))
"""


def folders(v):
    r = F.pmod(F.col("ticker") * 7 + F.dayofmonth("event_date"), F.lit(11))
    rows = v.event_list.withColumn("r", r)
    text = F.when(F.col("r") == 1, F.floor("magnitude").cast("string")).when(F.col("r") == 9, "n/a").otherwise(F.format_string("%.2f", "magnitude"))
    times = F.when(F.col("r") == 2, 2).when(F.col("r") == 6, 0).otherwise(1)
    rows = rows.select("ticker", F.when(F.col("r") != 10, F.col("event_date")).alias("event_date"), text.alias("magnitude_text"), (~F.col("r").isin(3, 5)).alias("has_trades"), (~F.col("r").isin(4, 5)).alias("has_quotes"), F.explode(F.array_repeat(F.lit(0), times)))
    return rows.drop("col")


@query("b12_classify_match", FOLDERS + """
, c AS (SELECT e.ticker, e.event_date, e.magnitude, count(f.ticker) FILTER (WHERE magnitude_text <> printf('%.2f', magnitude)) AS n_other, count(f.ticker) FILTER (WHERE magnitude_text = printf('%.2f', magnitude)) AS n_exact,
  bool_or(has_trades) FILTER (WHERE magnitude_text = printf('%.2f', magnitude)) AS t, bool_or(has_quotes) FILTER (WHERE magnitude_text = printf('%.2f', magnitude)) AS q FROM event_list e LEFT JOIN folders f ON f.ticker = e.ticker AND f.event_date = e.event_date GROUP BY 1, 2, 3)
SELECT ticker, event_date, CASE WHEN n_other > 0 THEN 'format_mismatch' WHEN n_exact = 0 THEN 'folder_absent' WHEN n_exact > 1 THEN 'duplicate_collision' WHEN t AND NOT q THEN 'missing_quotes' WHEN q AND NOT t THEN 'missing_trades'
  WHEN NOT t AND NOT q THEN 'missing_both' ELSE 'unexpected_both_present' END AS match FROM c
""")
def _(v):
    return b.classify_match(v.event_list, folders(v)).select(*KEYS, "match")


@query("b12_classify_folders", FOLDERS + """
, n AS (SELECT ticker, event_date, magnitude::DECIMAL(18, 2) AS k, count(*) AS n FROM event_list GROUP BY 1, 2, 3)
SELECT f.*, CASE WHEN f.event_date IS NULL THEN 'none_date_unresolved' WHEN TRY_CAST(magnitude_text AS DOUBLE) IS NULL THEN 'unparseable' WHEN n IS NULL THEN 'orphan' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match
FROM folders f LEFT JOIN n ON n.ticker = f.ticker AND n.event_date = f.event_date AND n.k = TRY_CAST(magnitude_text AS DOUBLE)::DECIMAL(18, 2)
""")
def _(v):
    return b.classify_folders(folders(v), v.event_list)


@query("b13_fallback_match", """
, e AS (SELECT o_orderkey AS event_id, o_custkey AS ticker, o_orderdate::DATE AS d1, o_orderdate::DATE + 1 AS d2 FROM orders),
x AS (SELECT o_orderkey, o_custkey AS ticker, o_orderdate::DATE + (o_orderkey % 4)::INT AS d FROM orders WHERE o_orderkey % 5 = 0),
h AS (SELECT DISTINCT o_orderkey, x.ticker, d, event_id FROM x JOIN e ON x.ticker = e.ticker AND (d = d1 OR d = d2)), n AS (SELECT o_orderkey, ticker, d, count(*) AS n FROM h GROUP BY ALL)
SELECT x.*, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'multiple' END AS match FROM x LEFT JOIN n USING (o_orderkey, ticker, d)
""")
def _(v):
    o = day(v, "orders", "o_orderdate")
    events = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("ticker"), F.col("d").alias("d1"), F.date_add("d", 1).alias("d2"))
    orphans = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.col("o_custkey").alias("ticker"), F.date_add("d", (F.col("o_orderkey") % 4).cast("int")).alias("d"))
    return b.fallback_match(orphans, events, ["ticker"], "d", ["d1", "d2"])


@query("b13_match_by_magnitude", """
, e AS (SELECT o_custkey AS ticker, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS event_date, floor(o_totalprice / 10) / 100 AS magnitude FROM orders),
f AS (SELECT o_orderkey, o_custkey + (o_orderkey % 5 = 0)::INT AS ticker, floor(o_totalprice / 10) / 100 AS magnitude FROM orders WHERE o_orderkey % 2 = 0),
c AS (SELECT ticker, magnitude::DECIMAL(18, 2) AS k, count(*) AS n, max(event_date) AS d FROM e GROUP BY 1, 2)
SELECT f.*, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN 'no_match_found' WHEN n > 1 THEN 'multiple_matches' WHEN d IS NULL THEN 'matched_null_date' ELSE 'matched_valid_date' END AS match, CASE WHEN n = 1 THEN d END AS found_date
FROM f LEFT JOIN c ON c.ticker = f.ticker AND c.k = f.magnitude::DECIMAL(18, 2)
""")
def _(v):
    o = day(v, "orders", "o_orderdate")
    size = (F.floor(F.col("o_totalprice") / 10) / 100).alias("magnitude")
    events = o.select(F.col("o_custkey").alias("ticker"), F.when(F.col("o_orderkey") % 3 > 0, F.col("d")).alias("event_date"), size)
    folders_ = o.filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + (F.col("o_orderkey") % 5 == 0).cast("int")).alias("ticker"), size)
    return b.match_by_magnitude(folders_, events)


@query("b14_magnitude_recompute_check", """
, p AS (SELECT ticker, day, high, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prior_close, round(100 * (close / open - 1), 2) AS magnitude FROM daily),
m AS (SELECT *, (high - prior_close) / nullif(prior_close, 0) * 100 AS recomputed FROM p),
f AS (SELECT *, abs(recomputed - magnitude) AS mismatch, coalesce(magnitude > 100, false) AS over_bound, coalesce(prior_close <= 950, false) AS under_floor, coalesce(abs(recomputed - magnitude) > 0.01, false) AS is_mismatch FROM m)
SELECT *, over_bound OR under_floor OR is_mismatch AS is_junk FROM f
""")
def _(v):
    from pyspark.sql import Window

    prior = F.lag("close").over(Window.partitionBy("ticker").orderBy("day"))
    rows = v.daily.select("ticker", "day", "high", prior.alias("prior_close"), F.round(100 * (F.col("close") / F.col("open") - 1), 2).alias("magnitude"))
    return b.magnitude_recompute_check(rows, 100, 950)


@query("b15_describe_quantiles", "SELECT l_returnflag, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def _(v):
    return b.describe_quantiles(v.table("lineitem"), "l_extendedprice", ["l_returnflag"])


@query("b16_set_diff_window", """
SELECT ticker, event_date, session_offset, session_date, CASE WHEN session_offset = 0 THEN 'event_day' WHEN session_date IN (DATE '2024-01-12', DATE '2024-01-16') THEN 'flanking' ELSE 'outer' END AS place FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM trades t WHERE t.ticker = s.ticker AND t.et_date = s.session_date AND t.size > 70)
""")
def _(v):
    held = v.trades.filter("size > 70").select("ticker", F.col("et_date").alias("session_date")).distinct()
    have = v.spine.join(held, ["ticker", "session_date"], "left_semi")
    skipped = v.calendar.filter(F.col("session_date").cast("string").isin("2024-01-12", "2024-01-16"))
    return b.set_diff_window(v.spine.select(*KEYS, "session_offset", "session_date"), have, KEYS, skipped)


@query("b17_clear_repaired_flags", """
, m AS (SELECT ticker, event_date, 'trades' AS side FROM event_list UNION ALL SELECT ticker, event_date, 'quotes' FROM event_list WHERE ticker % 2 = 0),
l AS (SELECT DISTINCT ticker, et_date AS event_date, CASE WHEN size % 2 = 0 THEN 'trades' ELSE 'quotes' END AS side FROM trades WHERE size > 70 AND price > 20),
c AS (SELECT m.ticker, m.event_date, bool_and(l.side IS NOT NULL) AS covered FROM m LEFT JOIN l ON l.ticker = m.ticker AND l.event_date = m.event_date AND l.side = m.side GROUP BY 1, 2)
SELECT e.ticker, e.event_date, NOT covered AS is_flagged FROM event_list e JOIN c USING (ticker, event_date)
""")
def _(v):
    side = F.when(F.col("size") % 2 == 0, "trades").otherwise("quotes")
    status = F.when(F.col("price") > 20, "ok").otherwise("failed")
    ledger = v.trades.filter("size > 70").select("ticker", F.col("et_date").alias("event_date"), side.alias("side"), status.alias("status"))
    sides = F.when(F.col("ticker") % 2 == 0, F.array(F.lit("trades"), F.lit("quotes"))).otherwise(F.array(F.lit("trades")))
    return b.clear_repaired_flags(v.event_list.select(*KEYS, F.lit(True).alias("is_flagged")), v.event_list.select(*KEYS, F.explode(sides).alias("side")), ledger, KEYS)


VOLUMES = """
, r AS (SELECT ticker, event_date, sum(volume)::BIGINT AS reported_volume FROM day_bars GROUP BY 1, 2), t AS (SELECT ticker, et_date AS event_date, sum(size)::BIGINT AS tick_volume FROM trades GROUP BY 1, 2),
vr AS (SELECT *, tick_volume / nullif(reported_volume, 0) AS volume_ratio FROM r LEFT JOIN t USING (ticker, event_date))
"""


def volumes(v):
    reported = v.day_bars.groupBy(*KEYS).agg(F.sum("volume").alias("reported_volume"))
    return b.volume_ratio_check(v.trades.withColumnRenamed("et_date", "event_date"), reported, KEYS, 0.8, 1.25)


@query("b18_volume_ratio_check", VOLUMES + "SELECT *, coalesce(volume_ratio BETWEEN 0.8 AND 1.25, false) AS in_band FROM vr")
def _(v):
    return volumes(v)


@query("b18_volume_band", VOLUMES + "SELECT count(volume_ratio) AS n, count(*) - count(volume_ratio) AS n_undefined, quantile_cont(volume_ratio, 0.5) AS median_ratio, coalesce(quantile_cont(volume_ratio, 0.5) BETWEEN 0.8 AND 1.25, false) AS in_band FROM vr")
def _(v):
    return b.volume_band(volumes(v), 0.8, 1.25)


@query("b19_log_evidence", """
, s AS (SELECT ticker, day, max(CASE WHEN price > 80 THEN 2 ELSE 1 END) AS rank FROM trades WHERE size > 95 GROUP BY 1, 2),
x AS (SELECT e.ticker, e.event_date, max(rank) AS rank FROM event_list e LEFT JOIN s ON s.ticker = e.ticker AND s.day BETWEEN e.event_date - 1 AND e.event_date + 1 GROUP BY 1, 2)
SELECT ticker, event_date, CASE rank WHEN 2 THEN 'explicit_failure' WHEN 1 THEN 'mentioned_no_failure' ELSE 'not_mentioned' END AS evidence FROM x
""")
def _(v):
    word = F.when(F.col("price") > 80, "FAILED to fetch").otherwise("fetched")
    lines = v.trades.filter("size > 95").select(F.concat(F.lit("[job] ticker="), "ticker", F.lit(" day="), "day", F.lit(" "), word).alias("line"))
    return b.log_evidence(lines, v.event_list.select(*KEYS), r"ticker=(\d+) day=(\S+) (.*)", "FAILED", 1, 1)


@query("b20_class_from_reference", RULE_SQL + """
, m AS (SELECT p_partkey AS ticker, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS code, p_size > 10 AS active, CASE WHEN p_size <= 10 THEN DATE '1998-01-01' + p_size * 100 END AS delisted FROM part WHERE p_partkey % 5 > 0),
l AS (SELECT l_partkey AS ticker, max(l_shipdate::DATE) AS last_event FROM lineitem GROUP BY 1),
k AS (SELECT r.p_partkey AS ticker, kind AS rule_class, code, active, delisted, last_event, CASE WHEN code IS NULL THEN 'unresolved' WHEN code = 'PROMO' THEN 'promo' WHEN code = 'STANDARD' THEN 'common' WHEN code = 'SMALL' THEN 'small' ELSE 'other' END AS class
  FROM r LEFT JOIN m ON m.ticker = r.p_partkey LEFT JOIN l ON l.ticker = r.p_partkey)
SELECT ticker, rule_class, code, class, coalesce(code IN ('PROMO', 'STANDARD'), false) AS in_scope, CASE WHEN code IS NULL THEN NULL WHEN rule_class = 'promo' THEN class IN ('promo') WHEN rule_class = 'common' THEN class IN ('common', 'other') END AS agrees,
  coalesce(NOT active AND last_event > delisted, false) AS ticker_reuse FROM k
""")
def _(v):
    p = v.table("part")
    kind, _rule = b.classify_by_rules(F.col("p_type"), RULES)
    old = F.when(F.col("p_size") <= 10, F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size") * 100))
    rows = p.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("ticker"), F.when(F.col("p_partkey") % 3 != 0, F.split("p_type", " ")[0]).alias("code"), (F.col("p_size") > 10).alias("active"), old.alias("delisted"), F.lit(2).alias("as_of"))
    stale = rows.select("ticker", F.lit("STALE").alias("code"), F.lit(True).alias("active"), F.date_sub("delisted", 1).alias("delisted"), F.lit(1).alias("as_of"))
    events = v.table("lineitem").select(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("event_date"))
    mapping = {"PROMO": ("promo", True), "STANDARD": ("common", True), "SMALL": ("small", False)}
    return b.class_from_reference(p.select(F.col("p_partkey").alias("ticker"), kind.alias("rule_class")), rows.unionByName(stale), mapping, events, {"promo": ("promo",), "common": ("common", "other")})


@query("b20_confusion", RULE_SQL + ", k AS (SELECT kind, CASE WHEN p_size > 25 THEN 'brass' ELSE 'common' END AS other FROM r) SELECT kind, other, count(*) AS n, kind = other AS agrees FROM k GROUP BY 1, 2")
def _(v):
    kind, _rule = b.classify_by_rules(F.col("p_type"), RULES)
    rows = v.table("part").select(kind.alias("kind"), F.when(F.col("p_size") > 25, "brass").otherwise("common").alias("other"))
    return b.confusion(rows, "kind", "other")


#: Two ratios of prices of each part's day: opening over closing, and low over high of the same day.
BASIS = ", r AS (SELECT ticker, day, open / nullif(close, 0) AS one, CASE WHEN ticker % 7 > 0 THEN low / nullif(high, 0) END AS two, close > open AS rises FROM daily)\n"


def basis(v):
    from tidegrid.functions.frames import ratio

    return v.daily.select("ticker", "day", ratio(F.col("open"), F.col("close")).alias("one"), F.when(F.col("ticker") % 7 > 0, ratio(F.col("low"), F.col("high"))).alias("two"), (F.col("close") > F.col("open")).alias("rises"))


@query("b21_basis_check", BASIS + """
, a AS (SELECT count(*) AS n_both, count(*) FILTER (WHERE abs(one - two) / two < 0.02) AS n_agree FROM r WHERE one IS NOT NULL AND two IS NOT NULL)
SELECT *, 100 * n_agree / n_both AS agree_pct, 100 * n_agree / n_both >= 90 AS passes FROM a
""")
def _(v):
    return b.basis_agreement(basis(v), "one", "two")


@query("b21_basis_stability", BASIS + """
, p AS (SELECT ticker, unnest([one, two]) AS x FROM r), n AS (SELECT ticker, count(*) AS n_events FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT ticker, n_events, count(x) AS n_values, CASE WHEN count(x) >= 2 THEN max(x) / min(x) END AS spread, CASE WHEN count(x) >= 2 THEN max(x) / min(x) < 1.1 END AS is_stable FROM n JOIN p USING (ticker) GROUP BY 1, 2
""")
def _(v):
    return b.basis_stability(basis(v), "ticker", "one", "two")


@query("b21_basis_factors", BASIS + """
, p AS (SELECT rises, unnest([one, two]) AS x FROM r)
SELECT rises, count(*) AS n, 100 * avg((x > 1.05)::INT) AS over_pct, 100 * avg((len(list_filter([1, 1/2, 1/3, 1/4, 1/5, 1/6, 1/8, 1/10, 1/12, 1/15, 1/20, 1/25, 1/30, 1/50], lambda t: abs(x - t) < 0.05::DOUBLE * t)) > 0)::INT) AS near_pct FROM p WHERE x IS NOT NULL GROUP BY 1
""")
def _(v):
    return b.basis_factors(basis(v), "rises", "one", "two")


@query("b22_gap_cause", """
, g AS (SELECT *, minute_index - lag(minute_index) OVER (PARTITION BY ticker, event_date, segment ORDER BY minute_index) - 1 AS gap FROM day_bars),
c AS (SELECT ticker, event_date, count(*) FILTER (WHERE segment = 'rth') AS rth_bars, coalesce(max(gap) FILTER (WHERE segment = 'rth'), 0) AS longest_gap, 1 - coalesce(sum(n_trades) FILTER (WHERE segment = 'rth'), 0) / sum(n_trades) AS outside_share,
  max(high) FILTER (WHERE segment = 'rth') AS day_high, max(high) AS reported_high, arg_max(last_price, minute_index) AS l, arg_min(first_price, minute_index) AS f FROM g GROUP BY 1, 2),
m AS (SELECT ticker, quantile_cont(rth_bars, 0.5) AS b, quantile_cont(longest_gap, 0.5) AS g, quantile_cont(outside_share, 0.5) AS o FROM c GROUP BY 1),
e AS (SELECT c.*, day_high / reported_high AS r1, day_high / reported_high * (1 + (l - f) / (20 * f)) AS r2, coalesce((b > 0 AND rth_bars < b * 0.8::DOUBLE)::INT, 0) + coalesce((longest_gap > g * 1.2::DOUBLE)::INT, 0) + coalesce((outside_share > o * 1.2::DOUBLE)::INT, 0) AS n_evidence, coalesce(reported_high > day_high, false) AS higher FROM c JOIN m USING (ticker))
SELECT ticker, event_date, n_evidence, CASE WHEN (r2 - r1) / r1 > 0.1::DOUBLE AND higher AND n_evidence > 0 THEN 'coverage_gap' WHEN abs(r1 - r2) / r2 BETWEEN 0.02::DOUBLE AND 0.07::DOUBLE AND abs((r2 - r1) / r1) <= 0.1::DOUBLE AND NOT (higher AND n_evidence > 0) THEN 'band_margin' ELSE 'unexplained' END AS cause FROM e
""")
def _(v):
    rth = F.col("segment") == "rth"
    extra = v.day_bars.groupBy(*KEYS).agg(F.max(F.when(rth, F.col("high"))).alias("day_high"), F.max("high").alias("reported_high"), F.max_by("last_price", "minute_index").alias("l"), F.min_by("first_price", "minute_index").alias("f"))
    one = F.col("day_high") / F.col("reported_high")
    rows = calendar.coverage_stats(v.day_bars, KEYS).join(extra, KEYS).withColumns({"ratio_one": one, "ratio_two": one * (1 + (F.col("l") - F.col("f")) / (20 * F.col("f")))})
    names = ("rth_bars", "longest_gap", "outside_share")
    medians = rows.groupBy("ticker").agg(*(F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in names))
    return b.gap_cause(rows, medians, ["ticker"]).select(*KEYS, "n_evidence", "cause")


@query("b23_key_fingerprint", """
, k AS (SELECT DISTINCT ticker, event_date FROM event_list), h AS (SELECT ('0x' || substr(md5(ticker::VARCHAR || '|' || event_date::VARCHAR), 1, 15))::BIGINT AS h FROM k)
SELECT count(*) AS n, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM h
""")
def _(v):
    return b.key_fingerprint(v.event_list, KEYS)


@query("b24_monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1")
def _(v):
    return b.monthly_counts(day(v, "orders", "o_orderdate"), "d")
