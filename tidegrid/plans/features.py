"""Queries of the tick feature, scanner and target operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import features as g
from tidegrid.operators import quotes as q
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query

DAY = ["ticker", "et_date"]
#: The fixture's prints are minutes to hours apart, so rates and gaps are on that scale.
ALPHA, BETA, FREEZE = 0.5, 0.001, 7200.0
HAWKES = """
, hg AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(ts_ns) OVER w IS NOT NULL THEN greatest((ts_ns - lag(ts_ns) OVER w) / 1e9, 1e-9) END AS gap FROM trades WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
ht AS (SELECT *, sum(CASE WHEN gap <= 7200 THEN gap ELSE 0 END) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS tau FROM hg),
hm AS (SELECT ticker, et_date, (count(*) FILTER (WHERE gap <= 7200) + 1) / greatest(coalesce(sum(gap) FILTER (WHERE gap <= 7200), 1e-6), 1e-6) AS mu, count(*) AS total FROM hg GROUP BY 1, 2),
hs AS (SELECT a.ticker, a.et_date, a.seq, sum(exp(-0.001 * (a.tau - b.tau))) AS s FROM ht a JOIN ht b ON a.ticker = b.ticker AND a.et_date = b.et_date AND b.n > 1 AND b.n <= a.n GROUP BY 1, 2, 3),
hl AS (SELECT t.*, CASE WHEN total < 2 THEN 0 ELSE mu + coalesce(0.5 * s, 0) END AS intensity FROM ht t JOIN hm USING (ticker, et_date) LEFT JOIN hs USING (ticker, et_date, seq)),
hawkes AS (SELECT *, coalesce(intensity - lag(intensity) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq), 0) AS step FROM hl)
"""
CVD = """
, cs AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)) AS s FROM trades),
ch AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq), 1) AS sg, row_number() OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS i, count(*) OVER (PARTITION BY ticker, et_date) AS n_ticks FROM cs),
cvd AS (SELECT *, sum(CASE WHEN n_ticks = 1 THEN 0 ELSE sg * size END) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS cvd, sum(CASE WHEN i = 1 THEN 0 ELSE sg * size END) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS later_cvd,
  sum(price * size) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) / sum(size) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS vwap FROM ch)
"""
ENTRY = CVD + """
, entry AS (SELECT ticker, et_date, min(ts_ns) FILTER (WHERE go) AS entry_ns, arg_min(seq, (ts_ns, seq)) FILTER (WHERE go) AS entry_seq, arg_min(price, (ts_ns, seq)) FILTER (WHERE go) AS entry_price
  FROM (SELECT *, et_min BETWEEN 240 AND 960 AND price > vwap AND later_cvd > 0 AS go FROM cvd) GROUP BY 1, 2)
"""


def hawkes(v):
    return g.hawkes_intensity(v.trades, DAY, ALPHA, BETA, FREEZE)


def entries(v):
    return g.entry_signal(v.trades, DAY, 240, 960)


@query("g1_gap_scanner", """
, p AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prior_close FROM daily), x AS (SELECT *, 100 * (open / nullif(prior_close, 0) - 1) AS gap_pct, 100 * (high / nullif(prior_close, 0) - 1) AS move_pct FROM p)
SELECT ticker, day, prior_close, gap_pct, move_pct, dense_rank() OVER (PARTITION BY day ORDER BY gap_pct DESC)::INTEGER AS gap_rank FROM x WHERE gap_pct >= 30
""")
def _(v):
    return g.gap_scanner(v.daily, 30).select("ticker", "day", "prior_close", "gap_pct", "move_pct", "gap_rank")


@query("g2_opening_volume", """
, n AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS n FROM day_bars),
o AS (SELECT ticker, event_date, sum(volume) FILTER (WHERE minute_index BETWEEN 330 AND 359) AS o, sum(volume) FILTER (WHERE n <= 5) AS f FROM n GROUP BY 1, 2)
SELECT ticker, event_date, coalesce(o, f)::BIGINT AS volume, o IS NULL AS is_fallback, dense_rank() OVER (PARTITION BY event_date ORDER BY coalesce(o, f) DESC NULLS LAST)::INTEGER AS volume_rank FROM o
""")
def _(v):
    return g.opening_volume(v.day_bars, KEYS, "event_date", 330, 359)


@query("g3_relative_volume", """
SELECT ticker, day, volume, CASE WHEN count(volume) OVER w >= 10 THEN volume / nullif(avg(volume) OVER w, 0) END AS rvol FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
""")
def _(v):
    return g.relative_volume(v.daily).select("ticker", "day", "volume", "rvol")


@query("g4_top_magnitude", "SELECT * FROM event_list WHERE magnitude >= 50 ORDER BY magnitude DESC, ticker, event_date LIMIT 25")
def _(v):
    return g.top_magnitude(v.event_list, 25, 50)


@query("g4_top_magnitude_of_names", """
, n AS (SELECT e.*, 'T' || e.ticker || '_' || e.event_date || '_' || printf('%.2f', magnitude) AS folder, c.n_rows FROM event_list e JOIN (SELECT ticker, et_date, count(*) AS n_rows FROM trades GROUP BY 1, 2) c ON c.ticker = e.ticker AND c.et_date = e.event_date)
SELECT ticker, event_date, n_rows, regexp_extract(folder, '_(-?[0-9]+(?:[.][0-9]+)?)$', 1)::DOUBLE AS magnitude FROM n WHERE n_rows >= 10 AND magnitude >= 50 ORDER BY magnitude DESC, ticker, event_date LIMIT 25
""")
def _(v):
    counts = v.trades.groupBy("ticker", F.col("et_date").alias("event_date")).agg(F.count(F.lit(1)).alias("n_rows"))
    folder = F.concat(F.lit("T"), F.col("ticker").cast("string"), F.lit("_"), F.col("event_date").cast("string"), F.lit("_"), F.format_string("%.2f", "magnitude"))
    rows = v.event_list.join(counts, KEYS).withColumn("magnitude", g.magnitude_of_name(folder))
    return g.top_magnitude(rows, 25, 50, min_rows=10)


@query("g5_price_normalise", """
, f AS (SELECT ticker, et_date AS event_date, arg_min(price, (ts_ns, seq)) AS first_price FROM trades WHERE et_min BETWEEN 570 AND 959 GROUP BY 1, 2)
SELECT e.*, e.magnitude AS open, first_price, magnitude / nullif(first_price, 0) AS phi, coalesce(abs(log10(nullif(magnitude, 0) / first_price)) > 3, true) AS is_outlier FROM event_list e LEFT JOIN f USING (ticker, event_date)
""")
def _(v):
    rth = v.trades.filter("et_min BETWEEN 570 AND 959").withColumnRenamed("et_date", "event_date")
    return g.price_normalise(v.event_list.withColumn("open", F.col("magnitude")), rth, KEYS)


@query("g6_regime", "SELECT CASE WHEN et_min < 570 THEN 'PRE' WHEN et_min < 585 THEN 'FLIP' ELSE 'STD' END AS regime, count(*) AS n FROM trades GROUP BY 1")
def _(v):
    return v.trades.groupBy(g.regime(F.col("et_min")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("g7_halts", """
, x AS (SELECT *, lead(ts_ns) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) - ts_ns AS gap FROM trades), h AS (SELECT *, gap > 1800000000000 AND et_min >= 570 AND et_min < 960 AS halt FROM x)
SELECT ticker, et_date, count(*) FILTER (WHERE halt) AS n_halts, coalesce(max(gap) FILTER (WHERE halt), 0) AS longest_ns, coalesce(sum(gap) FILTER (WHERE halt), 0)::BIGINT AS total_ns, max(ts_ns + gap) FILTER (WHERE halt) AS last_resume_ns FROM h GROUP BY 1, 2
""")
def _(v):
    return g.halts(v.trades, DAY, 1_800_000_000_000)


HALT = """
, hx AS (SELECT *, ts_ns - lag(ts_ns) OVER w > 1800000000000 AND lag(et_min) OVER w >= 570 AND lag(et_min) OVER w < 960 AS resumes FROM trades WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
hw AS (SELECT *, min(CASE WHEN et_min BETWEEN 840 AND 899 THEN ts_ns END) OVER (PARTITION BY ticker, et_date) AS start_ns FROM hx),
since AS (SELECT ticker, et_date, (max(start_ns) - max(ts_ns) FILTER (WHERE resumes AND ts_ns < start_ns)) / 1e9 AS seconds_since_halt FROM hw GROUP BY 1, 2)
"""


@query("g7_since_halt", HALT + "SELECT * FROM since")
def _(v):
    return g.since_halt(v.trades, DAY, 1_800_000_000_000, 840, 900)


@query("g8_hawkes_intensity", HAWKES + "SELECT seq, intensity, step FROM hawkes")
def _(v):
    return hawkes(v).select("seq", "intensity", "step")


WINDOWS = {"pre": "et_min < 570", "flip": "et_min >= 570 AND et_min < 585", "std": "et_min >= 585", "rth": "et_min >= 570 AND et_min < 960", "day": "true"}
STATS = HAWKES + ", stats AS (" + " UNION ALL ".join(f"""
SELECT ticker, et_date, '{n}' AS "window", count(*) AS n, CASE WHEN count(*) >= 10 THEN avg(intensity) END AS mean_intensity, CASE WHEN count(*) >= 10 THEN max(intensity) END AS max_intensity,
  CASE WHEN count(*) >= 10 THEN avg(step) END AS mean_step, CASE WHEN count(*) >= 10 THEN max(step) END AS max_step FROM hawkes WHERE {c} GROUP BY 1, 2""" for n, c in WINDOWS.items()) + ")\n"
SURGE = HALT + """
, sr AS (SELECT h.*, last_value(CASE WHEN resumes THEN h.ts_ns END IGNORE NULLS) OVER (PARTITION BY h.ticker, h.et_date ORDER BY h.ts_ns, h.seq) AS last_ns FROM hawkes h JOIN hx USING (ticker, et_date, seq)),
surge AS (SELECT ticker, et_date, max(intensity) FILTER (WHERE ts_ns < last_ns + 60000000000) AS post_halt_surge FROM sr GROUP BY 1, 2)
"""


def stats(v):
    rows = hawkes(v).join(v.trades.select(*DAY, "seq", "et_min"), [*DAY, "seq"])
    return g.intensity_stats(rows, DAY, {n: F.expr(c) for n, c in WINDOWS.items()})


def surge(v):
    ends = g.halt_ends(v.trades, DAY, 1_800_000_000_000).select(*DAY, "seq", "resume_ns")
    return g.post_halt_surge(hawkes(v).join(ends, [*DAY, "seq"]), DAY)


@query("g9_intensity_stats", STATS + "SELECT * FROM stats")
def _(v):
    return stats(v)


@query("g9_post_halt_surge", HAWKES + SURGE + "SELECT * FROM surge")
def _(v):
    return surge(v)


@query("g10_cvd", CVD + "SELECT seq, sg::INTEGER AS sign, cvd::BIGINT AS cvd FROM cvd")
def _(v):
    return g.cvd(v.trades, DAY).select("seq", "sign", "cvd")


#: Curvature on a grid of ten minutes from each day's first tick, back on the ticks.
CONVEXITY = CVD + """
, so AS (SELECT ticker, et_date, count(*) AS n, min(ts_ns) AS origin, max(ts_ns) AS stop FROM cvd GROUP BY 1, 2 HAVING count(*) >= 10 AND (max(ts_ns) - min(ts_ns)) // 600000000000 + 1 >= 5),
sg AS (SELECT ticker, et_date, origin, least((stop - origin + 599999999999) // 600000000000, 50000)::BIGINT AS last FROM so),
gr AS (SELECT *, origin + cell * 600000000000 AS at_ns FROM (SELECT *, unnest(range(0, last + 1)) AS cell FROM sg)),
ta AS (SELECT ticker, et_date, ts_ns, arg_max(cvd, seq) AS y FROM cvd GROUP BY 1, 2, 3), tz AS (SELECT ticker, et_date, ts_ns, arg_min(cvd, seq) AS y FROM cvd GROUP BY 1, 2, 3),
ga AS (SELECT gr.*, ta.ts_ns AS x0, ta.y AS y0 FROM gr ASOF LEFT JOIN ta ON ta.ticker = gr.ticker AND ta.et_date = gr.et_date AND gr.at_ns >= ta.ts_ns),
gz AS (SELECT ga.*, tz.ts_ns AS x1, tz.y AS y1 FROM ga ASOF LEFT JOIN tz ON tz.ticker = ga.ticker AND tz.et_date = ga.et_date AND ga.at_ns < tz.ts_ns),
l AS (SELECT ticker, et_date, origin, last, cell, y0 + coalesce((y1 - y0) * (at_ns - x0) / (x1 - x0), 0) AS y FROM gz),
lh AS (SELECT *, ((CASE WHEN last + 1 >= 31 THEN 31 WHEN last % 2 = 0 THEN last + 1 ELSE last END) - 1) // 2 AS h FROM l),
lm AS (SELECT *, CASE WHEN last + 1 >= 31 THEN least(greatest(cell, h), last - h) WHEN last % 2 = 1 AND cell > h THEN h + 1 ELSE h END AS mid, h * (h + 1) / 3 AS m2, h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15 - h * (h + 1) / 3 * h * (h + 1) * (2 * h + 1) / 3 AS norm FROM lh),
conv AS (SELECT m.ticker, m.et_date, m.cell, any_value(m.origin) AS origin, any_value(m.last) AS last, sum(2 * ((n.cell - m.mid) ** 2 - m.m2) * n.y / m.norm) AS c
  FROM lm m JOIN l n ON n.ticker = m.ticker AND n.et_date = m.et_date AND n.cell BETWEEN m.mid - m.h AND m.mid + m.h GROUP BY m.ticker, m.et_date, m.cell),
cn AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY ticker, et_date ORDER BY cell), c) AS d FROM conv),
tk AS (SELECT t.ticker, t.et_date, t.seq, t.ts_ns, origin, least((t.ts_ns - origin) // 600000000000, last) AS cell FROM cvd t LEFT JOIN sg ON sg.ticker = t.ticker AND sg.et_date = t.et_date),
convexity AS (SELECT tk.ticker, tk.et_date, tk.seq, round(coalesce(c + least(1, (ts_ns - tk.origin) / 6e11 - tk.cell) * (d - c), 0), 6) + 0.0::DOUBLE AS convexity FROM tk LEFT JOIN cn ON cn.ticker = tk.ticker AND cn.et_date = tk.et_date AND cn.cell = tk.cell)
"""


def convexity(v):
    made = g.cvd_convexity(g.cvd(v.trades, DAY), DAY, 600)
    return made.select(*DAY, "seq", (F.round("convexity", 6) + F.lit(0.0)).alias("convexity"))


@query("g11_cvd_convexity", CONVEXITY + "SELECT * FROM convexity")
def _(v):
    return convexity(v)


PREMARKET = """
, px AS (SELECT ticker, event_date, max(high) FILTER (WHERE segment = 'premarket') AS pre_high, arg_min(first_price, minute_index) FILTER (WHERE segment = 'rth') AS open, coalesce(sum(n_trades) FILTER (WHERE segment = 'premarket'), 0)::BIGINT AS pre_trades,
  sum(volume) FILTER (WHERE segment = 'rth' AND minute_index BETWEEN 330 AND 344) / 15 AS a, sum(volume) FILTER (WHERE segment = 'premarket') AS b,
  (max(last_ts) FILTER (WHERE segment = 'premarket') - min(first_ts) FILTER (WHERE segment = 'premarket')) / 6e10 AS span FROM day_bars GROUP BY 1, 2),
premarket AS (SELECT ticker, event_date, pre_high, open, pre_trades, CASE WHEN b IS NOT NULL THEN a / greatest(b / greatest(span, 1), 1) END AS volume_ratio, CASE WHEN pre_high > 0 THEN (open - pre_high) / pre_high END AS pre_high_distance FROM px)
"""


@query("g12_premarket_context", PREMARKET + "SELECT * FROM premarket")
def _(v):
    return g.premarket_context(v.day_bars, KEYS)


@query("g13_feature_row", STATS + SURGE + CONVEXITY + PREMARKET + """
, w AS (SELECT ticker, et_date, """ + ", ".join(f"max({c}) FILTER (WHERE \"window\" = '{n}') AS {n}_{c}" for n in ("flip", "rth", "day") for c in ("mean_intensity", "max_intensity", "mean_step", "max_step")) + """ FROM stats GROUP BY 1, 2),
h AS (SELECT ticker, et_date, count(*) FILTER (WHERE resumes) AS n_halts FROM hx GROUP BY 1, 2),
f AS (SELECT ticker, et_date, arg_max(cvd, (ts_ns, seq))::BIGINT AS cvd_final, arg_max(cvd, (ts_ns, seq)) FILTER (WHERE et_min BETWEEN 570 AND 584)::BIGINT AS cvd_flip_final FROM cvd GROUP BY 1, 2),
cx AS (SELECT ticker, et_date, avg(convexity) AS convexity_mean, max(convexity) AS convexity_max, avg((convexity > 0)::INT) AS convexity_positive_share FROM convexity GROUP BY 1, 2),
oi AS (SELECT *, CASE WHEN lag(ts_ns) OVER w IS NULL THEN 0 ELSE
  CASE WHEN bid >= lag(bid) OVER w THEN bid_size - lag(bid_size) OVER w ELSE -lag(bid_size) OVER w END
  - CASE WHEN ask <= lag(ask) OVER w THEN ask_size - lag(ask_size) OVER w ELSE -lag(ask_size) OVER w END END AS ofi
  FROM quotes WHERE bid > 0 AND ask > bid WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
og AS (SELECT ticker, et_date, avg(ofi) AS ofi_mean, sum(ofi)::BIGINT AS ofi_total, max(ofi) AS ofi_max FROM oi GROUP BY 1, 2)
SELECT e.ticker, e.event_date, e.magnitude, w.* EXCLUDE (ticker, et_date), n_halts, seconds_since_halt, post_halt_surge, cvd_final, cvd_flip_final, cx.* EXCLUDE (ticker, et_date), p.* EXCLUDE (ticker, event_date), og.* EXCLUDE (ticker, et_date)
FROM event_list e LEFT JOIN w ON w.ticker = e.ticker AND w.et_date = e.event_date LEFT JOIN h ON h.ticker = e.ticker AND h.et_date = e.event_date LEFT JOIN since ON since.ticker = e.ticker AND since.et_date = e.event_date
  LEFT JOIN surge ON surge.ticker = e.ticker AND surge.et_date = e.event_date LEFT JOIN f ON f.ticker = e.ticker AND f.et_date = e.event_date LEFT JOIN cx ON cx.ticker = e.ticker AND cx.et_date = e.event_date
  LEFT JOIN premarket p ON p.ticker = e.ticker AND p.event_date = e.event_date LEFT JOIN og ON og.ticker = e.ticker AND og.et_date = e.event_date
""")
def _(v):
    last = lambda c: F.max_by("cvd", F.when(c, F.struct("ts_ns", "seq")))
    flip = F.col("et_min").between(570, 584)
    wide = stats(v).filter(F.col("window").isin("flip", "rth", "day")).groupBy(*DAY).pivot("window", ["flip", "rth", "day"]).agg(*(F.max(c).alias(c) for c in ("mean_intensity", "max_intensity", "mean_step", "max_step")))
    halted = g.halt_ends(v.trades, DAY, 1_800_000_000_000).groupBy(*DAY).agg(F.count("resume_ns").alias("n_halts"))
    moved = g.cvd(v.trades, DAY).groupBy(*DAY).agg(last(F.lit(True)).alias("cvd_final"), F.when(F.count(F.when(flip, 1)) > 0, last(flip)).alias("cvd_flip_final"))
    bent = convexity(v).groupBy(*DAY).agg(F.avg("convexity").alias("convexity_mean"), F.max("convexity").alias("convexity_max"), F.avg((F.col("convexity") > 0).cast("double")).alias("convexity_positive_share"))
    book = q.ofi(v.quotes, DAY).select(*DAY, F.col("mean").alias("ofi_mean"), F.col("total").alias("ofi_total"), F.col("max").alias("ofi_max"))
    dated = [p.withColumnRenamed("et_date", "event_date") for p in (wide, halted, g.since_halt(v.trades, DAY, 1_800_000_000_000, 840, 900), surge(v), moved, bent, book)]
    return g.feature_row([v.event_list, *dated, g.premarket_context(v.day_bars, KEYS)], KEYS)


#: Fourteen hours from 05:00, as the fixture's prints are sparse.
TARGETS = """
, tt AS (SELECT *, et_min::BIGINT * 60000000000 + ts_ns % 60000000000 AS instant FROM trades),
tp AS (SELECT * FROM (SELECT *, first_value(price) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS ref, count(*) OVER (PARTITION BY ticker, et_date) AS n_all FROM tt WHERE instant BETWEEN 18000000000000 AND 68400000000000) WHERE n_all >= 10 AND ref > 0),
th AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(ts_ns) OVER w IS NOT NULL THEN greatest((ts_ns - lag(ts_ns) OVER w) / 1e9, 1e-9) END AS gap FROM tp WHERE instant <= 61200000000000 WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
tu AS (SELECT *, sum(CASE WHEN gap <= 7200 THEN gap ELSE 0 END) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) AS tau FROM th),
tm AS (SELECT ticker, et_date, count(*) AS total, (count(*) FILTER (WHERE gap <= 7200) + 1) / greatest(coalesce(sum(gap) FILTER (WHERE gap <= 7200), 1e-6), 1e-6) AS mu FROM th GROUP BY 1, 2),
ts AS (SELECT a.ticker, a.et_date, a.seq, sum(exp(-0.001 * (a.tau - b.tau))) AS s FROM tu a JOIN tu b ON a.ticker = b.ticker AND a.et_date = b.et_date AND b.n > 1 AND b.n <= a.n GROUP BY 1, 2, 3),
tl AS (SELECT tu.*, total, CASE WHEN total < 2 THEN 0 ELSE mu + coalesce(0.5 * s, 0) END AS lam FROM tu JOIN tm USING (ticker, et_date) LEFT JOIN ts USING (ticker, et_date, seq)),
ta AS (SELECT *, (lam + lead(lam) OVER w) / 2 * least((lead(ts_ns) OVER w - ts_ns) / 1e9, 7200) AS area FROM tl WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
tb AS (SELECT ticker, et_date, CASE WHEN count(*) >= 10 THEN sum(area) END AS intensity_area, CASE WHEN count(*) >= 10 THEN avg(lam) END AS intensity_mean, CASE WHEN count(*) >= 10 THEN max(lam) END AS intensity_max FROM ta GROUP BY 1, 2),
tr AS (SELECT ticker, et_date, count(*) AS n, CASE WHEN count(*) FILTER (WHERE instant <= 43200000000000) >= 5 THEN max(price / ref - 1) FILTER (WHERE instant <= 43200000000000) END AS best,
  CASE WHEN count(*) FILTER (WHERE instant <= 43200000000000) >= 5 THEN min(price / ref - 1) FILTER (WHERE instant <= 43200000000000) END AS worst,
  CASE WHEN count(*) FILTER (WHERE instant <= 61200000000000) >= 5 THEN arg_max(price / ref - 1, (ts_ns, seq)) FILTER (WHERE instant <= 61200000000000) END AS ret FROM tp GROUP BY 1, 2)
SELECT tr.*, intensity_area, intensity_mean, intensity_max, CASE WHEN best IS NULL THEN NULL WHEN abs(worst) > 1e-6 THEN abs(best / worst) ELSE CASE WHEN best > 0 THEN 100.0 ELSE 0.0 END END::DOUBLE AS efficiency FROM tr LEFT JOIN tb USING (ticker, et_date)
"""


@query("g14_forward_targets", TARGETS)
def _(v):
    return g.forward_targets(v.trades, DAY, 5 * 3600, 12 * 3600, 17 * 3600, 19 * 3600, ALPHA, BETA, FREEZE)


@query("g15_sample_weights", """
, p AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prior_close FROM daily), x AS (SELECT *, 100 * (open / nullif(prior_close, 0) - 1) AS gap_pct FROM p),
r AS (SELECT ticker, day, volume, CASE WHEN ticker % 3 > 0 THEN volume / 10 END AS rvol, dense_rank() OVER (PARTITION BY day ORDER BY gap_pct DESC) AS gap_rank FROM x WHERE gap_pct >= 30),
s AS (SELECT min(ln(1 + volume)) AS lo, max(ln(1 + volume)) AS hi FROM r WHERE rvol IS NULL)
SELECT ticker, day, greatest(ln(greatest(coalesce(rvol, CASE WHEN hi > lo THEN 1 + 9 * (ln(1 + volume) - lo) / (hi - lo) ELSE 5 END), 1.01)) / greatest(gap_rank, 1) ** 2, 1e-6) AS weight FROM r CROSS JOIN s
""")
def _(v):
    rows = g.gap_scanner(v.daily, 30).withColumn("rvol", F.when(F.col("ticker") % 3 > 0, F.col("volume") / 10))
    return g.sample_weights(rows, "gap_rank", "rvol", "volume").select("ticker", "day", "weight")


@query("g16_temporal_split", """
, d AS (SELECT event_date, count(*) AS n FROM event_list GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM d)
SELECT ticker, event_date, CASE WHEN b < 0.8 * t THEN 'train' ELSE 'test' END AS split FROM event_list JOIN c USING (event_date)
""")
def _(v):
    return g.temporal_split(v.event_list, "event_date").select(*KEYS, "split")


@query("g17_top_quantile", "SELECT * FROM event_list WHERE magnitude >= (SELECT quantile_cont(magnitude, 0.75) FROM event_list)")
def _(v):
    return g.top_quantile(v.event_list, "magnitude")


@query("g18_entry_signal", ENTRY + "SELECT * FROM entry")
def _(v):
    return entries(v)


BARRIER = ENTRY + """
, taken AS (SELECT * FROM entry WHERE entry_ns IS NOT NULL),
bx AS (SELECT t.*, entry_ns, entry_price, price / entry_price - 1 AS r FROM trades t JOIN taken USING (ticker, et_date) WHERE (ts_ns, seq) > (entry_ns, entry_seq) AND ts_ns <= entry_ns + 7200000000000),
bs AS (SELECT *, min((ts_ns, seq)) FILTER (WHERE price <= entry_price * (1 - 0.2::DOUBLE)) OVER (PARTITION BY ticker, et_date) AS stop FROM bx),
bo AS (SELECT ticker, et_date, max(stop) IS NOT NULL AS stopped, max(ts_ns) AS exit_ns, arg_max(r, (ts_ns, seq)) AS last, max(r) AS up, min(r) AS down FROM bs WHERE stop IS NULL OR (ts_ns, seq) <= stop GROUP BY 1, 2),
exits AS (SELECT ticker, et_date, CASE WHEN exit_ns IS NULL THEN 'no_ticks' WHEN stopped THEN 'stop' ELSE 'time' END AS reason, coalesce(exit_ns, entry_ns) AS exit_ns,
  CASE WHEN stopped THEN -0.2::DOUBLE ELSE coalesce(last, 0) END AS ret, greatest(coalesce(up, 0), 0) AS best, least(coalesce(down, 0), 0) AS worst FROM taken LEFT JOIN bo USING (ticker, et_date))
"""


@query("g19_barrier_exit", BARRIER + "SELECT * FROM exits")
def _(v):
    return g.barrier_exit(v.trades, entries(v), DAY, 0.2, 7_200_000_000_000)


@query("g20_pnl_metrics", BARRIER + """
, p AS (SELECT *, 100 * ret AS pnl FROM exits), c AS (SELECT *, sum(pnl) OVER (PARTITION BY ticker ORDER BY et_date) AS cum FROM p), q AS (SELECT *, cum - max(cum) OVER (PARTITION BY ticker ORDER BY et_date) AS dd FROM c)
SELECT ticker, count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, sum(pnl) AS total, avg(pnl) AS mean, quantile_cont(pnl, 0.5) AS median,
  coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / greatest(coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0), 1e-6) AS profit_factor, min(dd) AS max_drawdown, coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) AS annualised FROM q GROUP BY 1
""")
def _(v):
    rows = g.barrier_exit(v.trades, entries(v), DAY, 0.2, 7_200_000_000_000).withColumn("pnl", 100 * F.col("ret"))
    return g.pnl_metrics(rows, ["ticker"], "pnl", "ret", ["et_date"])
