"""Queries of the burst, interval, sampling and inference operators (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import bursts as h
from tidegrid.operators import inference as i
from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query
from tidegrid.plans.returns import MARKS, marks

DAY = ["ticker", "et_date"]
MIN = 60_000_000_000
TIES = ", lt AS (SELECT l_partkey AS ticker, epoch_us(l_shipdate) * 1000 AS ts_ns, l_quantity::BIGINT AS size FROM lineitem), lc AS (SELECT ticker, ts_ns, sum(size)::BIGINT AS size, count(*) AS n_prints FROM lt GROUP BY 1, 2)\n"
RUNS = """
, rc AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER w < 1800000000000 THEN 0 ELSE 1 END AS ch FROM trades WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
runs AS (SELECT *, sum(ch) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)::BIGINT AS run FROM rc)
"""
HYST = """
, hy AS (SELECT *, coalesce(last_value(CASE WHEN price >= 80 THEN 1 WHEN price < 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts_ns, seq), 0) = 1 AS is_on FROM trades),
hc AS (SELECT *, CASE WHEN is_on IS DISTINCT FROM lag(is_on) OVER (PARTITION BY ticker ORDER BY ts_ns, seq) THEN 1 ELSE 0 END AS ch FROM hy),
hr AS (SELECT *, sum(ch) OVER (PARTITION BY ticker ORDER BY ts_ns, seq) AS run FROM hc),
iv AS (SELECT ticker, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n FROM hr WHERE is_on GROUP BY ticker, run)
"""
MERGE = HYST + """
, mr AS (SELECT *, max(end_ns) OVER (PARTITION BY ticker ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
mi AS (SELECT *, sum(CASE WHEN start_ns - reach < 7200000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY start_ns, end_ns) AS run FROM mr),
merged AS (SELECT ticker, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS merged FROM mi GROUP BY ticker, run HAVING max(end_ns) - min(start_ns) >= 3600000000000)
"""


def line_ticks(v):
    from tidegrid.functions.clock import epoch_us

    return v.table("lineitem").select(F.col("l_partkey").alias("ticker"), (epoch_us(F.col("l_shipdate")) * 1000).alias("ts_ns"), F.col("l_quantity").cast("long").alias("size"))


def runs(v):
    from pyspark.sql import Window

    from tidegrid.functions.frames import islands

    gap = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy(*DAY).orderBy("ts_ns", "seq"))
    return islands(v.trades, DAY, ["ts_ns", "seq"], F.coalesce(gap >= 30 * MIN, F.lit(True)))


def hysteresis(v):
    rows = h.hysteresis_bursts(v.trades, ["ticker"], ["ts_ns", "seq"], F.col("price"), 80, 30)
    return h.runs_of(rows, ["ticker"], "is_on")


@query("h1_collapse_ties", TIES + "SELECT * FROM lc")
def _(v):
    return h.collapse_ties(line_ticks(v), ["ticker"])


@query("h2_tie_structure", TIES + """
, g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY ticker ORDER BY ts_ns) AS gap FROM lc)
SELECT ticker, coalesce((sum(n_prints) - count(*)) / nullif(sum(n_prints) - 1, 0), 0) AS tied_share, count(*) AS n_stamps, max(n_prints) AS longest_tie, min(gap) AS min_gap_ns FROM g GROUP BY 1
""")
def _(v):
    return h.tie_structure(line_ticks(v), ["ticker"])


@query("h3_knn_rate", """
, r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker, et_date) AS n, sum(size) OVER w AS cum FROM trades WINDOW w AS (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)),
k AS (SELECT *, least(greatest(i - 2, 0), n - 5) AS a FROM r WHERE n >= 5)
SELECT k.ticker, k.et_date, k.seq, k.ts_ns, 5 / greatest((z.ts_ns - y.ts_ns) / 1e9, 1.0) AS print_rate, (z.cum - y.cum + y.size) / greatest((z.ts_ns - y.ts_ns) / 1e9, 1.0) AS volume_rate
FROM k JOIN r y ON y.ticker = k.ticker AND y.et_date = k.et_date AND y.i = k.a JOIN r z ON z.ticker = k.ticker AND z.et_date = k.et_date AND z.i = k.a + 4
""")
def _(v):
    return h.knn_rate(v.trades, DAY, 5, 1.0)


@query("h4_sustained_crossing", """
, n AS (SELECT *, lead(minute_index) OVER (PARTITION BY ticker, event_date ORDER BY minute_index) AS nxt, avg(high) OVER (PARTITION BY ticker, event_date) AS level FROM day_bars),
a AS (SELECT ticker, event_date, min(minute_index) AS start, max(minute_index) FILTER (WHERE high > level) AS last FROM n GROUP BY 1, 2)
SELECT a.ticker, a.event_date, CASE WHEN last IS NULL THEN 0 ELSE nxt - start END AS elapsed, last IS NOT NULL AND nxt IS NULL AS never_reached FROM a LEFT JOIN n ON n.ticker = a.ticker AND n.event_date = a.event_date AND n.minute_index = a.last
""")
def _(v):
    from pyspark.sql import Window

    rows = v.day_bars.withColumn("level", F.avg("high").over(Window.partitionBy(*KEYS)))
    return h.sustained_crossing(rows, KEYS, "minute_index", "high", "level")


@query("h5_peak_profile", """
, p AS (SELECT ticker, event_date, arg_max(minute_index, (volume, -minute_index)) AS peak_at, max(volume) AS top FROM day_bars GROUP BY 1, 2),
e AS (SELECT *, peak_at + o AS target FROM p CROSS JOIN (SELECT unnest([-30, 0, 30, 120]) AS o))
SELECT e.ticker, e.event_date, peak_at, top, o AS offset, volume / top AS share_of_peak FROM e ASOF LEFT JOIN day_bars b ON e.ticker = b.ticker AND e.event_date = b.event_date AND e.target >= b.minute_index
""")
def _(v):
    return h.peak_profile(v.day_bars, KEYS, "minute_index", "volume", [-30, 0, 30, 120])


PEAKED = """
, p AS (SELECT ticker, event_date, arg_max(minute_index, (volume, -minute_index)) AS peak_at, max(volume) AS top, avg(volume) AS baseline, min(minute_index) + 60 AS origin FROM day_bars GROUP BY 1, 2),
r AS (SELECT b.ticker, b.event_date, minute_index, volume, peak_at, top, baseline, origin, lead(minute_index) OVER (PARTITION BY b.ticker, b.event_date ORDER BY minute_index) AS nxt FROM day_bars b JOIN p ON p.ticker = b.ticker AND p.event_date = b.event_date),
k AS (SELECT * FROM r WHERE minute_index >= peak_at)
"""


def after(level, name):
    """Elapsed minutes and the flag of one level."""
    above = f"FILTER (WHERE volume > {level})"
    return f"CASE WHEN count(*) {above} = 0 THEN 0 ELSE nullif(arg_max(coalesce(nxt, -1), minute_index) {above}, -1) - any_value(peak_at) END AS {name}, coalesce(arg_max(coalesce(nxt, -1), minute_index) {above} = -1, false) AS {name}_never"


@query("h5_decay_times", PEAKED + "SELECT ticker, event_date, any_value(peak_at) AS peak_at, any_value(top) AS top, " + ", ".join([after("0.5 * top", "decay_0"), after("0.1 * top", "decay_1"), after("baseline", "terminal_0"), after("2 * baseline", "terminal_1")]) + ", any_value(peak_at - origin) AS origin_to_peak FROM k GROUP BY 1, 2")
def _(v):
    own = v.day_bars.groupBy(*KEYS).agg(F.avg("volume").alias("baseline"), (F.min("minute_index") + 60).alias("at"))
    return h.decay_times(v.day_bars, KEYS, "minute_index", "volume", [0.5, 0.1], [1, 2], own, own)


@query("h5_profile_around", """
, o AS (SELECT ticker, event_date, arg_max(minute_index, (volume, -minute_index)) AS o_at, max(volume) AS top FROM day_bars GROUP BY 1, 2), t AS (SELECT *, o_at + x AS target FROM o CROSS JOIN (SELECT unnest([-100, -10, -1, 0, 1, 10, 100]::DOUBLE[]) AS x)),
a AS (SELECT t.*, b.minute_index AS x0, b.volume AS y0 FROM t ASOF LEFT JOIN day_bars b ON b.ticker = t.ticker AND b.event_date = t.event_date AND t.target >= b.minute_index),
c AS (SELECT a.*, b.minute_index AS x1, b.volume AS y1 FROM a ASOF LEFT JOIN day_bars b ON b.ticker = a.ticker AND b.event_date = a.event_date AND a.target <= b.minute_index)
SELECT ticker, event_date, o_at AS "at", x AS "offset", CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (target - x0) / (x1 - x0) END / top AS share_of_top FROM c
""")
def _(v):
    origin = v.day_bars.groupBy(*KEYS).agg(F.max_by("minute_index", F.struct(F.col("volume"), -F.col("minute_index"))).alias("at"))
    return h.profile_around(v.day_bars, origin, KEYS, "minute_index", "volume", [round(x, 9) for x in h.log_grid(1, 100, 3)])


COLLECTED = """
, got AS (SELECT ticker, event_date, session_offset, (post_min - pre_min)::BIGINT AS minutes FROM spine s WHERE session_offset IN (-3, -2, -1) AND EXISTS (SELECT 1 FROM trades t WHERE t.ticker = s.ticker AND t.et_date = s.session_date)),
flank AS (SELECT b.* FROM bars b JOIN got USING (ticker, event_date, session_offset))
"""


def collected(v):
    return h.collected_sessions(v.spine, v.trades, KEYS)


@query("h6_scalar_baseline", COLLECTED + """
, s AS (SELECT ticker, event_date, sum(minutes) AS minutes, count(*) AS n_sessions FROM got GROUP BY 1, 2), t AS (SELECT ticker, event_date, sum(n_trades)::BIGINT AS n, sum(volume) AS v FROM flank GROUP BY 1, 2)
SELECT ticker, event_date, coalesce(n_sessions, 0) AS n_sessions, coalesce(n, 0)::BIGINT AS n_prints, CASE WHEN n > 0 THEN n / (minutes * 60) END AS prints_per_s, CASE WHEN n > 0 THEN v / (minutes * 60) END AS volume_per_s, coalesce(n, 0) = 0 AS is_undefined
FROM event_list LEFT JOIN s USING (ticker, event_date) LEFT JOIN t USING (ticker, event_date)
""")
def _(v):
    return h.scalar_baseline(v.bars, collected(v), v.event_list, KEYS)


@query("h7_tod_baseline", COLLECTED + """
, f AS (SELECT ticker, event_date, minute_index, sum(n_trades) AS n FROM flank GROUP BY 1, 2, 3),
o AS (SELECT ticker, event_date, unnest(range(0, post_min - pre_min)) AS minute_index FROM spine WHERE session_offset = 0),
p AS (SELECT o.ticker, o.event_date, o.minute_index, coalesce(sum(n), 0)::BIGINT AS prints FROM o LEFT JOIN f ON f.ticker = o.ticker AND f.event_date = o.event_date AND f.minute_index BETWEEN o.minute_index - 15 AND o.minute_index + 15 GROUP BY 1, 2, 3),
t AS (SELECT o.ticker, o.event_date, o.minute_index, coalesce(sum(greatest(0, least(minutes - 1, o.minute_index + 15) - greatest(0, o.minute_index - 15) + 1)) FILTER (WHERE minutes IS NOT NULL), 0)::BIGINT AS slots FROM o LEFT JOIN got ON got.ticker = o.ticker AND got.event_date = o.event_date GROUP BY 1, 2, 3)
SELECT *, CASE WHEN slots > 0 THEN prints / slots END AS rate, greatest(coalesce(CASE WHEN slots > 0 THEN prints / slots END, 0.01), 0.01) AS rate_floored,
  CASE WHEN max(slots) OVER w = 0 THEN 'baseline_undefined' WHEN min(prints) OVER w > 0 THEN 'defined' ELSE 'baseline_partial' END AS label FROM p JOIN t USING (ticker, event_date, minute_index) WINDOW w AS (PARTITION BY ticker, event_date)
""")
def _(v):
    return h.tod_baseline(v.bars, collected(v), v.spine, KEYS, 15, 0.01)


@query("h8_hysteresis_bursts", HYST + "SELECT * FROM iv")
def _(v):
    return hysteresis(v)


GRIDDED = COLLECTED + """
, f AS (SELECT ticker, event_date, minute_index, sum(n_trades) AS n FROM flank GROUP BY 1, 2, 3),
o AS (SELECT ticker, event_date, unnest(range(0, post_min - pre_min)) AS minute_index FROM spine WHERE session_offset = 0),
p AS (SELECT o.ticker, o.event_date, o.minute_index, coalesce(sum(n), 0) AS prints FROM o LEFT JOIN f ON f.ticker = o.ticker AND f.event_date = o.event_date AND f.minute_index BETWEEN o.minute_index - 15 AND o.minute_index + 15 GROUP BY 1, 2, 3),
t AS (SELECT o.ticker, o.event_date, o.minute_index, coalesce(sum(greatest(0, least(minutes - 1, o.minute_index + 15) - greatest(0, o.minute_index - 15) + 1)) FILTER (WHERE minutes IS NOT NULL), 0) AS slots FROM o LEFT JOIN got ON got.ticker = o.ticker AND got.event_date = o.event_date GROUP BY 1, 2, 3),
base AS (SELECT ticker, event_date, minute_index, greatest(coalesce(prints / nullif(slots, 0), 0.01), 0.01) AS rate FROM p JOIN t USING (ticker, event_date, minute_index)),
se AS (SELECT ticker, event_date, (post_min - pre_min)::BIGINT AS minutes, (epoch_us(event_date::TIMESTAMP) + (pre_min + 300)::BIGINT * 60000000) * 1000 AS start_ns FROM spine WHERE session_offset = 0),
gp AS (SELECT *, start_ns + g * 300000000000 AS at_ns FROM (SELECT *, unnest(range(0, (minutes + 4) // 5 + 1)) AS g FROM se)),
tn AS (SELECT s.ticker, s.event_date, t.ts_ns, t.seq, row_number() OVER (PARTITION BY s.ticker, s.event_date ORDER BY t.ts_ns, t.seq) AS i FROM trades t JOIN se s ON s.ticker = t.ticker AND s.event_date = t.et_date),
tc AS (SELECT ticker, event_date, ts_ns, max(i) AS i FROM tn GROUP BY 1, 2, 3),
lo AS (SELECT gp.*, coalesce(i, 0) AS a FROM gp ASOF LEFT JOIN tc ON tc.ticker = gp.ticker AND tc.event_date = gp.event_date AND gp.at_ns - 3600000000000 > tc.ts_ns),
hi AS (SELECT lo.*, coalesce(i, 0) - a AS prints FROM lo ASOF LEFT JOIN tc ON tc.ticker = lo.ticker AND tc.event_date = lo.event_date AND lo.at_ns + 3600000000000 > tc.ts_ns),
gz AS (SELECT hi.*, ln(prints / 120 + 1e-9) - ln(rate + 1e-9) AS z FROM hi JOIN base ON base.ticker = hi.ticker AND base.event_date = hi.event_date AND base.minute_index = least((at_ns - start_ns) // 60000000000, minutes - 1)),
gs AS (SELECT *, coalesce(last_value(CASE WHEN z >= ln(3) THEN 1 WHEN z < ln(1.5) THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker, event_date ORDER BY g), 0) = 1 AS is_on FROM gz),
gc AS (SELECT *, CASE WHEN is_on IS DISTINCT FROM lag(is_on) OVER (PARTITION BY ticker, event_date ORDER BY g) THEN 1 ELSE 0 END AS ch FROM gs), gr AS (SELECT *, sum(ch) OVER (PARTITION BY ticker, event_date ORDER BY g) AS run FROM gc),
ga AS (SELECT ticker, event_date, min(at_ns) AS s, max(at_ns) AS e FROM gr WHERE is_on GROUP BY ticker, event_date, run),
gb AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY ticker, event_date ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1200000000000 THEN 0 ELSE 1 END AS ch FROM ga),
gm AS (SELECT ticker, event_date, min(s) AS s, max(e) AS e FROM (SELECT *, sum(ch) OVER (PARTITION BY ticker, event_date ORDER BY s) AS run FROM gb) GROUP BY ticker, event_date, run HAVING max(e) - min(s) >= 600000000000)
SELECT gm.ticker, gm.event_date, s AS grid_start_ns, e AS grid_end_ns, min(i) - 1 AS start_index, max(i) - 1 AS end_index, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n_prints
FROM gm JOIN tn ON tn.ticker = gm.ticker AND tn.event_date = gm.event_date AND ts_ns BETWEEN s AND e GROUP BY gm.ticker, gm.event_date, s, e
"""


@query("h8_grid_bursts", GRIDDED)
def _(v):
    from tidegrid.functions import clock

    own = v.spine.filter("session_offset = 0")
    start = clock.local_to_ns(clock.us_of(F.col("event_date"), F.col("pre_min")))
    sessions = own.select(*KEYS, start.alias("start_ns"), (F.col("post_min") - F.col("pre_min")).cast("long").alias("minutes"))
    ticks = v.trades.withColumnRenamed("et_date", "event_date").join(own.select(*KEYS), KEYS, "left_semi")
    return h.grid_bursts(ticks, sessions, h.tod_baseline(v.bars, collected(v), v.spine, KEYS, 15, 0.01), KEYS, 300, 7200, 3, 1.5, 0.01, 1200, 600)


@query("h9_merge_drop", MERGE + "SELECT * FROM merged")
def _(v):
    return h.merge_drop(hysteresis(v), ["ticker"], 120 * MIN, 60 * MIN)


KLEINBERG = """
, g0 AS (SELECT ticker, et_date, ts_ns, seq, greatest((ts_ns - lag(ts_ns) OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq)) / 1e9, 1e-9) AS gap, row_number() OVER (PARTITION BY ticker, et_date ORDER BY ts_ns, seq) - 1 AS i FROM trades),
g AS (SELECT *, count(*) OVER w + 1 AS n, sum(gap) OVER w AS span FROM g0 WHERE i > 0 WINDOW w AS (PARTITION BY ticker, et_date)),
c AS (SELECT *, ln(n) AS tau, (3 - 1) * n / span * gap - ln(3) AS dc FROM g),
path AS (
  WITH RECURSIVE r AS (
    SELECT ticker, et_date, i, ts_ns, seq, tau, tau + dc AS d FROM c WHERE i = 1
    UNION ALL SELECT c.ticker, c.et_date, c.i, c.ts_ns, c.seq, c.tau, least(greatest(r.d, 0), c.tau) + c.dc FROM r JOIN c ON c.ticker = r.ticker AND c.et_date = r.et_date AND c.i = r.i + 1)
  SELECT * FROM r)
"""


@query("h10_two_state_bursts", KLEINBERG + """
SELECT ticker, et_date, ts_ns, seq, d, coalesce(first_value(CASE WHEN d >= tau THEN 0 WHEN d < 0 THEN 1 END IGNORE NULLS) OVER (PARTITION BY ticker, et_date ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS state FROM path
""")
def _(v):
    return h.two_state_bursts(v.trades, DAY, 3.0, 1.0)


@query("h10_burst_runs", KLEINBERG + """
, st AS (SELECT *, coalesce(first_value(CASE WHEN d >= tau THEN 0 WHEN d < 0 THEN 1 END IGNORE NULLS) OVER (PARTITION BY ticker, et_date ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS state FROM path),
sc AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY ticker, et_date ORDER BY i) THEN 1 ELSE 0 END AS ch FROM st), sr AS (SELECT *, sum(ch) OVER (PARTITION BY ticker, et_date ORDER BY i) AS run FROM sc)
SELECT ticker, et_date, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n FROM sr WHERE state = 1 GROUP BY ticker, et_date, run
""")
def _(v):
    return h.burst_runs(h.two_state_bursts(v.trades, DAY, 3.0, 1.0), DAY)


@query("h12_sweep_runs", RUNS.replace("< 1800000000000", "<= 1800000000000") + """
, s AS (SELECT ticker, et_date, count(*) AS n FROM runs GROUP BY ticker, et_date, run)
SELECT ticker, et_date, count(*) AS n_runs, avg(n) AS mean, sum(n * n) / sum(n) AS size_biased, max(n) AS largest FROM s GROUP BY 1, 2
""")
def _(v):
    return h.sweep_runs(v.trades, DAY, 30 * MIN)


MEASURES = RUNS + """
, kept AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY ticker, et_date, run) >= 2 THEN run END AS burst FROM runs),
se AS (SELECT ticker, et_date, count(*) AS session_prints, sum(size) AS session_volume, max(ts_ns) - min(ts_ns) AS session_ns, arg_max(price, (ts_ns, seq)) - arg_min(price, (ts_ns, seq)) AS session_move FROM kept GROUP BY 1, 2),
bm AS (SELECT ticker, et_date, burst, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n_prints, sum(size)::BIGINT AS volume, arg_max(price, (ts_ns, seq)) - arg_min(price, (ts_ns, seq)) AS move, max(price) AS high FROM kept WHERE burst IS NOT NULL GROUP BY 1, 2, 3),
measures AS (SELECT bm.ticker, bm.et_date, burst, start_ns, end_ns - start_ns AS duration_ns, n_prints, volume, move, high, move / nullif(session_move, 0) AS move_share, start_ns - lag(end_ns) OVER (PARTITION BY bm.ticker, bm.et_date ORDER BY start_ns) AS spacing_ns FROM bm JOIN se USING (ticker, et_date))
"""


def bursts_of(v):
    """Runs of two prints at least are bursts; other prints belong to the session alone."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*DAY, "run"))
    return runs(v).withColumn("burst", F.when(n >= 2, F.col("run")))


@query("h13_burst_measures", MEASURES + "SELECT * FROM measures")
def _(v):
    return h.burst_measures(bursts_of(v), DAY, "burst")


@query("h13_burst_coverage", MEASURES + """
, c AS (SELECT ticker, et_date, count(*) AS n_bursts, sum(duration_ns) AS ns, sum(n_prints) AS prints, sum(volume) AS volume, sum(abs(move)) AS abs_move FROM measures GROUP BY 1, 2)
SELECT se.ticker, se.et_date, coalesce(n_bursts, 0) AS n_bursts, coalesce(ns / nullif(session_ns, 0), 0) AS time_share, coalesce(prints / session_prints, 0) AS print_share, coalesce(volume / session_volume, 0) AS volume_share, coalesce(abs_move, 0) AS abs_move_in_bursts, session_move
FROM se LEFT JOIN c USING (ticker, et_date)
""")
def _(v):
    ticks = bursts_of(v)
    return h.burst_coverage(ticks, h.burst_measures(ticks, DAY, "burst"), DAY)


@query("h14_burst_concentration", MEASURES + """
, a AS (SELECT *, (ts_ns - min(ts_ns) OVER (PARTITION BY ticker, et_date, burst)) / 1e9 AS age FROM kept WHERE burst IS NOT NULL),
g AS (SELECT ticker, et_date, burst, seconds, sum(size) FILTER (WHERE age <= seconds) / sum(size) AS volume_share, (arg_max(price, (ts_ns, seq)) FILTER (WHERE age <= seconds) - arg_min(price, (ts_ns, seq))) / nullif(arg_max(price, (ts_ns, seq)) - arg_min(price, (ts_ns, seq)), 0) AS move_share,
  max(age) >= seconds AS is_open, max(age) AS duration FROM a CROSS JOIN (SELECT unnest([0, 600]) AS seconds) GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (duration) FROM g WHERE duration > 0
""")
def _(v):
    return h.burst_concentration(bursts_of(v), DAY, "burst", [0, 600])


@query("h15_interval_jaccard", MERGE + """
, o AS (SELECT a.ticker, sum(greatest(0, least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns)))::BIGINT AS ov FROM iv a JOIN merged b USING (ticker) GROUP BY 1),
la AS (SELECT ticker, sum(end_ns - start_ns)::BIGINT AS a FROM iv GROUP BY 1), lb AS (SELECT ticker, sum(end_ns - start_ns)::BIGINT AS b FROM merged GROUP BY 1)
SELECT ticker, coalesce(ov, 0) AS overlap_ns, coalesce(a, 0) + coalesce(b, 0) - coalesce(ov, 0) AS union_ns, coalesce(coalesce(ov, 0) / nullif(coalesce(a, 0) + coalesce(b, 0) - coalesce(ov, 0), 0), 1) AS jaccard
FROM la FULL JOIN lb USING (ticker) LEFT JOIN o USING (ticker)
""")
def _(v):
    on = hysteresis(v)
    return h.interval_jaccard(on, h.merge_drop(on, ["ticker"], 120 * MIN, 60 * MIN), ["ticker"])


@query("h16_allan_fano", """
, b AS (SELECT ticker, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM trades GROUP BY 1), t AS (SELECT unnest([3600, 21600, 86400]::DOUBLE[]) AS "T"),
w AS (SELECT ticker, "T", start_ns, floor((end_ns - start_ns) / 1e9 / "T")::BIGINT AS n_windows FROM b CROSS JOIN t),
d AS (SELECT ticker, "T", start_ns, n_windows, unnest(range(n_windows)) AS b FROM w),
k AS (SELECT ticker, "T", floor((ts_ns - start_ns) / 1e9 / "T")::BIGINT AS b, count(*)::DOUBLE AS c FROM trades JOIN w USING (ticker) GROUP BY 1, 2, 3),
x AS (SELECT d.*, coalesce(c, 0) AS c FROM d LEFT JOIN k USING (ticker, "T", b)), y AS (SELECT *, c - lag(c) OVER (PARTITION BY ticker, "T" ORDER BY b) AS dc FROM x)
SELECT ticker, "T", n_windows, avg(c) AS mean_count, sum(dc * dc) / (n_windows - 1) / (2 * avg(c)) AS allan, var_pop(c) / avg(c) AS fano FROM y GROUP BY 1, 2, 3
""")
def _(v):
    bounds = v.trades.groupBy("ticker").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
    return h.allan_fano(v.trades, ["ticker"], bounds, [3600, 21600, 86400])


@query("h20_count_dependence", RUNS + """
, s AS (SELECT ticker, et_date, count(DISTINCT run) AS y, count(*) AS x FROM runs GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY x) + (count(*) OVER (PARTITION BY ticker, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY ticker ORDER BY y) + (count(*) OVER (PARTITION BY ticker, y) - 1) / 2 AS ry FROM s)
SELECT ticker, count(*) AS n, count(*) FILTER (WHERE x > 0 AND y > 0) AS n_positive, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rank_correlation, CASE WHEN count(*) FILTER (WHERE x > 0 AND y > 0) >= 5 THEN regr_slope(ln(y), ln(x)) END AS slope FROM r GROUP BY 1
""")
def _(v):
    rows = runs(v).groupBy(*DAY).agg(F.countDistinct("run").alias("y"), F.count(F.lit(1)).alias("x"))
    return h.count_dependence(rows, "x", "y", ["ticker"])


@query("h21_variant_stability", """
, u AS (SELECT ticker, et_date, 'all' AS v, max(price) AS m FROM trades GROUP BY 1, 2 UNION ALL SELECT ticker, et_date, 'large', max(price) FROM trades WHERE size > 50 GROUP BY 1, 2)
SELECT ticker, et_date, max(m) / min(m) AS spread, abs(ln(max(m) FILTER (WHERE v = 'all') / max(m) FILTER (WHERE v = 'large'))) AS log_ratio, coalesce(abs(ln(max(m) FILTER (WHERE v = 'all') / max(m) FILTER (WHERE v = 'large'))) <= 0.1, false) AS is_stable FROM u GROUP BY 1, 2
""")
def _(v):
    one = lambda rows, name: rows.groupBy(*DAY).agg(F.max("price").alias("m")).withColumn("v", F.lit(name))
    return h.variant_stability(one(v.trades, "all").unionByName(one(v.trades.filter("size > 50"), "large")), DAY, "v", "m", "all", "large", 0.1)


@query("h22_status_shares", """
, s AS (SELECT ticker, CASE WHEN count(*) < 15 THEN 'too_few' WHEN max(price) < 50 THEN 'no_threshold' ELSE 'ok' END AS status FROM trades GROUP BY ticker, et_date), n AS (SELECT ticker, status, count(*) AS n FROM s GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY ticker) AS share FROM n
""")
def _(v):
    status = F.when(F.count(F.lit(1)) < 15, "too_few").when(F.max("price") < 50, "no_threshold").otherwise("ok")
    return h.status_shares(v.trades.groupBy(*DAY).agg(status.alias("status")), "status", ["ticker"])


@query("h21_moved_share", """
, u AS (SELECT ticker, et_date, 'all' AS v, arg_max(ts_ns, (price, -ts_ns)) AS p_at, 3600000000000 * (1 + count(*) % 3) AS decay FROM trades GROUP BY 1, 2 UNION ALL SELECT ticker, et_date, 'large', arg_max(ts_ns, (price, -ts_ns)), 0 FROM trades WHERE size > 50 GROUP BY 1, 2),
e AS (SELECT ticker, et_date, abs(max(p_at) FILTER (WHERE v = 'all') - max(p_at) FILTER (WHERE v = 'large')) AS moved, max(decay) FILTER (WHERE v = 'all') AS decay FROM u GROUP BY 1, 2)
SELECT ticker, count(*) AS n, avg((moved > decay)::INT) AS moved_share FROM e WHERE moved IS NOT NULL GROUP BY 1
""")
def _(v):
    one = lambda rows, name, decay: rows.groupBy(*DAY).agg(F.max_by("ts_ns", F.struct(F.col("price"), -F.col("ts_ns"))).alias("at"), decay.alias("decay")).withColumn("v", F.lit(name))
    rows = one(v.trades, "all", 3_600_000_000_000 * (1 + F.count(F.lit(1)) % 3)).unionByName(one(v.trades.filter("size > 50"), "large", F.lit(0).cast("long")))
    return h.moved_share(rows, ["ticker"], "v", "at", "decay", "all", "large", ["et_date"])


@query("h22_near_cutoff", """
, s AS (SELECT ticker, count(*) AS k, CASE WHEN count(*) < 12 THEN 'too_few' ELSE 'ok' END AS status, CASE WHEN count(*) < 12 THEN 'prints' WHEN max(price) < 50 THEN 'price' ELSE 'none' END AS reason FROM trades GROUP BY ticker, et_date),
o AS (SELECT ticker, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'ok' AND k >= 15 AND k < 18) AS n_near, avg((k >= 15 AND k < 18)::INT) FILTER (WHERE status = 'ok') AS near_share FROM s GROUP BY 1),
p AS (SELECT ticker, status, reason, count(*) AS n, count(*) FILTER (WHERE abs(k - 15) <= 3) AS n_within, avg((abs(k - 15) <= 3)::INT) AS within_share FROM s GROUP BY 1, 2, 3)
SELECT p.*, n_ok, n_near, near_share FROM p JOIN o ON p.ticker IS NOT DISTINCT FROM o.ticker
""")
def _(v):
    few = F.count(F.lit(1)) < 12
    rows = v.trades.groupBy(*DAY).agg(F.count(F.lit(1)).alias("k"), F.when(few, "too_few").otherwise("ok").alias("status"), F.when(few, "prints").when(F.max("price") < 50, "price").otherwise("none").alias("reason"))
    return h.near_cutoff_parts(rows, ["ticker"], "status", "reason", "k", 15, 3)


@query("h22_status_counts", """
, s AS (SELECT ticker, CASE WHEN count(*) < 15 THEN 'too_few' ELSE 'ok' END AS status, CASE WHEN count(*) < 15 THEN 'prints' WHEN max(price) < 50 THEN 'price' ELSE 'none' END AS reason FROM trades GROUP BY ticker, et_date)
SELECT ticker, status, reason, count(*) AS n FROM s GROUP BY 1, 2, 3
""")
def _(v):
    few = F.count(F.lit(1)) < 15
    rows = v.trades.groupBy(*DAY).agg(F.when(few, "too_few").otherwise("ok").alias("status"), F.when(few, "prints").when(F.max("price") < 50, "price").otherwise("none").alias("reason"))
    return h.status_counts(rows, ["ticker"], "status", "reason")


SAMPLE = MARKS + """
, q AS (SELECT *, row_number() OVER (ORDER BY markout, ticker, event_date) AS r, count(*) OVER () AS n FROM marks WHERE markout IS NOT NULL),
g AS (SELECT *, (CASE WHEN r <= (n % 10) * (n // 10 + 1) THEN ceil(r / (n // 10 + 1)) ELSE n % 10 + ceil((r - (n % 10) * (n // 10 + 1)) / (n // 10)) END)::INTEGER AS grp, md5('7|' || ticker || '|' || event_date) AS h FROM q),
deciles AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY h, ticker, event_date) <= 5)
"""


def deciles(v):
    return i.decile_sample(marks(v), "markout", KEYS, 10, 5, 7)


@query("i1_decile_sample", SAMPLE + 'SELECT ticker, event_date, grp AS "group" FROM deciles')
def _(v):
    return deciles(v).select(*KEYS, "group")


@query("i1_edge_sample", MARKS + """
, g AS (SELECT *, CASE WHEN markout <= -1 THEN 1 WHEN markout <= 0 THEN 2 WHEN markout <= 1 THEN 3 ELSE 4 END AS grp FROM marks WHERE markout IS NOT NULL)
SELECT ticker, event_date, grp AS "group" FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('7|' || ticker || '|' || event_date), ticker, event_date) <= 5
""")
def _(v):
    return i.edge_sample(marks(v), "markout", KEYS, [-1, 0, 1], 5, 7).select(*KEYS, "group")


@query("i2_topped_up_draw", MARKS + """
, f AS (SELECT ticker, event_date, era, md5('8|' || ticker || '|' || event_date) AS h FROM marks), r AS (SELECT *, row_number() OVER (PARTITION BY era, ticker ORDER BY h, event_date) = 1 AS first FROM f)
SELECT ticker, event_date, era FROM r ORDER BY first DESC, h, ticker, event_date LIMIT 40
""")
def _(v):
    return i.topped_up_draw(marks(v), ["era", "ticker"], KEYS, 40, 8).select(*KEYS, "era")


@query("i2_frequent_pattern_draw", MARKS + """
, f AS (SELECT ticker, event_date, era || '-' || flag AS pattern, md5('8|' || ticker || '|' || event_date) AS h FROM marks), c AS (SELECT pattern, count(*) AS frequency FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT ticker, event_date, pattern, frequency FROM f JOIN c USING (pattern) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY h, ticker, event_date) = 1
""")
def _(v):
    rows = marks(v).withColumn("pattern", F.concat_ws("-", "era", F.col("flag").cast("string")))
    return i.frequent_pattern_draw(rows, "pattern", KEYS, 3, 8).select(*KEYS, "pattern", "frequency")


@query("i2_complement_draw", SAMPLE + """
SELECT ticker, event_date, era FROM marks m WHERE NOT EXISTS (SELECT 1 FROM deciles d WHERE d.ticker = m.ticker AND d.event_date = m.event_date)
QUALIFY row_number() OVER (PARTITION BY era ORDER BY md5('8|' || ticker || '|' || event_date), ticker, event_date) <= 12
""")
def _(v):
    return i.complement_draw(marks(v), deciles(v), KEYS, ["era"], 12, 8).select(*KEYS, "era")


@query("i3_sample_overlap", SAMPLE + """
, r AS (SELECT ticker, event_date FROM marks WHERE markout > 0 ORDER BY md5('9|' || ticker || '|' || event_date), ticker, event_date LIMIT 40)
SELECT coalesce(d.ticker, r.ticker) AS ticker, coalesce(d.event_date, r.event_date) AS event_date, CASE WHEN d.ticker IS NULL THEN 'only_b' WHEN r.ticker IS NULL THEN 'only_a' ELSE 'both' END AS side
FROM deciles d FULL JOIN r ON d.ticker = r.ticker AND d.event_date = r.event_date
""")
def _(v):
    return i.sample_overlap(deciles(v), i.random_sample(marks(v), F.col("markout") > 0, KEYS, 40, 9), KEYS)


@query("i4_random_sample", MARKS + "SELECT ticker, event_date FROM marks WHERE markout > 0 ORDER BY md5('9|' || ticker || '|' || event_date), ticker, event_date LIMIT 40")
def _(v):
    return i.random_sample(marks(v), F.col("markout") > 0, KEYS, 40, 9).select(*KEYS)


@query("i5_quantile_line")
def _(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return i.above_line(rows, "l_quantity", "l_extendedprice", i.quantile_line(rows, "l_quantity", "l_extendedprice", 0.9))


def boot(name, unit, seed):
    """Bounds under as many draws of units as there are; the fixture's units make one range."""
    return f"""
, {name}n AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT {unit} AS unit FROM marks WHERE markout IS NOT NULL)),
{name}d AS (SELECT rep, ('0x' || substr(md5('{seed}|' || rep || ',0,' || j), 1, 12))::BIGINT % t AS i FROM (SELECT rep, t, unnest(range(t)) AS j FROM (SELECT DISTINCT t FROM {name}n) CROSS JOIN (SELECT unnest(range(50)) AS rep))),
{name}p AS (SELECT rep, quantile_cont(markout, 0.5) AS m FROM {name}d JOIN {name}n n USING (i) JOIN marks ON {unit} = n.unit AND markout IS NOT NULL GROUP BY 1),
{name} AS (SELECT (SELECT quantile_cont(markout, 0.5) FROM marks) AS point, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {name}p)
"""


ROW = "ticker || '|' || event_date"


@query("i6_block_bootstrap_median", MARKS + boot("block", "ticker", 11) + "SELECT * FROM block")
def _(v):
    return i.block_bootstrap_median(marks(v), "markout", "ticker", 50, 11)


@query("i7_naive_bootstrap_median", MARKS + boot("naive", ROW, 11) + "SELECT * FROM naive")
def _(v):
    return i.naive_bootstrap_median(marks(v), "markout", KEYS, 50, 11)


@query("i7_width_ratio", MARKS + boot("block", "ticker", 11) + boot("naive", ROW, 11) + "SELECT b.high - b.low AS block_width, n.high - n.low AS naive_width, (b.high - b.low) / nullif(n.high - n.low, 0) AS width_ratio FROM block b CROSS JOIN naive n")
def _(v):
    rows = marks(v)
    return i.width_ratio(i.block_bootstrap_median(rows, "markout", "ticker", 50, 11), i.naive_bootstrap_median(rows, "markout", KEYS, 50, 11))


@query("i8_cluster_medians", MARKS + """
, e AS (SELECT ticker, quantile_cont(markout, 0.5) AS m, count(markout) AS n FROM marks GROUP BY 1 HAVING count(markout) > 0)
SELECT count(*) AS n_units, quantile_cont(m, 0.5) AS median_of_medians, avg((m < 0)::INT) AS negative_share, quantile_cont(n::DOUBLE, 0.5) AS rows_a_unit, max(n) AS most_rows FROM e
""")
def _(v):
    return i.cluster_medians(marks(v), "markout", "ticker")


@query("i9_sign_flip_test", MARKS + """
, m AS (SELECT * FROM marks WHERE markout IS NOT NULL), t AS (SELECT rep, sum(CASE WHEN ('0x' || substr(md5('13|' || rep || ',' || ticker || ',' || event_date), 1, 12))::BIGINT % 2 = 0 THEN markout ELSE -markout END) AS t
  FROM m CROSS JOIN (SELECT unnest(range(100)) AS rep) GROUP BY 1), s AS (SELECT sum(markout) AS total FROM m)
SELECT total, avg((t >= total)::INT) AS p FROM t CROSS JOIN s GROUP BY 1
""")
def _(v):
    return i.sign_flip_test(marks(v), "markout", KEYS, 100, 13)
