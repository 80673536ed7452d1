"""Queries of the rate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import bursts, rates, voids
from tidegrid.plans.registry import query

LADDER = [2.0**k * 900 for k in range(10)]


def bounds(v):
    return v.trades.groupBy("ticker").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))


@query("h17_broken_stick", """
, b AS (SELECT ticker, min(ts_ns) AS s, max(ts_ns) AS e FROM trades GROUP BY 1), t AS (SELECT 900.0 * 2 ** unnest(range(10)) AS w),
k AS (SELECT ticker, w, floor((e - s) / 1e9 / w)::BIGINT AS nw, floor((ts_ns - s) / 1e9 / w)::BIGINT AS bin FROM trades JOIN b USING (ticker) CROSS JOIN t),
c AS (SELECT ticker, w, nw, bin, count(*)::DOUBLE AS c FROM k WHERE bin < nw AND nw >= 2 GROUP BY ALL),
f AS (SELECT ticker, log10(w) AS x, log10((sum(c * c) / nw - (sum(c) / nw) ** 2) / (sum(c) / nw)) AS y FROM c GROUP BY ticker, w, nw),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY x) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM f),
o AS (SELECT ticker, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM r GROUP BY 1),
o2 AS (SELECT r.ticker, any_value(n) AS n, any_value(b1) AS single_slope, sum((y - b0 - b1 * x) ** 2) AS rss FROM r JOIN o USING (ticker) GROUP BY 1),
kn AS (SELECT ticker, x AS knee FROM r WHERE i > 2 AND i <= n - 2),
m AS (SELECT r.ticker, knee, x, y, greatest(0, x - knee) AS h FROM r JOIN kn USING (ticker)),
s AS (SELECT ticker, knee, count(*)::DOUBLE AS a, sum(x) AS b, sum(h) AS c, sum(x * x) AS d, sum(x * h) AS e, sum(h * h) AS f, sum(y) AS p, sum(x * y) AS q, sum(h * y) AS r FROM m GROUP BY 1, 2),
z AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
g AS (SELECT ticker, knee, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS b0, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS b1,
  (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS b2 FROM z),
u AS (SELECT m.ticker, m.knee, any_value(b1) AS b1, any_value(b2) AS b2, sum((y - b0 - b1 * x - b2 * h) ** 2) AS rss FROM m JOIN g USING (ticker, knee) GROUP BY 1, 2),
w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rss, knee) = 1)
SELECT ticker, n, single_slope, knee, b1 AS slope_before, b1 + b2 AS slope_after, (n * ln(o2.rss / n) + 2 * ln(n)) - (n * ln(w.rss / n) + 4 * ln(n)) AS delta_bic FROM o2 JOIN w USING (ticker) WHERE n >= 6
""")
def _(v):
    curve = bursts.allan_fano(v.trades, ["ticker"], bounds(v), LADDER).select("ticker", F.log10("T").alias("x"), F.log10("fano").alias("y"))
    return rates.broken_stick(curve, ["ticker"], "x", "y")


@query("h18_kernel_intensity", """
, b AS (SELECT ticker, min(ts_ns) AS s, max(ts_ns) AS e FROM trades GROUP BY 1),
cells AS (SELECT ticker, unnest(range(ceil((e - s) / 1e9 / 7200)::BIGINT + 1)) AS cell FROM b),
c AS (SELECT ticker, floor((ts_ns - s) / 1e9 / 7200 + 0.5)::BIGINT AS cell, count(*) AS c FROM trades JOIN b USING (ticker) GROUP BY 1, 2),
n AS (SELECT x.ticker, x.cell, sum(c * exp(-0.5 * ((x.cell - c.cell) * 7200 / 21600.0) ** 2)) AS num FROM cells x JOIN c ON c.ticker = x.ticker AND abs(c.cell - x.cell) <= 12 GROUP BY 1, 2),
d AS (SELECT x.ticker, x.cell, sum(exp(-0.5 * ((x.cell - y.cell) * 7200 / 21600.0) ** 2)) AS den FROM cells x JOIN cells y ON y.ticker = x.ticker AND abs(y.cell - x.cell) <= 12 GROUP BY 1, 2)
SELECT ticker, cell, coalesce(num, 0) / (den * 7200) AS rate FROM cells LEFT JOIN n USING (ticker, cell) LEFT JOIN d USING (ticker, cell)
""")
def _(v):
    return rates.kernel_intensity(v.trades, bounds(v), ["ticker"], 21_600, 7200)


@query("h19_rescaled_gaps")
def _(v):
    return rates.rescaled_gaps(v.trades, bounds(v), ["ticker"], 21_600, 7200, 86_400, 1e-6)


@query("h11_log_interval_bursts")
def _(v):
    return voids.log_interval_bursts(v.trades, ["ticker"], 0.2, 3, width=0.1, prominence=0.02, distance=1, cutoff=0.05)


@query("h11_thresholds")
def _(v):
    return voids.thresholds(voids.centred_log_gaps(v.trades, ["ticker"], 0.2), ["ticker"], width=0.1, prominence=0.02, distance=1, cutoff=0.05)
