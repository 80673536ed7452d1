"""Rates and their fits (H17-H19): broken lines, kernel intensity, rescaled gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def _det(m: list[list[Column]]) -> Column:
    a, b, c = m
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def broken_stick(rungs: DataFrame, keys: list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """The best continuous two-segment line against one line, by BIC; a row a key with enough rungs.

    Every interior rung is tried as the knee: rungs meet knees of their key (a
    ladder has tens), moments are summed and the 3 x 3 system is solved in closed
    form. Ties go to the lower knee.
    """
    w = Window.partitionBy(*keys)
    rows = rungs.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({"i": F.row_number().over(w.orderBy("x", "y")), "n": F.count(F.lit(1)).over(w)}).filter(F.col("n") >= least)
    X, Y = F.col("x"), F.col("y")
    one = rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icept"), F.max("n").alias("n"))
    single = rows.join(one.drop("n"), keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("slope").alias("single_slope"), F.sum(F.pow(Y - F.col("icept") - F.col("slope") * X, F.lit(2))).alias("single_rss"))
    knees = rows.filter((F.col("i") > 2) & (F.col("i") <= F.col("n") - 2)).select(*keys, F.col("x").alias("knee")).distinct()
    H = F.greatest(F.lit(0.0), X - F.col("knee"))
    met = rows.join(knees, keys)
    m = met.groupBy(*keys, "knee").agg(*(F.sum(c).alias(n) for n, c in {"s1": F.lit(1.0), "sx": X, "sh": H, "sxx": X * X, "sxh": X * H, "shh": H * H, "sy": Y, "sxy": X * Y, "shy": H * Y}.items()))
    c = {n: F.col(n) for n in m.columns if n.startswith("s")}
    base = [[c["s1"], c["sx"], c["sh"]], [c["sx"], c["sxx"], c["sxh"]], [c["sh"], c["sxh"], c["shh"]]]
    right = [c["sy"], c["sxy"], c["shy"]]
    swap = lambda k: _det([[right[r] if j == k else base[r][j] for j in range(3)] for r in range(3)])
    whole = F.nullif(_det(base), F.lit(0.0))
    fit = m.select(*keys, "knee", *((swap(k) / whole).alias(n) for k, n in enumerate(("b0", "b1", "b2"))))
    rss = met.join(fit, [*keys, "knee"]).groupBy(*keys, "knee").agg(F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.sum(F.pow(Y - F.col("b0") - F.col("b1") * X - F.col("b2") * H, F.lit(2))).alias("rss"))
    best = rss.filter("rss IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("rss", "knee", "b1", "b2")).alias("b"))
    bic = lambda r, k: F.col("n") * F.log(F.greatest(r, F.lit(1e-300)) / F.col("n")) + k * F.log("n")
    made = single.join(best, keys)
    return made.select(*keys, "n", "single_slope", F.col("b.knee").alias("knee"), F.col("b.b1").alias("slope_before"), (F.col("b.b1") + F.col("b.b2")).alias("slope_after"), (bic(F.col("single_rss"), 2) - bic(F.col("b.rss"), 4)).alias("delta_bic"))


def _kernel(counts: DataFrame, cells: DataFrame, keys: list[str], h_s: float, dx_s: float, truncate: float, least: float) -> DataFrame:
    """(keys, cell, rate): kernel sums of counts over the kernel's mass inside the support.

    ``counts``: (cell, c) of occupied cells only; ``cells``: (cell, support 0/1).
    Each occupied cell reaches 2 * half + 1 cells, whatever the ticks in it.
    """
    half = max(1, int(-(-truncate * h_s // dx_s)))
    weight = F.exp(-0.5 * F.pow(F.col("o") * dx_s / h_s, F.lit(2)))
    reach = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    spread = lambda df, v: df.withColumn("o", reach).groupBy(*keys, (F.col("cell") + F.col("o")).alias("cell")).agg(F.sum(F.col(v) * weight).alias(v))
    total = sum(math.exp(-0.5 * (o * dx_s / h_s) ** 2) for o in range(-half, half + 1))
    num = spread(counts.select(*keys, "cell", F.col("c").cast("double").alias("c")), "c")
    den = spread(cells.filter("support = 1").select(*keys, "cell", F.lit(1.0).alias("m")), "m")
    joined = cells.join(num, [*keys, "cell"], "left").join(den, [*keys, "cell"], "left")
    rate = F.coalesce("c", F.lit(0.0)) / (F.col("m") * dx_s)
    return joined.select(*keys, "cell", "support", F.when(F.coalesce("m", F.lit(0.0)) < least * total, 0.0).otherwise(F.coalesce(rate, F.lit(0.0))).alias("rate"))


def _cells(ticks: DataFrame, bounds: DataFrame, keys: list[str], dx_s: float) -> tuple[DataFrame, DataFrame]:
    rows = ticks.join(bounds, keys).filter((F.col("ts_ns") >= F.col("start_ns")) & (F.col("ts_ns") < F.col("end_ns")))
    age = (F.col("ts_ns") - F.col("start_ns")) / NS
    rows = rows.withColumns({"age": age, "cell": F.floor(age / dx_s)})
    last = F.ceil((F.col("end_ns") - F.col("start_ns")) / NS / dx_s) - 1
    return rows, bounds.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("cell"))


def kernel_intensity(ticks: DataFrame, bounds: DataFrame, keys: list[str], h_s: float, dx_s: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian rate at the points of a uniform grid from the start on, corrected for the kernel's mass outside the grid.

    A tick counts at the point nearest to it: cells are centred at the points.
    """
    rows = ticks.join(bounds, keys).filter((F.col("ts_ns") >= F.col("start_ns")) & (F.col("ts_ns") <= F.col("end_ns")))
    last = F.ceil((F.col("end_ns") - F.col("start_ns")) / NS / dx_s)
    cells = bounds.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("cell"))
    counts = rows.groupBy(*keys, F.floor((F.col("ts_ns") - F.col("start_ns")) / NS / dx_s + 0.5).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    return _kernel(counts, cells.withColumn("support", F.lit(1)), keys, h_s, dx_s, truncate, 0.0).drop("support")


def rescaled_gaps(ticks: DataFrame, bounds: DataFrame, keys: list[str], h_s: float, dx_s: float, block_s: float, floor: float, least: float = 0.05) -> DataFrame:
    """Rate fitted on alternate blocks, integrated at the prints of the others; the gaps'
    mean and largest distance to the unit exponential, by fold (the statistic only)."""
    rows, cells = _cells(ticks, bounds, keys, dx_s)
    fold = F.explode(F.array(F.lit(0), F.lit(1)))
    parity = lambda s: F.pmod(F.floor(s / block_s), F.lit(2))
    by = [*keys, "fold"]
    fit = rows.withColumn("fold", fold).filter(parity(F.col("age")) != F.col("fold")).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("c"))
    both = cells.withColumn("fold", fold).withColumn("support", F.when(parity(F.col("cell") * dx_s) != F.col("fold"), 1).otherwise(0))
    rate = _kernel(fit, both, by, h_s, dx_s, 4.0, least)
    held = rate.withColumn("lam", F.when(F.col("support") == 0, F.greatest("rate", F.lit(float(floor)))).otherwise(0.0))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("cum", F.coalesce(F.sum(F.col("lam") * dx_s).over(before), F.lit(0.0)))
    prints = rows.withColumn("fold", fold).filter(parity(F.col("age")) == F.col("fold")).join(held.select(*by, "cell", "lam", "cum"), [*by, "cell"])
    big = prints.withColumn("big", F.col("cum") + F.col("lam") * (F.col("age") - F.col("cell") * dx_s))
    gaps = big.withColumn("d", F.col("big") - F.lag("big").over(Window.partitionBy(*by).orderBy("big"))).filter("d IS NOT NULL")
    w = Window.partitionBy(*by)
    ranked = gaps.withColumns({"r": F.row_number().over(w.orderBy("d")), "n": F.count(F.lit(1)).over(w), "f": 1 - F.exp(-F.col("d"))})
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.avg("d").alias("mean_gap"), F.max(F.greatest(F.col("r") / F.col("n") - F.col("f"), F.col("f") - (F.col("r") - 1) / F.col("n"))).alias("distance"))
