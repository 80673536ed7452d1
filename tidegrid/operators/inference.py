"""Sampling and inference (I). Draws are hashes of a seed and a key, so any engine can repeat them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import describe, global_rank, hash_draw, ratio, stored


def decile_sample(rows: DataFrame, value: str, keys: list[str], groups: int, per: int, seed: int) -> DataFrame:
    """A fixed-seed draw of ``per`` rows from each of the groups, equal in size, that a value's order is cut into; the first ones hold one row more."""
    ranked = global_rank(rows.filter(F.col(value).isNotNull()), [value, *keys])
    size, more = F.floor(F.col("total") / groups), F.col("total") % groups
    long = more * (size + 1)  # rows of the groups with one row more
    group = F.when(F.col("rank") <= long, F.ceil(F.col("rank") / (size + 1))).otherwise(more + F.ceil((F.col("rank") - long) / F.nullif(size, F.lit(0))))
    ranked = ranked.withColumn("group", group.cast("int")).drop("rank", "total")
    w = Window.partitionBy("group").orderBy(hash_draw(seed, *keys), *keys)
    return ranked.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per).drop("n")


def edge_sample(rows: DataFrame, value: str, keys: list[str], edges: list[float], per: int, seed: int) -> DataFrame:
    """A fixed-seed draw of ``per`` rows from each group between ascending edges; a value on an edge belongs below it."""
    group = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col(value))) + 1
    w = Window.partitionBy("group").orderBy(hash_draw(seed, *keys), *keys)
    return rows.filter(F.col(value).isNotNull()).withColumn("group", group).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per).drop("n")


def topped_up_draw(rows: DataFrame, strata: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """One row a stratum, then further rows by the same draw until there are ``n``."""
    draw = hash_draw(seed, *keys)
    first = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, *keys)) == 1
    return rows.withColumns({"_first": first, "_draw": draw}).orderBy(F.desc("_first"), "_draw", *keys).limit(n).drop("_first", "_draw")


def frequent_pattern_draw(rows: DataFrame, pattern: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """One row for each of the ``n`` most frequent patterns, ties by pattern."""
    counts = rows.groupBy(pattern).agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), pattern).limit(n)
    w = Window.partitionBy(pattern).orderBy(hash_draw(seed, *keys), *keys)
    return rows.join(F.broadcast(counts), pattern).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def complement_draw(rows: DataFrame, taken: DataFrame, keys: list[str], strata: list[str], per: int, seed: int) -> DataFrame:
    """A draw of ``per`` rows a stratum from those not taken, independent of row order."""
    w = Window.partitionBy(*strata).orderBy(hash_draw(seed, *keys), *keys)
    return rows.join(taken.select(*keys).distinct(), keys, "left_anti").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per).drop("n")


def sample_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Members of two samples: shared, or of one alone."""
    side = lambda df, c: df.select(*keys).distinct().withColumn(c, F.lit(True))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    return both.withColumn("side", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")).drop("a", "b")


def random_sample(rows: DataFrame, condition: Column, keys: list[str], n: int, seed: int) -> DataFrame:
    """I4: n rows over a floor, without replacement."""
    return rows.filter(condition).orderBy(hash_draw(seed, *keys), *keys).limit(n)


def quantile_line(rows: DataFrame, x: str, y: str, q: float, steps: int = 40, eps: float = 1e-6) -> tuple[float, float]:
    """(intercept, slope) of a linear quantile regression by iterated weighted least squares.

    Each step is one aggregate row of moments; rows stay distributed.
    """
    data = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    a = b = 0.0
    for step in range(steps):
        r = F.col("y") - F.lit(a) - F.lit(b) * F.col("x")
        w = F.lit(1.0) if step == 0 else F.when(r >= 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(eps))
        m = data.withColumn("w", w).agg(*(F.sum(c).alias(n) for n, c in (("s", F.col("w")), ("sx", F.col("w") * F.col("x")), ("sy", F.col("w") * F.col("y")), ("sxx", F.col("w") * F.col("x") ** 2), ("sxy", F.col("w") * F.col("x") * F.col("y"))))).first()
        if not m.s or (det := m.s * m.sxx - m.sx**2) == 0:
            return a, b
        new = ((m.sxx * m.sy - m.sx * m.sxy) / det, (m.s * m.sxy - m.sx * m.sy) / det)
        if max(abs(new[0] - a), abs(new[1] - b)) < 1e-9 and step:
            return new
        a, b = new
    return a, b


def above_line(rows: DataFrame, x: str, y: str, line: tuple[float, float]) -> DataFrame:
    """Each row's fitted value and whether it lies above the line."""
    fitted = F.lit(line[0]) + F.lit(line[1]) * F.col(x)
    return rows.withColumns({"fitted": fitted, "is_above": F.col(y) > fitted})


def _index(seed: int, draw: Column, n: Column) -> Column:
    """A number 0..n-1 from the seed and a draw's name."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw).cast("binary")), 1, 12), 16, 10).cast("long")
    return F.pmod(h, n)


#: Units of a range whose draws are made one by one.
LEAF = 4_096


def _split(seed: int, rep: int, leaf: int, total: int, leaves: int, size: int, known: dict) -> int:
    """Draws that fall to a range of units in a replicate of ``total`` draws, by binomial splits from the whole down to it.

    Each split's generator is keyed by seed, replicate and range, so that every task makes the same splits.
    """
    import numpy as np

    lo, hi, n = 0, leaves, total
    while hi - lo > 1 and n:
        mid = (lo + hi) // 2
        key = (rep, lo, hi)
        if key not in known:
            of = min(hi * size, total) - lo * size
            known[key] = int(np.random.default_rng([seed, rep, lo, hi]).binomial(n, (mid - lo) * size / of))
        left = known[key]
        lo, hi, n = (lo, mid, left) if leaf < mid else (mid, hi, n - left)
    return n


def resample(units: DataFrame, reps: int, seed: int, size: int = LEAF) -> DataFrame:
    """(rep, unit, times): every replicate draws as many units as there are, with replacement.

    Units are numbered by ranges of their order. Binomial splits over ranges of ``size`` units give each
    range its draws - together exactly as many as there are units - and hashes place these in the range.
    """
    import pandas as pd

    numbered = global_rank(units.select("unit"), ["unit"]).withColumns({"leaf": F.floor((F.col("rank") - 1) / size).cast("long"), "i": (F.col("rank") - 1) % size})
    leaves = numbered.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.max("total").alias("total")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for f in frames:
            n = [_split(seed, int(r), int(x), int(t), -(-int(t) // size), size, known) for r, x, t in zip(f["rep"], f["leaf"], f["total"], strict=True)]
            yield f[["rep", "leaf", "size"]].assign(n=n)

    each = leaves.mapInPandas(draws, "rep int, leaf long, size long, n long").filter("n > 0").select("rep", "leaf", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    drawn = each.select("rep", "leaf", _index(seed, F.concat_ws(",", "rep", "leaf", "j"), F.col("size")).alias("i"))
    return drawn.groupBy("rep", "leaf", "i").agg(F.count(F.lit(1)).alias("times")).join(numbered.select("leaf", "i", "unit"), ["leaf", "i"]).select("rep", "unit", "times")


def block_bootstrap_median(rows: DataFrame, value: str, unit: str, reps: int, seed: int, size: int = LEAF) -> DataFrame:
    """Interval of the median under resampling of whole units with replacement; one row: point, low, high.

    Equal values of a unit are counted first; a replicate's rows are those of the units it draws.
    """
    data = rows.filter(F.col(value).isNotNull()).groupBy(F.col(unit).alias("unit"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    each = resample(data.select("unit").distinct(), reps, seed, size).join(data, "unit").withColumn("times", F.col("times") * F.col("n"))
    per = each.groupBy("rep").agg(F.percentile("v", F.lit(0.5), F.col("times")).alias("m"))
    point = data.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("point"))
    ends = per.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return point.join(F.broadcast(ends))


def naive_bootstrap_median(rows: DataFrame, value: str, keys: list[str], reps: int, seed: int) -> DataFrame:
    """The same with the row as the unit."""
    return block_bootstrap_median(rows.withColumn("_unit", F.concat_ws("|", *keys)), value, "_unit", reps, seed)


def width_ratio(block: DataFrame, naive: DataFrame) -> DataFrame:
    """The block interval's width over the naive one's."""
    width = lambda df, n: df.select((F.col("high") - F.col("low")).alias(n))
    return width(block, "block_width").join(F.broadcast(width(naive, "naive_width"))).withColumn("width_ratio", ratio(F.col("block_width"), F.col("naive_width")))


def cluster_medians(rows: DataFrame, value: str, unit: str) -> DataFrame:
    """I8: median of units' medians, share of negative units, and rows a unit."""
    half = (0.5,)
    each = stored(describe(rows, [unit], {value: (half, ("m",))}, n=F.count(value)).filter("n > 0"), "units")
    return describe(each, [], {"m": (half, ("median_of_medians",)), "n": (half, ("rows_a_unit",))}, True, n_units=F.count(F.lit(1)), negative_share=F.avg((F.col("m") < 0).cast("double")), most_rows=F.max("n"))


def sign_flip_test(rows: DataFrame, value: str, keys: list[str], reps: int, seed: int) -> DataFrame:
    """The total against totals under random signs; one row: total and one-tailed p.

    All replicates are sums of one pass: no row is copied by draw.
    """
    data = rows.filter(F.col(value).isNotNull()).select(*keys, value)
    total = data.agg(F.sum(value).alias("total"))
    name = F.concat_ws(",", *(F.col(k).cast("string") for k in keys))
    for lo in range(0, reps, SUMS):
        sign = lambda rep: F.when(_index(seed, F.concat(F.lit(f"{rep},"), name), F.lit(2)) == 0, 1).otherwise(-1)
        sums = data.agg(F.array(*(F.sum(sign(rep) * F.col(value)) for rep in range(lo, min(reps, lo + SUMS)))).alias(f"t{lo}"))
        total = total.join(F.broadcast(sums))  # a row each
    over = lambda lo: F.size(F.filter(f"t{lo}", lambda t: t >= F.col("total")))
    p = sum((over(lo) for lo in range(0, reps, SUMS)), F.lit(0)) / reps
    return total.select("total", F.when(F.col("total").isNotNull(), p).alias("p"))


#: Replicates summed in one pass.
SUMS = 50
