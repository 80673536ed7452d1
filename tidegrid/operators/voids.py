"""Bursts under a void threshold of log gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import islands

NS = 1_000_000_000


def moving_medians(rows: DataFrame, keys: list[str], value: str, buckets: int = 32) -> DataFrame:
    """(keys, a, m): the median of the window of ``half`` rows on either side of each anchor ``a``.

    ``rows`` has i, n, half, stride and whole (a single window). Anchors lie every ``stride`` rows and at the end. Rows
    are not copied to the windows that hold them: windows are unions of blocks of ``stride`` positions and of fixed parts of
    the blocks at their ends, so counts by (block, part, bucket of values) are what is laid to the windows. Running
    counts name the bucket with the median, and only rows of such buckets meet their windows, to be ranked there.
    """
    i, n, s = F.col("i"), F.col("n"), F.col("stride")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [x / buckets for x in range(1, buckets)], 1000).alias("cuts"))
    placed = rows.join(cuts, keys).withColumns({
        "bucket": F.size(F.filter("cuts", lambda c: c < F.col(value))), "b": F.floor(i / s), "q": F.floor(F.col("half") / s), "last": F.floor((n - 1) / s),
        "right": (i % s) <= F.col("half") % s, "left": (i % s) >= s - F.col("half") % s, "tail": (n - 1 - i <= F.col("half")) & ((n - 1) % s != 0),
    })
    shape = [*keys, "n", "stride", "whole", "q", "last", "b", "right", "left", "tail"]
    first = F.greatest(F.lit(0), F.col("b") - F.col("q") + 1 - F.col("right").cast("int"))
    upto = F.least(F.col("last"), F.col("b") + F.col("q") + F.col("left").cast("int"))
    none = F.array().cast("array<bigint>")
    steps = F.when(first <= upto, F.transform(F.sequence(first, upto), lambda k: k * s)).otherwise(none)
    near = F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.concat(steps, F.when(F.col("tail"), F.array(n - 1)).otherwise(none)))).alias("a")
    counts = placed.groupBy(*shape, "bucket").agg(F.count(F.lit(1)).alias("c")).select(*keys, near, "bucket", "c").groupBy(*keys, "a", "bucket").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "a")  # a row a bucket
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumns({"upto": F.sum("c").over(run), "all": F.sum("c").over(w)}).withColumn("ahead", F.col("upto") - F.col("c"))
    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    wanted = summed.filter((F.col("ahead") <= high) & (F.col("upto") > low)).select(*keys, "a", "bucket", "ahead", low.alias("low"), high.alias("high"))
    some = placed.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi").select(*keys, near, "bucket", F.col(value).alias("v"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy(*keys, "a", "bucket").orderBy("v")) - 1
    met = some.join(wanted, [*keys, "a", "bucket"]).withColumn("place", place)
    return met.filter((F.col("place") == F.col("low")) | (F.col("place") == F.col("high"))).groupBy(*keys, "a").agg(F.avg("v").alias("m"))


def centred_log_gaps(ticks: DataFrame, keys: list[str], fraction: float, per_window: int = 10, floor_s: float = 1e-9) -> DataFrame:
    """log10 of each gap less its centred moving median.

    Medians are taken at anchors, ``per_window`` to a window, and interpolated.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy("ts_ns", "seq")
    gap = (F.col("ts_ns") - F.lag("ts_ns").over(order)) / NS
    rows = ticks.select(*keys, "ts_ns", "seq", gap.alias("gap")).filter("gap IS NOT NULL")
    rows = rows.withColumns({"y": F.log10(F.greatest("gap", F.lit(floor_s))), "i": (F.row_number().over(order) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})
    width = F.greatest(F.lit(11), F.round(F.lit(fraction) * F.col("n")).cast("long").bitwiseOR(F.lit(1).cast("long")))
    rows = rows.withColumn("w", width).withColumns({"half": F.floor(F.col("w") / 2), "stride": F.greatest(F.lit(1), F.floor(F.col("w") / per_window)), "whole": F.col("w") >= F.col("n")})
    med = moving_medians(rows, keys, "y")
    a0 = F.when(F.col("whole"), F.lit(0)).otherwise(F.floor(F.col("i") / F.col("stride")) * F.col("stride"))
    a1 = F.when(F.col("whole"), F.lit(0)).otherwise(F.least(F.col("a0") + F.col("stride"), F.col("n") - 1))
    placed = rows.withColumn("a0", a0).withColumn("a1", a1)
    at = lambda c, m: med.select(*keys, F.col("a").alias(c), F.col("m").alias(m))
    met = placed.join(at("a0", "m0"), [*keys, "a0"]).join(at("a1", "m1"), [*keys, "a1"])
    line = F.when(F.col("a1") == F.col("a0"), F.col("m0")).otherwise(F.col("m0") + (F.col("m1") - F.col("m0")) * (F.col("i") - F.col("a0")) / (F.col("a1") - F.col("a0")))
    return met.select(*keys, "ts_ns", "seq", "gap", (F.col("y") - line).alias("yn"))


def peaks_of(heights: list[float], prominence: float, distance: int) -> list[int]:
    """Local maxima (a flat top counts once, at its middle), the highest kept first within
    ``distance`` bins, of at least a prominence: height over the higher of the two lowest
    points between the peak and the next higher bin, or the end, on each side."""
    found, i, n = [], 1, len(heights)
    while i < n - 1:
        j = i
        while j < n - 1 and heights[j + 1] == heights[i]:
            j += 1
        if heights[i - 1] < heights[i] and j < n - 1 and heights[j + 1] < heights[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-heights[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def base(p: int, way: int) -> float:
        low, k = heights[p], p + way
        while 0 <= k < n and heights[k] <= heights[p]:
            low, k = min(low, heights[k]), k + way
        return low

    return sorted(p for p in kept if heights[p] - max(base(p, -1), base(p, 1)) >= prominence)


def first_trough(counts: list[int], lo: float, width: float, prominence: float, distance: int, cutoff: float) -> tuple[float | None, str]:
    """(threshold, status): the first trough right of the leftmost peak whose void clears the cutoff."""
    total = sum(counts)
    if not total:
        return None, "empty"
    density = [c / total / width for c in counts]
    peaks = peaks_of(density, prominence * max(density), distance)
    if len(peaks) < 2:
        return None, "too_few_peaks"
    left = peaks[0]
    for right in peaks[1:]:
        between = density[left : right + 1]
        t = left + between.index(min(between))
        if 1 - density[t] / math.sqrt(density[left] * density[right]) >= cutoff:
            return lo + (t + 0.5) * width, "ok"
    return None, "no_void"


def thresholds(gaps: DataFrame, keys: list[str], lo: float = -6.0, hi: float = 6.0, width: float = 0.1, prominence: float = 0.05, distance: int = 3, cutoff: float = 0.7) -> DataFrame:
    """(keys, threshold, status) from each key's histogram of centred log gaps.

    The histogram, a fixed number of bins, is the only thing that a key gathers.
    """
    bins = round((hi - lo) / width)
    bin_ = F.floor((F.col("yn") - lo) / width)
    counted = gaps.withColumn("bin", bin_).filter(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    listed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "c"))).alias("h"))

    @F.udf("threshold double, status string")
    def decide(h):  # a key's histogram
        return first_trough([h.get(b, 0) for b in range(bins)], lo, width, prominence, distance, cutoff)

    return listed.withColumn("d", decide("h")).select(*keys, "d.threshold", "d.status")


def log_interval_bursts(ticks: DataFrame, keys: list[str], fraction: float, least: int, **options) -> DataFrame:
    """Maximal runs of gaps under each key's threshold, with at least ``least`` prints.

    Keys without a threshold have no bursts; ``thresholds`` says why.
    """
    gaps = centred_log_gaps(ticks, keys, fraction)
    rows = gaps.join(thresholds(gaps, keys, **options).filter("threshold IS NOT NULL"), keys).withColumn("under", F.col("yn") < F.col("threshold"))
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    runs = islands(rows, keys, ["ts_ns", "seq"], F.coalesce(F.col("under") != F.lag("under").over(w), F.lit(True)))
    start = F.min(F.col("ts_ns") - F.round(F.col("gap") * NS).cast("long"))
    made = runs.filter("under").groupBy(*keys, "run").agg(start.alias("start_ns"), F.max("ts_ns").alias("end_ns"), (F.count(F.lit(1)) + 1).alias("n_prints"))
    return made.filter(F.col("n_prints") >= least).drop("run")
