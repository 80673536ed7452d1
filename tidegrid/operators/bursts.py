"""Intervals, bursts and count statistics (H)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.frames import asof_join, average_ranks, islands, next_known, ratio

NS = 1_000_000_000


def collapse_ties(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """H1: one row a timestamp: summed size and how many prints it holds."""
    return ticks.groupBy(*keys, "ts_ns").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_prints"))


def tie_structure(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """H2: share of prints at the time of the one before, distinct stamps, longest tie, smallest gap between stamps."""
    one = collapse_ties(ticks, keys)
    gap = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy("ts_ns"))
    n, stamps = F.sum("n_prints"), F.count(F.lit(1))
    return one.withColumn("gap", gap).groupBy(*keys).agg(F.coalesce(ratio(n - stamps, n - 1), F.lit(0.0)).alias("tied_share"), F.count(F.lit(1)).alias("n_stamps"), F.max("n_prints").alias("longest_tie"), F.min("gap").alias("min_gap_ns"))


def knn_rate(ticks: DataFrame, keys: list[str], k: int, floor_s: float) -> DataFrame:
    """H3: print and volume rate over the block of k arrivals around each print, clamped at the ends.

    Block ends are found by an equi-join on the row number.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy("ts_ns", "seq")
    rows = ticks.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(w), "cum": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}).filter(F.col("n") >= k)
    rows = rows.withColumn("a", F.least(F.greatest(F.col("i") - k // 2, F.lit(0)), F.col("n") - k)).withColumn("b", F.col("a") + k - 1)
    at = lambda p: rows.select(*keys, F.col("i").alias(p), F.col("ts_ns").alias(f"t_{p}"), F.col("cum").alias(f"c_{p}"), F.col("size").alias(f"s_{p}"))
    met = rows.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"])
    span = F.greatest((F.col("t_b") - F.col("t_a")) / NS, F.lit(float(floor_s)))
    return met.select(*keys, "seq", "ts_ns", (k / span).alias("print_rate"), ((F.col("c_b") - F.col("c_a") + F.col("s_a")) / span).alias("volume_rate"))


def _sustained(order: str, above: Column, start: Column) -> tuple[Column, Column]:
    """(elapsed, never): from the start to the first row that is not above and is followed by none that is; 0 if none is above."""
    last = F.max(F.when(above, F.struct(order, "next")))
    return F.when(last.isNull(), F.lit(0)).otherwise(last["next"] - start), last.isNotNull() & last["next"].isNull()


def sustained_crossing(series: DataFrame, keys: list[str], order: str, value: str, level: str, start: str | None = None) -> DataFrame:
    """H4: how long from the start (a column, or the first row) until the value is at or under the level and stays there.

    0 if it is never above; null, and flagged, if the last row still is.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("next", F.lead(order).over(w))
    rows = rows if start is None else rows.filter(F.col(order) >= F.col(start))
    elapsed, never = _sustained(order, F.col(value) > F.col(level), F.min(order))
    return rows.groupBy(*keys).agg(elapsed.alias("elapsed"), never.alias("never_reached"))


def peak_profile(series: DataFrame, keys: list[str], order: str, value: str, offsets: list[int]) -> DataFrame:
    """H5: the value at fixed offsets after its peak, relative to the peak (as-of, null before data)."""
    peak = series.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("peak_at"), F.col(value).alias("top")), F.struct(F.col(value), -F.col(order))).alias("p")).select(*keys, "p.*")
    each = peak.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("target", F.col("peak_at") + F.col("offset"))
    met = asof_join(each, series.select(*keys, F.col(order).alias("known_at"), F.col(value).alias("known")), keys, "target", "known_at", prefix="")
    return met.select(*keys, "peak_at", "top", "offset", ratio(F.col("known"), F.col("top")).alias("share_of_peak"))


def decay_times(series: DataFrame, keys: list[str], order: str, value: str, fractions: list[float], multiples: list[float] = (), baseline: DataFrame | None = None, origin: DataFrame | None = None) -> DataFrame:
    """H5: time from the peak (the first largest value) until the value stays at or under each fraction of it (``decay_``).

    And, given a ``baseline`` (keys, baseline), until it stays at or under each multiple of it (``terminal_``; null
    without a positive baseline), and, given an ``origin`` (keys, at: a detection), the signed time from it to the peak.
    A level that the last row is still above gives null and ``_never``.
    """
    peak = series.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("peak_at"), F.col(value).alias("top")), F.struct(F.col(value), -F.col(order))).alias("p")).select(*keys, "p.*")
    peak = peak.join(baseline.select(*keys, "baseline"), keys, "left") if baseline is not None else peak.withColumn("baseline", F.lit(None).cast("double"))
    peak = peak.join(origin.select(*keys, "at"), keys, "left") if origin is not None else peak.withColumn("at", F.lit(None).cast("long"))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("next", F.lead(order).over(w)).join(peak, keys).filter(F.col(order) >= F.col("peak_at"))
    at, top, base = F.first("peak_at"), F.first("top"), F.first("baseline")
    made = [at.alias("peak_at"), top.alias("top")]
    for i, f in enumerate(fractions):
        elapsed, never = _sustained(order, F.col(value) > F.lit(float(f)) * F.col("top"), at)
        made += [elapsed.alias(f"decay_{i}"), never.alias(f"decay_{i}_never")]
    for i, m in enumerate(multiples):
        elapsed, never = _sustained(order, F.col(value) > F.lit(float(m)) * F.col("baseline"), at)
        made += [F.when(base > 0, elapsed).alias(f"terminal_{i}"), F.coalesce(F.when(base > 0, never), F.lit(True)).alias(f"terminal_{i}_never")]
    if origin is not None:
        made.append((at - F.first("at")).alias("origin_to_peak"))
    return rows.groupBy(*keys).agg(*made)


def log_grid(least: float, most: float, points: int) -> list[float]:
    """H5: offsets on a symmetric log scale around 0, ``points`` on either side."""
    side = [least * (most / least) ** (i / (points - 1)) for i in range(points)]
    return [*(-x for x in reversed(side)), 0.0, *side]


def profile_around(series: DataFrame, origins: DataFrame, keys: list[str], order: str, value: str, offsets: list[float]) -> DataFrame:
    """H5: the value at offsets around an origin (``at``: a peak or a detection), interpolated between rows, relative to the largest.

    Null outside the series. Rows before and after each point come from two as-of joins, forward and backward.
    """
    top = series.groupBy(*keys).agg(F.max(value).alias("top"))
    each = origins.select(*keys, "at").withColumn("offset", F.explode(F.array(*(F.lit(float(x)) for x in offsets)))).withColumn("target", F.col("at") + F.col("offset"))
    known = series.select(*keys, F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    below = asof_join(each, known, keys, "target", "x", prefix="a_").withColumn("negative", -F.col("target"))
    both = asof_join(below, known.withColumn("negative_x", -F.col("x")), keys, "negative", "negative_x", prefix="b_").join(top, keys)
    line = F.when(F.col("a_x") == F.col("b_x"), F.col("a_y")).otherwise(F.col("a_y") + (F.col("b_y") - F.col("a_y")) * ratio(F.col("target") - F.col("a_x"), F.col("b_x") - F.col("a_x")))
    return both.select(*keys, "at", "offset", ratio(line, F.col("top")).alias("share_of_top"))


def collected_sessions(spine: DataFrame, ticks: DataFrame, keys: list[str], flank: tuple[int, ...] = (-3, -2, -1), ticker: str = "ticker", date: str = "et_date") -> DataFrame:
    """H6, H7: (keys, session_offset, minutes): flanking sessions for which any tick was collected."""
    days = ticks.select(ticker, F.col(date).alias("session_date")).distinct()
    return spine.filter(F.col("session_offset").isin(*flank)).join(days, [ticker, "session_date"], "left_semi").select(*keys, "session_offset", (F.col("post_min") - F.col("pre_min")).alias("minutes"))


def scalar_baseline(bars: DataFrame, collected: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """H6: prints and volume a second over the collected flanking sessions; undefined without any, or without prints."""
    span = collected.groupBy(*keys).agg(F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("n_sessions"))
    total = bars.join(collected.select(*keys, "session_offset"), [*keys, "session_offset"], "left_semi").groupBy(*keys).agg(F.sum("n_trades").alias("n_prints"), F.sum("volume").alias("volume"))
    rows = events.select(*keys).join(span, keys, "left").join(total, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sessions", "n_prints")})
    rate = lambda c: F.when(F.col("n_prints") > 0, F.col(c) / (F.col("minutes") * 60.0))
    return rows.select(*keys, "n_sessions", "n_prints", rate("n_prints").alias("prints_per_s"), rate("volume").alias("volume_per_s"), (F.col("n_prints") == 0).alias("is_undefined"))


def tod_baseline(bars: DataFrame, collected: DataFrame, spine: DataFrame, keys: list[str], half: int, floor: float) -> DataFrame:
    """H7: for every minute of the event's session the prints a minute within +-half minutes of it in the collected flanking sessions.

    Counts over slots (the minutes that these sessions have there), floored; the
    event's label: baseline_undefined without slots, defined where every minute
    has prints, else baseline_partial.
    """
    own = spine.filter("session_offset = 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), (F.col("post_min") - F.col("pre_min") - 1).cast("long"))).alias("minute_index"))
    fine = bars.join(collected.select(*keys, "session_offset"), [*keys, "session_offset"], "left_semi").groupBy(*keys, "minute_index").agg(F.sum("n_trades").alias("n"))
    rows = fine.withColumn("own", F.lit(False)).unionByName(own.withColumns({"n": F.lit(0).cast("long"), "own": F.lit(True)}))
    near = Window.partitionBy(*keys).orderBy("minute_index").rangeBetween(-half, half)
    counted = rows.withColumn("prints", F.sum("n").over(near)).filter("own").drop("n", "own")
    spans = collected.groupBy(*keys).agg(F.collect_list("minutes").alias("spans"))  # as many as there are flanking offsets
    m = F.col("minute_index")
    slot = lambda s: F.greatest(F.lit(0), F.least(s - 1, m + half) - F.greatest(F.lit(0), m - half) + 1)
    made = counted.join(spans, keys, "left").withColumn("slots", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + slot(s)), F.lit(0)))
    w = Window.partitionBy(*keys)
    label = F.when(F.max("slots").over(w) == 0, "baseline_undefined").when(F.min("prints").over(w) > 0, "defined").otherwise("baseline_partial")
    rate = F.when(F.col("slots") > 0, F.col("prints") / F.col("slots"))
    return made.select(*keys, "minute_index", "prints", "slots", rate.alias("rate"), F.greatest(F.coalesce(rate, F.lit(floor)), F.lit(floor)).alias("rate_floored"), label.alias("label"))


def hysteresis_bursts(series: DataFrame, keys: list[str], order: list[str], z: Column, on: float, off: float) -> DataFrame:
    """H8: two-threshold trigger: on at or over ``on``, off under ``off``, held between; it starts off."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(z >= on, 1).when(z < off, 0), ignorenulls=True).over(w)
    return series.withColumn("is_on", F.coalesce(state, F.lit(0)) == 1)


def grid_bursts(ticks: DataFrame, sessions: DataFrame, baseline: DataFrame, keys: list[str], grid_s: int, window_s: int, on: float, off: float, floor: float, merge_s: float, dwell_s: float) -> DataFrame:
    """H8 on a regular grid: bursts where the print rate is a multiple of the baseline of the time of day, as spans of prints.

    ``sessions``: a row an event with start_ns and minutes; ``baseline`` its rate_floored by minute_index (``tod_baseline``).
    Prints within half a window of each grid point come from one sweep over ticks and window edges. The log of
    their rate a minute over the floored baseline turns on at ln(on), off under ln(off); runs of the grid closer than
    ``merge_s`` are merged, then those shorter than ``dwell_s`` dropped, then each is cut to its prints, and
    dropped if it has none.
    """
    least = 1e-9  # added to both rates under the logarithm
    step, half = grid_s * NS, window_s * NS // 2
    points = F.floor((F.col("minutes") * 60 * NS + step - 1) / step)
    grid = sessions.select(*keys, "start_ns", "minutes", F.explode(F.sequence(F.lit(0).cast("long"), points.cast("long"))).alias("g")).withColumn("at_ns", F.col("start_ns") + F.col("g") * step)
    grid = grid.filter(F.col("at_ns") < F.col("start_ns") + F.col("minutes") * 60 * NS + step)
    edges = grid.select(*keys, "g", F.explode(F.array(F.struct((F.col("at_ns") - half).alias("t"), F.lit(-1).alias("sign")), F.struct((F.col("at_ns") + half).alias("t"), F.lit(1).alias("sign")))).alias("e"))
    stacked = edges.select(*keys, "e.t", F.lit(0).alias("print"), "g", "e.sign").unionByName(ticks.select(*keys, F.col("ts_ns").alias("t"), F.lit(1).alias("print"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("int").alias("sign")))
    run = Window.partitionBy(*keys).orderBy("t", "print").rowsBetween(Window.unboundedPreceding, 0)
    counted = stacked.withColumn("n", F.sum("print").over(run)).filter("g IS NOT NULL").groupBy(*keys, "g").agg(F.sum(F.col("n") * F.col("sign")).alias("prints"))
    minute = F.least(F.floor((F.col("at_ns") - F.col("start_ns")) / (60 * NS)), F.col("minutes") - 1)
    rows = grid.withColumn("minute_index", minute.cast("long")).join(counted, [*keys, "g"]).join(baseline.select(*keys, F.col("minute_index").cast("long").alias("minute_index"), "rate_floored"), [*keys, "minute_index"], "left")
    rate, base = F.col("prints") / (window_s / 60.0), F.greatest(F.coalesce("rate_floored", F.lit(float(floor))), F.lit(float(floor)))
    rows = rows.withColumn("z", F.log(rate + least) - F.log(base + least))
    flagged = hysteresis_bursts(rows, keys, ["g"], F.col("z"), math.log(on), math.log(off))
    merged = merge_drop(runs_of(flagged, keys, "is_on", "at_ns", ("g",)), keys, int(merge_s * NS), int(dwell_s * NS))
    numbered = ticks.select(*keys, "ts_ns", "seq", (F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ns", "seq")) - 1).alias("i"))
    inside = asof_join(numbered, merged.select(*keys, "start_ns", "end_ns"), keys, "ts_ns", "start_ns", prefix="grid_").filter(F.col("ts_ns") <= F.col("grid_end_ns"))
    return inside.groupBy(*keys, "grid_start_ns", "grid_end_ns").agg(F.min("i").alias("start_index"), F.max("i").alias("end_index"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("n_prints"))


def runs_of(rows: DataFrame, keys: list[str], flag: str, start: str = "ts_ns", order: tuple[str, ...] = ("ts_ns", "seq")) -> DataFrame:
    """Runs in which a flag holds: first and last place and number of rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    f = F.coalesce(F.col(flag), F.lit(False))
    runs = islands(rows, keys, list(order), F.coalesce(f != F.lag(f).over(w), F.lit(True)))
    return runs.filter(F.col(flag)).groupBy(*keys, "run").agg(F.min(start).alias("start_ns"), F.max(start).alias("end_ns"), F.count(F.lit(1)).alias("n")).drop("run")


def merge_drop(intervals: DataFrame, keys: list[str], gap_ns: int, least_ns: int) -> DataFrame:
    """H9: merge intervals closer than a gap, then drop short ones. Overlaps merge too."""
    reach = F.max("end_ns").over(Window.partitionBy(*keys).orderBy("start_ns", "end_ns").rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(intervals.withColumn("reach", reach), keys, ["start_ns", "end_ns"], F.coalesce(F.col("start_ns") - F.col("reach") >= gap_ns, F.lit(True)))
    made = runs.groupBy(*keys, "run").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("merged"))
    return made.filter(F.col("end_ns") - F.col("start_ns") >= least_ns).drop("run")


def _clamps(add, low, high):
    """Running compositions of steps x -> least(greatest(x + add, low), high), by doubling."""
    import numpy as np

    k = 1
    while k < len(add):
        clip = lambda x, k=k: np.minimum(np.maximum(x[:-k] + add[k:], low[k:]), high[k:])
        made = add[:-k] + add[k:], clip(low), clip(high)
        add, low, high = (np.concatenate([old[:k], new]) for old, new in zip((add, low, high), made, strict=True))
        k *= 2
    return add, low, high


def _steps(batches, n_keys: int, s: float, gamma: float):
    """The fold of every event over its sorted gaps; an event may go on in the next batch.

    A step clamps and adds, and such steps compose, so a batch is a scan of arrays;
    an event's first step doesn't depend on what comes before.
    """
    import numpy as np
    import pyarrow as pa

    held, d = None, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        gap, n, span = (np.asarray(batch.column(n_keys + i)).astype(float) for i in range(3))
        first = np.zeros(batch.num_rows, bool)
        for i in range(n_keys):
            code = np.asarray(batch.column(i).dictionary_encode(null_encoding="encode").indices)
            first[1:] |= code[1:] != code[:-1]
        ends = [tuple(batch.column(i)[row].as_py() for i in range(n_keys)) for row in (0, batch.num_rows - 1)]
        first[0] = ends[0] != held
        tau, shift = gamma * np.log(n), (s - 1) * n / span * gap - np.log(s)
        add, low, high = _clamps(shift, np.where(first, tau + shift, shift), tau + shift)
        out = np.minimum(np.maximum(d + add, low), high)
        held, d = ends[1], float(out[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "d"])


def two_state_bursts(ticks: DataFrame, keys: list[str], s: float, gamma: float, floor_s: float = 1e-9) -> DataFrame:
    """Least-cost two-state path over the gaps (rates n/span and s times it), a row a gap.

    The difference of both states' best costs follows ``d = least(greatest(d', 0),
    tau) + c1 - c0``, a clamp that no window function expresses without a running
    list; it is a scan of arrays, carried over Arrow batches of rows sorted by event
    and time, in constant memory. The path backwards is 0 where d >= tau, 1 where d < 0, else as
    its successor: carried backward.
    """
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    whole = Window.partitionBy(*keys)
    gap = (F.col("ts_ns") - F.lag("ts_ns").over(w)) / NS
    rows = ticks.withColumn("gap", gap).filter("gap IS NOT NULL").withColumn("gap", F.greatest("gap", F.lit(floor_s)))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(whole) + 1, "span": F.sum("gap").over(whole)})
    chosen = rows.select(*keys, "gap", "n", "span", "ts_ns", "seq").repartition(*keys).sortWithinPartitions(*keys, "ts_ns", "seq")
    schema = T.StructType([*chosen.schema.fields, T.StructField("d", T.DoubleType())])
    folded = chosen.mapInArrow(lambda batches: _steps(batches, len(keys), s, gamma), schema)
    fixed = F.when(F.col("d") >= F.lit(gamma) * F.log("n"), 0).when(F.col("d") < 0, 1)
    return folded.withColumn("state", F.coalesce(next_known(fixed, keys, ["ts_ns", "seq"]), F.lit(0))).select(*keys, "ts_ns", "seq", "d", "state")


def burst_runs(path: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of gaps in the upper state: first and last gap's end and their number."""
    return runs_of(path.withColumn("is_burst", F.col("state") == 1), keys, "is_burst")


def sweep_runs(ticks: DataFrame, keys: list[str], gap_ns: int) -> DataFrame:
    """Runs of prints no further apart than a gap: count, mean, size-biased mean, largest."""
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    runs = islands(ticks, keys, ["ts_ns", "seq"], F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(w) > gap_ns, F.lit(True)))
    sizes = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("n").alias("mean"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("size_biased"), F.max("n").alias("largest"))


def session_ends(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each session's prints: number, volume, span, and the move from the first price to the last."""
    order = F.struct("ts_ns", "seq")
    return ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("session_prints"), F.sum("size").alias("session_volume"), (F.max("ts_ns") - F.min("ts_ns")).alias("session_ns"), (F.max_by("price", order) - F.min_by("price", order)).alias("session_move"))


def burst_measures(ticks: DataFrame, keys: list[str], burst: str = "run") -> DataFrame:
    """Duration, prints, volume, move, high, share of the session's move (null if that is 0) and time since the last burst's end.

    Ticks whose burst is null belong to the session alone.
    """
    order = F.struct("ts_ns", "seq")
    made = ticks.filter(F.col(burst).isNotNull()).groupBy(*keys, burst).agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("n_prints"), F.sum("size").alias("volume"), (F.max_by("price", order) - F.min_by("price", order)).alias("move"), F.max("price").alias("high"))
    joined = made.join(session_ends(ticks, keys).select(*keys, "session_move"), keys)
    spacing = F.col("start_ns") - F.lag("end_ns").over(Window.partitionBy(*keys).orderBy("start_ns"))
    return joined.select(*keys, burst, "start_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "n_prints", "volume", "move", "high", ratio(F.col("move"), F.col("session_move")).alias("move_share"), spacing.alias("spacing_ns"))


def burst_coverage(ticks: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    """Per event the bursts and the shares of time, prints and volume inside them; absolute moves added up."""
    inside = measures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bursts"), F.sum("duration_ns").alias("covered_ns"), F.sum("n_prints").alias("prints"), F.sum("volume").alias("volume"), F.sum(F.abs("move")).alias("abs_move"))
    rows = session_ends(ticks, keys).join(inside, keys, "left")
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return rows.select(*keys, F.coalesce("n_bursts", F.lit(0)).alias("n_bursts"), share("covered_ns", "session_ns").alias("time_share"), share("prints", "session_prints").alias("print_share"), share("volume", "session_volume").alias("volume_share"), F.coalesce("abs_move", F.lit(0.0)).alias("abs_move_in_bursts"), "session_move")


def burst_concentration(ticks: DataFrame, keys: list[str], burst: str, marks_s: list[int]) -> DataFrame:
    """Shares of a burst's volume and of its move reached by each mark of seconds from its start, and whether it is still open.

    Bursts without duration or volume have no marks; the move's share is null where the burst does not move.
    """
    w = Window.partitionBy(*keys, burst)
    order = F.struct("ts_ns", "seq")
    rows = ticks.filter(F.col(burst).isNotNull()).withColumn("age", (F.col("ts_ns") - F.min("ts_ns").over(w)) / NS)
    by = lambda m: F.col("age") <= m
    first, last = F.min_by("price", order), F.max_by("price", order)
    marks = [
        F.struct(F.lit(m).alias("seconds"), ratio(F.coalesce(F.sum(F.when(by(m), F.col("size"))), F.lit(0)), F.sum("size")).alias("volume_share"), ratio(F.max_by("price", F.when(by(m), order)) - first, last - first).alias("move_share"), (F.max("age") >= m).alias("is_open"))
        for m in marks_s
    ]
    made = rows.groupBy(*keys, burst).agg(F.array(*marks).alias("marks"), F.max("age").alias("duration"), F.sum("size").alias("volume"))
    return made.filter("duration > 0 AND volume > 0").select(*keys, burst, F.inline("marks"))


def interval_jaccard(a: DataFrame, b: DataFrame, keys: list[str], events: DataFrame | None = None) -> DataFrame:
    """Overlap over union of two sets of disjoint intervals, by a sweep over their ends.

    One union and one sort a key, no interval pairs. Both empty counts as 1; ``events``
    names all keys, so that those without intervals have a row.
    """
    ends = lambda df, side: df.select(*keys, F.col("start_ns").alias("t"), F.lit(1).alias("d"), F.lit(side).alias("s")).unionByName(df.select(*keys, F.col("end_ns").alias("t"), F.lit(-1).alias("d"), F.lit(side).alias("s")))
    rows = ends(a, "a").unionByName(ends(b, "b"))
    points = rows.groupBy(*keys, "t").agg(F.coalesce(F.sum(F.when(F.col("s") == "a", F.col("d"))), F.lit(0)).alias("da"), F.coalesce(F.sum(F.when(F.col("s") == "b", F.col("d"))), F.lit(0)).alias("db"))
    w = Window.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.withColumns({"na": F.sum("da").over(run), "nb": F.sum("db").over(run), "len": F.lead("t").over(w) - F.col("t")})
    length = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0))
    made = swept.groupBy(*keys).agg(length((F.col("na") > 0) & (F.col("nb") > 0)).alias("overlap_ns"), length((F.col("na") > 0) | (F.col("nb") > 0)).alias("union_ns"))
    if events is not None:
        made = events.select(*keys).join(made, keys, "left").fillna(0, ["overlap_ns", "union_ns"])
    return made.withColumn("jaccard", F.coalesce(ratio(F.col("overlap_ns"), F.col("union_ns")), F.lit(1.0)))


def allan_fano(ticks: DataFrame, keys: list[str], bounds: DataFrame, ladder_s: list[float]) -> DataFrame:
    """Allan and Fano factors at each window length, from occupied windows only.

    Sums of squares and of neighbouring products are the same over all windows
    as over occupied ones, so empty windows are never made.
    """
    rows = ticks.join(bounds, keys).withColumn("T", F.explode(F.array(*(F.lit(float(t)) for t in ladder_s))))
    rows = rows.withColumns({"n_windows": F.floor((F.col("end_ns") - F.col("start_ns")) / NS / F.col("T")), "b": F.floor((F.col("ts_ns") - F.col("start_ns")) / NS / F.col("T"))})
    kept = rows.filter((F.col("n_windows") >= 2) & (F.col("b") >= 0) & (F.col("b") < F.col("n_windows")))
    bins = kept.groupBy(*keys, "T", "n_windows", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    w = Window.partitionBy(*keys, "T").orderBy("b")
    near = F.when(F.lag("b").over(w) == F.col("b") - 1, F.lag("c").over(w))
    made = bins.withColumn("p", F.coalesce(F.col("c") * near, F.lit(0.0))).groupBy(*keys, "T", "n_windows").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum("p").alias("p"), F.coalesce(F.max(F.when(F.col("b") == 0, F.col("c"))), F.lit(0.0)).alias("first"),
        F.coalesce(F.max(F.when(F.col("b") == F.col("n_windows") - 1, F.col("c"))), F.lit(0.0)).alias("last"),
    )
    mean = F.col("n") / F.col("n_windows")
    ssd = 2 * F.col("s2") - F.col("first") ** 2 - F.col("last") ** 2 - 2 * F.col("p")
    return made.select(*keys, "T", "n_windows", mean.alias("mean_count"), (ssd / (F.col("n_windows") - 1) / (2 * mean)).alias("allan"), ((F.col("s2") / F.col("n_windows") - mean * mean) / mean).alias("fano"))


def count_dependence(rows: DataFrame, x: str, y: str, by: list[str], least: tuple[int, int] = (3, 5)) -> DataFrame:
    """Rank correlation (average ranks) of all pairs without nulls, and log-log slope of y on x over the positive ones, within groups.

    Null with fewer pairs than ``least``, of either kind; not a number where one side (the slope: x) never changes.
    """
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(pairs, by, "_x", "_rx"), by, "_y", "_ry")
    fine = (F.col("_x") > 0) & (F.col("_y") > 0)
    n_fine = F.count(F.when(fine, 1))
    nan = F.lit(float("nan"))
    c = ratio(F.covar_pop("_rx", "_ry"), F.sqrt(F.var_pop("_rx") * F.var_pop("_ry")))  # ``corr`` raises where a side never changes
    made = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n_fine.alias("n_positive"), F.coalesce(c, nan).alias("c"), F.coalesce(F.regr_slope(F.when(fine, F.log("_y")), F.when(fine, F.log("_x"))), nan).alias("s"))
    return made.select(*by, "n", "n_positive", F.when(F.col("n") >= least[0], F.col("c")).alias("rank_correlation"), F.when(F.col("n_positive") >= least[1], F.col("s")).alias("slope"))


def variant_stability(rows: DataFrame, keys: list[str], variant: str, value: str, a: str, b: str, tolerance: float) -> DataFrame:
    """Spread of a measure over settings and absolute log ratio of two of them against a tolerance."""
    of = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    made = rows.groupBy(*keys).agg(ratio(F.max(value), F.min(value)).alias("spread"), F.abs(F.log(of(a) / F.nullif(of(b), F.lit(0)))).alias("log_ratio"))
    return made.withColumn("is_stable", F.coalesce(F.col("log_ratio") <= tolerance, F.lit(False)))


def moved_share(rows: DataFrame, by: list[str], variant: str, at: str, decay: str, a: str, b: str, event: list[str]) -> DataFrame:
    """Of events with both variants, the share whose peak lies further apart than variant ``a``'s decay."""
    of = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    each = rows.groupBy(*by, *event).agg(F.abs(of(a, at) - of(b, at)).alias("moved"), of(a, decay).alias("decay"))
    kept = each.filter("moved IS NOT NULL AND decay IS NOT NULL")
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("moved") > F.col("decay")).cast("double")).alias("moved_share"))


def _cutoff_counts(rows: DataFrame, by: list[str], status: str, value: str, cutoff: float, margin: float, fine: str) -> DataFrame:
    known = (F.col(status) == fine) & F.col(value).isNotNull()
    above = known & (F.col(value) >= cutoff) & (F.col(value) < cutoff + margin)
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(F.abs(F.col(value) - cutoff) <= margin).alias("n_within"), count(known).alias("n_ok"), count(above).alias("n_near"))


def near_cutoff(rows: DataFrame, by: list[str], status: str, value: str, cutoff: float, margin: float, fine: str = "ok") -> DataFrame:
    """Of the events whose status is fine and value defined, how many lie just above the cutoff: from it to less than ``margin`` over it.

    A group without such events stays; its share is null.
    """
    made = _cutoff_counts(rows, by, status, value, cutoff, margin, fine)
    return made.select(*by, F.col("n_ok").alias("n"), "n_near", ratio(F.col("n_near"), F.col("n_ok")).alias("near_share"))


def near_cutoff_parts(rows: DataFrame, by: list[str], status: str, reason: str, value: str, cutoff: float, margin: float, fine: str = "ok") -> DataFrame:
    """All events by status and reason, and how many lie within ``margin`` of the cutoff on either side; beside them the group's ``near_cutoff``."""
    made = _cutoff_counts(rows, [*by, status, reason], status, value, cutoff, margin, fine)
    whole = lambda c: F.sum(c).over(Window.partitionBy(*by))
    made = made.withColumns({"within_share": ratio(F.col("n_within"), F.col("n")), "n_ok": whole("n_ok"), "n_near": whole("n_near")})
    return made.withColumn("near_share", ratio(F.col("n_near"), F.col("n_ok")))


def status_counts(rows: DataFrame, by: list[str], status: str, reason: str) -> DataFrame:
    """Events by status and reason."""
    return rows.groupBy(*by, status, reason).agg(F.count(F.lit(1)).alias("n"))


def status_shares(rows: DataFrame, status: str, by: list[str]) -> DataFrame:
    """Share of events in each status of a group."""
    n = rows.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


