"""Minute bars, dense grids and concentration (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import QUARTILES, describe, first_when, next_known, ratio
from tidegrid.operators.calendar import segment_of

SEGMENTS = ("premarket", "rth", "post")


def built_bars(trades: DataFrame, spine: DataFrame, keys: list[str], distinct: dict[str, list[str]] | None = None) -> DataFrame:
    """D1, D2 and D4 in one pass: bars of every minute with a print of the sessions that events expect, inside their segments or not.

    Trades become rows a (ticker, date, minute) before they meet the sessions of up to seven
    events, so that minutes are multiplied, not ticks. ``distinct`` maps names to columns whose
    distinct values each bar keeps a mergeable sketch of.
    """
    order = F.struct("ts_ns", "seq")
    made = trades.groupBy(F.col("ticker").alias("_ticker"), F.col("et_date").alias("_date"), "et_min").agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"),
        *(F.hll_sketch_agg(F.xxhash64(*cols)).alias(n) for n, cols in (distinct or {}).items()),
    )
    rows = made.join(spine, (F.col("_ticker") == spine["ticker"]) & (F.col("_date") == spine["session_date"]))
    rows = rows.withColumn("segment", segment_of(F.col("et_min"), F.col("pre_min"), F.col("open_min"), F.col("close_min"), F.col("post_min")))
    own = ["n_trades", "volume", "notional", "high", "low", "first_price", "last_price", "first_ts", "last_ts"]
    return rows.select(*keys, "session_offset", "segment", (F.col("et_min") - F.col("pre_min")).alias("minute_index"), *own, ratio(F.col("notional"), F.col("volume")).alias("vwap"), *(distinct or {}))


def minute_bars(trades: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Bars by event, offset, segment and minute, of minutes with a print."""
    return built_bars(trades, spine, keys).filter(F.col("segment").isin(*SEGMENTS))


def excluded_share(built: DataFrame, keys: list[str]) -> DataFrame:
    """From ``built_bars``, rows inside and outside the segments, and the outside share."""
    inside = F.col("segment").isin(*SEGMENTS)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_trades"))), F.lit(0))
    made = built.groupBy(*keys).agg(n(inside).alias("n_inside"), n(~inside).alias("n_outside"))
    return made.withColumn("outside_share", F.col("n_outside") / (F.col("n_inside") + F.col("n_outside")))


def dup_prints_of_bars(built: DataFrame, by: list[str], strict: str = "strict", loose: str = "loose") -> DataFrame:
    """D4 from the sketches of ``built_bars``, however many builds they come from: rows less approximate distinct keys, not under 0."""
    beyond = lambda c: F.greatest(F.lit(0), F.sum("n_trades") - F.hll_sketch_estimate(F.hll_union_agg(c)))
    return built.groupBy(*by).agg(F.sum("n_trades").alias("n"), beyond(strict).alias("dup_strict"), beyond(loose).alias("dup_loose"))


def verify_bars(bars: DataFrame, keys: list[str], last_minute: int = 960) -> DataFrame:
    """D3: one row: duplicate keys, minutes out of range, unknown labels (all 0 for sound bars)."""
    one = bars.groupBy(*keys, "session_offset", "minute_index").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("segment"))
    return one.agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"), F.count(F.when(~F.col("minute_index").between(0, last_minute - 1), 1)).alias("out_of_range"),
        F.count(F.when(~F.col("segment").isin(*SEGMENTS), 1)).alias("bad_labels"),
    )


def dup_prints_approx(trades: DataFrame, by: list[str], strict: list[str], loose: list[str], rsd: float = 0.01) -> DataFrame:
    """Rows less approximate distinct keys, strict and loose, not under 0."""
    beyond = lambda cols: F.greatest(F.lit(0), F.count(F.lit(1)) - F.approx_count_distinct(F.xxhash64(*cols), rsd))
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), beyond(strict).alias("dup_strict"), beyond(loose).alias("dup_loose"))


def dup_prints_exact(trades: DataFrame, by: list[str], strict: list[str], loose: list[str]) -> DataFrame:
    """Rows beyond the first of each key, strict and loose; two levels, no distinct sets."""
    fine = trades.groupBy(*dict.fromkeys([*by, *loose, *strict])).agg(F.count(F.lit(1)).alias("c"))
    mid = fine.groupBy(*dict.fromkeys([*by, *loose])).agg(F.sum("c").alias("c"), F.sum(F.col("c") - 1).alias("s"))
    return mid.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("s").alias("dup_strict"), F.sum(F.col("c") - 1).alias("dup_loose"))


def row_cap_scan(counts: DataFrame, n: str = "n", least: int = 3, step: int = 50_000) -> DataFrame:
    """Counts that many events share, or that are round numbers: signs of a row cap."""
    made = counts.groupBy(n).agg(F.count(F.lit(1)).alias("events")).withColumn("is_round", F.col(n) % step == 0)
    return made.filter((F.col("events") >= least) | F.col("is_round"))


def dense_grid(bars: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Every minute start..stop-1 of each event; volume 0 and prices null where no bar is."""
    grid = bounds.select(*keys, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("minute_index"))
    return grid.join(bars.select(*keys, "minute_index", "volume", "first_price", "last_price"), [*keys, "minute_index"], "left").withColumn("volume", F.coalesce("volume", F.lit(0)))


def forward_fill(grid: DataFrame, keys: list[str], value: str = "last_price", order: str = "minute_index") -> DataFrame:
    """The last known value so far, as ``filled``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def concentration_curve(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative shares of volume and of absolute log path against the share of minutes.

    Returns across empty minutes count 0: only a minute with a print right after
    one with a print moves.
    """
    w = Window.partitionBy(*keys)
    run = w.orderBy("minute_index").rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("last_price").over(w.orderBy("minute_index"))
    step = F.coalesce(F.abs(F.log(ratio(F.col("last_price"), before))), F.lit(0.0))
    rows = grid.withColumn("step", step)
    share = lambda c: ratio(F.sum(c).over(run), F.sum(c).over(w))
    return rows.select(*keys, "minute_index", (F.row_number().over(w.orderBy("minute_index")) / F.count(F.lit(1)).over(w)).alias("time_share"), share("volume").alias("volume_share"), share("step").alias("path_share"))


def min_window_minutes(grid: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """The shortest run of minutes that holds a share of the volume; without volume all of the minutes.

    For each start the first end whose prefix sum reaches the target: starts and
    ends are stacked on the prefix axis and the next end is carried backward, one
    sort a key instead of a search a start.
    """
    w = Window.partitionBy(*keys)
    run = w.orderBy("minute_index").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.withColumns({"cum": F.sum("volume").over(run), "total": F.sum("volume").over(w)})
    ends = sums.select(*keys, F.col("cum").cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("start"), F.col("minute_index").cast("long").alias("end"), "total")
    starts = sums.select(*keys, (F.col("cum") - F.col("volume") + F.lit(fraction) * F.col("total")).alias("at"), F.lit(0).alias("side"), F.col("minute_index").cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "total")
    met = starts.unionByName(ends).withColumn("end", next_known(F.col("end"), keys, ["at", "side", "end"])).filter("start IS NOT NULL")
    return met.groupBy(*keys).agg(F.when(F.max("total") > 0, F.min(F.col("end") - F.col("start") + 1)).otherwise(F.count(F.lit(1))).alias("minutes"))


def opportunity_decay(grid: DataFrame, keys: list[str], least_minute: int | None = None) -> DataFrame:
    """Absolute log move since the start over that to the last price, by minute.

    The form from the open: the start is the first row's first price (if it has none, the first price known); before any print the
    move is 0. A zero denominator is flagged and its fractions are null. ``least_minute`` leaves out earlier minutes.
    """
    w = Window.partitionBy(*keys).orderBy("minute_index")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.last("last_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.first("first_price").over(whole), F.first("last_price", ignorenulls=True).over(whole))
    kept = grid if least_minute is None else grid.filter(F.col("minute_index") >= least_minute)
    rows = kept.withColumns({"now": filled, "start": start, "stop": F.last("last_price", ignorenulls=True).over(whole)})
    move = lambda to: F.abs(F.log(ratio(to, F.col("start"))))
    return rows.select(*keys, "minute_index", ratio(F.coalesce(move(F.col("now")), F.lit(0.0)), move(F.col("stop"))).alias("realized"), (F.coalesce(F.col("stop") == F.col("start"), F.lit(True))).alias("is_undefined"))


def anchored_decay(grid: DataFrame, keys: list[str], anchor: str, high: str) -> DataFrame:
    """D11, primary form: signed log move from an anchor price over that from the anchor to the day's high, by minute.

    Null unless the anchor is positive and the high above it; before any print the move is 0. Below the anchor
    the fraction is negative.
    """
    run = Window.partitionBy(*keys).orderBy("minute_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("now", F.last("last_price", ignorenulls=True).over(run))
    start = F.when(F.col(anchor) > 0, F.col(anchor))
    way = F.log(ratio(F.col(high), start))
    move = F.coalesce(F.log(ratio(F.col("now"), start)), F.lit(0.0))
    fine = F.coalesce(way > 0, F.lit(False))
    return rows.select(*keys, "minute_index", F.when(fine, move / way).alias("realized"), (~fine).alias("is_undefined"))


def half_life(decay: DataFrame, keys: list[str], level: float = 0.5) -> DataFrame:
    """The first minute at which the realised fraction reaches a level."""
    return decay.groupBy(*keys).agg(first_when(F.col("realized") >= level, F.col("minute_index")).alias("minute_at_level"), F.max("is_undefined").alias("is_undefined"))


def pooled_minute_quantiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Quartiles of a value by minute over events, optionally split by a flag."""
    return describe(rows, [*(by or []), "minute_index"], {value: QUARTILES}, n=F.count(value))


def pooled_crossing(pooled: DataFrame, level: float = 0.5) -> DataFrame:
    """The first minute at which the pooled median reaches a level, null if never."""
    return pooled.agg(first_when(F.col("median") >= level, F.col("minute_index")).alias("minute_at_level"))


def segment_shares(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Each segment's share of the volume; 0 where it has none, null where the event has none."""
    of = lambda s: ratio(F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("volume"))), F.lit(0)), F.sum("volume"))
    return bars.groupBy(*keys).agg(*(of(s).alias(f"{s}_share") for s in SEGMENTS))


def anchor_close(bars: DataFrame, keys: list[str], offset: int = -1) -> DataFrame:
    """The last price up to the regular close of a neighbouring session."""
    rows = bars.filter((F.col("session_offset") == offset) & F.col("segment").isin("premarket", "rth"))
    return rows.groupBy(*keys).agg(F.max_by("last_price", "minute_index").alias("anchor_price"), F.max("minute_index").alias("anchor_minute"))


def high_time_of_day(bars: DataFrame, keys: list[str], pre_min: int = 240) -> DataFrame:
    """The day's high, the first minute that reaches it, as clock text and decimal hour."""
    w = Window.partitionBy(*keys)
    top = bars.withColumn("day_high", F.max("high").over(w)).filter("high = day_high")
    made = top.groupBy(*keys).agg(F.first("day_high").alias("day_high"), F.min("minute_index").alias("high_minute"))
    clock_min = (F.col("high_minute") + pre_min).cast("int")
    return made.withColumns({"high_clock": F.format_string("%02d:%02d", (clock_min / 60).cast("int"), clock_min % 60), "high_hour": F.round(clock_min / 60, 6)})


def realized_at_minute(decay: DataFrame, minutes: DataFrame, keys: list[str]) -> DataFrame:
    """The realised fraction at each event's own (rounded) minute."""
    return minutes.withColumn("minute_index", F.round("minute").cast("long")).join(decay.select(*keys, "minute_index", "realized"), [*keys, "minute_index"], "left")


def reindex_clock(bars: DataFrame, bounds: DataFrame, keys: list[str], segment: str = "rth", pre_min: int = 240) -> DataFrame:
    """Minutes counted from the session's open, of one segment."""
    rows = bars.filter(F.col("segment") == segment).join(bounds.select(*keys, "open_min"), keys)
    return rows.withColumn("minute_index", F.col("minute_index") - (F.col("open_min") - pre_min)).drop("open_min")


def tie_audit(trades: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose first or last timestamp is shared, with the price range among the tied."""
    w = Window.partitionBy(*by)
    rows = trades.withColumns({"a": F.min("ts_ns").over(w), "z": F.max("ts_ns").over(w)})
    at = lambda c: F.col("ts_ns") == F.col(c)
    n = lambda c: F.count(F.when(at(c), 1))
    span = lambda c: F.max(F.when(at(c), F.col("price"))) - F.min(F.when(at(c), F.col("price")))
    return rows.groupBy(*by).agg((n("a") > 1).alias("first_tied"), (n("z") > 1).alias("last_tied"), span("a").alias("first_range"), span("z").alias("last_range"))


def vwap_running(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Volume-weighted price so far; null before the first size."""
    run = Window.partitionBy(*keys).orderBy("minute_index").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("vwap_running", ratio(F.sum("notional").over(run), F.sum("volume").over(run)))


def atr_bars(bars: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Mean true range over bars; with fewer than ``least``, the closes' deviation."""
    w = Window.partitionBy(*keys).orderBy("minute_index")
    prior = F.lag("last_price").over(w)
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    rows = bars.withColumn("tr", F.when(prior.isNotNull(), span))
    return rows.groupBy(*keys).agg(F.count("tr").alias("n"), F.when(F.count("tr") >= least, F.avg("tr")).otherwise(F.stddev_pop("last_price")).alias("atr"))
