"""Tick features, scanner and targets (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import exact_quantile, next_known, ratio


def gap_scanner(daily: DataFrame, min_gap: float) -> DataFrame:
    """G1: open gap and high move against the prior close, filtered, dense rank per day."""
    prior = F.lag("close").over(Window.partitionBy("ticker").orderBy("day"))
    rows = daily.withColumn("prior_close", prior).withColumns({"gap_pct": 100 * (ratio(F.col("open"), F.col("prior_close")) - 1), "move_pct": 100 * (ratio(F.col("high"), F.col("prior_close")) - 1)})
    kept = rows.filter(F.col("gap_pct") >= min_gap)
    return kept.withColumn("gap_rank", F.dense_rank().over(Window.partitionBy("day").orderBy(F.desc("gap_pct"))))


def opening_volume(bars: DataFrame, keys: list[str], day: str, first: int, last: int, fallback: int = 5) -> DataFrame:
    """Volume in the opening minutes, else of the first bars; rank per day, nulls last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("minute_index"))
    opening = F.sum(F.when(F.col("minute_index").between(first, last), F.col("volume")))
    made = bars.withColumn("n", place).groupBy(*keys).agg(opening.alias("opening"), F.sum(F.when(F.col("n") <= fallback, F.col("volume"))).alias("first_bars"))
    rows = made.withColumns({"volume": F.coalesce("opening", "first_bars"), "is_fallback": F.col("opening").isNull()}).drop("opening", "first_bars")
    return rows.withColumn("volume_rank", F.dense_rank().over(Window.partitionBy(day).orderBy(F.desc_nulls_last("volume"))))


def relative_volume(daily: DataFrame, back: int = 30, least: int = 10) -> DataFrame:
    """Volume over the mean of up to ``back`` prior rows; null with fewer than ``least``."""
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-back, -1)
    return daily.withColumn("rvol", F.when(F.count("volume").over(w) >= least, ratio(F.col("volume"), F.avg("volume").over(w))))


def top_magnitude(events: DataFrame, n: int, least: float, min_rows: int | None = None, rows: str = "n_rows") -> DataFrame:
    """The n largest magnitudes at or above a threshold, ties by key; ``min_rows``: of events with so many ticks at least."""
    kept = events.filter(F.col("magnitude") >= least)
    kept = kept if min_rows is None else kept.filter(F.col(rows) >= min_rows)
    return kept.orderBy(F.desc("magnitude"), "ticker", "event_date").limit(n)


def magnitude_of_name(name: Column) -> Column:
    """The number at the end of a folder name such as ``TICKER_2024-01-05_87.5``, null where there is none."""
    return F.nullif(F.regexp_extract(name, r"_(-?\d+(?:\.\d+)?)$", 1), F.lit("")).cast("double")


def price_normalise(events: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """Reported open over the first regular trade; an outlier where |log10| exceeds 3."""
    first = trades.groupBy(*keys).agg(F.min_by("price", F.struct("ts_ns", "seq")).alias("first_price"))
    rows = events.join(first, keys, "left").withColumn("phi", ratio(F.col("open"), F.col("first_price")))
    return rows.withColumn("is_outlier", F.coalesce(F.abs(F.log10("phi")) > 3, F.lit(True)))


def regime(minute: Column) -> Column:
    """PRE before the open, FLIP for its first quarter hour, STD afterwards."""
    return F.when(minute < 570, "PRE").when(minute < 585, "FLIP").otherwise("STD")


def halts(ticks: DataFrame, keys: list[str], least_ns: int, open_min: int = 570, close_min: int = 960) -> DataFrame:
    """Gaps over a threshold that start in regular hours: count, longest, total, last end."""
    nxt = F.lead("ts_ns").over(Window.partitionBy(*keys).orderBy("ts_ns", "seq"))
    gaps = ticks.withColumn("gap_ns", nxt - F.col("ts_ns")).withColumn("is_halt", (F.col("gap_ns") > least_ns) & (F.col("et_min") >= open_min) & (F.col("et_min") < close_min))
    hit = F.col("is_halt")
    return gaps.groupBy(*keys).agg(F.count(F.when(hit, 1)).alias("n_halts"), F.coalesce(F.max(F.when(hit, F.col("gap_ns"))), F.lit(0)).alias("longest_ns"), F.coalesce(F.sum(F.when(hit, F.col("gap_ns"))), F.lit(0)).alias("total_ns"), F.max(F.when(hit, F.col("ts_ns") + F.col("gap_ns"))).alias("last_resume_ns"))


def halt_ends(ticks: DataFrame, keys: list[str], least_ns: int, open_min: int = 570, close_min: int = 960) -> DataFrame:
    """Ticks with ``resume_ns``: their own time where they end a halt (see ``halts``)."""
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    old = F.lag("et_min").over(w)
    halted = (F.col("ts_ns") - F.lag("ts_ns").over(w) > least_ns) & (old >= open_min) & (old < close_min)
    return ticks.withColumn("resume_ns", F.when(halted, F.col("ts_ns")))


def since_halt(ticks: DataFrame, keys: list[str], least_ns: int, first_min: int, end_min: int) -> DataFrame:
    """Seconds from the end of the last halt before a window to the window's first tick; null without either."""
    rows = halt_ends(ticks, keys, least_ns)
    start = F.min(F.when(F.col("et_min").between(first_min, end_min - 1), F.col("ts_ns"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("start_ns", start)
    last = F.max(F.when(F.col("resume_ns") < F.col("start_ns"), F.col("resume_ns")))
    return rows.groupBy(*keys).agg(((F.max("start_ns") - last) / 1e9).alias("seconds_since_halt"))


def hawkes_intensity(ticks: DataFrame, keys: list[str], alpha: float, beta: float, freeze_s: float) -> DataFrame:
    """Self-exciting intensity with decay frozen across gaps over ``freeze_s``, and its step.

    With active time tau (frozen gaps add nothing) the state is the sum over
    earlier ticks, the first not counted, of exp(-beta (tau_i - tau_j)). Tau is cut
    into blocks of 20 / beta: sums inside a block stay in double range, and two
    blocks back contribute e^-20, three less than a double resolves. A key with a
    single tick has no intensity: 0.
    """
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    before = F.lag("ts_ns").over(w)
    gap = F.when(before.isNotNull(), F.greatest((F.col("ts_ns") - before) / 1e9, F.lit(1e-9)))
    rows = ticks.withColumn("gap_s", gap).withColumns({"active": F.col("gap_s") <= freeze_s, "n": F.row_number().over(w)})
    rows = rows.withColumn("tau", F.sum(F.when(F.col("active"), F.col("gap_s")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = 20.0 / beta
    rows = rows.withColumn("block", F.floor(F.col("tau") / size)).withColumn("inside", F.col("tau") - F.col("block") * size)
    counted = F.when(F.col("n") > 1, 1.0).otherwise(0.0)
    inner = Window.partitionBy(*keys, "block").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("local", F.sum(counted * F.exp(F.lit(beta) * F.col("inside"))).over(inner) * F.exp(F.lit(-beta) * F.col("inside")))
    ends = rows.groupBy(*keys, "block").agg(F.sum(counted * F.exp(F.lit(beta) * (F.col("inside") - size))).alias("left"))
    carried = ends.withColumn("back", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(*keys, (F.col("block") + F.col("back")).alias("block"), (F.col("left") * F.exp(-20.0 * (F.col("back") - 1))).alias("part"))
    carried = carried.groupBy(*keys, "block").agg(F.sum("part").alias("carry"))
    base = rows.groupBy(*keys).agg(((F.count(F.when(F.col("active"), 1)) + 1) / F.greatest(F.coalesce(F.sum(F.when(F.col("active"), F.col("gap_s"))), F.lit(1e-6)), F.lit(1e-6))).alias("mu"), F.count(F.lit(1)).alias("total"))
    joined = rows.join(carried, [*keys, "block"], "left").join(base, keys)
    state = F.col("local") + F.coalesce("carry", F.lit(0.0)) * F.exp(F.lit(-beta) * F.col("inside"))
    lam = joined.withColumn("intensity", F.when(F.col("total") < 2, 0.0).otherwise(F.col("mu") + F.when(F.col("n") > 1, alpha * state).otherwise(0.0)))
    return lam.withColumn("step", F.coalesce(F.col("intensity") - F.lag("intensity").over(w), F.lit(0.0))).select(*keys, "seq", "ts_ns", "tau", "intensity", "step")


def intensity_stats(rows: DataFrame, keys: list[str], windows: dict[str, Column], least: int = 10) -> DataFrame:
    """Mean and largest intensity and step in each named window, null with fewer ticks than ``least``. Windows may overlap."""
    inside = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in windows.items())))
    each = rows.select(*keys, "intensity", "step", F.explode(inside).alias("window"))
    enough = F.count(F.lit(1)) >= least
    stats = {"mean_intensity": F.avg("intensity"), "max_intensity": F.max("intensity"), "mean_step": F.avg("step"), "max_step": F.max("step")}
    return each.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), *(F.when(enough, x).alias(n) for n, x in stats.items()))


def post_halt_surge(rows: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """The largest intensity within some seconds after a halt's end; null without halts. ``rows`` has resume_ns."""
    run = Window.partitionBy(*keys).orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumn("last_ns", F.last("resume_ns", ignorenulls=True).over(run))
    return made.groupBy(*keys).agg(F.max(F.when(F.col("ts_ns") < F.col("last_ns") + seconds * 1_000_000_000, F.col("intensity"))).alias("post_halt_surge"))


def cvd(ticks: DataFrame, keys: list[str], counts_first: bool = True) -> DataFrame:
    """Cumulative signed volume by the tick rule; an unchanged price holds the last sign, which starts at +1.

    A key with a single tick has 0. Without ``counts_first`` the first tick's size is left out (the form of G18).
    """
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    d = F.col("price") - F.lag("price").over(w)
    rows = ticks.withColumn("s", F.when(d > 0, 1).when(d < 0, -1))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sign", F.coalesce(F.last("s", ignorenulls=True).over(run), F.lit(1)))
    first = F.lag("ts_ns").over(w).isNull()
    alone = first & F.lead("ts_ns").over(w).isNull()
    rows = rows.withColumn("s", F.when(alone if counts_first else first, 0).otherwise(F.col("sign") * F.col("size")))
    return rows.withColumn("cvd", F.sum("s").over(run)).drop("s")


def convexity_grid(points: DataFrame, keys: list[str], step_s: int, window: int, most: int = 50_000) -> DataFrame:
    """(keys, origin, cell, y, convexity, last): the cumulative volume on a regular grid from each key's first tick,
    and the second derivative of the parabola that fits ``window`` points best (odd; fewer where the grid has fewer).

    The grid's values are interpolated between ticks (the last of tied ones counts). Edge points take the
    parabola of the nearest full window, whose second derivative is the same everywhere. A fit's second
    derivative is a fixed weighted sum, so windows do it; grids shorter than ``window`` are gathered, as they are short.
    Only keys of 10 ticks and 5 steps at least have a grid; it ends after ``most`` steps.
    """
    step = step_s * 1_000_000_000
    half = window // 2
    w = Window.partitionBy(*keys)
    span = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("origin"), F.max("ts_ns").alias("end"))
    span = span.filter((F.col("n") >= 10) & (F.floor((F.col("end") - F.col("origin")) / step) + 1 >= 5))
    last = F.least(F.ceil((F.col("end") - F.col("origin")) / step), F.lit(most))
    span = span.select(*keys, "origin", last.cast("long").alias("last"))
    grid = span.select(*keys, "origin", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("cell")).withColumn("at_ns", F.col("origin") + F.col("cell") * step)
    ticks = points.join(span.select(*keys), keys).select(*keys, F.col("ts_ns").alias("at_ns"), F.lit(0).alias("side"), "seq", F.col("cvd").cast("double").alias("cvd"))
    both = grid.withColumn("side", F.lit(1)).unionByName(ticks, allowMissingColumns=True)
    known = F.when(F.col("side") == 0, F.struct(F.col("at_ns").alias("x"), F.col("cvd").alias("y")))
    order = ["at_ns", "side", "seq"]
    past = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({"a": F.last(known, ignorenulls=True).over(past), "z": next_known(known, keys, order)}).filter("side = 1")
    line = F.col("a.y") + F.coalesce((F.col("z.y") - F.col("a.y")) * (F.col("at_ns") - F.col("a.x")) / (F.col("z.x") - F.col("a.x")), F.lit(0.0))
    rows = rows.select(*keys, "origin", "last", "cell", line.alias("y"))

    def weights(h: int) -> list[float]:
        k2 = [k * k for k in range(-h, h + 1)]
        mean = sum(k2) / len(k2)
        norm = sum(x * (x - mean) for x in k2)
        return [2 * (x - mean) / norm for x in k2]

    dot = lambda ys, ws: F.aggregate(F.zip_with(ys, F.array(*map(F.lit, ws)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    o = w.orderBy("cell")
    near = F.collect_list("y").over(o.rowsBetween(-half, half))  # ``window`` values at most
    long = rows.filter(F.col("last") + 1 >= window).withColumn("c", F.when(F.size(near) == 2 * half + 1, dot(near, weights(half))))
    filled = F.coalesce("c", next_known(F.col("c"), keys, ["cell"]), F.last("c", True).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    long = long.select(*keys, "origin", "last", "cell", "y", filled.alias("convexity"))
    short = rows.filter(F.col("last") + 1 < window).groupBy(*keys, "origin", "last").agg(F.sort_array(F.collect_list(F.struct("cell", "y"))).alias("p"))  # fewer than ``window`` values
    own = F.floor(F.col("last") / 2)  # half the greatest odd window that fits
    first = lambda h, at: dot(F.slice(F.transform("p", lambda p: p["y"]), at, 2 * h + 1), weights(h))
    fits = lambda at: F.coalesce(*(F.when(own == h, first(h, at)) for h in range(2, half + 1)))
    short = short.withColumns({"left": fits(1), "right": F.when(F.col("last") % 2 == 1, fits(2))}).select("*", F.explode("p").alias("q"))
    short = short.select(*keys, "origin", "last", "q.cell", "q.y", F.when((F.col("last") % 2 == 1) & (F.col("q.cell") > own), F.col("right")).otherwise(F.col("left")).alias("convexity"))
    return long.unionByName(short)


def cvd_convexity(points: DataFrame, keys: list[str], step_s: int = 1, window: int = 31, most: int = 50_000) -> DataFrame:
    """``points`` (ticks with ``cvd``) with the curvature of their cumulative volume, ``convexity_grid`` interpolated at each tick.

    0 for keys without a grid; past the grid's end its last value.
    """
    step = step_s * 1_000_000_000
    made = convexity_grid(points, keys, step_s, window, most)
    after = F.lead("convexity").over(Window.partitionBy(*keys).orderBy("cell"))
    cells = made.select(*keys, "cell", "convexity", F.coalesce(after, F.col("convexity")).alias("after"))
    ends = made.filter("cell = 0").select(*keys, "origin", "last")
    placed = points.join(ends, keys, "left").withColumn("cell", F.least(F.floor((F.col("ts_ns") - F.col("origin")) / step), F.col("last")).cast("long"))
    share = F.least(F.lit(1.0), (F.col("ts_ns") - F.col("origin")) / step - F.col("cell"))
    met = placed.join(cells, [*keys, "cell"], "left")
    value = F.coalesce(F.col("convexity") + share * (F.col("after") - F.col("convexity")), F.lit(0.0))
    return met.select(*points.columns, value.alias("convexity"))


def premarket_context(bars: DataFrame, keys: list[str], first: int = 330, minutes: int = 15) -> DataFrame:
    """The open against the pre-market high, and the opening minutes' volume rate against the pre-market's.

    The pre-market's rate is over the minutes from its first to its last print,
    one at least, and counts as one at least; null without bars on either side.
    """
    pre = F.col("segment") == "premarket"
    rth = F.col("segment") == "rth"
    opening = rth & (F.col("minute_index") >= first) & (F.col("minute_index") < first + minutes)
    span = (F.max(F.when(pre, F.col("last_ts"))) - F.min(F.when(pre, F.col("first_ts")))) / 6e10
    made = bars.groupBy(*keys).agg(
        F.max(F.when(pre, F.col("high"))).alias("pre_high"), F.min_by(F.when(rth, F.col("first_price")), F.when(rth, F.col("minute_index"))).alias("open"),
        F.count(F.when(rth, 1)).alias("n_rth"), F.coalesce(F.sum(F.when(pre, F.col("n_trades"))), F.lit(0)).alias("pre_trades"),
        (F.sum(F.when(opening, F.col("volume"))) / minutes / F.greatest(F.sum(F.when(pre, F.col("volume"))) / F.greatest(span, F.lit(1.0)), F.lit(1.0))).alias("ratio"),
        (F.count(F.when(pre, 1)) > 0).alias("has_pre"),
    )
    open_ = F.when(F.col("n_rth") > 0, F.col("open"))
    return made.select(*keys, "pre_high", open_.alias("open"), "pre_trades", F.when(F.col("has_pre"), F.col("ratio")).alias("volume_ratio"), F.when(F.col("pre_high") > 0, (open_ - F.col("pre_high")) / F.col("pre_high")).alias("pre_high_distance"))


def feature_row(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One wide row an event from feature tables, each with a row an event."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def forward_targets(ticks: DataFrame, keys: list[str], start_s: int, mfe_s: int, hold_s: int, end_s: int, alpha: float, beta: float, cap_s: float, least: int = 10, few: int = 5) -> DataFrame:
    """Intensity area, mean and peak, best and worst excursion with their ratio, and return from a start on.

    ``ticks`` has et_min, ts_ns, seq and price. Instants are seconds of the local day, ends included. Events with fewer than ``least``
    ticks up to ``end_s``, or a first price not above 0, have no row. The intensity is that of the ticks up to
    ``hold_s`` alone, frozen over gaps of more than ``cap_s``, and needs ``least`` of them; excursions (up to ``mfe_s``) and return need ``few``.
    """
    ns = 1_000_000_000
    instant = F.col("et_min").cast("long") * 60 * ns + F.pmod(F.col("ts_ns"), F.lit(60 * ns))
    upto = lambda s: F.col("instant") <= s * ns
    rows = ticks.withColumn("instant", instant).filter((F.col("instant") >= start_s * ns) & upto(end_s))
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"reference": F.first("price").over(whole), "n_all": F.count(F.lit(1)).over(whole)}).filter((F.col("n_all") >= least) & (F.col("reference") > 0))
    r = F.col("price") / F.col("reference") - 1
    n = lambda s: F.count(F.when(upto(s), 1))
    enough = lambda s, c: F.when(n(s) >= few, c)
    moves = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), enough(mfe_s, F.max(F.when(upto(mfe_s), r))).alias("best"), enough(mfe_s, F.min(F.when(upto(mfe_s), r))).alias("worst"),
        enough(hold_s, F.max_by(r, F.when(upto(hold_s), F.struct("ts_ns", "seq")))).alias("ret"),
    )
    held = rows.filter(upto(hold_s))
    lam = hawkes_intensity(held.select(*keys, "ts_ns", "seq"), keys, alpha, beta, cap_s)
    gap = F.least((F.lead("ts_ns").over(w) - F.col("ts_ns")) / 1e9, F.lit(float(cap_s)))
    lam = lam.withColumn("area", (F.col("intensity") + F.lead("intensity").over(w)) / 2 * gap)
    many = lambda c: F.when(F.count(F.lit(1)) >= least, c)
    areas = lam.groupBy(*keys).agg(many(F.sum("area")).alias("intensity_area"), many(F.avg("intensity")).alias("intensity_mean"), many(F.max("intensity")).alias("intensity_max"))
    ratio_ = F.when(F.abs("worst") > 1e-6, F.abs(F.col("best") / F.col("worst"))).otherwise(F.when(F.col("best") > 0, 100.0).otherwise(0.0))
    return moves.join(areas, keys, "left").withColumn("efficiency", F.when(F.col("best").isNotNull(), ratio_))


def sample_weights(rows: DataFrame, rank: str, rvol: str, volume: str) -> DataFrame:
    """Inverse squared rank times log relative volume; missing ones take log volume scaled to 1..10."""
    lv = F.log1p(F.coalesce(F.col(volume), F.lit(1.0)))
    missing = F.col(rvol).isNull()
    span = rows.agg(F.min(F.when(missing, lv)).alias("lo"), F.max(F.when(missing, lv)).alias("hi"))  # one row
    joined = rows.join(F.broadcast(span))
    scaled = F.when(F.col("hi") > F.col("lo"), 1 + 9 * (lv - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(5.0)
    part = F.log(F.greatest(F.coalesce(F.col(rvol), scaled), F.lit(1.01)))
    return joined.withColumn("weight", F.greatest(part / F.pow(F.greatest(F.col(rank), F.lit(1)), F.lit(2)), F.lit(1e-6))).drop("lo", "hi")


def temporal_split(rows: DataFrame, date: str, share: float = 0.8) -> DataFrame:
    """Dates in order; a row trains while fewer than ``share`` of all rows lie on earlier dates.

    Whole dates stay on one side, so no key leaks; the shuffle sees one row a date.
    """
    dates = rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sides = dates.select(date, F.when(before < share * total, "train").otherwise("test").alias("split"))
    return rows.join(sides, date)


def top_quantile(rows: DataFrame, score: str, q: float = 0.75) -> DataFrame:
    """Rows at or above a quantile of the score."""
    cut = exact_quantile(rows, score, q)
    return rows.filter(F.lit(False) if cut is None else F.col(score) >= cut)


def entry_signal(ticks: DataFrame, keys: list[str], first_min: int, last_min: int) -> DataFrame:
    """The first tick in a window above the running vwap (its own price before any size) with positive cumulative delta from the second tick on."""
    run = Window.partitionBy(*keys).orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = cvd(ticks, keys, counts_first=False).withColumn("vwap", F.coalesce(ratio(F.sum(F.col("price") * F.col("size")).over(run), F.sum("size").over(run)), F.col("price")))
    go = F.col("et_min").between(first_min, last_min) & (F.col("price") > F.col("vwap")) & (F.col("cvd") > 0)
    hit = F.when(go, F.struct("ts_ns", "seq"))
    return rows.groupBy(*keys).agg(F.min(hit)["ts_ns"].alias("entry_ns"), F.min(hit)["seq"].alias("entry_seq"), F.min_by("price", hit).alias("entry_price")).withColumn("entry_price", F.when(F.col("entry_ns").isNotNull(), F.col("entry_price")))


def barrier_exit(ticks: DataFrame, entries: DataFrame, keys: list[str], stop: float, hold_ns: int) -> DataFrame:
    """First stop hit or time exit after entry; excursions from entry up to it.

    Later ticks are those after the entry by time and sequence (without ``entry_seq``: by
    time alone). A stop fills at the stop price; a time exit at the last tick held; an
    entry without later ticks leaves at its own price (``no_ticks``).
    """
    taken = entries.filter("entry_ns IS NOT NULL")
    rows = taken.join(ticks.select(*keys, "ts_ns", "seq", "price"), keys)
    tied = (F.col("ts_ns") == F.col("entry_ns")) & (F.col("seq") > F.col("entry_seq")) if "entry_seq" in entries.columns else F.lit(False)
    rows = rows.filter(((F.col("ts_ns") > F.col("entry_ns")) | tied) & (F.col("ts_ns") <= F.col("entry_ns") + hold_ns))
    rows = rows.withColumn("r", ratio(F.col("price"), F.col("entry_price")) - 1)
    hit = F.min(F.when(F.col("price") <= F.col("entry_price") * (1 - stop), F.struct("ts_ns", "seq"))).over(Window.partitionBy(*keys))
    kept = rows.withColumn("hit", hit).filter(F.col("hit").isNull() | (F.struct("ts_ns", "seq") <= F.col("hit")))
    out = kept.groupBy(*keys).agg(F.max("hit").isNotNull().alias("stopped"), F.max("ts_ns").alias("exit_ns"), F.max_by("r", F.struct("ts_ns", "seq")).alias("last"), F.max("r").alias("up"), F.min("r").alias("down"))
    zero = F.lit(0.0)
    return taken.join(out, keys, "left").select(
        *keys, F.when(F.col("exit_ns").isNull(), "no_ticks").when(F.col("stopped"), "stop").otherwise("time").alias("reason"), F.coalesce("exit_ns", "entry_ns").alias("exit_ns"),
        F.when(F.col("stopped"), F.lit(-stop)).otherwise(F.coalesce("last", zero)).alias("ret"), F.greatest(F.coalesce("up", zero), zero).alias("best"), F.least(F.coalesce("down", zero), zero).alias("worst"),
    )


def pnl_metrics(trades: DataFrame, by: list[str], pnl: str, ret: str, order: list[str]) -> DataFrame:
    """Win rate, totals, profit factor, deepest drawdown and annualised ratio (population deviation)."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("cum", F.sum(pnl).over(run))
    rows = rows.withColumn("drawdown", F.col("cum") - F.max("cum").over(run))
    p = F.col(pnl)
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.percentile(pnl, F.lit(0.5)).alias("median"),
        (gain / F.greatest(loss, F.lit(1e-6))).alias("profit_factor"), F.min("drawdown").alias("max_drawdown"), F.coalesce(ratio(F.avg(ret), F.stddev_pop(ret)) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("annualised"),
    )


