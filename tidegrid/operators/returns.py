"""As-of prices, anchors and returns (E)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import QUARTILES, asof_join, describe, first_when, rank_buckets, ratio, stored


def asof_shifted(left: DataFrame, right: DataFrame, by: list[str], on: str, offsets_ns: list[int], seq: str | None = None, span: float | None = None, tol: float | None = None) -> DataFrame:
    """The as-of match under each time shift of the left side; one job for all shifts."""
    shifted = left.withColumn("offset_ns", F.explode(F.array(*(F.lit(o).cast("long") for o in offsets_ns)))).withColumn("at", F.col(on) + F.col("offset_ns"))
    return asof_join(shifted, right.withColumnRenamed(on, "right_ts"), by, "at", "right_ts", seq, span=span, tol=tol)


def clock_anchors(bars: DataFrame, keys: list[str], minutes: dict[str, int]) -> DataFrame:
    """Named minutes and the last print; undefined while nothing has printed."""
    span = bars.groupBy(*keys).agg(F.min("minute_index").alias("first"), F.max("minute_index").alias("last"))
    named = [F.struct(F.lit(n).alias("anchor"), F.lit(m).cast("long").alias("minute")) for n, m in minutes.items()]
    each = span.select(*keys, "first", F.explode(F.array(*named, F.struct(F.lit("last_print").alias("anchor"), F.col("last").cast("long").alias("minute")))).alias("a"))
    return each.select(*keys, "a.anchor", F.when(F.col("a.minute") >= F.col("first"), F.col("a.minute")).alias("minute"), (F.col("a.minute") < F.col("first")).alias("is_undefined"))


def volume_rungs(bars: DataFrame, baseline: DataFrame, keys: list[str], multiples: list[float]) -> DataFrame:
    """The first minute at which cumulative volume reaches each multiple of a baseline."""
    run = Window.partitionBy(*keys).orderBy("minute_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("cum", F.sum("volume").over(run)).join(baseline, keys)
    return rows.groupBy(*keys).agg(*(first_when(F.col("cum") >= F.lit(float(m)) * F.col("baseline"), F.col("minute_index")).alias(f"rung_{i}") for i, m in enumerate(multiples)))


def horizon_prices(anchors: DataFrame, bars: DataFrame, keys: list[str], horizons: list[int]) -> DataFrame:
    """E5: the price at each anchor and at each horizon after it, with undefined flags."""
    each = anchors.withColumn("horizon", F.explode(F.array(*map(F.lit, [0, *horizons])))).withColumn("target", F.col("minute") + F.col("horizon"))
    known = asof_join(each, bars.select(*keys, "minute_index", "last_price"), keys, "target", "minute_index", prefix="")
    return known.select(*keys, "anchor", "minute", "horizon", F.col("last_price").alias("price"), F.col("last_price").isNull().alias("is_undefined"))


def close_horizons(anchors: DataFrame, closes: DataFrame, keys: list[str]) -> DataFrame:
    """E5: the price at the close of each session of ``closes`` (keys, session_offset, close, last_minute), for each anchor.

    In the anchor's own session the close is undefined where it comes before the anchor.
    """
    rows = anchors.join(closes, keys)
    early = (F.col("session_offset") == 0) & (F.col("last_minute") < F.col("minute"))
    price = F.when(F.col("minute").isNotNull() & ~early, F.col("close"))
    return rows.select(*keys, "anchor", "minute", "session_offset", price.alias("price"), price.isNull().alias("is_undefined"))


#: First minutes after the pre-market's start at which an interval of the day ends, and their names.
DAY_BINS = (
    (330, "premarket (04:00-09:30)"),
    (390, "open-10:30"),
    (480, "10:30-12:00"),
    (600, "12:00-14:00"),
    (720, "14:00-16:00"),
    (None, "post (16:00-20:00)"),
)


def time_bin(minute: Column, bins=DAY_BINS) -> Column:
    """A named interval of the day, of minutes counted from the pre-market's start; null for none."""
    label = None
    for end, name in bins:
        inside = minute.isNotNull() if end is None else minute < end
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def clock_text(minute: Column) -> Column:
    """HH:MM of a minute of the day."""
    m = minute.cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


def detect_crossing(bars: DataFrame, anchor: DataFrame, keys: list[str], multiple: float, bins=DAY_BINS) -> DataFrame:
    """The first minute whose high reaches a multiple of the anchor, its segment and interval of the day, and whether none does."""
    rows = (bars if "segment" in bars.columns else bars.withColumn("segment", F.lit(None).cast("string"))).join(anchor, keys, "left")
    made = rows.groupBy(*keys).agg(F.first("anchor_price").alias("anchor_price"), F.min(F.when(F.col("high") >= F.lit(multiple) * F.col("anchor_price"), F.struct("minute_index", "segment"))).alias("hit"))
    made = made.select(*keys, "anchor_price", F.col("hit.minute_index").alias("detection_minute"), F.col("hit.segment").alias("segment"), time_bin(F.col("hit.minute_index"), bins).alias("bin"))
    return made.withColumns({"is_undefined": F.col("anchor_price").isNull(), "never_reaches": F.col("anchor_price").isNotNull() & F.col("detection_minute").isNull()})


def poll_resolve(ticks: DataFrame, sessions: DataFrame, keys: list[str], thresholds: list[float], interval_s: list[int]) -> DataFrame:
    """The first tick at or over each multiple of a reference, as seen at the next poll of each interval.

    ``sessions``: a row an event with anchor_price, start_ns, open_ns, close_ns and end_ns. Polls count from the
    session's start; an interval of 0 sees at once. Events that never cross, or have no reference or no
    ticks, stay and are flagged with the reason.
    """
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    hit = ticks.join(sessions.select(*keys, "anchor_price"), keys).withColumn("threshold", levels)
    hit = hit.groupBy(*keys, "threshold").agg(first_when(F.col("price") >= F.col("threshold") * F.col("anchor_price"), F.col("ts_ns")).alias("cross_ns"), F.lit(True).alias("has_ticks"))
    each = sessions.withColumn("threshold", levels).join(hit, [*keys, "threshold"], "left").withColumn("interval_s", F.explode(F.array(*map(F.lit, interval_s))))
    step, late = F.nullif(F.col("interval_s").cast("long") * 1_000_000_000, F.lit(0)), F.col("cross_ns") - F.col("start_ns")
    seen = F.col("cross_ns") + F.coalesce(F.pmod(-late, step), F.lit(0))
    rows = each.withColumn("seen_ns", seen)
    reason = F.when(F.col("anchor_price").isNull(), "no_reference").when(F.col("has_ticks").isNull(), "no_ticks").when(F.col("cross_ns").isNull(), "below_threshold")
    segment = F.when(F.col("seen_ns") < F.col("open_ns"), "premarket").when(F.col("seen_ns") < F.col("close_ns"), "rth").when(F.col("seen_ns").isNotNull(), "post")
    return rows.select(*keys, "threshold", "interval_s", "cross_ns", "seen_ns", segment.alias("segment"), (F.col("seen_ns") >= F.col("end_ns")).alias("is_after_end"), F.col("cross_ns").isNull().alias("never_crosses"), reason.alias("reason"))


def latency_prices(detections: DataFrame, bars: DataFrame, keys: list[str], latencies: list[int]) -> DataFrame:
    """The price at detection plus each latency, a column each."""
    each = detections.filter("detection_minute IS NOT NULL").withColumn("latency", F.explode(F.array(*map(F.lit, latencies)))).withColumn("target", F.col("detection_minute") + F.col("latency"))
    known = asof_join(each, bars.select(*keys, "minute_index", "last_price"), keys, "target", "minute_index", prefix="")
    return known.groupBy(*keys).pivot("latency", latencies).agg(F.first("last_price")).select(*keys, *(F.col(f"`{x}`").alias(f"price_{x}") for x in latencies))


def runway(detections: DataFrame, highs: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes and log distance from detection to the day's high."""
    rows = detections.join(highs.select(*keys, "day_high", "high_minute"), keys)
    return rows.withColumns({"runway_minutes": F.col("high_minute") - F.col("detection_minute"), "runway_log": markout(F.col("detection_price"), F.col("day_high"))})


def session_ends(bars: DataFrame, keys: list[str]) -> DataFrame:
    """The last price of each session, its minute and the session's bars; a row a session."""
    return bars.groupBy(*keys, "session_offset").agg(F.max_by("last_price", "minute_index").alias("close"), F.max("minute_index").alias("last_minute"), F.count(F.lit(1)).alias("bars"))


def session_closes(bars: DataFrame, keys: list[str], offsets: list[int]) -> DataFrame:
    """The last price of each session, wide by offset, with its bars counted."""
    long = session_ends(bars, keys)
    name = lambda o: f"m{-o}" if o < 0 else f"p{o}"
    wide = long.groupBy(*keys).pivot("session_offset", offsets).agg(F.first("close").alias("close"), F.first("bars").alias("bars"))
    return wide.select(*keys, *(F.col(f"{o}_{c}").alias(f"{c}_{name(o)}") for o in offsets for c in ("close", "bars")))


def markout(start: Column, stop: Column) -> Column:
    """Signed log return; null unless both prices are positive."""
    return F.when((start > 0) & (stop > 0), F.log(stop / start))


def cell_table(rows: DataFrame, by: list[str], value: str, thin: int = 100) -> DataFrame:
    """N, median, quartiles and a thin flag for any grouping."""
    return describe(rows, by, {value: QUARTILES}, n=F.count(value), is_thin=F.count(value) < thin)


def markout_grid(rows: DataFrame, axes: list[str], value: str, thin: int = 100) -> DataFrame:
    """Cell statistics over all combinations of the axes' values, empty cells included.

    Each axis has few distinct values (names, horizons, buckets); the grid of
    them is their product.
    """
    cells = cell_table(rows, axes, value, thin)
    grid = None
    for a in axes:
        each = rows.select(a).filter(F.col(a).isNotNull()).distinct()
        grid = each if grid is None else grid.join(F.broadcast(each.agg(F.collect_set(a).alias(f"{a}_all")))).withColumn(a, F.explode(f"{a}_all")).drop(f"{a}_all")
    return grid.join(cells, axes, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "is_thin": F.coalesce("is_thin", F.lit(True))})


def excluded_populations(rows: DataFrame, reasons: dict[str, Column], value: str) -> DataFrame:
    """Rows left out by the first of the reasons that holds, and their values apart from the grid's."""
    which = F.coalesce(*(F.when(c, F.lit(n)) for n, c in reasons.items()), F.lit("included"))
    each = stored(rows.select(which.alias("population"), value), "populations")
    return describe(each, ["population"], {value: ((0.5,), ("median",))}, True, n=F.count(F.lit(1)), n_defined=F.count(value))


def axis_rows(detections: DataFrame, bars: DataFrame, keys: list[str], latencies: list[int], holds: list[int]) -> DataFrame:
    """Every detection entered after each latency and left after each hold, or at the last price (fixed_exit).

    A leg past the session's last print is undefined. Entries and exits are one
    stacked as-of; an entry meets its exits in a window over the same keys.
    """
    price = bars.select(*keys, "minute_index", "last_price")
    last = bars.groupBy(*keys).agg(F.max("minute_index").alias("last_minute"), F.max_by("last_price", "minute_index").alias("close"))
    legs = [F.struct(F.lit(a).alias("latency"), F.lit(h).alias("hold")) for a in latencies for h in (0, *holds)]
    each = detections.filter("detection_minute IS NOT NULL").select(*keys, "detection_minute", F.explode(F.array(*legs)).alias("x")).select(*keys, "x.*", (F.col("detection_minute") + F.col("x.latency")).alias("entry_minute"), (F.col("detection_minute") + F.col("x.latency") + F.col("x.hold")).alias("target"))
    met = asof_join(each, price, keys, "target", "minute_index", prefix="").join(last, keys)
    rows = met.withColumn("price", F.when(F.col("target") <= F.col("last_minute"), F.col("last_price")))
    fixed = F.col("hold") == 0
    rows = rows.withColumn("entry_price", F.max(F.when(fixed, F.col("price"))).over(Window.partitionBy(*keys, "latency")))
    out = F.when(fixed, F.col("close")).otherwise(F.col("price"))
    return rows.select(
        *keys, F.when(fixed, "fixed_exit").otherwise("fixed_horizon").alias("grid"), "latency", F.when(~fixed, F.col("hold")).alias("hold"), "entry_minute",
        F.when(fixed, F.col("last_minute")).otherwise(F.col("target")).alias("exit_minute"), "entry_price", out.alias("exit_price"), markout(F.col("entry_price"), out).alias("markout"),
    )


def axis_grid(detections: DataFrame, bars: DataFrame, keys: list[str], latencies: list[int], holds: list[int]) -> DataFrame:
    """Statistics of the log returns of each latency and hold, and of each latency up to the last price."""
    cell = ["grid", "latency", "hold"]
    rows = stored(axis_rows(detections, bars, keys, latencies, holds).select(*cell, "markout"), "axes")
    return describe(rows, cell, {"markout": QUARTILES}, True, n=F.count(F.lit(1)), n_defined=F.count("markout"))


def log_decomposition(bars: DataFrame, keys: list[str], open_minute: int = 330) -> DataFrame:
    """Prior regular close to the open as log parts - prior post, overnight, pre-market - that add up, and their shares.

    The open is the last price at or before ``open_minute``. All are null unless
    all four prices are positive; shares also where the sum is not positive.
    """
    at = lambda cond, c, f: f(F.when(cond, F.col(c)), F.when(cond, F.col("minute_index")))
    before, now = F.col("session_offset") == -1, F.col("session_offset") == 0
    made = bars.filter("session_offset IN (-1, 0)").groupBy(*keys).agg(
        at(before & (F.col("segment") == "rth"), "last_price", F.max_by).alias("close"), at(before, "last_price", F.max_by).alias("post"),
        at(now, "first_price", F.min_by).alias("first"), at(now & (F.col("minute_index") <= open_minute), "last_price", F.max_by).alias("open"),
        *(F.max(c).alias(n) for n, c in {"has_close": before & (F.col("segment") == "rth"), "has_post": before, "has_first": now, "has_open": now & (F.col("minute_index") <= open_minute)}.items()),
    )
    fine = F.lit(True)
    for c in ("close", "post", "first", "open"):
        fine = fine & F.coalesce(F.col(f"has_{c}") & (F.col(c) > 0), F.lit(False))
    part = lambda a, b: F.when(fine, F.log(F.col(b) / F.col(a)))
    rows = made.withColumns({"prior_post": part("close", "post"), "overnight": part("post", "first"), "premarket": part("first", "open"), "is_undefined": ~fine})
    total = F.col("prior_post") + F.col("overnight") + F.col("premarket")
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).alias(f"share_{c}")
    rows = rows.withColumn("total", total)
    return rows.select(*keys, "prior_post", "overnight", "premarket", "total", *map(share, ("prior_post", "overnight", "premarket")), "is_undefined", F.coalesce(F.col("total") <= 0, F.lit(False)).alias("share_undefined"))


def participation(bars: DataFrame, anchors: DataFrame, keys: list[str], prior: tuple[int, ...] = (-3, -2, -1)) -> DataFrame:
    """Volume up to the anchor's minute, and medians over prior sessions: up to it (clock) and whole (session).

    A prior session without bars is left out; one with bars but none so far counts 0.
    """
    rows = bars.filter(F.col("session_offset").isin(*prior, 0)).join(anchors.select(*keys, "minute"), keys)
    by = rows.groupBy(*keys, "session_offset").agg(F.coalesce(F.sum(F.when(F.col("minute_index") <= F.col("minute"), F.col("volume"))), F.lit(0)).alias("volume"), F.sum("volume").alias("whole"))
    old = lambda c: F.percentile(F.when(F.col("session_offset") < 0, F.col(c)), F.lit(0.5))
    made = by.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("session_offset") == 0, F.col("volume"))), F.lit(0)).alias("volume"), old("volume").alias("clock_baseline"), old("whole").alias("session_baseline"), F.count(F.when(F.col("session_offset") < 0, 1)).alias("n_sessions"))
    out = anchors.select(*keys).join(made, keys, "left")
    return out.withColumns({"volume": F.coalesce("volume", F.lit(0)), "n_sessions": F.coalesce("n_sessions", F.lit(0))})


def participation_form(rows: DataFrame, most_undefined: float = 0.2) -> DataFrame:
    """+1 log ratio of the volume to the clock baseline, or to the session's where the clock's is null or 0 too often."""
    rate = rows.agg(F.avg((F.coalesce("clock_baseline", F.lit(0.0)) == 0).cast("double")).alias("rate"))
    form = F.when(F.col("rate") > most_undefined, "session").otherwise("clock")
    base = F.when(F.col("form") == "session", F.col("session_baseline")).otherwise(F.col("clock_baseline"))
    return rows.join(F.broadcast(rate)).withColumn("form", form).withColumn("participation", F.log((F.col("volume") + 1) / (base + 1))).drop("rate")


def buckets(rows: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    """Balanced rank buckets 1..n, ties broken by further columns; null values have none."""
    ranked = rows.filter(F.col(value).isNotNull())
    return rank_buckets(ranked, [value, *ties], n)


def cross_session_extreme(closes: DataFrame, keys: list[str], pairs: list[tuple[str, str]], magnitude: float, k_max: int, tolerance: float) -> DataFrame:
    """Log ratio of each pair of closes, magnitude flag, and the nearest of k and 1/k by relative deviation from it."""
    named = [F.struct(F.lit(f"{a}->{b}").alias("pair"), F.log(F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(b) / F.col(a))).alias("log_ratio")) for a, b in pairs]
    each = closes.select(*keys, F.explode(F.array(*named)).alias("x")).select(*keys, "x.*").filter("log_ratio IS NOT NULL")
    r, whole = F.exp("log_ratio"), F.sequence(F.lit(2), F.lit(k_max))
    up = F.transform(whole, lambda k: F.struct((F.abs(r - k) / k).alias("deviation"), k.alias("place"), k.cast("string").alias("label")))
    down = F.transform(whole, lambda k: F.struct((F.abs(r - 1 / k) / (1 / k)).alias("deviation"), (k + k_max).alias("place"), F.concat(F.lit("1/"), k.cast("string")).alias("label")))
    near = F.array_min(F.concat(up, down))
    return each.withColumn("is_large", F.abs("log_ratio") >= magnitude).withColumn("near", near).select(*keys, "pair", "log_ratio", "is_large", F.col("near.label").alias("nearest"), F.col("near.deviation").alias("deviation"), (F.col("near.deviation") <= tolerance).alias("is_integer_ratio"))


def band_width(tolerance: float) -> float:
    """Width of every band on the log scale."""
    return math.log((1 + tolerance) / (1 - tolerance))


def touching(tolerance: float, k_max: int) -> int | None:
    """The first k whose band touches the next one; from there on membership says nothing."""
    return next((k for k in range(2, k_max + 1) if math.log(1 + 1 / k) < band_width(tolerance)), None)


def off_band(k: int, tolerance: float, k_max: int, window: float) -> float:
    """Log measure of what bands 2..k_max leave uncovered within ``window`` of ln k.

    Bands are equally wide and in order: each covers from its start to its end or the next one's start.
    """
    half, lo, hi, covered = band_width(tolerance) / 2, math.log(k) - window, math.log(k) + window, 0.0
    for j in range(2, k_max + 1):
        upto = min(math.log(j) + half, math.log(j + 1) - half if j < k_max else math.inf, hi)
        covered += max(0.0, upto - max(math.log(j) - half, lo))
    return hi - lo - covered


def band_null(flagged: DataFrame, k_max: int, tolerance: float, window: float = 0.18) -> DataFrame:
    """Absolute log ratios in each band against the density around it that no band covers, of the k whose bands are apart.

    The off-band values within ``window`` of ln k, over the log measure that the bands leave free there, scaled to a
    band's width; null where nothing is left. Each value meets the few k near it.
    """
    half, last = band_width(tolerance) / 2, min(k_max, (touching(tolerance, k_max) or k_max + 1) - 1)
    u = flagged.select(F.abs("log_ratio").alias("u")).filter("u IS NOT NULL")
    near = lambda reach, top: F.sequence(F.greatest(F.lit(2), F.least(F.lit(top), F.ceil(F.exp(F.col("u") - reach)) - 1)), F.greatest(F.lit(2), F.least(F.lit(top), F.floor(F.exp(F.col("u") + reach)) + 1)))
    away = lambda k: F.abs(F.col("u") - F.log(k))
    rows = u.withColumn("off", ~F.exists(near(half, k_max), lambda k: away(k) <= half))
    met = rows.withColumn("k", F.explode(near(window, last))).withColumn("away", away(F.col("k")))
    counts = met.groupBy(F.col("k").cast("int").alias("k")).agg(F.count(F.when(F.col("away") <= half, 1)).alias("observed"), F.count(F.when((F.col("away") <= window) & F.col("off"), 1)).alias("n_off"))
    free = [F.struct(F.lit(k).alias("k"), F.lit(off_band(k, tolerance, k_max, window)).alias("free")) for k in range(2, last + 1)]
    each = flagged.sparkSession.range(1).select(F.inline(F.array(*free))).join(counts, "k", "left").fillna(0, ["observed", "n_off"])
    expected = F.when(F.col("free") > 1e-9, F.round(F.col("n_off") / F.col("free") * (2 * half), 2))
    return each.select("k", "observed", "n_off", expected.alias("expected"), (F.col("observed") - expected).alias("excess"), F.when(F.col("n_off") > 0, F.round(F.col("observed") / (F.col("n_off") / F.col("free") * (2 * half)), 2)).alias("ratio"))


def band_coverage(flagged: DataFrame, least: float, k_max: int, tolerance: float) -> DataFrame:
    """The share of the flagged range of absolute log ratios, ``least`` to the largest, that the bands cover by chance."""
    half = band_width(tolerance) / 2
    top = flagged.agg(F.max(F.abs("log_ratio")).alias("top"))
    band = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(math.log(k) + half), F.col("top")) - F.greatest(F.lit(math.log(k) - half), F.lit(least)))
    covered = F.lit(0.0)
    for k in range(2, k_max + 1):
        covered = covered + band(k)
    return top.select(F.when(F.col("top") > least, covered / (F.col("top") - least)).alias("chance_coverage"))


def retracement(rows: DataFrame, keys: list[str], anchor: str, detected: str, high: str, closes: dict[str, str], contaminated: str | None = None) -> DataFrame:
    """Per horizon what the close gave back of the way from the anchor, and from detection, to the high.

    (high - close) / (high - start); null unless the close and the way are positive.
    """
    each = rows.select(*keys, F.col(anchor).alias("a"), F.col(detected).alias("p"), F.col(high).alias("h"), (F.col(contaminated) if contaminated else F.lit(False)).alias("is_contaminated"), F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.col(c).alias("close")) for n, c in closes.items()))).alias("x"))
    c, h = F.col("x.close"), F.col("h")
    back = lambda start: F.when((c > 0) & (h > start), (h - c) / (h - start))
    under = lambda start: F.when(c > 0, c < start)
    a, p = F.col("a"), F.col("p")
    wide = lambda start: F.coalesce(h > start, F.lit(False))
    return each.select(*keys, "x.horizon", back(a).alias("of_excursion"), back(p).alias("of_detection"), under(a).alias("below_anchor"), under(p).alias("below_detection"), (~wide(a)).alias("excursion_undefined"), (~wide(p)).alias("detection_undefined"), (~F.coalesce(c > 0, F.lit(False))).alias("horizon_undefined"), "is_contaminated")


def sensitivity_variants(rows: DataFrame, value: str, flag: str, by: list[str], trim: float) -> DataFrame:
    """The same median over all, flagged, unflagged and trimmed rows, and whether its sign flips."""
    f = F.coalesce(F.col(flag), F.lit(False))
    member = F.array_compact(F.array(F.lit("all"), F.when(f, "flagged"), F.when(~f, "unflagged"), F.when(F.abs(value) <= trim, "trimmed")))
    each = stored(rows.filter(F.col(value).isNotNull()).select(*by, value, F.explode(member).alias("variant")), "variants")
    made = describe(each, [*by, "variant"], {value: ((0.5,), ("median",))}, True, n=F.count(F.lit(1)))
    base = F.max(F.when(F.col("variant") == "all", F.signum("median"))).over(Window.partitionBy(*by))
    return made.withColumn("sign_flips", F.signum("median") != base)


def monotonicity(cells: DataFrame, by: list[str], bucket: str, median: str = "median") -> DataFrame:
    """Whether bucket medians never rise, and the spread of first less last."""
    w = Window.partitionBy(*by).orderBy(bucket)
    rows = cells.withColumn("falls", F.coalesce(F.col(median) <= F.lag(median).over(w), F.lit(True)))
    return rows.groupBy(*by).agg(F.bool_and("falls").alias("is_non_increasing"), (F.min_by(median, bucket) - F.max_by(median, bucket)).alias("spread"))


def runway_split(rows: DataFrame, value: str, marks: list[float], width: float) -> tuple[DataFrame, DataFrame]:
    """(mass at zero and cumulative shares at marks; log10 histogram of positive values)."""
    shares = [F.avg((F.col(value) <= m).cast("double")).alias(f"share_{i}") for i, m in enumerate(marks)]
    summary = rows.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"), *shares)
    bins = rows.filter(F.col(value) > 0).groupBy(F.floor(F.log10(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return summary, bins


def volume_at(bars: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative volume up to and with the detection's minute, and its share of the day's."""
    rows = bars.join(detections.filter("detection_minute IS NOT NULL").select(*keys, "detection_minute"), keys)
    so_far = F.sum(F.when(F.col("minute_index") <= F.col("detection_minute"), F.col("volume")))
    return rows.groupBy(*keys).agg(so_far.alias("volume_at_detection"), ratio(so_far, F.sum("volume")).alias("volume_share"))


def kde_trough(values: DataFrame, value: str, bandwidth: float = 0.15, points: int = 1000, bin_width: float = 0.01) -> DataFrame:
    """Gaussian density of log10 values on a grid; the two highest modes and the trough between.

    Values are binned first, so the grid meets bins, of which there are as many as
    the range holds, not rows. One row: low_mode, high_mode, trough, is_bimodal.
    """
    logs = values.filter(F.col(value) > 0).select(F.log10(value).alias("x"))
    bins = logs.groupBy(F.round(F.col("x") / bin_width).alias("b")).agg(F.count(F.lit(1)).alias("n")).select((F.col("b") * bin_width).alias("x"), "n")
    span = bins.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    grid = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("g", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    reach = 8 * bandwidth  # beyond this the kernel is under 1e-14
    cell = lambda c: F.floor(c / reach)
    near = bins.withColumn("cell", F.explode(F.array(cell(F.col("x")) - 1, cell(F.col("x")), cell(F.col("x")) + 1)))
    met = grid.withColumn("cell", cell(F.col("g"))).join(near, "cell")
    u = (F.col("g") - F.col("x")) / bandwidth
    density = met.groupBy("i", "g").agg(F.sum(F.col("n") * F.exp(-u * u / 2)).alias("f"))
    w = Window.orderBy("i")  # the grid has ``points`` rows
    turn = density.withColumns({"p": F.lag("f").over(w), "q": F.lead("f").over(w)})
    peaks = turn.filter("f > p AND f >= q").orderBy(F.desc("f"), "i").limit(2)
    modes = peaks.agg(F.min("g").alias("low_mode"), F.max("g").alias("high_mode"), F.count(F.lit(1)).alias("n_modes"))
    between = density.join(F.broadcast(modes)).filter("g > low_mode AND g < high_mode").agg(F.min_by("g", "f").alias("trough"))
    return modes.join(F.broadcast(between)).select("low_mode", "high_mode", "trough", (F.col("n_modes") == 2).alias("is_bimodal"))


def era(date: Column, boundary: str) -> Column:
    """Label by a date boundary."""
    return F.when(date < F.lit(boundary).cast("date"), "early").otherwise("late")


LOG_TOLERANCE = math.log(1.02)
