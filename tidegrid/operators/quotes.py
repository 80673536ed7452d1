"""Quotes, spreads, trade signing and costs (F). Windows are keyed by (ticker, day, segment)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import QUARTILES, asof_join, describe, islands, quantiles, ratio, stored


def states() -> dict[str, Column]:
    """state flags of a quote row; three-valued logic is kept (null prices compare to null)."""
    bid, ask = F.col("bid"), F.col("ask")
    return {
        "is_crossed": bid > ask, "is_locked": bid == ask, "is_null_price": bid.isNull() | ask.isNull(), "is_nonpositive": (bid <= 0) | (ask <= 0),
        "is_one_sided": bid.isNull() != ask.isNull(), "is_zero_size": (F.col("bid_size") == 0) | (F.col("ask_size") == 0),
        "is_zero_bid": F.col("bid_size").isNull() | (F.col("bid_size") == 0), "is_zero_ask": F.col("ask_size").isNull() | (F.col("ask_size") == 0),
    }


def quote_states(quotes: DataFrame) -> DataFrame:
    """every state, hard (unusable) and degraded (usable with care)."""
    rows = quotes.withColumns(states())
    some = lambda *cs: F.coalesce(*(F.when(F.col(c), True) for c in cs), F.lit(False))
    return rows.withColumns({"is_hard": some("is_crossed", "is_null_price", "is_nonpositive"), "is_degraded": some("is_locked", "is_zero_bid", "is_zero_ask", "is_one_sided")})


def quote_durations(quotes: DataFrame, keys: list[str], end: str = "segment_end_ns") -> DataFrame:
    """time to the next quote, clamped to the segment's end; midpoint, spread, book change."""
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    upto = F.least(F.coalesce(F.lead("ts_ns").over(w), F.col(end)), F.col(end))
    changed = ~(F.col("bid").eqNullSafe(F.lag("bid").over(w)) & F.col("ask").eqNullSafe(F.lag("ask").over(w)))
    return quotes.withColumns({
        "duration_ns": F.greatest(F.lit(0), upto - F.col("ts_ns")), "mid": (F.col("bid") + F.col("ask")) / 2,
        "spread": F.col("ask") - F.col("bid"), "is_change": changed,
    })


def session_ns_prefilter(ticks: DataFrame, bounds: DataFrame, ticker: str = "ticker") -> DataFrame:
    """keep ticks within any of their ticker's session bounds, by integers alone.

    Bounds are a row a (ticker, session); they meet ticks by ticker and UTC day, so
    a ticker's sessions are not paired with all of its ticks.
    """
    day = 86_400_000_000_000
    span = bounds.withColumn("d", F.explode(F.sequence(F.floor(F.col("start_ns") / day), F.floor((F.col("end_ns") - 1) / day))))
    rows = ticks.withColumn("d", F.floor(F.col("ts_ns") / day))
    return rows.join(span.select(ticker, "d", "start_ns", "end_ns"), [ticker, "d"]).filter((F.col("ts_ns") >= F.col("start_ns")) & (F.col("ts_ns") < F.col("end_ns"))).drop("d", "start_ns", "end_ns")


def quote_minute_metrics(quotes: DataFrame, by: list[str]) -> DataFrame:
    """counts, time shares and time-weighted spread and midpoint; input from F1 and F2."""
    usable = ~F.col("is_hard")
    held = F.when(usable, F.col("duration_ns"))
    weighted = lambda c: ratio(F.sum(F.col(c) * held), F.sum(held))
    rows = quotes.withColumn("spread_bp", ratio(F.col("spread"), F.col("mid")) * 10_000)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_quotes"), F.sum("duration_ns").alias("duration_ns"), F.count(F.when(F.col("is_change"), 1)).alias("n_changes"),
        ratio(F.sum(F.when(~usable, F.col("duration_ns"))), F.sum("duration_ns")).alias("unusable_share"), ratio(F.sum(F.when(F.col("is_locked"), F.col("duration_ns"))), F.sum("duration_ns")).alias("locked_share"),
        weighted("spread").alias("tw_spread"), weighted("spread_bp").alias("tw_spread_bp"), weighted("mid").alias("tw_mid"),
    )


STATES = ("is_crossed", "is_locked", "is_null_price", "is_nonpositive", "is_one_sided", "is_zero_bid", "is_zero_ask")


def unions() -> dict[str, Column]:
    """every quote is hard (unusable), degraded or clean."""
    return {"hard": F.col("is_hard"), "degraded": ~F.col("is_hard") & F.col("is_degraded"), "clean": ~F.col("is_hard") & ~F.col("is_degraded")}


def state_census(quotes: DataFrame, by: list[str]) -> DataFrame:
    """share of rows and of time in each state and each union of them, and the time in each two states at once."""
    time = F.sum("duration_ns")
    of = lambda c: ratio(F.coalesce(F.sum(F.when(c, F.col("duration_ns"))), F.lit(0)), time)
    rows = lambda c: F.count(F.when(c, 1)) / F.count(F.lit(1))
    flags = {**unions(), **{s[3:]: F.col(s) for s in STATES}}
    shares = [x for n, c in flags.items() for x in (rows(c).alias(f"{n}_rows"), of(c).alias(f"{n}_time"))]
    pairs = [of(F.col(s) & F.col(t)).alias(f"{s[3:]}_and_{t[3:]}_time") for s, t in itertools.combinations(STATES, 2)]
    return quotes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_quotes"), time.alias("duration_ns"), *shares, *pairs)


def state_runs(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """spells of neighbouring quotes in each state, and in the hard and the degraded union, by event and segment: number, longest, median, 95th percentile and total time."""
    flags = {**{s[3:]: F.col(s) for s in STATES}, **{n: c for n, c in unions().items() if n != "clean"}}
    listed = F.array(*(F.struct(F.lit(n).alias("state"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in flags.items()))
    rows = quotes.select(*keys, "ts_ns", "seq", "duration_ns", F.inline(listed))
    own = [*keys, "state"]
    before = F.lag("flag").over(Window.partitionBy(*own).orderBy("ts_ns", "seq"))
    runs = islands(rows, own, ["ts_ns", "seq"], F.coalesce(F.col("flag") != before, F.lit(True)))
    spells = runs.filter("flag").groupBy(*own, "run").agg(F.sum("duration_ns").alias("ns"))
    return describe(spells, own, {"ns": ((0.5, 0.95), ("p50", "p95"))}, n=F.count(F.lit(1)), longest=F.max("ns"), total=F.sum("ns"))


def book_runs(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """spells of unchanged best prices: their starts and lengths."""
    runs = islands(quotes, keys, ["ts_ns", "seq"], F.col("is_change"))
    return runs.groupBy(*keys, "run").agg(F.min("ts_ns").alias("start_ns"), F.sum("duration_ns").alias("ns"), F.count(F.lit(1)).alias("n_quotes"))


def book_age(trades: DataFrame, quotes: DataFrame, by: list[str], span: float | None = None) -> DataFrame:
    """age of the book (time since its last change) at each trade, null before the first quote."""
    changes = quotes.filter("is_change").select(*by, F.col("ts_ns").alias("change_ns"), F.col("seq").alias("change_seq"))
    rows = asof_join(trades, changes, by, "ts_ns", "change_ns", "change_seq", prefix="", span=span)
    return rows.withColumn("age_ns", F.col("ts_ns") - F.col("change_ns"))


def quote_to_trade(quotes: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """F8: quotes per trade and quantiles of the time between quotes."""
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    q = quotes.withColumn("gap", F.col("ts_ns") - F.lag("ts_ns").over(w)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_quotes"), *quantiles("gap", (0.5, 0.95), ("gap_p50", "gap_p95")))
    t = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"))
    return q.join(t, keys, "left").withColumn("quotes_per_trade", ratio(F.col("n_quotes"), F.col("n_trades")))


def quoted_spread(quotes: DataFrame, by: list[str], event: list[str]) -> DataFrame:
    """per cell the median over events of time-weighted spreads and the price they imply."""
    metrics = quote_minute_metrics(quotes, [*event, *by])
    rows = metrics.withColumn("implied_price", ratio(F.col("tw_spread"), F.col("tw_spread_bp")) * 10_000)
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    made = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), med("tw_spread"), med("tw_spread_bp"), med("implied_price"))
    return made.withColumn("price_of_medians", ratio(F.col("median_tw_spread"), F.col("median_tw_spread_bp")) * 10_000)


def with_quote(trades: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """Each trade with the last usable quote at or before it (q_ columns), and when the book last changed by then."""
    w = Window.partitionBy(*by).orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    keep = [c for c in quotes.columns if c in {*by, "seq", "bid", "ask", "mid"}]
    usable = quotes.filter(~F.col("is_hard"))
    usable = usable.select(*keep, F.col("ts_ns").alias("quote_ns"), F.max(F.when(F.col("is_change"), F.col("ts_ns"))).over(w).alias("change_ns"))
    return asof_join(trades, usable, by, "ts_ns", "quote_ns", "seq", prefix="q_")


def sign_trades(trades: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """+1 / -1 by the midpoint of the last usable quote, at it by the previous trade's price, else null.

    ``by`` holds ticker, day and segment: neither quotes nor prices are carried over.
    """
    rows = with_quote(trades, quotes, by)
    before = F.lag("price").over(Window.partitionBy(*by).orderBy("ts_ns", "seq"))
    sign = lambda d: F.when(d > 0, 1).when(d < 0, -1)
    return rows.withColumn("sign", F.coalesce(sign(F.col("price") - F.col("q_mid")), sign(F.col("price") - before)))


def trade_minute_metrics(signed: DataFrame, by: list[str]) -> DataFrame:
    """volumes, distance to the midpoint, classified and signed volume, ages of the book at the trades."""
    rows = signed.withColumn("age", F.col("ts_ns") - F.col("q_change_ns"))
    over = lambda ns: F.avg(F.when(F.col("age") > ns, 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"), F.sum(F.abs(F.col("price") - F.col("q_mid")) * F.col("size")).alias("abs_distance_size"),
        F.sum(F.when(F.col("sign").isNotNull(), F.col("size"))).alias("classified"), F.sum(F.col("sign") * F.col("size")).alias("signed_volume"),
        F.count(F.when(F.col("sign").isNull(), 1)).alias("n_unclassified"), F.count(F.when(F.col("q_mid").isNull(), 1)).alias("n_no_quote"), *quantiles("age", (0.5, 0.95), ("age_p50", "age_p95")),
        over(1_000_000_000).alias("share_over_1s"), over(60_000_000_000).alias("share_over_60s"),
    )


def quote_trade_cache(quote_metrics: DataFrame, trade_metrics: DataFrame, by: list[str]) -> DataFrame:
    """both sides of every minute, full outer."""
    return quote_metrics.join(trade_metrics, by, "full")


def alignment_sweep(trades: DataFrame, quotes: DataFrame, by: list[str], offsets_ns: list[int], span: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """how many trades have no quote, an unusable one, and where the others lie, for each time shift.

    The places overlap: at or inside the quote, at either side within the tolerance, strictly inside, beyond either side.
    """
    from tidegrid.operators.returns import asof_shifted

    rows = asof_shifted(trades, quotes.select(*by, "ts_ns", "seq", "bid", "ask", "is_hard"), by, "ts_ns", offsets_ns, "seq", span)
    bid, ask, price = F.col("r_bid"), F.col("r_ask"), F.col("price")
    some = F.col("r_seq").isNotNull()
    fine = some & ~F.col("r_is_hard")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("offset_ns").agg(
        F.count(F.lit(1)).alias("n_trades"), n(~some).alias("n_no_quote"), n(some & F.col("r_is_hard")).alias("n_unusable"), n(fine & (price >= bid) & (price <= ask)).alias("n_at_or_inside"),
        n(fine & (F.abs(price - bid) < tolerance)).alias("n_at_bid"), n(fine & (F.abs(price - ask) < tolerance)).alias("n_at_ask"), n(fine & (price > bid + tolerance) & (price < ask - tolerance)).alias("n_inside"),
        n(fine & (price < bid - tolerance)).alias("n_below_bid"), n(fine & (price > ask + tolerance)).alias("n_above_ask"),
    )


def effective_spread(signed: DataFrame, event: list[str]) -> DataFrame:
    """F14, plain form: per event the median over trades of twice the distance to the usable midpoint, in currency and basis points."""
    off = 2 * F.abs(F.col("price") - F.col("q_mid"))
    rows = signed.filter(F.col("q_mid") > 0).withColumns({"off": off, "off_bp": off / F.col("q_mid") * 10_000})
    return describe(rows, event, {"off": ((0.5,), ("spread",)), "off_bp": ((0.5,), ("spread_bp",))}, n=F.count(F.lit(1)))


def with_effective(cache: DataFrame) -> DataFrame:
    """Minutes with trades, with the size-weighted effective spread: in currency and as a fraction of the midpoint."""
    rows = cache.filter((F.col("n_trades") > 0) & (F.col("volume") > 0)).withColumn("effective", 2 * ratio(F.col("abs_distance_size"), F.col("volume")))
    return rows.withColumn("effective_share", ratio(F.col("effective"), F.col("tw_mid")))


def effective_at(detections: DataFrame, cache: DataFrame, keys: list[str], latencies: list[int]) -> DataFrame:
    """the effective spread in the last traded minute at or before detection plus each latency, by event.

    ``detections`` has detection_minute and detection_price.
    """
    each = detections.filter("detection_minute IS NOT NULL").withColumn("latency", F.explode(F.array(*map(F.lit, latencies)))).withColumn("target", F.col("detection_minute") + F.col("latency"))
    met = asof_join(each, with_effective(cache).select(*keys, "minute_index", "effective", "effective_share"), keys, "target", "minute_index", prefix="")
    return met.select(*keys, "latency", F.col("effective").alias("spread"), (100 * F.col("effective")).alias("cents"), (10_000 * F.col("effective_share")).alias("bp"), ratio(F.col("effective"), F.when(F.col("detection_price") > 0, F.col("detection_price"))).alias("of_price"))


def effective_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """quantiles of the effective spreads that are defined, by cell."""
    wanted = {"bp": ((0.25, 0.5, 0.75, 0.95), ("bp_p25", "bp_p50", "bp_p75", "bp_p95")), "cents": (QUARTILES[0], ("cents_p25", "cents_p50", "cents_p75")), "of_price": ((0.5,), ("of_price_p50",))}
    return describe(rows.filter("bp IS NOT NULL"), by, wanted, n=F.count(F.lit(1)))


def cost_vs_capture(legs: DataFrame, cache: DataFrame, highs: DataFrame, keys: list[str], multiples: list[float]) -> DataFrame:
    """half the effective spread at entry plus half at exit, against the realised and the best possible log return.

    ``legs`` has entry_minute, exit_minute, entry_price and markout; ``highs`` the
    day_high. A row a leg and multiple: cost over return, null unless both are
    defined and the return is positive.
    """
    book = with_effective(cache).select(*keys, "minute_index", F.col("effective_share").alias("share"), F.col("effective").alias("spread"))
    one = asof_join(legs, book, keys, "entry_minute", "minute_index", prefix="i_")
    two = asof_join(one, book, keys, "exit_minute", "minute_index", prefix="o_").join(highs.select(*keys, "day_high"), keys, "left")
    cost = (F.col("i_share") + F.col("o_share")) / 2
    rows = two.withColumns({"cost": cost, "cost_currency": (F.col("i_spread") + F.col("o_spread")) / 2, "best": F.when((F.col("entry_price") > 0) & (F.col("day_high") > 0), F.log(F.col("day_high") / F.col("entry_price")))})
    rows = rows.withColumn("is_valid", F.col("markout").isNotNull() & F.col("cost").isNotNull())
    over = lambda c: F.when(F.col("is_valid") & (F.col(c) > 0), F.col("multiple") * F.col("cost") / F.col(c))
    each = rows.withColumn("multiple", F.explode(F.array(*(F.lit(float(m)) for m in multiples))))
    return each.withColumns({
        "of_realized": over("markout"), "of_best": over("best"), "is_nonpositive": F.col("is_valid") & (F.col("markout") <= 0),
        "exceeds": F.when(F.col("is_valid") & (F.col("markout") > 0), F.col("cost") > F.col("markout")),
    })


def cost_verdict(rows: DataFrame, by: list[str], thin: int = 100, kill: float = 0.5) -> DataFrame:
    """per cell and multiple the medians and shares, and a verdict by fixed rules, the first that holds."""
    cell = [*by, "multiple"]
    each = stored(rows.select(*cell, "of_realized", "of_best", "cost", "cost_currency", "exceeds", "is_nonpositive"), "costs")
    places = {"of_realized": ((0.25, 0.5), ("p25", "median")), "of_best": ((0.5,), ("median_of_best",)), "cost": ((0.5,), ("median_cost_bp",)), "cost_currency": ((0.5,), ("median_cost_cents",))}
    shares = {n: F.avg(F.col(c).cast("double")) for c, n in (("exceeds", "exceeds_share"), ("is_nonpositive", "nonpositive_share"))}
    made = describe(each, cell, places, True, n=F.count(F.lit(1)), n_defined=F.count("of_realized"), **shares)
    made = made.withColumns({"median_cost_bp": 10_000 * F.col("median_cost_bp"), "median_cost_cents": 100 * F.col("median_cost_cents")})
    verdict = (
        F.when(F.col("n_defined") < thin, "too_thin").when(F.col("nonpositive_share") > 0.5, "mostly_nonpositive").when(F.col("median") >= 1, "cost_exceeds")
        .when(F.col("p25") >= kill, "lower_quartile_high").otherwise("lower_quartile_low")
    )
    return made.withColumn("verdict", verdict)


def impact(cache: DataFrame, keys: list[str], w: int, minute: str = "minute_index") -> DataFrame:
    """F16: relative midpoint change over the next ``w`` traded minutes per signed volume in them.

    Only minutes with trades, size and a midpoint take part.
    """
    order = Window.partitionBy(*keys).orderBy(minute)
    kept = cache.filter((F.col("n_trades") > 0) & (F.col("volume") > 0) & (F.col("tw_mid") > 0))
    rows = kept.withColumns({"move": ratio(F.lead("tw_mid", w).over(order) - F.col("tw_mid"), F.col("tw_mid")), "flow": F.sum("signed_volume").over(order.rowsBetween(0, w - 1))})
    return rows.withColumn("impact", ratio(F.col("move"), F.col("flow")))


def venue_frequency(quotes: DataFrame, sides: dict[str, str]) -> DataFrame:
    """rows of each venue on each side and their share of the side."""
    each = quotes.select(F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(c).alias("venue")) for n, c in sides.items()))).alias("x")).select("x.*")
    made = each.groupBy("side", "venue").agg(F.count(F.lit(1)).alias("n"))
    return made.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("side")))


def exchange_identity(quotes: DataFrame, by: list[str], bid_venue: str, ask_venue: str) -> DataFrame:
    """venues on each side and the share of two-sided quotes."""
    return quotes.groupBy(*by).agg(F.countDistinct(bid_venue).alias("bid_venues"), F.countDistinct(ask_venue).alias("ask_venues"), F.avg((F.col("bid").isNotNull() & F.col("ask").isNotNull()).cast("double")).alias("two_sided_share"))


def timestamp_quality(ticks: DataFrame, keys: list[str], clock: str = "ts_ns") -> DataFrame:
    """gaps of a clock in its own order: the least and the median of those above 0, the largest, and how many are 0."""
    gap = F.col(clock) - F.lag(clock).over(Window.partitionBy(*keys).orderBy(clock))
    rows = ticks.withColumn("gap", gap).filter("gap IS NOT NULL").withColumn("above", F.when(F.col("gap") > 0, F.col("gap")))
    return describe(rows, keys, {"above": ((0.5,), ("gap_median",))}, gap_min=F.min("above"), gap_max=F.max("gap"), n_zero=F.count(F.when(F.col("gap") == 0, 1)), n_gaps=F.count(F.lit(1)))


def order_agreement(ticks: DataFrame, keys: list[str], clock: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """neighbours in order of time and sequence: how many are tied in time, and in both."""
    w = Window.partitionBy(*keys).orderBy(clock, seq)
    rows = ticks.withColumns({"dt": F.col(clock) - F.lag(clock).over(w), "ds": F.col(seq) - F.lag(seq).over(w)}).filter("dt IS NOT NULL")
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), share(F.col("ds") < 0).alias("sequence_falls"), share(F.col("dt") == 0).alias("tied"), F.count(F.when((F.col("dt") == 0) & (F.col("ds") == 0), 1)).alias("n_repeated"))


def session_mismatch(ticks: DataFrame, keys: list[str], day: str, local_day: str) -> DataFrame:
    """ticks whose own local date is not that of the session they are filed under."""
    other = F.count(F.when(~F.col(day).eqNullSafe(F.col(local_day)), 1))
    return ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), other.alias("n_mismatch"), (other / F.count(F.lit(1))).alias("mismatch_share"))


def clock_latency(ticks: DataFrame, by: list[str], one: str, two: str) -> DataFrame:
    """time from clock ``one`` to clock ``two``: quantiles, extremes, and the share that is negative; null clocks are counted apart."""
    rows = ticks.withColumn("latency", F.col(two) - F.col(one))
    found = F.col("latency")
    negative = F.coalesce((found < 0).cast("double"), F.lit(0.0))
    places = {"latency": ((0.01, 0.25, 0.5, 0.75, 0.99), ("p01", "p25", "p50", "p75", "p99"))}
    return describe(rows, by, places, n_rows=F.count(F.lit(1)), n_missing=F.count(F.when(found.isNull(), 1)), min_ns=F.min(found), max_ns=F.max(found), share_negative=F.avg(negative))


def storage_order_census(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """share of neighbours, by an explicit position column, where time or sequence falls."""
    w = Window.partitionBy(*keys).orderBy(position)
    falls = lambda c: (F.col(c) < F.lag(c).over(w)).cast("double")
    made = rows.withColumns({"t": falls("ts_ns"), "s": falls("seq")})
    return made.groupBy(*keys).agg(F.count("t").alias("n_pairs"), F.avg("t").alias("time_falls"), F.avg("s").alias("seq_falls"))


def list_code_census(rows: DataFrame, codes: str, event: list[str]) -> DataFrame:
    """rows and events of every code in a list column; null lists count as code null."""
    each = rows.select(*event, F.explode_outer(F.array_distinct(codes)).alias("code"))
    fine = each.groupBy("code", *event).agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy("code").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_events"))


def code_combinations(rows: DataFrame, codes: str) -> DataFrame:
    """how often each combination of codes occurs."""
    return rows.groupBy(F.concat_ws("+", F.array_sort(F.array_distinct(codes)).cast("array<string>")).alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def ofi(quotes: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """order-flow increments of valid quotes (both prices positive, ask above bid), by event; of ``least`` valid quotes at least.

    A bid that holds or rises adds its change of size, one that falls takes the old size away; the ask
    likewise downwards, and is subtracted. The first quote's increment is 0. The positive share is of those that are not 0.
    """
    w = Window.partitionBy(*keys).orderBy("ts_ns", "seq")
    old = lambda c: F.lag(c).over(w)
    valid = quotes.filter((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") > F.col("bid")))
    bid = F.when(F.col("bid") >= old("bid"), F.col("bid_size") - old("bid_size")).otherwise(-old("bid_size"))
    ask = F.when(F.col("ask") <= old("ask"), F.col("ask_size") - old("ask_size")).otherwise(-old("ask_size"))
    rows = valid.withColumn("ofi", F.when(old("ts_ns").isNull(), 0).otherwise(bid - ask))
    moved = F.col("ofi") != 0
    made = rows.groupBy(*keys).agg(F.count("ofi").alias("n"), F.avg("ofi").alias("mean"), F.sum("ofi").alias("total"), F.max("ofi").alias("max"), F.avg(F.when(moved, (F.col("ofi") > 0).cast("double"))).alias("positive_share"))
    return made.filter(F.col("n") >= least)
