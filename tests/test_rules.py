"""Rules worked out by hand: zero sizes and prices, ties, edges of intervals, and plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import bars, bursts, calendar, features, inference, quotes, rates, returns, spine

D = dt.date
NS = 10**9


# ------------------------------------------------- zero sizes and prices


def test_bars_without_size(spark):
    trades = spark.createDataFrame([("a", D(2024, 1, 2), 570, 1, 1, 10.0, 0), ("a", D(2024, 1, 2), 571, 2, 2, 12.0, 5), ("a", D(2024, 1, 2), 572, 3, 3, 0.0, 0)], "ticker string, et_date date, et_min int, ts_ns long, seq long, price double, size long")
    sessions = spark.createDataFrame([("a", D(2024, 1, 2), 0, D(2024, 1, 2), 240, 570, 960, 1200)], "ticker string, event_date date, session_offset int, session_date date, pre_min int, open_min int, close_min int, post_min int")
    keys = ["ticker", "event_date"]
    made = bars.minute_bars(trades, sessions, keys)
    assert [r.vwap for r in made.orderBy("minute_index").collect()] == [None, 12.0, None]
    assert [r.vwap_running for r in bars.vwap_running(made, keys).orderBy("minute_index").collect()] == [None, 12.0, 12.0]
    r = bars.segment_shares(made.filter("minute_index = 330"), keys).first()
    assert (r.premarket_share, r.rth_share, r.post_share) == (None, None, None)
    assert bars.segment_shares(made, keys).first().rth_share == 1.0
    assert [r.path_share for r in bars.concentration_curve(made, keys).orderBy("minute_index").collect()] == [0, 1, 1]  # a price of 0 is no move
    assert bars.opportunity_decay(made, keys).count() == 3


def test_entries_without_size(spark):
    ticks = spark.createDataFrame([("a", 570, 1, 1, 10.0, 0), ("a", 570, 2, 2, 11.0, 0), ("a", 570, 3, 3, 12.0, 4), ("a", 570, 4, 4, 13.0, 1), ("b", 570, 1, 1, 0.0, 0)], "k string, et_min int, ts_ns long, seq long, price double, size long")
    got = {r.k: (r.entry_ns, r.entry_price) for r in features.entry_signal(ticks, ["k"], 0, 1440).collect()}
    assert got == {"a": (4, 13.0), "b": (None, None)}  # at 3 the price is the vwap itself
    out = features.barrier_exit(ticks, spark.createDataFrame([("b", 0, 0, 0.0)], "k string, entry_ns long, entry_seq long, entry_price double"), ["k"], 0.2, 10).first()
    assert (out.reason, out.ret) == ("stop", -0.2)


def test_minutes_without_volume_are_their_whole_length(spark):
    grid = spark.createDataFrame([("x", i, 0) for i in range(7)] + [("y", i, i) for i in range(3)], "k string, minute_index int, volume long")
    assert {r.k: r.minutes for r in bars.min_window_minutes(grid, ["k"], 0.5).collect()} == {"x": 7, "y": 1}


# ------------------------------------------------- bars and returns


def test_anchored_decay_is_signed(spark):
    rows = [("x", 0, None), ("x", 1, 8.0), ("x", 2, 14.0), ("x", 3, 20.0)]
    grid = spark.createDataFrame([(*r, 10.0, 20.0) for r in rows] + [("y", 0, 5.0, None, 9.0), ("z", 0, 5.0, 5.0, 5.0), ("w", 0, 5.0, 0.0, 9.0)], "k string, minute_index int, last_price double, anchor double, high double")
    got = {(r.k, r.minute_index): r for r in bars.anchored_decay(grid, ["k"], "anchor", "high").collect()}
    assert [got["x", i].realized for i in range(4)] == pytest.approx([0, math.log(0.8) / math.log(2), math.log(1.4) / math.log(2), 1])
    assert all(got[k, 0].realized is None and got[k, 0].is_undefined for k in "yzw")


def test_intervals_of_the_day(spark):
    minutes = [-5, 0, 329, 330, 360, 389, 390, 480, 600, 719, 720, 959, None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "i int, m int")
    got = [r.b for r in rows.select("i", returns.time_bin(F.col("m")).alias("b")).orderBy("i").collect()]
    pre, post = "premarket (04:00-09:30)", "post (16:00-20:00)"
    assert got == [pre, pre, pre, "open-10:30", "open-10:30", "open-10:30", "10:30-12:00", "12:00-14:00", "14:00-16:00", "14:00-16:00", post, post, None]


def test_polls_count_from_the_session_start(spark):
    s = 7 * NS  # not a whole number of intervals from the epoch
    sessions = spark.createDataFrame([("a", 10.0, s, s + 100 * NS, s + 200 * NS, s + 300 * NS), ("b", None, s, s, s, s), ("c", 10.0, s, s, s, s), ("d", 10.0, s, s, s, s)], "k string, anchor_price double, start_ns long, open_ns long, close_ns long, end_ns long")
    ticks = spark.createDataFrame([("a", s + 61 * NS, 1, 12.0), ("a", s + 60 * NS, 2, 11.0), ("a", s + 299 * NS + 1, 3, 20.0), ("b", s, 1, 5.0), ("d", s, 1, 5.0)], "k string, ts_ns long, seq long, price double")
    got = {(r.k, r.threshold, r.interval_s): r for r in returns.poll_resolve(ticks, sessions, ["k"], [1.1, 2.0], [0, 60, 90]).collect()}
    assert len(got) == 4 * 2 * 3
    seen = lambda *k: (got[k].seen_ns - s) / NS
    assert (seen("a", 1.1, 0), seen("a", 1.1, 60), seen("a", 1.1, 90)) == (60, 60, 90)
    assert (seen("a", 2.0, 60), got["a", 2.0, 60].segment, got["a", 2.0, 60].is_after_end) == (300, "post", True)
    assert got["a", 1.1, 60].segment == "premarket" and not got["a", 1.1, 60].is_after_end
    assert [got[k, 1.1, 0].reason for k in "abcd"] == [None, "no_reference", "no_ticks", "below_threshold"]
    assert got["b", 1.1, 0].never_crosses and got["d", 1.1, 60].seen_ns is None and got["d", 1.1, 60].segment is None


def test_nearest_integer_ratio_is_relative_to_itself(spark):
    closes = spark.createDataFrame([("x", 1.0, 0.485), ("y", 1.0, 3.1), ("z", 1.0, 0.0)], "k string, a double, b double")
    got = {r.k: r for r in returns.cross_session_extreme(closes, ["k"], [("a", "b")], 0.69, 20, 0.05).collect()}
    assert got["x"].nearest == "1/2" and got["x"].deviation == pytest.approx(0.03)
    assert got["y"].nearest == "3" and got["y"].deviation == pytest.approx(0.1 / 3) and "z" not in got
    other = returns.cross_session_extreme(spark.createDataFrame([("x", 1.0, 0.515)], "k string, a double, b double"), ["k"], [("a", "b")], 0.69, 20, 0.05).first()
    assert other.deviation == pytest.approx(0.03) and other.nearest == "1/2"


def test_local_background_of_bands(spark):
    tolerance, k_max, window = 0.05, 20, 0.18
    assert returns.touching(tolerance, k_max) == 10 and returns.touching(0.001, 20) is None
    w = math.log(1.05 / 0.95)
    bands = [(math.log(k) - w / 2, math.log(k) + w / 2) for k in range(2, k_max + 1)]
    inside = lambda x: any(a <= x <= b for a, b in bands)
    rng = np.random.default_rng(2)
    u = [*rng.uniform(0.4, 3.2, 400).tolist(), *(math.log(3) + rng.normal(0, 0.02, 60)).tolist()]
    rows = spark.createDataFrame([(x * (-1) ** i,) for i, x in enumerate(u)] + [(None,)], "log_ratio double")
    got = {r.k: r for r in returns.band_null(rows, k_max, tolerance, window).collect()}
    assert sorted(got) == list(range(2, 10))
    for k, r in got.items():
        c = math.log(k)
        grid = np.linspace(c - window, c + window, 400_001)
        free = 2 * window * (1 - np.any([(grid >= a) & (grid <= b) for a, b in bands], axis=0).mean())
        off = sum(c - window <= x <= c + window and not inside(x) for x in u)
        assert returns.off_band(k, tolerance, k_max, window) == pytest.approx(free, abs=1e-5)
        assert (r.observed, r.n_off) == (sum(abs(x - c) <= w / 2 for x in u), off)
        assert r.expected == pytest.approx(off / free * w, abs=0.02 + 1e-3 * off) and r.excess == pytest.approx(r.observed - r.expected)


# ------------------------------------------------- quotes


def test_order_flow_of_valid_quotes(spark):
    rows = [(1, 10.0, 11.0, 100, 50), (2, 10.5, 11.0, 30, 50), (3, 10.5, 10.4, 9, 9), (4, None, 11.0, 9, 9), (5, 10.2, 10.9, 40, 70), (6, 10.2, 10.9, 40, 70)]
    book = spark.createDataFrame([("a", *r[:1], *r) for r in rows] + [("b", 1, 1, 2.0, 1.0, 5, 5)], "k string, ts_ns long, seq long, bid double, ask double, bid_size long, ask_size long")
    got = {r.k: r for r in quotes.ofi(book, ["k"]).collect()}
    # a rising bid adds the difference of sizes, -70; then the bid falls (-30) and the ask falls by (70 - 50)
    assert got.keys() == {"a"} and (got["a"].n, got["a"].total, got["a"].max) == (4, -70 + (-30 - 20) + 0, 0)
    assert got["a"].positive_share == 0.0 and got["a"].mean == -120 / 4
    assert quotes.ofi(book, ["k"], least=5).count() == 0


def test_spells_by_state(spark):
    rows = [("a", t, t, *r) for t, r in enumerate([(1.0, 2.0, 1, 1), (2.0, 2.0, 1, 0), (2.0, 2.0, 1, None), (3.0, 2.0, 1, 1), (None, 2.0, 1, 1), (None, None, 0, 1), (1.0, 2.0, 0, 1)])]
    book = quotes.quote_states(spark.createDataFrame(rows, "k string, ts_ns long, seq long, bid double, ask double, bid_size long, ask_size long")).withColumn("duration_ns", F.lit(10))
    got = {r.state: (r.n, r.longest, r.total, r.p50) for r in quotes.state_runs(book, ["k"]).collect()}
    assert got == {"crossed": (1, 10, 10, 10.0), "locked": (1, 20, 20, 20.0), "null_price": (1, 20, 20, 20.0), "one_sided": (1, 10, 10, 10.0), "zero_bid": (1, 20, 20, 20.0), "zero_ask": (1, 20, 20, 20.0), "hard": (1, 30, 30, 30.0), "degraded": (2, 20, 30, 15.0)}
    r = quotes.state_census(book, ["k"]).first()
    assert (r.hard_time, r.degraded_time, r.clean_time) == pytest.approx((3 / 7, 3 / 7, 1 / 7)) and r.zero_bid_rows == pytest.approx(2 / 7)


def test_places_against_the_quote_overlap(spark):
    book = quotes.quote_states(spark.createDataFrame([("a", 10, 1, 1.0, 2.0, 1, 1), ("a", 20, 2, 3.0, 2.0, 1, 1)], "k string, ts_ns long, seq long, bid double, ask double, bid_size long, ask_size long"))
    trades = spark.createDataFrame([("a", t, i, p) for i, (t, p) in enumerate([(5, 1.0), (10, 1.0), (11, 2.0 + 1e-12), (12, 1.5), (13, 0.5), (14, 2.5), (25, 2.0)])], "k string, ts_ns long, seq long, price double")
    r = quotes.alignment_sweep(trades, book, ["k"], [0]).first()
    assert (r.n_trades, r.n_no_quote, r.n_unusable, r.n_at_or_inside, r.n_at_bid, r.n_at_ask, r.n_inside, r.n_below_bid, r.n_above_ask) == (7, 1, 1, 2, 1, 1, 1, 1, 1)


def test_gaps_of_a_clock(spark):
    ticks = spark.createDataFrame([("a", t, s) for t, s in [(10, 5), (10, 4), (13, 3), (20, 9), (20, 9)]] + [("b", 1, 1)], "k string, ts_ns long, seq long")
    r = quotes.timestamp_quality(ticks, ["k"]).collect()
    assert [(x.k, x.gap_min, x.gap_median, x.gap_max, x.n_zero, x.n_gaps) for x in r] == [("a", 3, 5.0, 7, 2, 4)]
    o = quotes.order_agreement(ticks, ["k"]).first()
    assert (o.n_pairs, o.sequence_falls, o.tied, o.n_repeated) == (4, 0.25, 0.5, 1)  # 5 -> 3 falls


# ------------------------------------------------- features


def ticks_of(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "k string, ts_ns long, seq long, price double, size long")


def test_signs_start_upwards(spark):
    got = [(r.sign, r.cvd) for r in features.cvd(ticks_of(spark, [(1, 1, 5.0, 3), (2, 2, 5.0, 4), (3, 3, 4.0, 10), (4, 4, 4.0, 1)]), ["k"]).orderBy("seq").collect()]
    assert got == [(1, 3), (1, 7), (-1, -3), (-1, -4)]
    later = [r.cvd for r in features.cvd(ticks_of(spark, [(1, 1, 5.0, 3), (2, 2, 5.0, 4)]), ["k"], counts_first=False).orderBy("seq").collect()]
    assert later == [0, 4]
    assert features.cvd(ticks_of(spark, [(1, 1, 5.0, 3)]), ["k"]).first().cvd == 0


def test_a_single_tick_has_no_intensity(spark):
    r = features.hawkes_intensity(ticks_of(spark, [(1, 1, 5.0, 3)]), ["k"], 0.5, 1.0, 5.0).first()
    assert (r.intensity, r.step) == (0.0, 0.0)


def test_stop_in_the_nanosecond_of_the_entry(spark):
    ticks = ticks_of(spark, [(10, 1, 90.0, 1), (10, 2, 100.0, 1), (10, 3, 70.0, 1), (11, 4, 150.0, 1)])
    entry = spark.createDataFrame([("a", 10, 2, 100.0)], "k string, entry_ns long, entry_seq long, entry_price double")
    r = features.barrier_exit(ticks, entry, ["k"], 0.2, 50).first()
    assert (r.reason, r.exit_ns, r.ret, r.best) == ("stop", 10, -0.2, 0.0) and r.worst == pytest.approx(-0.3)


def scan(times, alpha, beta, cap):
    gaps = np.maximum(np.diff(times), 1e-9)
    live = gaps[gaps <= cap]
    mu, s, out = (len(live) + 1) / max(live.sum() if len(live) else 1e-6, 1e-6), 0.0, []
    for g in [None, *gaps]:
        if g is not None:
            s = s * (math.exp(-beta * g) if g <= cap else 1.0) + 1
        out.append(mu + alpha * s)
    return np.array(out)


def test_forward_targets_follow_their_windows(spark):
    rng = random.Random(6)
    base = 1_704_200_400 * NS  # 08:00 in New York, 2 January 2024
    rows = []
    for k, n in (("many", 60), ("few", 9), ("short", 14)):
        times = sorted(rng.uniform(0, 1800 if k != "short" else 1.0) for _ in range(n)) if k != "short" else [*(x / 2 for x in range(4)), *(1000 + x for x in range(10))]
        rows += [(k, base + 6300 * NS + int(t * NS), i, 10 + rng.uniform(-1, 1)) for i, t in enumerate(times)]
    rows += [("many", base + 6299 * NS, -1, 99.0), ("many", base + 6300 * NS + 900 * NS, 900, 12.5), ("many", base + 6300 * NS + 900 * NS + 1, 901, 99.0)]
    df = spark.createDataFrame(rows, "k string, ts_ns long, seq long, price double").withColumn("et_min", F.floor((F.col("ts_ns") - base) / (60 * NS)).cast("int") + 480)
    at = 9 * 3600 + 45 * 60
    got = {r.k: r for r in features.forward_targets(df, ["k"], at, at + 600, at + 900, at + 1800, 0.5, 2.0, 5.0).collect()}
    assert got.keys() == {"many", "short"}  # nine ticks are too few
    own = sorted((t, s, p) for k, t, s, p in rows if k == "many" and t >= base + 6300 * NS)
    ref = own[0][2]
    first, hold = ([p / ref - 1 for t, _, p in own if t <= base + (6300 + s) * NS] for s in (600, 900))
    r = got["many"]
    assert (r.best, r.worst, r.ret) == pytest.approx((max(first), min(first), hold[-1])) and hold[-1] == pytest.approx(12.5 / ref - 1)
    assert r.efficiency == pytest.approx(abs(max(first) / min(first)))
    times = np.array([(t - own[0][0]) / NS for t, _, _ in own if t <= base + 7200 * NS])
    lam = scan(times, 0.5, 2.0, 5.0)
    assert r.intensity_area == pytest.approx((np.minimum(np.diff(times), 5.0) * (lam[1:] + lam[:-1]) / 2).sum(), rel=1e-6)
    assert (r.intensity_mean, r.intensity_max) == pytest.approx((lam.mean(), lam.max()), rel=1e-6)
    short = got["short"]  # four ticks within ten minutes, none to fifteen but those: no excursions, no return, no intensity
    assert (short.best, short.efficiency, short.ret, short.intensity_area) == (None, None, None, None)


def curvature(times, y, step, window):
    """On a grid from the first tick, least squares over the greatest odd window that fits, then back on the ticks."""
    n = len(times)
    if n < 10 or int((times[-1] - times[0]) / step) + 1 < 5:
        return [0.0] * n
    grid = times[0] + step * np.arange(math.ceil((times[-1] - times[0]) / step) + 1)
    on = np.interp(grid, times, y)
    size = min(window, len(grid))
    size -= 1 - size % 2
    half = size // 2
    mid = np.clip(np.arange(len(grid)), half, len(grid) - 1 - half)
    c = np.array([2 * np.polyfit(np.arange(-half, half + 1), on[m - half : m + half + 1], 2)[0] for m in mid])
    return np.interp(times, grid, c).tolist()


@pytest.mark.parametrize("seconds", [3, 6, 7, 12, 13, 30, 31, 75])
def test_curvature_equals_a_fit(spark, seconds):
    rng = np.random.default_rng(seconds)
    times = np.unique(np.concatenate([[0, seconds * NS - (seconds % 2) * NS // 3], rng.integers(0, seconds * NS - NS, 25)]))
    y = rng.normal(0, 50, len(times)).cumsum().round()
    rows = [("a", int(5 * NS + t), i, float(v)) for i, (t, v) in enumerate(zip(times, y, strict=True))] + [("b", t, t, 1.0) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, ts_ns long, seq long, cvd double")
    got = features.cvd_convexity(df, ["k"], 1, 31).orderBy("k", "seq").collect()
    assert [r.convexity for r in got if r.k == "b"] == [0.0] * 5
    assert [r.convexity for r in got if r.k == "a"] == pytest.approx(curvature(times / NS, y, 1.0, 31), abs=1e-6)


# ------------------------------------------------- bursts


def test_ties_count_from_the_second_print(spark):
    ticks = spark.createDataFrame([("a", t, 1) for t in (1, 1, 1, 4, 9, 9)] + [("b", 1, 1)], "k string, ts_ns long, size long")
    got = {r.k: r for r in bursts.tie_structure(ticks, ["k"]).collect()}
    assert (got["a"].tied_share, got["a"].n_stamps, got["a"].longest_tie, got["a"].min_gap_ns) == (3 / 5, 3, 3, 3)
    assert (got["b"].tied_share, got["b"].n_stamps, got["b"].min_gap_ns) == (0.0, 1, None)


def test_a_gap_at_the_limit_does_not_break(spark):
    ticks = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 5, 10, 16])], "k string, ts_ns long, seq long")
    r = bursts.sweep_runs(ticks, ["k"], 5).first()
    assert (r.n_runs, r.mean, r.size_biased, r.largest) == (2, 2.0, 10 / 4, 3)


def test_staying_under_a_level(spark):
    rows = [("never above", t, v) for t, v in [(0, 1.0), (5, 2.0)]] + [("falls", t, v) for t, v in [(0, 9.0), (3, 2.0), (6, 5.0), (8, 2.0), (9, 1.0)]] + [("stays above", t, v) for t, v in [(0, 1.0), (4, 3.0)]]
    df = spark.createDataFrame([(*r, 2.0) for r in rows], "k string, t long, v double, level double")
    got = {r.k: (r.elapsed, r.never_reached) for r in bursts.sustained_crossing(df, ["k"], "t", "v", "level").collect()}
    assert got == {"never above": (0, False), "falls": (8, False), "stays above": (None, True)}  # at the level is not above
    late = bursts.sustained_crossing(df.withColumn("start", F.lit(6)), ["k"], "t", "v", "level", "start").collect()
    assert {r.k: (r.elapsed, r.never_reached) for r in late} == {"falls": (2, False)}


def test_decay_to_fractions_and_multiples(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in [(0, 1.0), (10, 8.0), (12, 4.0), (15, 5.0), (20, 4.0), (30, 2.0), (40, 3.0)]], "k string, t long, v double")
    base = spark.createDataFrame([("a", 2.0, 25)], "k string, baseline double, at long")
    r = bursts.decay_times(df, ["k"], "t", "v", [0.5, 0.25], [2, 1], base, base).first()
    assert (r.peak_at, r.top, r.decay_0, r.decay_1, r.decay_1_never) == (10, 8.0, 10, None, True)
    assert (r.terminal_0, r.terminal_0_never, r.terminal_1, r.terminal_1_never, r.origin_to_peak) == (10, False, None, True, -15)
    none = bursts.decay_times(df, ["k"], "t", "v", [0.5], [1], spark.createDataFrame([("a", 0.0)], "k string, baseline double")).first()
    assert none.terminal_0 is None and none.terminal_0_never


def test_events_without_intervals_agree(spark):
    none = spark.createDataFrame([], "k string, start_ns long, end_ns long")
    one = spark.createDataFrame([("x", 0, 5)], none.schema)
    events = spark.createDataFrame([("x",), ("y",)], "k string")
    assert {r.k: r.jaccard for r in bursts.interval_jaccard(one, none, ["k"], events).collect()} == {"x": 0.0, "y": 1.0}


def test_a_side_that_never_changes_has_no_correlation(spark):
    flat = [("y", i, 1) for i in range(1, 8)] + [("x", 1, i) for i in range(1, 8)] + [("few", 1, 1)] + [("up", i, 2 * i) for i in range(1, 8)]
    got = {r.k: r for r in bursts.count_dependence(spark.createDataFrame(flat, "k string, x long, y long"), "x", "y", ["k"]).collect()}
    assert math.isnan(got["y"].rank_correlation) and got["y"].slope == 0 and math.isnan(got["x"].rank_correlation) and math.isnan(got["x"].slope)
    assert (got["few"].rank_correlation, got["few"].slope) == (None, None)
    assert math.isclose(got["up"].rank_correlation, 1) and math.isclose(got["up"].slope, 1)


def test_just_above_the_cutoff(spark):
    rows = spark.createDataFrame([("g", "ok", 1.0), ("g", "ok", 1.05), ("g", "ok", 0.99), ("g", "ok", 1.1), ("g", "ok", None), ("g", "bad", 1.01)], "k string, status string, v double")
    r = bursts.near_cutoff(rows, ["k"], "status", "v", 1.0, 0.1).first()
    assert (r.n, r.n_near, r.near_share) == (4, 2, 0.5)


def test_a_group_without_fine_events_stays_at_the_cutoff(spark):
    rows = spark.createDataFrame([("g", "bad", 1.0), ("h", "ok", 1.0), (None, "ok", 0.0)], "k string, status string, v double")
    got = {r.k: r[1:] for r in bursts.near_cutoff(rows, ["k"], "status", "v", 1.0, 0.1).collect()}
    assert got == {"g": (0, 0, None), "h": (1, 1, 1.0), None: (1, 0, 0.0)}


def test_every_event_counts_at_the_cutoff(spark):
    """Events of any status, reason and side, and those without a value; the share above is that of the fine ones."""
    known = [("ok", "none", 1.0), ("ok", "none", 0.95), ("ok", "price", 1.05), ("ok", "price", 1.5), ("ok", "price", None)]
    rows = [("g", *r) for r in known] + [("g", "few", "prints", 0.95), ("g", "few", "prints", None), ("h", "few", "prints", 1.05), (None, "ok", "none", 1.0)]
    got = bursts.near_cutoff_parts(spark.createDataFrame(rows, "k string, status string, reason string, v double"), ["k"], "status", "reason", "v", 1.0, 0.1)
    names = ("k", "status", "reason", "n", "n_within", "within_share", "n_ok", "n_near", "near_share")
    assert {tuple(r[c] for c in names) for r in got.collect()} == {
        ("g", "ok", "none", 2, 2, 1.0, 4, 2, 0.5), ("g", "ok", "price", 3, 1, 1 / 3, 4, 2, 0.5), ("g", "few", "prints", 2, 1, 0.5, 4, 2, 0.5),
        ("h", "few", "prints", 1, 1, 1.0, 0, 0, None), (None, "ok", "none", 1, 1, 1.0, 1, 1, 1.0),
    }


def gridded(ts, start, minutes, rate, grid_s, window_s, on, off, floor, merge_s, dwell_s):
    if not len(ts):
        return []
    grid = np.arange(start, start + minutes * 60 * NS + grid_s * NS, grid_s * NS)
    half = window_s * NS // 2
    n = np.searchsorted(ts, grid + half, "left") - np.searchsorted(ts, grid - half, "left")
    base = np.maximum(rate[np.clip((grid - start) // (60 * NS), 0, minutes - 1)], floor)
    z = np.log(n / (window_s / 60) + 1e-9) - np.log(base + 1e-9)
    spans, now = [], False
    for at, v in zip(grid, z, strict=True):
        before, now = now, (v >= math.log(off) if now else v >= math.log(on))
        if now and not before:
            spans.append([at, at])
        elif now:
            spans[-1][1] = at
    merged = []
    for a, b in spans:
        if merged and (a - merged[-1][1]) / NS < merge_s:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        i, j = np.searchsorted(ts, a, "left"), np.searchsorted(ts, b, "right") - 1
        if (b - a) / NS >= dwell_s and j >= i:
            out.append((int(a), int(b), int(i), int(j), int(ts[i]), int(ts[j]), int(j - i + 1)))
    return out


@pytest.mark.parametrize("grid_s", [20, 37])
def test_bursts_on_a_grid_equal_a_loop(spark, grid_s):
    rng = np.random.default_rng(9)
    sessions, ticks, rates, want = [], [], [], {}
    for k, parts in {"dense": [(0, 1800, 30), (1800, 2400, 400), (2400, 3600, 40)], "two": [(0, 3600, 30), (300, 500, 200), (560, 700, 150), (2000, 2030, 90)], "quiet": [(0, 3600, 60)], "void": []}.items():
        start, minutes = 1000 * NS + 3, 60
        ts = np.sort(np.concatenate([rng.integers(a * NS, b * NS, n) for a, b, n in parts] or [np.zeros(0, int)])) + start
        ts[5:8] = ts[5] if len(ts) else 0
        ts = np.sort(ts)
        rate = rng.uniform(0.0, 2.0, minutes)
        sessions.append((k, start, minutes))
        ticks += [(k, int(t), i) for i, t in enumerate(ts)]
        rates += [(k, m, float(r)) for m, r in enumerate(rate)]
        want[k] = gridded(ts, start, minutes, rate, grid_s, 120, 6.0, 2.0, 0.5, 60, 90)
    got = bursts.grid_bursts(
        spark.createDataFrame(ticks, "k string, ts_ns long, seq long"), spark.createDataFrame(sessions, "k string, start_ns long, minutes long"), spark.createDataFrame(rates, "k string, minute_index long, rate_floored double"),
        ["k"], grid_s, 120, 6.0, 2.0, 0.5, 60, 90,
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append((r.grid_start_ns, r.grid_end_ns, r.start_index, r.end_index, r.start_ns, r.end_ns, r.n_prints))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
    assert len(want["dense"]) == 1 and want["two"]


def test_rates_at_grid_points(spark):
    rng = np.random.default_rng(12)
    h, dx, span = 2.0, 0.7, 30.0
    times = np.sort(rng.integers(0, int(span * 1000), 60)) / 1000
    grid = np.arange(0, span + dx, dx)
    n = np.histogram(times, np.append(grid - dx / 2, grid[-1] + dx / 2))[0]
    half = math.ceil(4 * h / dx)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) * dx / h) ** 2)
    want = np.convolve(n, k)[half : half + len(grid)] / (np.convolve(np.ones(len(grid)), k)[half : half + len(grid)] * dx)
    ticks = spark.createDataFrame([("a", int(round(t * 1000)) * 10**6) for t in times], "k string, ts_ns long")
    bounds = spark.createDataFrame([("a", 0, int(span * NS))], "k string, start_ns long, end_ns long")
    got = [r.rate for r in rates.kernel_intensity(ticks, bounds, ["k"], h, dx).orderBy("cell").collect()]
    assert got == pytest.approx(want.tolist())


# ------------------------------------------------- spine and calendar


def test_bad_denominators_keep_the_unknown(spark):
    rows = spark.createDataFrame([(None, 5.0), (None, 500.0), (0.5, None), (9.0, 5.0), (9.0, None)], "p double, m double")
    assert [r.b for r in rows.select(spine.bad_denominator(F.col("p"), F.col("m"), 1, 500).alias("b")).collect()] == [None, True, True, False, None]


def test_match_labels_of_folder_candidates(spark):
    day = D(2024, 1, 2)
    events = spark.createDataFrame([(k, day, 55.5) for k in "abcdefgh"] + [("a", D(2024, 1, 3), 55.5)], "ticker string, event_date date, magnitude double")
    rows = [("a", day, "55.5", True, True), ("b", day, "55.50", True, True), ("b", day, "55.50", True, True), ("c", day, "55.50", True, False), ("d", day, "55.50", False, True), ("e", day, "55.50", False, False), ("f", day, "55.50", True, True), ("h", day, "55.50", True, True), ("h", day, "60.00", True, True)]
    folders = spark.createDataFrame(rows, "ticker string, event_date date, magnitude_text string, has_trades boolean, has_quotes boolean")
    got = {(r.ticker, r.event_date.day): r.match for r in spine.classify_match(events, folders).collect()}
    assert got == {("a", 2): "format_mismatch", ("a", 3): "folder_absent", ("b", 2): "duplicate_collision", ("c", 2): "missing_quotes", ("d", 2): "missing_trades", ("e", 2): "missing_both", ("f", 2): "unexpected_both_present", ("g", 2): "folder_absent", ("h", 2): "format_mismatch"}
    more = spark.createDataFrame([("a", day, "55.5", True, True), ("z", day, "1.00", True, True), ("a", None, "1", True, True), ("a", day, "x", True, True)], folders.schema)
    twice = events.unionByName(events.filter("ticker = 'b'"))
    assert [r.match for r in spine.classify_folders(more, twice).orderBy("ticker", "magnitude_text").collect()] == ["none_date_unresolved", "matched", "unparseable", "orphan"]
    assert {r.match for r in spine.classify_folders(folders.filter("ticker = 'b'"), twice).collect()} == {"ambiguous"}


def test_matches_without_a_date(spark):
    events = spark.createDataFrame([("a", D(2024, 1, 2), 5.004), ("b", None, 7.0), ("c", D(2024, 1, 2), 1.0), ("c", None, 1.0)], "ticker string, event_date date, magnitude double")
    folders = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 1.0), ("a", 7.0)], "ticker string, magnitude double")
    got = {(r.ticker, r.magnitude): (r.match, r.n_hits, r.found_date) for r in spine.match_by_magnitude(folders, events).collect()}
    assert got == {("a", 5.0): ("matched_valid_date", 1, D(2024, 1, 2)), ("b", 7.0): ("matched_null_date", 1, None), ("c", 1.0): ("multiple_matches", 2, None), ("a", 7.0): ("no_match_found", 0, None)}


def test_groups_of_equal_size(spark):
    for n, groups in ((23, 10), (7, 10), (20, 10)):
        rows = spark.range(n).select("id", (F.col("id") * 1.0).alias("v"))
        got = {r.id: r.group for r in inference.decile_sample(rows, "v", ["id"], groups, 1000, 1).collect()}
        want = [g for g, part in enumerate(np.array_split(np.arange(n), groups), 1) for _ in part]
        assert [got[i] for i in range(n)] == want


def test_recomputed_magnitudes(spark):
    rows = spark.createDataFrame([(10.0, 15.0, 50.0), (10.0, 15.0, 49.0), (None, 15.0, 50.0), (0.0, 15.0, 50.0), (10.0, 90.0, 800.0)], "prior_close double, high double, magnitude double")
    got = [(r.mismatch, r.is_mismatch, r.is_junk) for r in spine.magnitude_recompute_check(rows, 500, 0.01).collect()]
    assert got == [(0.0, False, False), (1.0, True, True), (None, False, False), (None, False, True), (0.0, False, True)]


def test_missing_sessions_by_the_skipped_calendar(spark):
    rows = spark.createDataFrame([("a", o, D(2024, 1, 10 + o)) for o in (-2, -1, 0, 1)], "k string, session_offset int, session_date date")
    skipped = spark.createDataFrame([(D(2024, 1, 8),), (D(2024, 1, 10),)], "session_date date")
    got = spine.set_diff_window(rows, rows.filter("session_offset = 1"), ["k"], skipped).collect()
    assert {r.session_offset: r.place for r in got} == {-2: "flanking", -1: "outer", 0: "event_day"}


def test_flags_clear_by_the_sides_asked_for(spark):
    flags = spark.createDataFrame([(k, True) for k in "abcd"], "k string, is_flagged boolean")
    manifest = spark.createDataFrame([("a", "trades"), ("b", "trades"), ("b", "quotes"), ("c", "trades")], "k string, side string")
    ledger = spark.createDataFrame([("a", "trades", "ok"), ("b", "trades", "ok"), ("b", "quotes", "failed"), ("c", "trades", "failed"), ("c", "trades", "ok"), ("d", "trades", "ok")], "k string, side string, status string")
    got = {r.k: r.is_flagged for r in spine.clear_repaired_flags(flags, manifest, ledger, ["k"]).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True}


def test_basis_of_two_ratios(spark):
    rows = spark.createDataFrame([("x", True, 0.5, 0.505), ("x", True, 0.5, 0.6), ("y", False, None, 1.0), ("z", False, 1.0, 1.0), ("w", False, 1.0, None), ("w", False, None, None)], "t string, f boolean, a double, b double")
    r = spine.basis_agreement(rows, "a", "b").first()
    assert (r.n_both, r.n_agree, r.passes) == (3, 2, False) and r.agree_pct == pytest.approx(200 / 3)
    got = {r.t: (r.n_events, r.n_values, r.is_stable) for r in spine.basis_stability(rows, "t", "a", "b").collect()}
    assert got == {"x": (2, 4, False), "w": (2, 1, None)}
    f = {r.f: (r.n, r.over_pct, r.near_pct) for r in spine.basis_factors(rows, "f", "a", "b").collect()}
    assert f == {True: (4, 0.0, 75.0), False: (4, 0.0, 100.0)}


def test_causes_of_gaps(spark):
    rows = [("bars", 1.0, 1.2, 12.0, 10.0, 50, 3, 0.1), ("gap", 1.0, 1.2, 12.0, 10.0, 100, 13, 0.1), ("no evidence", 1.0, 1.2, 12.0, 10.0, 100, 10, 0.1), ("margin", 1.0, 1.05, 9.0, 10.0, 50, 10, 0.5), ("margin but higher", 1.0, 1.05, 12.0, 10.0, 50, 10, 0.5), ("far", 1.0, 1.09, 9.0, 10.0, 100, 1, 0.1), ("unknown", None, 1.05, 9.0, 10.0, 100, 1, 0.1)]
    df = spark.createDataFrame([("c", *r) for r in rows], "cohort string, k string, ratio_one double, ratio_two double, reported_high double, day_high double, rth_bars int, longest_gap int, outside_share double")
    medians = spark.createDataFrame([("c", 100.0, 10.0, 0.1)], "cohort string, median_rth_bars double, median_longest_gap double, median_outside_share double")
    got = {r.k: r.cause for r in spine.gap_cause(df, medians, ["cohort"]).collect()}
    assert got == {"bars": "coverage_gap", "gap": "coverage_gap", "no evidence": "unexplained", "margin": "band_margin", "margin but higher": "unexplained", "far": "unexplained", "unknown": "unexplained"}


def test_classes_of_the_reference(spark):
    reference = spark.createDataFrame([("a", "CS", True, None, 2), ("a", "OLD", False, D(2020, 1, 1), 1), ("b", "CS", False, D(2023, 1, 1), 1), ("b", "CS", False, D(2023, 1, 2), 1), ("c", "XX", False, D(2023, 1, 1), 1)], "ticker string, code string, active boolean, delisted date, as_of int")
    events = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", D(2023, 1, 2)), ("c", D(2022, 1, 1)), ("c", D(2023, 1, 2)), ("d", D(2023, 1, 2))], "ticker string, event_date date")
    tickers = spark.createDataFrame([("a", "common"), ("b", "warrant"), ("c", "common"), ("d", "common")], "ticker string, rule_class string")
    rows = spine.class_from_reference(tickers, reference, {"CS": ("common_stock", True)}, events, {"common": ("common_stock",)}).collect()
    got = {r.ticker: (r["class"], r.in_scope, r.agrees, r.ticker_reuse) for r in rows}
    assert got == {"a": ("common_stock", True, True, False), "b": ("common_stock", True, None, False), "c": ("other", False, False, True), "d": ("unresolved", False, None, False)}


def test_gap_labels(spark):
    rows = [([1, 2], False, False, "forward_missing"), ([-3], False, None, "backward_missing"), ([0], False, False, "both_sides"), ([0, 1], False, False, "both_sides"), ([-1, 1], False, False, "both_sides"), ([], False, False, "unclassified"), ([1], True, False, "archive_edge"), ([], True, True, "calendar_residue"), ([-3, -2, -1, 0, 1, 2, 3], False, False, "both_sides")]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, missing array<int>, edge boolean, residue boolean")
    got = [r.l for r in df.select("i", calendar.gap_label(F.col("missing"), F.col("edge"), F.col("residue")).alias("l")).orderBy("i").collect()]
    assert got == [r[3] for r in rows]
    sessions = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 1, 3)), ("b", D(2024, 1, 9))], "k string, session_date date")
    seen = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 8),)], "session_date date")
    assert {r.k: r.is_edge for r in calendar.archive_edge(sessions, seen, ["k"]).collect()} == {"a": False, "b": True}


def test_signatures_of_seen_sessions(spark):
    seen = spark.createDataFrame([("a", D(2024, 1, 4)), ("a", D(2024, 1, 9))], "ticker string, session_date date")
    rows = [("a", D(2024, 1, 9), "forward_missing", D(2024, 1, 4)), ("a", D(2024, 1, 8), "forward_missing", D(2024, 1, 3)), ("a", D(2024, 1, 8), "backward_missing", D(2024, 1, 3)), ("a", D(2024, 1, 9), "backward_missing", D(2024, 1, 4)), ("b", D(2024, 1, 9), "forward_missing", D(2024, 1, 4))]
    got = calendar.seen_signature(spark.createDataFrame(rows, "ticker string, event_date date, label string, first_expected date"), seen).collect()
    assert sorted((r.ticker, r.event_date.day, r.label[:3], r.is_last_seen, r.is_listing) for r in got) == [("a", 8, "bac", False, True), ("a", 8, "for", False, False), ("a", 9, "bac", False, False), ("a", 9, "for", True, False), ("b", 9, "for", False, False)]


def test_coverage_of_regular_hours(spark):
    rows = [("x", "premarket", 10, 6), ("x", "rth", 330, 1), ("x", "rth", 340, 2), ("x", "post", 900, 3), ("y", "post", 800, 4)]
    got = {r.k: r for r in calendar.coverage_stats(spark.createDataFrame(rows, "k string, segment string, minute_index int, n_trades long"), ["k"]).collect()}
    assert (got["x"].rth_bars, got["x"].longest_gap, got["x"].outside_share, got["x"].first_minute) == (2, 9, 0.75, 10)
    assert (got["y"].rth_bars, got["y"].longest_gap, got["y"].outside_share) == (0, 0, 1.0)
