"""Operators on hand-made rows: nulls, ties, clock changes, brute force."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import clock, frames
from tidegrid.operators import bars, bursts, calendar, features, inference, quotes, returns, spine

D = dt.date


def ns(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp()) * 10**9


def test_clock_follows_dst(spark):
    rows = spark.createDataFrame([(ns("2024-03-10T06:59:00"),), (ns("2024-03-10T07:00:00"),), (ns("2024-11-03T05:59:00"),), (ns("2024-11-03T06:00:00"),), (-1,)], "ts_ns long")
    got = calendar.with_local(rows).orderBy("ts_ns").collect()
    assert [(r.local_date, r.local_min) for r in got] == [(D(1969, 12, 31), 1139), (D(2024, 3, 10), 119), (D(2024, 3, 10), 180), (D(2024, 11, 3), 119), (D(2024, 11, 3), 60)]
    back = rows.filter("ts_ns > 0").limit(2).select("ts_ns", clock.local_to_ns(clock.local_us(F.col("ts_ns"))).alias("b")).collect()
    assert all(r.ts_ns == r.b for r in back)


def test_clock_ignores_the_session_zone(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-05 12:00:00' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = rows.select(clock.epoch_us(F.col("ts")).alias("us")).withColumn("l", clock.minute_of(clock.local_us(F.col("us") * 1000))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (got.us, got.l) == (ns("2024-01-05T12:00:00") // 1000, 7 * 60)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_keeps_every_left_row(spark, strict):
    left = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 1, 3), (None, 9, 4), ("a", 5, 5)], "k string, t long, id long")
    right = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 5, 2, 11.0), ("a", 3, 9, 9.0), (None, 1, 1, 8.0), ("c", 0, 0, 7.0)], "k string, t long, seq long, v double")
    got = {r.id: r.r_v for r in frames.asof_join(left, right, ["k"], "t", seq="seq").collect()} if not strict else {r.id: r.r_v for r in frames.asof_join(left, right, ["k"], "t", seq="seq", strict=True).collect()}
    assert got == ({1: 9.0, 2: 11.0, 3: None, 4: None, 5: 9.0} if strict else {1: 11.0, 2: 11.0, 3: None, 4: None, 5: 11.0})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 17])
def test_rank_buckets_equal_quantile_cuts(spark, n):
    import pandas as pd

    got = [r.bucket for r in frames.rank_buckets(spark.range(n), ["id"], 5).orderBy("id").collect()]
    want = [1] if n == 1 else [int(x) + 1 for x in pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False)]
    assert got == want


def test_global_rank_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(v, i) for i, v in enumerate([5.0] * 200 + [None, None] + [float(x % 17) for x in range(300)])], "v double, i int")
    got = frames.global_rank(rows, ["v", "i"], 8).collect()
    want = {i: n + 1 for n, (_, i) in enumerate(sorted(((r.v is not None, r.v or 0.0), r.i) for r in got))}
    assert {r.i: r.rank for r in got} == want and {r.total for r in got} == {502}
    assert frames.global_rank(rows.limit(0), ["v", "i"]).collect() == []


def test_spine_ends_at_the_calendar(spark):
    days = spark.createDataFrame([(D(2024, 1, d), 570, 780 if d == 4 else 960, d == 4) for d in (2, 3, 4)], "session_date date, open_min int, close_min int, is_early_close boolean")
    events = spark.createDataFrame([("x", D(2024, 1, 2)), ("y", D(2024, 1, 4)), ("z", D(2024, 1, 6))], "ticker string, event_date date")
    got = {(r.ticker, r.session_offset): r.post_min for r in calendar.session_spine(events, days, range(-3, 4)).collect()}
    assert got == {("x", 0): 1200, ("x", 1): 1200, ("x", 2): 1020, ("y", -2): 1200, ("y", -1): 1200, ("y", 0): 1020}


def test_quote_states_of_nulls(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 1, 1), (2.0, 2.0, 1, 1), (3.0, 2.0, 1, 1), (None, 2.0, 1, 1), (None, None, 1, 1), (0.0, 1.0, 1, 1), (1.0, 2.0, 0, None)], "bid double, ask double, bid_size long, ask_size long")
    got = quotes.quote_states(rows).collect()
    assert [r.is_hard for r in got] == [False, False, True, True, True, True, False]
    assert [r.is_degraded for r in got] == [False, True, False, True, False, False, True]
    assert got[3].is_crossed is None


def test_forward_fill_and_shares(spark):
    grid = spark.createDataFrame([("x", i, v, p) for i, (v, p) in enumerate([(0, None), (5, 10.0), (0, None), (5, 20.0), (10, 25.0)])], "k string, minute_index int, volume long, last_price double")
    assert [r.filled for r in bars.forward_fill(grid, ["k"]).orderBy("minute_index").collect()] == [None, 10.0, 10.0, 20.0, 25.0]
    curve = bars.concentration_curve(grid, ["k"]).orderBy("minute_index").collect()
    assert [r.volume_share for r in curve] == [0, 0.25, 0.25, 0.5, 1]
    assert [r.path_share for r in curve] == [0, 0, 0, 0, 1]  # only a print right after a minute with one moves


@pytest.mark.parametrize("volumes", [[1], [5, 0, 0, 5], [0, 3, 1, 1, 9, 1, 0, 2], [2] * 9])
@pytest.mark.parametrize("fraction", [0.3, 0.5, 1.0])
def test_shortest_window(spark, volumes, fraction):
    grid = spark.createDataFrame([("x", i, v) for i, v in enumerate(volumes)], "k string, minute_index int, volume long")
    want = min(j - i + 1 for i in range(len(volumes)) for j in range(i, len(volumes)) if sum(volumes[i : j + 1]) >= fraction * sum(volumes))
    assert bars.min_window_minutes(grid, ["k"], fraction).first().minutes == want


def test_crossing_never(spark):
    rows = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 1.2), ("y", 0, 5.0)], "ticker string, minute_index int, high double")
    anchor = spark.createDataFrame([("x", 1.0)], "ticker string, anchor_price double")
    got = {r.ticker: r for r in returns.detect_crossing(rows, anchor, ["ticker"], 1.5).collect()}
    assert got["x"].never_reaches and not got["x"].is_undefined
    assert got["y"].is_undefined and not got["y"].never_reaches


def test_log_parts_add_up(spark):
    bars_of = "k string, session_offset int, segment string, minute_index int, first_price double, last_price double"
    rows = [("x", -1, "rth", 700, 1.0, 2.0), ("x", -1, "post", 800, 2.0, 3.0), ("x", 0, "premarket", 10, 4.0, 4.0), ("x", 0, "rth", 330, 5.0, 6.0), ("x", 0, "rth", 331, 6.0, 9.0)]
    rows += [("y", -1, "rth", 700, 1.0, 8.0), ("y", 0, "rth", 331, 5.0, 6.0), ("z", -1, "rth", 700, 1.0, 8.0), ("z", 0, "premarket", 10, 4.0, 4.0)]
    got = {r.k: r for r in returns.log_decomposition(spark.createDataFrame(rows, bars_of), ["k"]).collect()}
    r = got["x"]  # the open is the last price at or before minute 330
    assert (r.prior_post, r.overnight, r.premarket) == pytest.approx((math.log(3 / 2), math.log(4 / 3), math.log(6 / 4))) and r.total == pytest.approx(math.log(3))
    assert r.share_prior_post + r.share_overnight + r.share_premarket == pytest.approx(1) and not r.share_undefined
    assert got["y"].is_undefined and got["y"].total is None  # no price by the open
    assert got["z"].total == pytest.approx(math.log(0.5)) and got["z"].share_undefined and got["z"].share_overnight is None


def test_decay_is_absolute_from_the_first_price(spark):
    grid = spark.createDataFrame([("x", 0, None, None), ("x", 1, 10.0, 12.0), ("x", 2, None, None), ("x", 3, 9.0, 8.0)], "k string, minute_index int, first_price double, last_price double")
    got = bars.opportunity_decay(grid, ["k"]).orderBy("minute_index").collect()
    # the first row has no print: the start is the first price known, a last price; before it the move is 0
    assert [r.realized for r in got] == pytest.approx([0, 0, 0, 1])
    late = bars.opportunity_decay(grid, ["k"], least_minute=1).orderBy("minute_index").collect()
    assert [r.realized for r in late] == pytest.approx([math.log(1.2) / math.log(1.25)] * 2 + [1])
    assert bars.half_life(bars.opportunity_decay(grid, ["k"], least_minute=1), ["k"]).first().minute_at_level == 1


def test_grid_legs_end_with_the_last_print(spark):
    found = spark.createDataFrame([("x", 5)], "k string, detection_minute int")
    prices = spark.createDataFrame([("x", 5, 2.0), ("x", 7, 4.0), ("x", 9, 8.0)], "k string, minute_index int, last_price double")
    got = {(r.grid, r.latency, r.hold): r for r in returns.axis_rows(found, prices, ["k"], [0, 3, 6], [1, 4]).collect()}
    mark = lambda *k: got[k].markout
    assert mark("fixed_horizon", 0, 4) == pytest.approx(math.log(8 / 2)) and mark("fixed_horizon", 0, 1) == 0
    assert mark("fixed_horizon", 3, 1) == pytest.approx(math.log(8 / 4))
    assert mark("fixed_horizon", 3, 4) is None  # minute 12 is past the last print
    assert mark("fixed_exit", 3, None) == pytest.approx(math.log(8 / 4)) and mark("fixed_exit", 6, None) is None


def test_participation_leaves_out_missing_sessions(spark):
    rows = [("x", -3, 400, 10), ("x", -2, 200, 4), ("x", -2, 700, 6), ("x", 0, 100, 9), ("x", 0, 600, 1)]
    minutes = spark.createDataFrame(rows, "k string, session_offset int, minute_index int, volume long")
    made = returns.participation(minutes, spark.createDataFrame([("x", 300), ("y", 300)], "k string, minute int"), ["k"])
    got = {r.k: r for r in returns.participation_form(made, 1.0).collect()}
    assert (got["x"].volume, got["x"].clock_baseline, got["x"].session_baseline, got["x"].n_sessions) == (9, 2, 10, 2)  # 0 and 4; -1 has no bars
    assert got["x"].participation == pytest.approx(math.log(10 / 3)) and got["y"].participation is None
    assert {r.form for r in returns.participation_form(made, 0.2).collect()} == {"session"}


def test_retracement_ratios_are_linear(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0, 5.0, 3.0), ("y", 5.0, 5.0, 5.0, 3.0)], "k string, a double, p double, h double, c double")
    got = {r.k: r for r in returns.retracement(rows, ["k"], "a", "p", "h", {"p0": "c"}).collect()}
    assert (got["x"].of_excursion, got["x"].of_detection) == pytest.approx((2 / 4, 2 / 3))
    assert got["y"].of_excursion is None and got["y"].excursion_undefined and got["y"].below_anchor


def test_trades_are_signed_by_the_last_usable_quote(spark):
    book = spark.createDataFrame([("a", 1, 1, 10, 1, 9.0, 11.0), ("a", 1, 1, 20, 2, 12.0, 11.0), ("a", 1, 2, 5, 3, 19.0, 21.0)], "k string, day int, segment int, ts_ns long, seq long, bid double, ask double")
    book = quotes.quote_states(book.withColumns({"bid_size": F.lit(1), "ask_size": F.lit(1)})).withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "is_change": F.lit(True)})
    trades = spark.createDataFrame([("a", 1, 1, 5, 1, 10.0, 1), ("a", 1, 1, 25, 2, 10.5, 2), ("a", 1, 1, 26, 3, 10.0, 3), ("a", 1, 1, 27, 4, 10.0, 5), ("a", 1, 2, 1, 5, 30.0, 7)], "k string, day int, segment int, ts_ns long, seq long, price double, size long")
    by = ["k", "day", "segment"]
    signed = quotes.sign_trades(trades, book, by)
    got = {r.seq: r for r in signed.collect()}
    assert got[1].q_mid is None and got[1].sign is None  # no quote yet, no price before
    assert (got[2].q_mid, got[2].sign) == (10.0, 1)  # the crossed quote at 20 is passed over
    assert (got[3].sign, got[4].sign) == (-1, None)  # at the midpoint: by the price just before, else not classified
    assert got[5].q_mid is None and got[5].sign is None  # another segment's quotes and prices are not carried over
    m = quotes.trade_minute_metrics(signed, by).filter("segment = 1").first()
    assert (m.n_trades, m.volume, m.classified, m.signed_volume, m.n_unclassified, m.n_no_quote, m.abs_distance_size) == (4, 11, 5, -1, 2, 1, 1.0)


def test_impact_is_relative(spark):
    rows = [("a", 1, 10.0, 5, 1, 2), ("a", 2, None, 7, 1, 2), ("a", 3, 11.0, 0, 1, 2), ("a", 4, 12.0, 4, 1, 2), ("a", 5, 9.0, 1, 0, 0)]
    cache = spark.createDataFrame(rows, "k string, minute_index int, tw_mid double, signed_volume long, n_trades int, volume long")
    got = {r.minute_index: r.impact for r in quotes.impact(cache, ["k"], 1).collect()}
    assert got == {1: pytest.approx(0.1 / 5), 3: None, 4: None}  # no flow; nothing after


def test_premarket_rates_are_by_elapsed_minutes(spark):
    minute = 60_000_000_000
    rows = [("x", "premarket", 0, 9.0, 10.0, 30, 3, 0, minute), ("x", "premarket", 9, 9.0, 12.0, 30, 2, 9 * minute, 10 * minute), ("x", "rth", 330, 15.0, 16.0, 90, 1, 330 * minute, 331 * minute), ("x", "rth", 345, 15.0, 16.0, 999, 1, 345 * minute, 346 * minute)]
    made = spark.createDataFrame(rows, "k string, segment string, minute_index int, first_price double, high double, volume long, n_trades int, first_ts long, last_ts long")
    r = features.premarket_context(made, ["k"]).first()
    assert (r.pre_high, r.open, r.pre_trades) == (12.0, 15.0, 5)
    assert (r.pre_high_distance, r.volume_ratio) == pytest.approx((0.25, (90 / 15) / (60 / 10)))


def test_stops_fill_at_the_stop_price(spark):
    entries = spark.createDataFrame([("a", 10, 100.0), ("b", 10, 100.0), ("c", 10, 100.0), ("d", None, None)], "k string, entry_ns long, entry_price double")
    ticks = spark.createDataFrame([("a", 11, 1, 110.0), ("a", 12, 2, 70.0), ("a", 13, 3, 150.0), ("b", 11, 1, 90.0), ("b", 15, 2, 95.0), ("b", 99, 3, 10.0), ("c", 5, 1, 100.0)], "k string, ts_ns long, seq long, price double")
    got = {r.k: r for r in features.barrier_exit(ticks, entries, ["k"], 0.2, 50).collect()}
    assert (got["a"].reason, got["a"].exit_ns, got["a"].ret) == ("stop", 12, -0.2) and (got["a"].best, got["a"].worst) == pytest.approx((0.1, -0.3))
    assert (got["b"].reason, got["b"].exit_ns) == ("time", 15) and (got["b"].ret, got["b"].best, got["b"].worst) == pytest.approx((-0.05, 0, -0.1))
    assert (got["c"].reason, got["c"].exit_ns, got["c"].ret) == ("no_ticks", 10, 0) and "d" not in got


def test_baselines_count_collected_sessions_only(spark):
    spine_ = spark.createDataFrame([("x", "e", o, f"d{o}", 240, 250) for o in (-3, -2, -1, 0)] + [("y", "e", 0, "d0", 240, 250)], "ticker string, event string, session_offset int, session_date string, pre_min int, post_min int")
    ticks = spark.createDataFrame([("x", "d-3"), ("x", "d-2"), ("x", "d0"), ("y", "d0")], "ticker string, et_date string")
    keys = ["ticker", "event"]
    got = bursts.collected_sessions(spine_, ticks, keys)
    assert sorted((r.session_offset, r.minutes) for r in got.collect()) == [(-3, 10), (-2, 10)]
    made = spark.createDataFrame([("x", "e", -3, 0, 4, 40), ("x", "e", -2, 9, 2, 20), ("x", "e", -1, 5, 7, 70), ("x", "e", 0, 5, 9, 90)], "ticker string, event string, session_offset int, minute_index long, n_trades long, volume long")
    events = spine_.filter("session_offset = 0").select(*keys)
    flat = {r.ticker: r for r in bursts.scalar_baseline(made, got, events, keys).collect()}
    assert (flat["x"].n_sessions, flat["x"].n_prints, flat["x"].prints_per_s, flat["x"].volume_per_s) == (2, 6, 6 / 1200, 60 / 1200)
    assert flat["y"].is_undefined and flat["y"].prints_per_s is None
    rows = {(r.ticker, r.minute_index): r for r in bursts.tod_baseline(made, got, spine_, keys, 1, 0.5).collect()}
    assert len(rows) == 20 and {r.label for r in rows.values()} == {"baseline_partial", "baseline_undefined"}
    assert (rows["x", 0].prints, rows["x", 0].slots, rows["x", 0].rate) == (4, 4, 1.0)  # minutes 0 and 1 of two sessions
    assert (rows["x", 5].prints, rows["x", 5].slots, rows["x", 5].rate_floored) == (0, 6, 0.5)
    assert rows["y", 0].rate is None and rows["y", 0].rate_floored == 0.5


@pytest.mark.parametrize("gaps", [[10, 9, 0.2, 0.1, 8], [1, 1, 1], [0.1, 0.1, 5, 0.1, 7, 9, 0.2]])
def test_two_states_are_the_cheapest_path(spark, gaps):
    times = [0, *itertools.accumulate(int(g * 1e9) for g in gaps)]
    rows = spark.createDataFrame([("x", t, i) for i, t in enumerate(times)], "k string, ts_ns long, seq long")
    got = [r.state for r in bursts.two_state_bursts(rows, ["k"], 3.0, 1.0).orderBy("seq").collect()]
    a = [len(times) / sum(gaps), 3 * len(times) / sum(gaps)]

    def cost(path):
        return sum(a[s] * g - math.log(a[s]) for s, g in zip(path, gaps, strict=True)) + math.log(len(times)) * sum(b > c for c, b in zip((0, *path), path, strict=False))

    assert cost(got) == pytest.approx(min(cost(p) for p in itertools.product((0, 1), repeat=len(gaps))), abs=1e-6)


@pytest.mark.parametrize("width", [0.37, 1.0, 3.3])
def test_sparse_counts_equal_dense_ones(spark, width):
    import random

    rng = random.Random(3)
    times = sorted(rng.uniform(0, 50) for _ in range(80)) + [50.0]
    rows = spark.createDataFrame([("x", int(t * 1e9)) for t in times], "k string, ts_ns long")
    bounds = spark.createDataFrame([("x", 0, 50 * 10**9)], "k string, start_ns long, end_ns long")
    r = bursts.allan_fano(rows, ["k"], bounds, [width]).first()
    n = int(50 / width)
    c = [sum(int(int(t * 1e9) / 1e9 / width) == i for t in times) for i in range(n)]
    mean = sum(c) / n
    assert r.allan == pytest.approx(sum((b - a) ** 2 for a, b in zip(c, c[1:], strict=False)) / (n - 1) / (2 * mean))
    assert r.fano == pytest.approx((sum(x * x for x in c) / n - mean * mean) / mean)


def test_intensity_equals_the_recurrence(spark):
    import random

    rng = random.Random(4)
    gaps = [rng.choice([0.01, 0.5, 1.0, 3.0, 4.9, 9.0, 300.0]) for _ in range(200)]
    times = [0, *itertools.accumulate(int(g * 1e9) for g in gaps)]
    rows = spark.createDataFrame([("x", t, i) for i, t in enumerate(times)], "k string, ts_ns long, seq long")
    got = [r.intensity for r in features.hawkes_intensity(rows, ["k"], 0.5, 2.0, 5.0).orderBy("seq").collect()]
    live = [g for g in gaps if g <= 5]
    mu, s, want = (len(live) + 1) / sum(live), 0.0, []
    for g in [None, *gaps]:
        if g is not None:
            s = s * (math.exp(-2.0 * g) if g <= 5 else 1.0) + 1
        want.append(mu + 0.5 * s)
    assert got == pytest.approx(want)


def test_intervals_overlap(spark):
    a = spark.createDataFrame([("x", 0, 10), ("x", 20, 30), ("y", 0, 5)], "k string, start_ns long, end_ns long")
    b = spark.createDataFrame([("x", 5, 25), ("z", 1, 2)], "k string, start_ns long, end_ns long")
    got = {r.k: (r.overlap_ns, r.union_ns) for r in bursts.interval_jaccard(a, b, ["k"]).collect()}
    assert got == {"x": (10, 30), "y": (0, 5), "z": (0, 1)}
    merged = bursts.merge_drop(a.unionByName(b), ["k"], 1, 0).orderBy("k", "start_ns").collect()
    assert [(r.k, r.start_ns, r.end_ns) for r in merged] == [("x", 0, 30), ("y", 0, 5), ("z", 1, 2)]


@pytest.mark.parametrize("size", [4_096, 16, 7])
def test_every_replicate_draws_as_many_units_as_there_are(spark, size):
    units = spark.range(100).select((F.col("id") * 3).alias("unit"))
    got = inference.resample(units, 40, 5, size).collect()
    again = inference.resample(units.repartition(7), 40, 5, size).collect()
    assert {(r.rep, r.unit): r.times for r in got} == {(r.rep, r.unit): r.times for r in again}
    per = {}
    for r in got:
        per.setdefault(r.rep, []).append(r.times)
    assert len(per) == 40 and all(sum(t) == 100 for t in per.values())
    share = sum(len(t) for t in per.values()) / 4000
    assert abs(share - (1 - math.exp(-1))) < 0.03  # of units drawn at all
    assert abs(sum(t * t for ts in per.values() for t in ts) / 4000 - 1.99) < 0.15  # variance 1 - 1/100 and mean 1


def test_splits_share_out_all_draws():
    for total in (1, 10, 101, 1000):
        leaves = -(-total // 10)
        got = [inference._split(3, 1, leaf, total, leaves, 10, {}) for leaf in range(leaves)]
        assert sum(got) == total


def test_average_ranks_across_ranges(spark):
    import random

    rng = random.Random(8)
    rows = [(k, v, i) for i, (k, v) in enumerate((rng.choice(["a"] * 6 + ["b", None]), rng.choice([None, *map(float, range(12))])) for _ in range(600))]
    got = {r.i: r["rank"] for r in frames.average_ranks(spark.createDataFrame(rows, "k string, v double, i int"), ["k"], "v").collect()}
    for k in ("a", "b", None):
        own = [(v, i) for x, v, i in rows if x == k and v is not None]
        assert [got[i] for _, i in own] == pytest.approx([sum(w < v for w, _ in own) + (sum(w == v for w, _ in own) + 1) / 2 for v, _ in own])
    assert all(got[i] is None for _, v, i in rows if v is None)


def test_dependence_needs_enough_pairs(spark):
    rows = [("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, 2.0), ("b", 2.0, 1.0), ("b", 3.0, 0.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", None, 2.0)]
    got = {r.k: r for r in bursts.count_dependence(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert (got["a"].n, got["a"].n_positive) == (6, 5) and (got["a"].rank_correlation, got["a"].slope) == pytest.approx((1, 2))
    assert got["b"].rank_correlation == pytest.approx(-1) and got["b"].slope is None and got["c"].rank_correlation is None


def test_quantile_line_beats_its_neighbours(spark):
    import random

    rng = random.Random(5)
    data = [(x, 2 + 3 * x + rng.expovariate(1)) for x in (rng.uniform(0, 10) for _ in range(400))]
    rows = spark.createDataFrame(data, "x double, y double")
    a, b = inference.quantile_line(rows, "x", "y", 0.9)

    def loss(a, b):
        return sum((0.9 if (r := y - a - b * x) >= 0 else -0.1) * r for x, y in data)

    assert loss(a, b) <= min(loss(a + da, b + db) for da in (-0.1, 0, 0.1) for db in (-0.05, 0, 0.05)) * 1.005


def test_flags_and_scope_of_nulls(spark):
    rows = spark.createDataFrame([("A", None), (None, False), ("B", True), ("A", True)], "kind string, bad boolean")
    assert [r.s for r in rows.select(spine.in_scope(F.col("kind"), ["A", "B"], [F.col("bad")]).alias("s")).collect()] == [True, False, False, False]
    flags = spark.createDataFrame([("x", 1), ("x", 2)], "k string, f int")
    assert spine.left_join_flags(spark.createDataFrame([("x",), ("y",)], "k string"), [flags], ["k"]).count() == 2


def test_operators_on_nothing(spark):
    trades = spark.createDataFrame([], "ticker long, et_date date, et_min int, ts_ns long, seq long, price double, size long")
    for f in (lambda t: features.cvd(t, ["ticker"]), lambda t: bursts.two_state_bursts(t, ["ticker"], 2.0, 1.0), lambda t: bursts.sweep_runs(t, ["ticker"], 5), lambda t: features.hawkes_intensity(t, ["ticker"], 1.0, 1.0, 5.0), lambda t: bursts.knn_rate(t, ["ticker"], 3, 1.0)):
        assert f(trades).collect() == []
