"""Void-threshold bursts against a plain loop."""

import random
import statistics

import pytest

from tidegrid.operators import voids


def series(n=400, seed=1):
    rng = random.Random(seed)
    gaps = [10 ** rng.gauss(-2, 0.2) if rng.random() < 0.8 else 10 ** rng.gauss(1, 0.2) for _ in range(n)]
    at, times = 0, [0]
    for g in gaps:
        at += int(g * 1e9)
        times.append(at)
    return times


@pytest.mark.parametrize("fraction", [0.02, 0.1, 0.33, 2.0])
def test_moving_median(spark, fraction):
    import math

    times = series()
    got = [r.yn for r in voids.centred_log_gaps(spark.createDataFrame([("x", t, i) for i, t in enumerate(times)], "k string, ts_ns long, seq long"), ["k"], fraction).orderBy("seq").collect()]
    y = [math.log10(max((b - a) / 1e9, 1e-9)) for a, b in zip(times, times[1:], strict=False)]
    n, w = len(y), max(11, round(fraction * len(y)) | 1)
    if w >= n:
        want = [v - statistics.median(y) for v in y]
    else:
        half, stride = w // 2, max(1, w // 10)
        anchors = sorted({*range(0, n, stride), n - 1})
        med = {a: statistics.median(y[max(0, a - half) : a + half + 1]) for a in anchors}
        want = []
        for i, v in enumerate(y):
            a = max(x for x in anchors if x <= i)
            b = min((x for x in anchors if x > a), default=a)
            want.append(v - (med[a] if a == b else med[a] + (med[b] - med[a]) * (i - a) / (b - a)))
    assert got == pytest.approx(want)


def test_peaks_and_troughs():
    assert voids.peaks_of([0, 3, 0, 1, 0, 4, 4, 0], 0.5, 1) == [1, 3, 5]
    assert voids.peaks_of([0, 3, 2, 2.5, 0], 1.0, 1) == [1]
    assert voids.peaks_of([0, 3, 0, 2, 0], 0.5, 3) == [1]
    assert voids.first_trough([0, 9, 1, 0, 1, 5, 0], 0.0, 1.0, 0.05, 1, 0.7) == (3.5, "ok")
    assert voids.first_trough([0, 9, 8, 9, 0], 0.0, 1.0, 0.01, 1, 0.7) == (None, "no_void")
    assert voids.first_trough([0, 9, 0], 0.0, 1.0, 0.05, 1, 0.7) == (None, "too_few_peaks")
    assert voids.first_trough([0, 0], 0.0, 1.0, 0.05, 1, 0.7) == (None, "empty")


def test_bursts_are_the_runs_of_short_gaps(spark):
    times = series()
    rows = spark.createDataFrame([("x", t, i) for i, t in enumerate(times)], "k string, ts_ns long, seq long")
    got = sorted((r.start_ns, r.end_ns, r.n_prints) for r in voids.log_interval_bursts(rows, ["k"], 2.0, 3).collect())
    want, run = [], [times[0]]
    for a, b in zip(times, times[1:], strict=False):
        if (b - a) / 1e9 < 0.3:
            run.append(b)
        else:
            want, run = want + [run], [b]
    want = [(r[0], r[-1], len(r)) for r in [*want, run] if len(r) >= 3]
    assert got == sorted(want)
