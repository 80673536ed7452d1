"""As-of joins over time buckets, and quantiles by group, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import frames


def asof_rows(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(key(), rng.choice([None, rng.randrange(-50, 400)]) if rng.random() < 0.05 else rng.randrange(-50, 400), i) for i in range(400)]
    right = [(key(), rng.choice([rng.randrange(-50, 120), rng.randrange(300, 400)]), rng.randrange(3), i) for i in range(250)]
    return left, right, spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, rt long, seq long, v long")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tol", [None, 0, 7, 150])
@pytest.mark.parametrize("span", [None, 1, 10, 64, 10_000])
def test_asof_by_buckets_equals_a_loop(spark, strict, tol, span):
    left, right, a, b = asof_rows(spark, 1)
    got = {r.id: (r.r_rt, r.r_seq) for r in frames.asof_join(a, b, ["k"], "t", "rt", "seq", strict=strict, span=span, tol=tol).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        before = [] if k is None or t is None else [(rt, s) for rk, rt, s, _ in right if rk == k and (rt < t if strict else rt <= t)]
        best = max(before, default=(None, None))
        assert got[i] == ((None, None) if best[0] is None or (tol is not None and t - best[0] > tol) else best)


def test_ties_without_a_sequence_do_not_depend_on_the_plan(spark):
    _, _, a, b = asof_rows(spark, 2)
    one = {r.id: r.r_v for r in frames.asof_join(a, b.repartition(3), ["k"], "t", "rt", span=20).collect()}
    two = {r.id: r.r_v for r in frames.asof_join(a, b.coalesce(1), ["k"], "t", "rt").collect()}
    assert one == two


def test_one_key_is_spread_over_tasks(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    made = frames.asof_join(rows, rows.withColumn("v", F.col("t")), ["k"], "t", span=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 4000 / 2
        assert made.filter("r_v <> t").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_asof_of_fractional_times(spark):
    left = spark.createDataFrame([("a", 0.5), ("a", 2.25), ("a", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 0.25, 1), ("a", 2.25, 2)], "k string, t double, v int")
    for span in (None, 0.5, 3.0):
        assert [r.r_v for r in frames.asof_join(left, right, ["k"], "t", span=span, tol=1.0).orderBy("t").collect()] == [1, 2, None]


@pytest.mark.parametrize("whole", [0, 30, 10**6])
def test_grouped_quantiles_are_exact(spark, whole):
    rng = np.random.default_rng(3)
    groups = {"big": rng.normal(0, 1, 6000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "few": np.arange(9.0), None: rng.exponential(1, 50)}
    rows = [(k, float(x), float(-x) if i % 3 else None) for k, v in groups.items() for i, x in enumerate(v)] + [("big", None, None)] * 5 + [("void", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    qs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r.k: r for r in frames.grouped_quantiles(df, ["k"], {"x": (qs, tuple(f"x{i}" for i in range(6))), "y": ((0.5,), ("y",))}, 100, whole, counts=True).collect()}
    assert got.keys() == {*groups, "void"}
    for k in got:
        x, y = ([r[c] for r in rows if r[0] == k and r[c] is not None] for c in (1, 2))
        assert (got[k].n_x, got[k].n_y) == (len(x), len(y))
        assert [got[k][f"x{i}"] for i in range(6)] == (pytest.approx(np.quantile(x, qs).tolist()) if x else [None] * 6)
        assert got[k].y == (pytest.approx(np.quantile(y, 0.5)) if y else None)


def test_quantiles_hold_no_group_in_a_buffer(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    plan = frames.grouped_quantiles(rows, ["k"], {"x": ((0.5,), ("m",))})._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and " percentile(" not in plan


def test_quantile_of_all_rows(spark):
    rows = spark.createDataFrame([(float(i % 700),) for i in range(5000)] + [(None,)], "x double")
    for q in (0.0, 0.1, 0.75, 1.0):
        assert frames.exact_quantile(rows, "x", q) == pytest.approx(float(np.quantile([i % 700 for i in range(5000)], q)))
    assert frames.exact_quantile(rows.filter("x IS NULL"), "x", 0.5) is None
    assert frames.exact_quantile(rows.limit(0), "x", 0.5) is None


def test_described_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, x double")
    got = {r.k: (r.n, r.m) for r in frames.describe(rows, ["k"], {"x": ((0.5,), ("m",))}, n=F.count("x")).collect()}
    assert got == {"a": (2, 2.0), None: (1, 5.0), "b": (0, None)}


def test_the_next_known_value_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r.i: r.z for r in df.withColumn("z", frames.next_known(F.col("v"), ["k"], ["i"])).collect()}
    assert got == {i: next((v for kk, j, v in rows if kk == k and j >= i and v is not None), None) for k, i, _ in rows}


def test_no_frame_reaches_to_the_end_of_its_key_alone(spark):
    """Such a frame is gone through anew for each row; over a whole key it is not."""
    from tidegrid.plans import catalog

    for name in ("h10_burst_runs", "g11_cvd_convexity", "g13_feature_row", "d10_min_window_minutes"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rowframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan, name
