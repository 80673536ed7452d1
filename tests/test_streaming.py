"""Live operators against their batch forms, and rescaled gaps against a plain loop."""

import math
import os

from pyspark.sql import functions as F

from tidegrid.operators import rates
from tidegrid.streaming import live

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def ticks(df):
    return df.select((F.col("user_id") % 10).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"), (F.col("event_id") % 100 + 1).alias("size"))


def drained(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_live_bars_equal_batch_bars(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ticks(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    got = drained(spark, live.live_minute_bars(stream, ["ticker"]), "bars", "update")
    want = live.live_minute_bars(ticks(table), ["ticker"])
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_live_crossings_come_once(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    anchors = ticks(table).groupBy("ticker").agg(F.avg("price").alias("anchor_price"))
    stream = ticks(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    got = drained(spark, live.live_crossings(stream, anchors, ["ticker"], 1.5, late="60 days"), "crossings", "append").collect()
    assert len(got) == len({r.ticker for r in got}) > 0 and all(r.price >= 1.5 * r.anchor_price for r in got)


def test_rescaled_gaps_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    times = sorted(rng.uniform(0, 100) for _ in range(150))
    rows = spark.createDataFrame([("x", int(t * 1e9)) for t in times], "k string, ts_ns long")
    bounds = spark.createDataFrame([("x", 0, 100 * 10**9)], "k string, start_ns long, end_ns long")
    h, dx, block, floor = 4.0, 1.0, 10.0, 1e-3
    got = {r.fold: r for r in rates.rescaled_gaps(rows, bounds, ["k"], h, dx, block, floor).collect()}
    times = [int(t * 1e9) / 1e9 for t in times]
    k = lambda o: math.exp(-0.5 * (o * dx / h) ** 2)
    half = math.ceil(4 * h / dx)
    mass = sum(k(o) for o in range(-half, half + 1))
    for fold in (0, 1):
        support = [int(c * dx // block) % 2 != fold for c in range(100)]
        counts = [sum(int(t // dx) == c and int(t // block) % 2 != fold for t in times) for c in range(100)]
        lam = []
        for c in range(100):
            den = sum(k(o) for o in range(-half, half + 1) if 0 <= c + o < 100 and support[c + o])
            num = sum(k(o) * counts[c + o] for o in range(-half, half + 1) if 0 <= c + o < 100)
            rate = 0.0 if den < 0.05 * mass else num / (den * dx)
            lam.append(0.0 if support[c] else max(rate, floor))
        big = sorted(sum(lam[: int(t // dx)]) * dx + lam[int(t // dx)] * (t - int(t // dx) * dx) for t in times if int(t // block) % 2 == fold)
        d = sorted(b - a for a, b in zip(big, big[1:], strict=False))
        sup = max(max((i + 1) / len(d) - (1 - math.exp(-x)), (1 - math.exp(-x)) - i / len(d)) for i, x in enumerate(d))
        assert (got[fold].n, round(got[fold].distance, 9)) == (len(d), round(sup, 9))
