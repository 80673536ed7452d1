"""Tick views derived from the given tables, and the same views as SQL.

Trades and quotes come from ``events``; prices, sizes and tickers are functions
of its columns. ``WITH`` holds the SQL twins for the oracle, where January's New
York clock is five hours behind UTC.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import clock
from tidegrid.operators import bars, calendar

KEYS = ["ticker", "event_date"]


class Views:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _ticks(self, kinds: list[str]) -> DataFrame:
        us = clock.epoch_us(F.col("ts"))
        local = clock.local_us(us * 1000)
        chosen = self.table("events").filter(F.col("event_type").isin(kinds))
        return chosen.select(
            (F.col("user_id") % 10).alias("ticker"), F.to_date("ts").alias("day"), (us * 1000).alias("ts_ns"), F.col("event_id").alias("seq"),
            clock.date_of(local).alias("et_date"), clock.minute_of(local).alias("et_min"), F.col("value"), F.col("event_id"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        rows = self._ticks(["purchase", "click", "error"])
        return rows.withColumns({"price": F.col("value") + 1, "size": F.col("event_id") % 100 + 1}).drop("value", "event_id")

    @cached_property
    def quotes(self) -> DataFrame:
        mid, i = F.col("value") + 1, F.col("event_id")
        rows = self._ticks(["view", "signup"])
        return rows.withColumns({"bid": mid - (i % 5) / 100, "ask": mid + (i % 7 - 1) / 100, "bid_size": i % 11, "ask_size": i % 13}).drop("value", "event_id")

    @cached_property
    def calendar(self) -> DataFrame:
        days = self.spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("session_date"))
        held = days.filter(F.weekday("session_date") < 5).filter(~F.col("session_date").cast("string").isin("2024-01-01", "2024-01-15"))
        early = F.col("session_date").cast("string") == "2024-01-19"
        return held.withColumns({"open_min": F.lit(570), "close_min": F.when(early, 780).otherwise(960), "is_early_close": early})

    @cached_property
    def event_list(self) -> DataFrame:
        """(ticker, event_date, magnitude): days with a session and a trade."""
        days = self.trades.join(F.broadcast(self.calendar), F.col("et_date") == F.col("session_date"))
        first = F.min_by("price", F.struct("ts_ns", "seq"))
        return days.groupBy("ticker", F.col("et_date").alias("event_date")).agg(F.round(100 * (F.max("price") / first - 1), 2).alias("magnitude"))

    @cached_property
    def spine(self) -> DataFrame:
        return calendar.session_spine(self.event_list.select(*KEYS), self.calendar, range(-3, 4))

    @cached_property
    def bars(self) -> DataFrame:
        return bars.minute_bars(self.trades, self.spine, KEYS)

    @cached_property
    def day_bars(self) -> DataFrame:
        """Bars of the event's own day."""
        return self.bars.filter("session_offset = 0")

    @cached_property
    def daily(self) -> DataFrame:
        """Daily bars of parts, from lineitem."""
        order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
        rows = self.table("lineitem").select("*", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
        return rows.groupBy(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("day")).agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"),
        )


WITH = """
WITH ticks AS (
  SELECT user_id % 10 AS ticker, ts::DATE AS day, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq,
         (ts - INTERVAL 5 HOUR)::DATE AS et_date,
         date_part('hour', ts - INTERVAL 5 HOUR) * 60 + date_part('minute', ts - INTERVAL 5 HOUR) AS et_min,
         event_type, value, event_id
  FROM events),
trades AS (
  SELECT ticker, day, ts_ns, seq, et_date, et_min, value + 1 AS price, event_id % 100 + 1 AS size
  FROM ticks WHERE event_type IN ('purchase', 'click', 'error')),
quotes AS (
  SELECT ticker, day, ts_ns, seq, et_date, et_min, value + 1 - (event_id % 5) / 100 AS bid,
         value + 1 + (event_id % 7 - 1) / 100 AS ask, event_id % 11 AS bid_size, event_id % 13 AS ask_size
  FROM ticks WHERE event_type IN ('view', 'signup')),
calendar AS (
  SELECT d::DATE AS session_date, 570 AS open_min, CASE WHEN d = DATE '2024-01-19' THEN 780 ELSE 960 END AS close_min,
         d = DATE '2024-01-19' AS is_early_close
  FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15')),
event_list AS (
  SELECT ticker, et_date AS event_date, round(100 * (max(price) / arg_min(price, (ts_ns, seq)) - 1), 2) AS magnitude
  FROM trades JOIN calendar ON et_date = session_date GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (ORDER BY session_date) AS n FROM calendar),
spine AS (
  SELECT e.ticker, e.event_date, (b.n - a.n)::INTEGER AS session_offset, b.session_date, 240 AS pre_min, b.open_min, b.close_min,
         CASE WHEN b.is_early_close THEN b.close_min + 240 ELSE 1200 END AS post_min, b.is_early_close
  FROM event_list e JOIN numbered a ON a.session_date = e.event_date JOIN numbered b ON b.n BETWEEN a.n - 3 AND a.n + 3),
seg AS (
  SELECT s.ticker, s.event_date, s.session_offset, s.open_min, s.close_min, s.pre_min, t.price, t.size, t.ts_ns, t.seq, t.et_min,
         CASE WHEN et_min < pre_min THEN 'outside_early' WHEN et_min < open_min THEN 'premarket' WHEN et_min < close_min THEN 'rth'
              WHEN et_min < post_min THEN 'post' ELSE 'outside_late' END AS segment
  FROM trades t JOIN spine s ON s.ticker = t.ticker AND s.session_date = t.et_date),
bars AS (
  SELECT ticker, event_date, session_offset, segment, (et_min - pre_min)::BIGINT AS minute_index, count(*) AS n_trades, sum(size)::BIGINT AS volume,
         sum(price * size) AS notional, sum(price * size) / sum(size) AS vwap, max(price) AS high, min(price) AS low,
         arg_min(price, (ts_ns, seq)) AS first_price, arg_max(price, (ts_ns, seq)) AS last_price, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts
  FROM seg WHERE segment IN ('premarket', 'rth', 'post') GROUP BY ALL),
day_bars AS (SELECT * FROM bars WHERE session_offset = 0),
daily AS (
  SELECT l_partkey AS ticker, l_shipdate::DATE AS day,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)
"""
