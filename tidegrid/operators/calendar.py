"""Session calendar and coverage (C): spines, segments, offsets, bitmaps, survivorship.

Calendars have session_date, open_min, close_min (minutes of the local day) and
is_early_close, one row a session: a few thousand rows whatever the ticks, so
they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import clock
from tidegrid.functions.frames import ratio

PRE_MIN, POST_MIN, POST_LENGTH = 240, 1200, 240


def numbered(calendar: DataFrame) -> DataFrame:
    """The calendar with each session's ordinal ``n``."""
    return calendar.withColumn("n", F.row_number().over(Window.orderBy("session_date")))


def session_spine(events: DataFrame, calendar: DataFrame, offsets) -> DataFrame:
    """One row per event and session offset that exists, with that session's bounds.

    The post-market end moves on an early close. Events on days without a
    session have no rows.
    """
    days = numbered(calendar)
    own = days.select(F.col("session_date").alias("event_date"), F.col("n").alias("own"))
    post = F.when(F.col("is_early_close"), F.col("close_min") + POST_LENGTH).otherwise(POST_MIN)
    target = events.join(F.broadcast(own), "event_date").withColumn("session_offset", F.explode(F.array(*map(F.lit, offsets))))
    spine = target.withColumn("n", F.col("own") + F.col("session_offset")).join(F.broadcast(days), "n")
    return spine.select(*events.columns, "session_offset", "session_date", F.lit(PRE_MIN).alias("pre_min"), "open_min", "close_min", post.alias("post_min"), "is_early_close")


def with_local(ticks: DataFrame, ns: str = "ts_ns", zone: str = clock.NEW_YORK) -> DataFrame:
    """Local date and minute of the day of UTC nanoseconds, correct across DST."""
    us = clock.local_us(F.col(ns), zone)
    return ticks.withColumns({"local_us": us, "local_date": clock.date_of(us), "local_min": clock.minute_of(us)})


def segment_of(minute: Column, pre: Column, start: Column, close: Column, post: Column) -> Column:
    """The segment of a minute, given the session's bounds (null: no session)."""
    return (
        F.when(start.isNull(), "non_session").when(minute < pre, "outside_early").when(minute < start, "premarket")
        .when(minute < close, "rth").when(minute < post, "post").otherwise("outside_late")
    )


def label_segments(ticks: DataFrame, calendar: DataFrame, date: str = "et_date", minute: str = "et_min") -> DataFrame:
    """Each tick's segment and the segment's end as UTC nanoseconds (null outside segments)."""
    post = F.when(F.col("is_early_close"), F.col("close_min") + POST_LENGTH).otherwise(POST_MIN)
    bounds = calendar.select(F.col("session_date").alias(date), "open_min", "close_min", post.alias("post_min"))
    joined = ticks.join(F.broadcast(bounds), date, "left")
    segment = segment_of(F.col(minute), F.lit(PRE_MIN), F.col("open_min"), F.col("close_min"), F.col("post_min"))
    end = F.when(F.col("segment") == "premarket", F.col("open_min")).when(F.col("segment") == "rth", F.col("close_min")).when(F.col("segment") == "post", F.col("post_min"))
    labelled = joined.withColumn("segment", segment).withColumn("segment_end_ns", clock.local_to_ns(clock.us_of(F.col(date), end)))
    return labelled.drop("open_min", "close_min", "post_min")


def day_offset(days: DataFrame, keys: list[str], anchor: str = "event_date", date: str = "session_date") -> DataFrame:
    """C4: signed dense rank of each session around the anchor; the anchor's own day is 0."""
    side = F.when(F.col(date) > F.col(anchor), 1).when(F.col(date) < F.col(anchor), -1).otherwise(0)
    w = Window.partitionBy(*keys, "side")
    up, down = F.dense_rank().over(w.orderBy(date)), F.dense_rank().over(w.orderBy(F.desc(date)))
    return days.withColumn("side", side).withColumn("day_offset", F.when(F.col("side") > 0, up).when(F.col("side") < 0, -down).otherwise(0)).drop("side")


def session_bitmap(ticks: DataFrame, spine: DataFrame, keys: list[str], ticker: str = "ticker", date: str = "day") -> DataFrame:
    """Which expected sessions have any row: 0/1 text by offset, missing offsets, full flag.

    ``date`` names the date rule (UTC or local) of the ticks.
    """
    seen = ticks.select(ticker, F.col(date).alias("session_date")).distinct().withColumn("has", F.lit(1))
    rows = spine.join(seen, [ticker, "session_date"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("session_offset", "has"))).alias("s"))
    missing = F.transform(F.filter("s", lambda x: x["has"] == 0), lambda x: x["session_offset"])
    return made.select(*keys, F.concat_ws("", F.transform("s", lambda x: x["has"].cast("string"))).alias("bitmap"), missing.alias("missing"), F.size(missing).alias("n_missing"), (F.size(missing) == 0).alias("is_full"))


def archive_edge(spine: DataFrame, observed: DataFrame, keys: list[str], date: str = "session_date") -> DataFrame:
    """Whether any session that an event expects lies outside the range of the observed ones; a row an event."""
    span = F.broadcast(observed.agg(F.min(date).alias("first"), F.max(date).alias("last")))  # one row
    return spine.join(span).groupBy(*keys).agg(F.coalesce(F.max((F.col(date) < F.col("first")) | (F.col(date) > F.col("last"))), F.lit(False)).alias("is_edge"))


def gap_label(missing: Column, edge: Column, residue: Column | None = None) -> Column:
    """Where an event's missing sessions lie; ``residue`` (a calendar's fault or its repair) comes first, the archive's edge next.

    The event's own day counts to neither side, so its absence makes both_sides; nothing missing is unclassified.
    """
    some = F.size(missing) > 0
    label = F.when(edge, "archive_edge").when(some & F.forall(missing, lambda o: o >= 1), "forward_missing").when(some & F.forall(missing, lambda o: o <= -1), "backward_missing").when(some, "both_sides").otherwise("unclassified")
    return label if residue is None else F.when(F.coalesce(residue, F.lit(False)), "calendar_residue").otherwise(label)


def seen_signature(rows: DataFrame, observed: DataFrame, ticker: str = "ticker", date: str = "session_date") -> DataFrame:
    """Weak signs of delisting and listing, of events with a label and ``first_expected`` (their earliest expected session).

    Forward gaps where the event is the ticker's last observed session; backward gaps where its first one comes after the earliest expected.
    """
    seen = observed.groupBy(ticker).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"))
    last = (F.col("label") == "forward_missing") & (F.col("event_date") == F.col("last_seen"))
    listed = (F.col("label") == "backward_missing") & (F.col("first_seen") > F.col("first_expected"))
    return rows.join(seen, ticker, "left").withColumns({"is_last_seen": F.coalesce(last, F.lit(False)), "is_listing": F.coalesce(listed, F.lit(False))})


def merge_sides(trades: DataFrame, quotes: DataFrame, keys: list[str], labels: DataFrame | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Both sides' bitmaps of each event: which side knows it, and whether both are full.

    ``labels``: further columns of the events; one that is missing takes its default.
    """
    side = lambda df, p: df.select(*keys, F.col("bitmap").alias(f"{p}_bitmap"), F.col("is_full").alias(f"{p}_full"))
    both = side(trades, "trade").join(side(quotes, "quote"), keys, "full")
    known = F.when(F.col("trade_full").isNull(), "quotes_only").when(F.col("quote_full").isNull(), "trades_only").otherwise("both")
    made = both.withColumns({"sides": known, "is_clean": F.coalesce(F.col("trade_full") & F.col("quote_full"), F.lit(False))})
    if labels is None:
        return made
    joined = made.join(labels, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (defaults or {}).items()})


def survivorship(events: DataFrame, ticks: DataFrame, calendar: DataFrame, ticker: str = "ticker", date: str = "et_date") -> DataFrame:
    """Sessions from the event to the ticker's last seen session, and whether any follow."""
    days = F.broadcast(numbered(calendar).select("session_date", "n"))
    held = ticks.select(ticker, F.col(date).alias("session_date")).distinct().join(days, "session_date")
    last = held.groupBy(ticker).agg(F.max("n").alias("last_n"))
    own = days.select(F.col("session_date").alias("event_date"), F.col("n").alias("own_n"))
    joined = events.join(own, "event_date").join(last, ticker, "left")
    return joined.withColumns({"sessions_after": F.col("last_n") - F.col("own_n"), "survives": F.coalesce(F.col("last_n") > F.col("own_n"), F.lit(False))}).drop("own_n", "last_n")


def later_sessions(events: DataFrame, bars: DataFrame, keys: list[str], offsets: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Whether each later session of an event has any bar."""
    seen = bars.filter(F.col("session_offset").isin(*offsets)).groupBy(*keys).agg(*(F.max(F.col("session_offset") == o).alias(f"has_{o}") for o in offsets))
    return events.join(seen, keys, "left").fillna(False, [f"has_{o}" for o in offsets])


def missing_rates(rows: DataFrame, by: list[str], offsets: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How many events miss each later session, and their rate, by era or another label."""
    gone = [x for o in offsets for x in (F.count(F.when(~F.col(f"has_{o}"), 1)).alias(f"missing_{o}"), F.avg((~F.col(f"has_{o}")).cast("double")).alias(f"missing_{o}_rate"))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *gone)


def coverage_stats(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Regular bars, longest run of missing minutes between regular bars, share of trades outside, first and last minute."""
    w = Window.partitionBy(*keys, "segment").orderBy("minute_index")
    gaps = bars.withColumn("gap", F.col("minute_index") - F.lag("minute_index").over(w) - 1)
    rth = F.col("segment") == "rth"
    inside = F.coalesce(F.sum(F.when(rth, F.col("n_trades"))), F.lit(0))
    return gaps.groupBy(*keys).agg(
        F.count(F.when(rth, 1)).alias("rth_bars"), F.coalesce(F.max(F.when(rth, F.col("gap"))), F.lit(0)).alias("longest_gap"),
        (1 - ratio(inside, F.sum("n_trades"))).alias("outside_share"), F.min("minute_index").alias("first_minute"), F.max("minute_index").alias("last_minute"),
    )


def zero_print_events(events: DataFrame, ticks: DataFrame, ticker: str = "ticker", date: str = "et_date") -> DataFrame:
    """C11: events without any row on their own day."""
    counts = ticks.groupBy(ticker, F.col(date).alias("event_date")).agg(F.count(F.lit(1)).alias("n"))
    return events.join(counts, [ticker, "event_date"], "left").filter(F.coalesce("n", F.lit(0)) == 0).drop("n")


def tz_mismatch_count(ticks: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose local date differs from their UTC date."""
    return ticks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("et_date") != F.col("day"), 1)).alias("n_mismatch"))
