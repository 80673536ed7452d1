"""Event spine, keys and scope (B): canonical rows, flags, reconciliation, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.frames import describe, ratio


def canonical_events(events: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """B1: two column layouts in one table become one; the layout is labelled, the magnitude keyed at 2 dp.

    ``first`` and ``second`` map canonical names to each layout's columns.
    """
    layout = F.when(F.col(first["event_date"]).isNotNull(), "first").when(F.col(second["event_date"]).isNotNull(), "second").otherwise("none")
    made = {c: F.coalesce(F.col(first[c]), F.col(second[c])) for c in first}
    rows = events.select("ticker", *(x.alias(c) for c, x in made.items()), layout.alias("layout"))
    return rows.withColumn("magnitude_key", F.col("magnitude").cast("decimal(18,2)"))


def union_dedup_scans(scans: list[DataFrame], keys: list[str]) -> DataFrame:
    """B2: stack scans, earlier ones first; keep the first row of each key, with its scan's number."""
    stacked = None
    for i, s in enumerate(scans):
        part = s.withColumn("scan", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    others = sorted(c for c in stacked.columns if c not in {*keys, "scan"})
    return stacked.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("scan", *others))).filter("n = 1").drop("n")


def bad_denominator(prior: Column, magnitude: Column, floor: float, cap: float) -> Column:
    """Prior price under a floor, or magnitude at its cap; null where the one is missing and the other doesn't decide."""
    return (prior < floor) | (magnitude >= cap)


def side_ingested(events: DataFrame, ticks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Does any tick exist for the event, on one side."""
    return events.join(ticks.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def has_folder(events: DataFrame, inventory: DataFrame, pattern: str) -> DataFrame:
    """Does a folder of the event's ticker, date and magnitude exist; keys are parsed from names."""
    part = lambda i: F.regexp_extract("folder", pattern, i)
    parsed = inventory.select(part(1).try_cast("long").alias("ticker"), part(2).try_cast("date").alias("event_date"), part(3).try_cast("decimal(18,2)").alias("magnitude_key"))
    found = parsed.dropna().distinct().withColumn("has_folder", F.lit(True))
    return events.join(found, ["ticker", "event_date", "magnitude_key"], "left").withColumn("has_folder", F.coalesce("has_folder", F.lit(False)))


def left_join_flags(events: DataFrame, flags: list[DataFrame], keys: list[str]) -> DataFrame:
    """Attach annotation tables by key; rows are never lost or multiplied (a table's repeats collapse)."""
    for f in flags:
        once = f.groupBy(*keys).agg(*(F.max(c).alias(c) for c in f.columns if c not in keys))
        events = events.join(once, keys, "left")
    return events


def in_scope(kind: Column, wanted: list[str], excluded: list[Column]) -> Column:
    """The class is wanted and no exclusion holds; nulls neither admit nor exclude."""
    scope = F.coalesce(kind.isin(*wanted), F.lit(False))
    for x in excluded:
        scope = scope & ~F.coalesce(x, F.lit(False))
    return scope


def classify_by_rules(text: Column, rules: list[tuple[str, str]], default: str = "common") -> tuple[Column, Column]:
    """(class, rule number) of the first matching pattern; the default is rule 0."""
    kind = number = None
    for i, (pattern, name) in enumerate(rules, 1):
        hit = text.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        number = F.when(hit, i) if number is None else number.when(hit, i)
    return kind.otherwise(default), number.otherwise(0)


def filter_waterfall(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows in, out and dropped at each successive filter, from one aggregate."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, cond) in enumerate(steps, 1):
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count(F.when(passed, 1)).alias(f"n{i}"))
    stages = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"), F.col(f"n{i - 1}").alias("rows_in"), F.col(f"n{i}").alias("rows_out")) for i, (name, _) in enumerate(steps, 1)))
    return rows.agg(*aggs).select(F.inline(stages)).withColumn("dropped", F.col("rows_in") - F.col("rows_out"))


def dup_key_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reconcile_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on both sides, on one side only, and overlap percentages."""
    side = lambda df, c: df.select(*keys).distinct().withColumn(c, F.lit(1))
    both = side(left, "l").join(side(right, "r"), keys, "full")
    n = lambda cond: F.count(F.when(cond, 1))
    made = both.agg(n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), n(F.col("r").isNull()).alias("only_left"), n(F.col("l").isNull()).alias("only_right"))
    pct = lambda c: 100 * ratio(F.col("both"), F.col("both") + F.col(c))
    return made.withColumns({"left_pct": pct("only_left"), "right_pct": pct("only_right")})


def classify_match(events: DataFrame, folders: DataFrame, magnitude: str = "magnitude", text: str = "magnitude_text", by: tuple[str, ...] = ("ticker", "event_date")) -> DataFrame:
    """Why an event isn't served by a folder, from all folders of its ticker and date.

    ``folders`` has the magnitude as written (``text``), has_trades and has_quotes. Any folder whose text is not the event's
    magnitude to two places makes a format mismatch; else absent, a collision of several, or the sides that the
    one folder lacks.
    """
    keys = list(by)
    wanted = F.format_string("%.2f", F.col(magnitude))
    met = events.select(*keys, magnitude).distinct().join(folders, keys)
    same = F.col(text) == wanted
    found = met.groupBy(*keys, magnitude).agg(
        F.count(F.when(~same, 1)).alias("n_other"), F.count(F.when(same, 1)).alias("n_exact"), F.max(F.when(same, F.col("has_trades"))).alias("t"), F.max(F.when(same, F.col("has_quotes"))).alias("q"),
    )
    label = (
        F.when(F.col("n_other") > 0, "format_mismatch").when(F.coalesce("n_exact", F.lit(0)) == 0, "folder_absent").when(F.col("n_exact") > 1, "duplicate_collision")
        .when(F.col("t") & ~F.col("q"), "missing_quotes").when(F.col("q") & ~F.col("t"), "missing_trades").when(~F.col("t") & ~F.col("q"), "missing_both").otherwise("unexpected_both_present")
    )
    return events.join(found, [*keys, magnitude], "left").select(*events.columns, label.alias("match"))


def classify_folders(folders: DataFrame, events: DataFrame, magnitude: str = "magnitude", text: str = "magnitude_text", by: tuple[str, str] = ("ticker", "event_date")) -> DataFrame:
    """Each folder's events by its parsed key: matched, orphan or ambiguous; or why it has no key."""
    ticker, date = by
    key = lambda c: F.round(c.cast("double"), 2).cast("decimal(18,2)")
    counts = events.groupBy(ticker, date, key(F.col(magnitude)).alias("k")).agg(F.count(F.lit(1)).alias("n_events"))
    parsed = folders.withColumn("k", key(F.col(text).try_cast("double")))
    joined = parsed.join(counts, [ticker, date, "k"], "left")
    label = F.when(F.col(date).isNull(), "none_date_unresolved").when(F.col(ticker).isNull() | F.col("k").isNull(), "unparseable").when(F.col("n_events").isNull(), "orphan").when(F.col("n_events") == 1, "matched").otherwise("ambiguous")
    return joined.select(*folders.columns, label.alias("match"))


def fallback_match(orphans: DataFrame, events: DataFrame, by: list[str], left_date: str, dates: list[str]) -> DataFrame:
    """Match orphans on any of several date columns; label none, unique or multiple.

    One equi-join a date column, then a union: an OR in one join would not hash.
    """
    rows = orphans.withColumn("row", F.struct(*orphans.columns))
    found = None
    for d in dates:
        hit = rows.join(events.select(*by, F.col(d).alias(left_date), F.col("event_id").alias("hit")), [*by, left_date]).select("row", "hit")
        found = hit if found is None else found.unionByName(hit)
    counts = found.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hits"))
    label = F.when(F.col("n_hits").isNull(), "none").when(F.col("n_hits") == 1, "unique").otherwise("multiple")
    return rows.join(counts, "row", "left").withColumn("match", F.when(F.col(left_date).isNull(), "null_date").otherwise(label)).select(*orphans.columns, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "match")


def match_by_magnitude(folders: DataFrame, events: DataFrame, magnitude: str = "magnitude", date: str = "event_date", ticker: str = "ticker") -> DataFrame:
    """Folders without a usable date, matched on ticker and magnitude to two places alone: one event with or without a date, several, or none."""
    key = F.round(F.col(magnitude).cast("double"), 2).cast("decimal(18,2)")
    counts = events.groupBy(ticker, key.alias("k")).agg(F.count(F.lit(1)).alias("n_hits"), F.max(date).alias("found_date"))
    joined = folders.withColumn("k", key).join(counts, [ticker, "k"], "left")
    label = F.when(F.col("n_hits").isNull(), "no_match_found").when(F.col("n_hits") > 1, "multiple_matches").when(F.col("found_date").isNull(), "matched_null_date").otherwise("matched_valid_date")
    return joined.select(*folders.columns, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), label.alias("match"), F.when(F.col("n_hits") == 1, F.col("found_date")).alias("found_date"))


def magnitude_recompute_check(rows: DataFrame, bound: float, floor: float, tolerance: float = 0.01) -> DataFrame:
    """Magnitude from the high and the prior close, the absolute mismatch, and flags of junk.

    A magnitude over its bound, a prior close at or under its floor, a mismatch over the tolerance; what can't be computed is no mismatch.
    """
    again = ratio(F.col("high") - F.col("prior_close"), F.col("prior_close")) * 100
    made = rows.withColumn("recomputed", again).withColumn("mismatch", F.abs(F.col("recomputed") - F.col("magnitude")))
    no = F.lit(False)
    flags = {"over_bound": F.col("magnitude") > bound, "under_floor": F.col("prior_close") <= floor, "is_mismatch": F.col("mismatch") > tolerance}
    made = made.withColumns({n: F.coalesce(c, no) for n, c in flags.items()})
    return made.withColumn("is_junk", F.col("over_bound") | F.col("under_floor") | F.col("is_mismatch"))


def describe_quantiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """N, mean, deviation, extremes and exact quantiles of each group."""
    return describe(rows, by, {value: ((0.05, 0.5, 0.95), ("p05", "p50", "p95"))}, n=F.count(value), mean=F.avg(value), std=F.stddev_samp(value), min=F.min(value), max=F.max(value))


def set_diff_window(spine: DataFrame, other: DataFrame, keys: list[str], skipped: DataFrame) -> DataFrame:
    """Sessions of one spine that another lacks: the event's own day, one that the other calendar skipped (flanking), or another.

    ``skipped`` lists those sessions (session_date): a few days, broadcast.
    """
    gone = spine.join(other.select(*keys, "session_date"), [*keys, "session_date"], "left_anti")
    known = F.broadcast(skipped.select("session_date").distinct().withColumn("skipped", F.lit(True)))
    place = F.when(F.col("session_offset") == 0, "event_day").when(F.col("skipped"), "flanking").otherwise("outer")
    return gone.join(known, "session_date", "left").withColumn("place", place).drop("skipped")


def clear_repaired_flags(flags: DataFrame, manifest: DataFrame, ledger: DataFrame, keys: list[str], done: str = "ok") -> DataFrame:
    """A flag is cleared when the repair ledger has, with status ``done``, every side that the manifest asks of the event."""
    asked = manifest.select(*keys, "side").distinct()
    fixed = ledger.filter(F.col("status") == done).select(*keys, "side").distinct().withColumn("fixed", F.lit(True))
    whole = asked.join(fixed, [*keys, "side"], "left").groupBy(*keys).agg(F.bool_and(F.coalesce("fixed", F.lit(False))).alias("covered"))
    return flags.join(whole, keys, "left").withColumn("is_flagged", F.col("is_flagged") & ~F.coalesce("covered", F.lit(False))).drop("covered")


def volume_ratio_check(ticks: DataFrame, reported: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Tick volume over reported volume, and whether it lies in the band."""
    total = ticks.groupBy(*keys).agg(F.sum("size").alias("tick_volume"))
    made = reported.join(total, keys, "left").withColumn("volume_ratio", ratio(F.col("tick_volume"), F.col("reported_volume")))
    return made.withColumn("in_band", F.coalesce(F.col("volume_ratio").between(low, high), F.lit(False)))


def volume_band(rows: DataFrame, low: float, high: float) -> DataFrame:
    """The median over events of the volume ratio, and whether it lies in the band; one row."""
    made = describe(rows, [], {"volume_ratio": ((0.5,), ("median_ratio",))}, n=F.count("volume_ratio"), n_undefined=F.count(F.when(F.col("volume_ratio").isNull(), 1)))
    return made.withColumn("in_band", F.coalesce(F.col("median_ratio").between(low, high), F.lit(False)))


def log_evidence(lines: DataFrame, events: DataFrame, pattern: str, failure: str, before: int = 3, after: int = 3) -> DataFrame:
    """What log lines say of each event's window: explicit failure, mention, or nothing.

    Lines carry a ticker and a date; an event's days are laid out, so the range
    join is an equi-join on (ticker, day).
    """
    part = lambda i: F.regexp_extract("line", pattern, i)
    said = lines.select(part(1).try_cast("long").alias("ticker"), part(2).try_cast("date").alias("day"), F.when(part(3).rlike(failure), 2).otherwise(1).alias("rank")).dropna()
    said = said.groupBy("ticker", "day").agg(F.max("rank").alias("rank"))
    days = events.withColumn("day", F.explode(F.sequence(F.date_sub("event_date", before), F.date_add("event_date", after))))
    found = days.join(said, ["ticker", "day"], "left").groupBy(*events.columns).agg(F.max("rank").alias("rank"))
    return found.withColumn("evidence", F.when(F.col("rank") == 2, "explicit_failure").when(F.col("rank") == 1, "mentioned_no_failure").otherwise("not_mentioned")).drop("rank")


def class_from_reference(tickers: DataFrame, reference: DataFrame, mapping: dict[str, tuple[str, bool]], events: DataFrame, agree: dict[str, tuple[str, ...]], rule: str = "rule_class") -> DataFrame:
    """Each ticker's class by its latest reference row, whether that is in scope, and whether the rules' class agrees.

    ``mapping``: code -> (class, in scope); a code that it lacks is ``other``, a ticker without a row ``unresolved``.
    ``agree``: class by rules -> the classes that agree with it; null for others and the unresolved. A ticker is
    reused where it is no longer active and any of its events lies after its last delisting.
    """
    latest = reference.groupBy("ticker").agg(F.max_by(F.struct("code", "active"), F.struct("as_of", "code")).alias("r"), F.max("delisted").alias("delisted"))
    last = events.groupBy("ticker").agg(F.max("event_date").alias("last_event"))
    code = F.col("r.code")
    table = lambda i: F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (k, v[i])))
    kind = F.when(code.isNull(), "unresolved").otherwise(F.coalesce(table(0)[code], F.lit("other")))
    joined = tickers.join(latest, "ticker", "left").join(last, "ticker", "left").withColumn("class", kind)
    agrees = None
    for own, classes in agree.items():
        hit = F.when((F.col(rule) == own) & code.isNotNull(), F.col("class").isin(*classes))
        agrees = hit if agrees is None else F.coalesce(agrees, hit)
    reuse = ~F.col("r.active") & (F.col("last_event") > F.col("delisted"))
    return joined.select(*tickers.columns, code.alias("code"), "class", F.coalesce(table(1)[code], F.lit(False)).alias("in_scope"), agrees.alias("agrees"), F.coalesce(reuse, F.lit(False)).alias("ticker_reuse"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pair counts of two labels and whether they agree."""
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).withColumn("agrees", F.col(a) == F.col(b))


#: A factor near one of these is near 1 or a small integer's reciprocal.
RECIPROCALS = (1.0, *(1.0 / k for k in (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 50)))


def basis_agreement(rows: DataFrame, one: str, two: str, band: float = 0.02, share: float = 90.0) -> DataFrame:
    """How many of the events with both price ratios have them within ``band`` of each other, relative to the second; one row."""
    apart = ratio(F.abs(F.col(one) - F.col(two)), F.col(two))
    both = rows.filter(F.col(one).isNotNull() & F.col(two).isNotNull()).withColumn("apart", apart)
    made = both.agg(F.count(F.lit(1)).alias("n_both"), F.count(F.when(F.col("apart") < band, 1)).alias("n_agree"))
    return made.withColumn("agree_pct", 100 * ratio(F.col("n_agree"), F.col("n_both"))).withColumn("passes", F.coalesce(F.col("agree_pct") >= share, F.lit(False)))


def basis_stability(rows: DataFrame, ticker: str, one: str, two: str, most: float = 1.10) -> DataFrame:
    """Of tickers with several events, the largest over the smallest of both ratios of all of them; null for fewer than two values."""
    pooled = rows.select(ticker, F.explode(F.array(one, two)).alias("r"), F.lit(0.5).alias("half"))
    made = pooled.groupBy(ticker).agg(F.sum("half").cast("long").alias("n_events"), F.count("r").alias("n_values"), F.max("r").alias("top"), F.min("r").alias("low")).filter("n_events > 1")
    spread = F.when(F.col("n_values") >= 2, ratio(F.col("top"), F.col("low")))
    return made.select(ticker, "n_events", "n_values", spread.alias("spread"), (spread < most).alias("is_stable"))


def basis_factors(rows: DataFrame, flag: str, one: str, two: str, over: float = 1.05, tolerance: float = 0.05) -> DataFrame:
    """Both ratios of flagged and other events: how many are well above 1, and near 1 or a small reciprocal."""
    pooled = rows.select(flag, F.explode(F.array(one, two)).alias("r")).filter("r IS NOT NULL")
    near = F.exists(F.array(*map(F.lit, RECIPROCALS)), lambda t: F.abs(F.col("r") - t) < tolerance * t)
    return pooled.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("r") > over).cast("double"))).alias("over_pct"), (100 * F.avg(near.cast("double"))).alias("near_pct"))


def gap_cause(rows: DataFrame, medians: DataFrame, by: list[str], material: float = 0.2, band: tuple[float, float] = (0.02, 0.07), internal: float = 0.10) -> DataFrame:
    """coverage_gap, band_margin or unexplained, from two price ratios and three pieces of evidence.

    ``rows`` has ratio_one, ratio_two, reported_high, day_high and the coverage of C10 (rth_bars, longest_gap, outside_share);
    ``medians`` those of the cohort as median_*. Evidence: materially fewer bars, a longer gap, a larger share outside.
    """
    joined = rows.join(medians, by, "left")
    one, two = F.col("ratio_one"), F.col("ratio_two")
    apart, inside = ratio(F.abs(one - two), two), ratio(two - one, one)
    no = F.lit(False)
    few = F.coalesce((F.col("median_rth_bars") > 0) & (F.col("rth_bars") < F.col("median_rth_bars") * (1 - material)), no)
    more = lambda c: F.coalesce(F.col(c) > F.col(f"median_{c}") * (1 + material), no)
    n = few.cast("int") + more("longest_gap").cast("int") + more("outside_share").cast("int")
    higher = F.coalesce(F.col("reported_high") > F.col("day_high"), no)
    label = (
        F.when((inside > internal) & higher & (n > 0), "coverage_gap")
        .when(apart.between(*band) & (F.abs(inside) <= internal) & ~(higher & (n > 0)), "band_margin").otherwise("unexplained")
    )
    return joined.withColumns({"n_evidence": n, "cause": label})


def key_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An order-free fingerprint of the key set: count, sum and xor of hashes of distinct keys."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, 15), 16, 10).cast("long")
    hashed = rows.select(*keys).distinct().select(h.alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def monthly_counts(events: DataFrame, date: str) -> DataFrame:
    """Events and date range of each month."""
    return events.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))
