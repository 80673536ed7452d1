"""Plan patterns shared by the operators: as-of, islands, first crossing, exact draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.sources.scratch import scratch


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, seq: str | None = None, strict: bool = False, prefix: str = "r_", span: float | None = None, tol: float | None = None) -> DataFrame:
    """For each left row the latest right row at or before it (before it, if ``strict``); outer.

    Both sides are stacked and the last right row is carried forward: one shuffle
    and one sort by key. Of right rows at the same time the highest ``seq`` wins;
    without ``seq``, one that their values' hashes choose. The right side's columns come back
    with ``prefix``; all null where nothing matches, or nothing within ``tol`` of
    the left row. Rows with null keys match nothing.

    With ``span`` a key is cut into buckets of so much time, each a sort of its
    own, so that a hot key is many tasks. A bucket starts with the last right row before
    it, which comes from one row a (key, bucket), carried over empty buckets.
    """
    right_on = right_on or on
    carried = [c for c in right.columns if c not in by]
    match = F.struct(*(F.col(c).alias(c) for c in carried))
    none = right.select(match.alias("m")).schema["m"].dataType
    tie = F.col(seq).cast("long") if seq else F.xxhash64(*carried)
    cut = lambda t: F.lit(0).cast("long") if span is None else F.floor(F.col(t) / span).cast("long")
    rows = left.select(
        *(F.col(c).alias(f"l_{c}") for c in left.columns), *(F.col(b).alias(f"k_{b}") for b in by), cut(on).alias("k_cut"), F.lit(1).alias("k_own"), F.col(on).alias("k_t"), F.lit(0 if strict else 1).alias("k_side"),
        F.lit(None).cast("long").alias("k_seq"), F.lit(True).alias("k_left"), F.lit(None).cast(none).alias("k_m"), F.lit(None).cast(right.schema[right_on].dataType).alias("k_rt"),
    )
    right = right.dropna(subset=list(dict.fromkeys([*by, right_on])))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in left.columns]
    keys = [f"k_{b}" for b in by]
    other = right.select(*blank, *(F.col(b).alias(f"k_{b}") for b in by), cut(right_on).alias("k_cut"), F.lit(1).alias("k_own"), F.col(right_on).alias("k_t"), F.lit(1 if strict else 0).alias("k_side"), tie.alias("k_seq"), F.lit(False).alias("k_left"), match.alias("k_m"), F.col(right_on).alias("k_rt"))
    both = rows.unionByName(other)
    if span is not None:
        last = F.max_by(F.struct("k_m", "k_rt"), F.when(~F.col("k_left"), F.struct("k_t", "k_seq")))
        ends = both.filter(F.col("k_cut").isNotNull()).dropna(subset=keys).groupBy(*keys, "k_cut").agg(F.when(F.max(~F.col("k_left")), last).alias("end"), F.max("k_left").alias("asked"))
        before = Window.partitionBy(*keys).orderBy("k_cut").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
        first = ends.withColumn("end", F.last("end", ignorenulls=True).over(before)).filter("asked AND end IS NOT NULL")
        time = F.lit(None).cast(left.schema[on].dataType)
        both = both.unionByName(first.select(*blank, *keys, "k_cut", F.lit(0).alias("k_own"), time.alias("k_t"), F.lit(0).alias("k_side"), F.lit(None).cast("long").alias("k_seq"), F.lit(False).alias("k_left"), F.col("end.k_m"), F.col("end.k_rt")))
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    near = F.lit(True) if tol is None else F.coalesce(F.col("k_t") - F.col("k_last.t") <= tol, F.lit(False))
    w = Window.partitionBy(*keys, *(["k_cut"] if span is not None else [])).orderBy("k_own", "k_t", "k_side", "k_seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("k_m").isNotNull(), F.struct(F.col("k_m").alias("m"), F.col("k_rt").alias("t"))), ignorenulls=True).over(w)
    both = both.withColumn("k_last", F.when(keyed, held)).withColumn("k_m", F.when(near, F.col("k_last.m")))
    return both.filter("k_left").select(*(F.col(f"l_{c}").alias(c) for c in left.columns), *(F.col(f"k_m.{c}").alias(f"{prefix}{c}") for c in carried))


def islands(df: DataFrame, by: list[str], order: list[str], change: Column, name: str = "run") -> DataFrame:
    """Number the runs of each key: a row where ``change`` holds starts the next one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(change, 1).otherwise(0)).over(w))


def next_known(value: Column, by: list[str], order: list[str]) -> Column:
    """The first value that is not null from each row on, carried from a key's end to its start.

    A frame that reaches to the end is gone through anew for each row: the square of a key's rows.
    """
    back = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(back)


def first_when(condition: Column, value: Column) -> Column:
    """Aggregate: the smallest value at which the condition holds."""
    return F.min(F.when(condition, value))


def quantiles(value: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75), names: tuple[str, ...] = ("q25", "median", "q75")) -> list[Column]:
    """Exact interpolated quantiles as aggregates."""
    return [F.percentile(F.col(value), F.lit(q)).alias(n) for q, n in zip(qs, names, strict=True)]


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


#: Values of a group, or of a table, that may be sorted whole for a quantile; of more only a band around the place is.
WHOLE = 50_000


def exact_quantile(rows: DataFrame, value: str, q: float, accuracy: int = 10_000) -> float | None:
    """The interpolated quantile of all rows, null where there are none."""
    found = grouped_quantiles(rows, [], {value: ((q,), ("v",))}, accuracy).first()
    return found.v if found else None


def grouped_quantiles(rows: DataFrame, by: list[str], values: dict[str, tuple[tuple[float, ...], tuple[str, ...]]], accuracy: int = 10_000, whole: int = WHOLE, counts: bool = False, on_disk: bool = False) -> DataFrame:
    """Exact interpolated quantiles of values by group: ``values`` maps a column to places and names.

    No buffer holds a group's values. A mergeable sketch gives each group of more than
    ``whole`` values a band around each place, about four rows in ``accuracy`` wide;
    rows below it are only counted, the band's are counted by value, and running
    counts over the sorted values of the bands find the two neighbours of each
    place. A smaller group is its own band, as is one in which the sketch's error may be under two rows. The values are written to the shared folder
    once, so that what they are made of is not computed twice. Nulls take no part;
    a group of nulls alone has null quantiles. ``counts`` adds n_<value>;
    ``on_disk``: the rows are stored already.
    """
    cells_by = [*by, "_c"]
    stacked = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_x")) for i, v in enumerate(values))))
    kept = rows.select(*by, stacked.alias("_s")).select(*by, "_s._c", "_s._x")
    kept = kept if on_disk else stored(kept, "values")
    slack = 2 / accuracy
    places = sorted({q for qs, _ in values.values() for q in qs})
    edges = [min(max(q + side * slack, 0.0), 1.0) for q in places for side in (-1, 1)]
    cells = kept.groupBy(*cells_by).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", edges, accuracy).alias("_e"))
    cells = cells.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cells_by)), "_n", F.when(F.col("_n") > max(whole, 2 * accuracy), F.col("_e")).alias("_e"))
    same = F.lit(True)
    for i, c in enumerate(cells_by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    met = kept.join(cells, same)
    x = F.col("_x")
    inside = F.array(*(F.when(x <= F.get("_e", F.lit(2 * i + 1)), F.struct(F.lit(i).alias("b"), F.when(x >= F.get("_e", F.lit(2 * i)), x).alias("x"))) for i in range(len(places))))
    bands = F.when(F.col("_e").isNull(), F.array(F.struct(F.lit(-1).alias("b"), x.alias("x")))).otherwise(F.filter(inside, lambda s: s.isNotNull()))
    # a null x stands for all rows below a band, or for the nulls of a group that is its own band
    each = met.withColumn("_s", F.explode_outer(bands)).select(*cells_by, "_n", F.coalesce("_s.b", F.lit(-2)).alias("_b"), F.col("_s.x").alias("_x"))
    tally = each.groupBy(*cells_by, "_n", "_b", "_x").agg(F.count(F.lit(1)).alias("_m"))
    tally = tally.withColumn("_m", F.when((F.col("_b") == -1) & F.col("_x").isNull(), 0).otherwise(F.col("_m")))
    run = Window.partitionBy(*cells_by, "_b").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tally.withColumn("_to", F.sum("_m").over(run)).withColumn("_from", F.col("_to") - F.col("_m"))
    n = F.col("_n")
    found = []
    for c, (v, (qs, names)) in enumerate(values.items()):
        own = F.col("_c") == c
        for q, name in zip(qs, names, strict=True):
            place = (n - 1) * F.lit(q)
            band = own & F.col("_b").isin(-1, places.index(q)) & F.col("_x").isNotNull()
            at = lambda p, band=band: F.max(F.when(band & (F.col("_from") <= p) & (p < F.col("_to")), F.col("_x")))
            some, share = F.max(F.when(own, n)), F.max(F.when(own, place - F.floor(place)))
            low, high = at(F.floor(place)), at(F.ceil(place))
            value = F.when(low.isNull() | high.isNull(), F.raise_error(F.lit(f"the band of {v} misses its place")).cast("double")).otherwise(low * (1 - share) + high * share)
            found.append(F.when(some > 0, value).alias(name))
        if counts:
            found.append(F.coalesce(F.max(F.when(own, n)), F.lit(0)).alias(f"n_{v}"))
    return ranked.groupBy(*by).agg(*found) if by else ranked.agg(*found)


#: Places and names of quartiles.
QUARTILES = ((0.25, 0.5, 0.75), ("q25", "median", "q75"))


def describe(rows: DataFrame, by: list[str], values: dict[str, tuple[tuple[float, ...], tuple[str, ...]]], on_disk: bool = False, **aggregates: Column) -> DataFrame:
    """Groups with plain aggregates beside ``grouped_quantiles`` of some values."""
    plain = rows.groupBy(*by).agg(*(a.alias(n) for n, a in aggregates.items()))
    if not by:
        return plain.join(F.broadcast(grouped_quantiles(rows, by, values, on_disk=on_disk)))  # a row each
    return _null_safe(plain, grouped_quantiles(rows, by, values, on_disk=on_disk), by)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder once, for plans that read them several times."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def hash_draw(seed: int, *cols: str) -> Column:
    """A repeatable draw for a key: md5 of the seed and the key's text, as hexadecimal."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def global_rank(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with ``rank`` (from 1, by ``order``) and ``total``, without one window over all rows.

    Rows are dealt by ranges of the whole order, so that ties in its first column
    spread, and written to the shared folder with their place in their range;
    ranks are places moved up by the rows of the ranges before. Nulls rank first.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    path = scratch(spark, "ranked")
    ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_range")  # a row a range
    ahead = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = F.broadcast(counts.select("_range", ahead.alias("_ahead"), whole.alias("total")))
    return kept.join(offsets, "_range").withColumn("rank", F.col("_ahead") + F.col("_place") + 1).drop("_range", "_place", "_ahead")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with their average rank (from 1) by a value inside their group; ties share it, nulls have none.

    Values are counted first and dealt by ranges of (group, value), so that a group is
    many tasks; a range's counts start where those of the group's ranges before it end.
    """
    spark = rows.sparkSession
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    path = scratch(spark, "ranks")
    counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    ahead = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = kept.groupBy(*by, "_range").agg(F.sum("_n").alias("_m")).withColumn("_start", ahead).drop("_m")
    run = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = kept.withColumn("_upto", F.sum("_n").over(run))
    ranks = _null_safe(placed, starts, [*by, "_range"]).select(*by, value, (F.col("_start") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return _null_safe(rows, ranks, [*by, value], "left")


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls match nulls; the left side's columns and the right side's others."""
    right = right.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(by)), *(c for c in right.columns if c not in by))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return left.join(right, same, how).drop(*(f"_r{i}" for i in range(len(by))))


def rank_buckets(rows: DataFrame, order: list[str], n: int, name: str = "bucket") -> DataFrame:
    """Rows with balanced rank buckets 1..n; a single row is bucket 1."""
    r, m = F.col("rank"), F.col("total")
    bucket = F.when(m == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(n) * (r - 1) / F.nullif(m - 1, F.lit(0))).cast("int")))
    return global_rank(rows, order).withColumn(name, bucket).drop("rank", "total")
