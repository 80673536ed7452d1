"""Sources, schema and sinks (A): keyed reads, schema union, incremental and guarded writes.

Paths are Spark paths; files are only opened by Spark, so any store it reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.frames import hash_draw


def read_keyed(spark: SparkSession, path: str, pattern: str, keys: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """A1: Parquet files with key columns taken from their names; files that do not match are skipped.

    ``keys``: column -> type, in the order of the pattern's groups.
    """
    reader = spark.read.option("mergeSchema", schema is None).option("recursiveFileLookup", True)
    rows = (reader.schema(schema) if schema else reader).parquet(path)
    name = F.col("_metadata.file_path")
    part = [F.regexp_extract(name, pattern, i).try_cast(t).alias(c) for i, (c, t) in enumerate(keys.items(), 1)]
    return rows.select("*", *part, name.rlike(pattern).alias("_match")).filter("_match").drop("_match")


def union_schema(schemas: dict[str, T.StructType], overrides: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> T.StructType:
    """A2: one schema over files' schemas; a column with several types needs an override, or this raises."""
    overrides, kinds = overrides or {}, {}
    for schema in schemas.values():
        for f in schema.fields:
            if f.name not in exclude:
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    clash = {c: sorted(k) for c, k in kinds.items() if len(k) > 1 and c not in overrides}
    if clash:
        raise ValueError(f"columns with several types and no override: {clash}")
    fields = [T.StructField(c, T._parse_datatype_string(overrides[c] if c in overrides else next(iter(k)))) for c, k in kinds.items()]
    return T.StructType(fields)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A3: the columns of a schema, cast, null where the table lacks them."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def align_union(frames: list[DataFrame], overrides: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A3: union by name of tables whose schemas drifted apart."""
    schema = union_schema({str(i): f.schema for i, f in enumerate(frames)}, overrides, exclude)
    out = None
    for f in frames:
        part = align(f, schema)
        out = part if out is None else out.unionByName(part)
    return out


#: Schemes whose files tasks open themselves, for their last bytes alone; those of other stores come through Spark whole.
OPENED = ("file", "hdfs", "s3", "gs")


def _footer_rows(files, opened: bool):
    """(file, n_rows, state, names, types) of files by their Parquet footers: ``files`` yields (path, footer's bytes or None)."""
    import io

    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    for path, length, raw in files:
        name = path.rsplit("/", 1)[-1]
        try:
            if opened:
                store, inner = pafs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    meta = pq.ParquetFile(file).metadata
            else:
                footer = b"" if raw is None else bytes(raw)
                meta = pq.ParquetFile(io.BytesIO(b"PAR1" + footer + len(footer).to_bytes(4, "little") + b"PAR1")).metadata
            schema = meta.schema.to_arrow_schema()
            types = [from_arrow_type(t).simpleString() for t in schema.types]
        except (pa.ArrowException, OSError, TypeError, ValueError, NotImplementedError):
            yield name, length, None, "unreadable", [], []
        else:
            yield name, length, meta.num_rows, "rows" if meta.num_rows else "empty", schema.names, types


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """A2, A4: (file, length, n_rows, state, columns) of every Parquet file below a path: rows, empty or unreadable, and its columns' types.

    Footers are read in tasks, none on the driver. Stores that tasks can't open themselves give whole files to Spark, which cuts the footers off.
    """
    import pandas as pd

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    one = listed.select("path").head()
    opened = one is None or one.path.split(":", 1)[0] in OPENED
    if opened:
        files = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length", F.lit(None).cast("binary").alias("footer"))
    else:
        size = F.conv(F.hex(F.reverse(F.substring("content", -8, 4))), 16, 10).cast("long")
        files = listed.withColumn("size", size).select("path", "length", F.expr("CASE WHEN length > 12 AND size < length - 8 THEN substring(content, CAST(length - 7 - size AS INT), CAST(size AS INT)) END").alias("footer"))

    def rows(frames):
        for f in frames:
            made = list(_footer_rows(zip(f["path"], f["length"], f["footer"], strict=True), opened))
            yield pd.DataFrame(made, columns=["file", "length", "n_rows", "state", "names", "types"]).astype({"n_rows": "Int64"})

    found = files.repartition("path").mapInPandas(rows, "file string, length long, n_rows long, state string, names array<string>, types array<string>")
    columns = F.zip_with("names", "types", lambda n, t: F.struct(n.alias("name"), t.alias("type")))
    return found.select("file", "length", "n_rows", "state", columns.alias("columns"))


def column_types(states: DataFrame) -> DataFrame:
    """A2: (column, type, n_files) over the readable files of ``file_states``."""
    each = states.filter("state <> 'unreadable'").select(F.explode("columns").alias("c"))
    return each.groupBy(F.col("c.name").alias("column"), F.col("c.type").alias("type")).agg(F.count(F.lit(1)).alias("n_files"))


def schema_of_files(spark: SparkSession, path: str, overrides: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> T.StructType:
    """A2: one schema over the files below a path, columns by name; types that differ need an override, or this raises.

    Only the distinct (column, type) pairs come to the driver.
    """
    found = column_types(file_states(spark, path)).orderBy("column", "type").collect()
    return union_schema({f"{r.column}:{r.type}": T.StructType([T.StructField(r.column, T._parse_datatype_string(r.type))]) for r in found}, overrides, exclude)


def read_drifted(spark: SparkSession, path: str, overrides: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A3 from files: the rows of all readable files below a path, cast to their one schema; files of equal schemas are read together."""
    schema = schema_of_files(spark, path, overrides, exclude)
    kind = F.concat_ws("|", F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"])))
    states = file_states(spark, path).filter("state = 'rows'").select(F.col("file").alias("_file"), "columns", kind.alias("kind"))
    out = spark.createDataFrame([], schema)
    for found in states.groupBy("kind").agg(F.first("columns").alias("columns")).orderBy("kind").collect():  # a row a schema
        own = T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in found.columns])
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", True).schema(own).parquet(path).withColumn("_file", F.col("_metadata.file_name"))
        wanted = F.broadcast(states.filter(F.col("kind") == found.kind).select("_file"))
        out = out.unionByName(align(rows.join(wanted, "_file", "left_semi"), schema))
    return out


def read_skip_unreadable(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A4: (rows of the files that can be read whole, file and state of the others).

    A file is unreadable without a footer, and ``partial`` if fewer rows come out of it
    than its footer says (all columns are decoded); neither gives rows. A valid empty file is no fault, and Spark doesn't list files without bytes.
    """
    read = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").schema(schema).parquet(path)
    named = read.withColumn("_file", F.col("_metadata.file_name"))
    decoded = named.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n_read"), F.bit_xor(F.xxhash64(*(F.col(c) for c in schema.names))).alias("digest"))
    met = file_states(spark, path).join(decoded, "file", "left")
    state = F.when(F.col("state") == "unreadable", "unreadable").when((F.col("n_rows") > 0) & (F.col("digest").isNull() | (F.col("n_read") < F.col("n_rows"))), "partial")
    bad = met.select("file", state.alias("state")).filter("state IS NOT NULL")
    return named.join(F.broadcast(bad.select(F.col("file").alias("_file"))), "_file", "left_anti").drop("_file"), bad


def flatten(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Columns of a nested schema under dotted names."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        out += flatten(f.dataType, path) if isinstance(f.dataType, T.StructType) else [F.col(path).alias(path.replace("`", ""))]
    return out


def read_json_reference(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """A5: a list of objects, or (``value``: its DDL type) an object of objects, with dotted columns.

    The outer object's names become column ``key``.
    """
    if value is None:
        rows = spark.read.option("multiLine", True).json(path)
        return rows.select(*flatten(rows.schema))
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "v")).select("key", "v.*")
    return rows.select(*flatten(rows.schema))


def read_csv_reference(spark: SparkSession, path: str, wildcard: str | None = None, column: str | None = None) -> DataFrame:
    """A headed CSV without comment lines, and without rows whose column is a wildcard."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("comment", "#").csv(path)
    return rows if wildcard is None else rows.filter(F.col(column) != wildcard)


def live_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A named view over files, union by name, with each row's file."""
    rows = spark.read.option("mergeSchema", True).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    rows.createOrReplaceTempView(name)
    return rows


def file_census(rows: DataFrame, ts: str) -> DataFrame:
    """A10: rows and first and last time of each file."""
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def presence_class(events: DataFrame, trades: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Both, trades_only, quotes_only or neither for each event."""
    side = lambda df, c: df.select(*keys).distinct().withColumn(c, F.lit(True))
    both = events.select(*keys).join(side(trades, "t"), keys, "left").join(side(quotes, "q"), keys, "left")
    label = F.when(F.col("t") & F.col("q"), "both").when(F.col("t"), "trades_only").when(F.col("q"), "quotes_only").otherwise("neither")
    return both.select(*keys, label.alias("presence"))


def materialize_sample(rows: DataFrame, sample: DataFrame, keys: list[str], cohort: str) -> DataFrame:
    """The sampled events' rows, tagged with their cohort."""
    return rows.join(sample.select(*keys).distinct(), keys, "left_semi").withColumn("cohort", F.lit(cohort))


def incremental_build(source: DataFrame, build, cache_path: str, keys: list[str], batch: str) -> DataFrame:
    """Build only keys missing from the cache and append them as one batch; returns the whole cache.

    A batch that is run again overwrites its own partition alone.
    """
    spark = source.sparkSession
    try:
        cached = spark.read.parquet(cache_path).filter(F.col("batch") != batch).select(*keys).distinct()
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        cached = None
    todo = source if cached is None else source.join(cached, keys, "left_anti")
    made = build(todo).withColumn("batch", F.lit(batch))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(cache_path)
    return spark.read.parquet(cache_path)


def append_with_guard(table: DataFrame, repair: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the repair rows of keys it lacks; ledger of inserted and skipped keys)."""
    have = table.select(*keys).distinct()
    new = repair.join(have, keys, "left_anti")
    outcome = repair.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(have.withColumn("had", F.lit(True)), keys, "left")
    return table.unionByName(new), outcome.select(*keys, "n_rows", F.when(F.col("had"), "collision_skipped").otherwise("inserted").alias("outcome"))


def guard_counts(before: DataFrame, after: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key before and after the insert, and whether they are what the ledger says."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    inserted = ledger.select(*keys, F.when(F.col("outcome") == "inserted", F.col("n_rows")).alias("n_inserted"))
    rows = n(after, "n_after").join(n(before, "n_before"), keys, "full").join(inserted, keys, "full").fillna(0, ["n_after", "n_before", "n_inserted"])
    return rows.withColumn("is_right", F.col("n_before") + F.col("n_inserted") == F.col("n_after"))


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A Parquet sink, partitioned by columns if given."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def column_presence(rows: DataFrame, rare: float = 0.05) -> DataFrame:
    """Non-null rate of every column from one pass, and whether it is rare."""
    rates = rows.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in rows.columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in rows.columns))
    return rates.select(F.inline(each)).withColumn("is_rare", F.col("rate") < rare)


def optional_columns(rows: DataFrame, file: str, columns: list[str], rare: float = 0.05) -> DataFrame:
    """Of each column the non-null rate, the files without any value of it, and whether it is optional: rare and sometimes absent."""
    each = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns))
    long = each.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("k")) for c in columns))))
    made = long.groupBy("column").agg((F.sum("k") / F.sum("n")).alias("rate"), F.count(F.when(F.col("k") == 0, 1)).alias("n_absent"), F.count(F.lit(1)).alias("n_files"))
    return made.withColumn("is_optional", (F.col("rate") < rare) & (F.col("n_absent") > 0))


def timestamp_granularity(rows: DataFrame, ts: str) -> DataFrame:
    """The epoch unit by magnitude, share of whole seconds, and distinct stamps."""
    per = F.when(F.col("top") >= 10**17, 10**9).when(F.col("top") >= 10**14, 10**6).when(F.col("top") >= 10**11, 10**3).otherwise(1)
    unit = F.when(F.col("top") >= 10**17, "ns").when(F.col("top") >= 10**14, "us").when(F.col("top") >= 10**11, "ms").otherwise("s")
    sums = [F.avg((F.col(ts) % d == 0).cast("double")).alias(f"w{d}") for d in (1, 10**3, 10**6, 10**9)]
    made = rows.agg(F.max(ts).alias("top"), F.countDistinct(ts).alias("n_distinct"), *sums)
    whole = F.when(per == 10**9, F.col("w1000000000")).when(per == 10**6, F.col("w1000000")).when(per == 10**3, F.col("w1000")).otherwise(F.col("w1"))
    return made.select(unit.alias("unit"), whole.alias("whole_second_share"), "n_distinct")


def null_signature_shares(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """For each event the rows that have exactly these columns null, and their share."""
    hit = F.lit(True)
    for c in columns:
        hit = hit & F.col(c).isNull()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_hit"), F.avg(hit.cast("double")).alias("share"))


def null_signature(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Events in which none, some or all rows have exactly these columns null."""
    each = null_signature_shares(rows, columns, keys)
    return each.groupBy(F.when(F.col("share") == 0, "none").when(F.col("share") == 1, "all").otherwise("some").alias("events")).agg(F.count(F.lit(1)).alias("n"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or changed between two versions, with the changed columns."""
    pack = lambda df, n: df.select(*keys, F.struct(*values).alias(n))
    both = pack(a, "a").join(pack(b, "b"), keys, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in values)))
    rows = both.withColumn("kind", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed"))
    return rows.filter("kind IS NOT NULL").select(*keys, "kind", F.when(F.col("kind") == "changed", F.array_join(changed, ",")).alias("columns"))


def diff_summary(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both versions and their difference, keys added, removed, changed and equal."""
    kinds = table_diff(a, b, keys, values).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("added", "removed", "changed")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    met = a.select(*keys).join(b.select(*keys), keys, "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    rows = n(a, "n_before").join(F.broadcast(n(b, "n_after"))).join(F.broadcast(kinds)).join(F.broadcast(met))  # a row each
    return rows.select("n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("delta"), "added", "removed", "changed", (F.col("matched") - F.col("changed")).alias("equal"))


def one_sided_codes(a: DataFrame, b: DataFrame, codes: str) -> DataFrame:
    """Codes of a list column that occur in one version only, with their rows there."""
    each = lambda df: df.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    one, two = each(a), each(b)
    return one.join(two, "code", "left_anti").withColumn("side", F.lit("before")).unionByName(two.join(one, "code", "left_anti").withColumn("side", F.lit("after")))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two samples holds, by side, repeats counted; no rows where the samples are the same."""
    only = lambda x, y, side: x.select(*keys).exceptAll(y.select(*keys)).withColumn("side", F.lit(side))
    return only(a, b, "before").unionByName(only(b, a, "after"))


def replace_session(table_path: str, rederived: DataFrame, partition_by: list[str]) -> None:
    """Replace the partitions (event, session) that the new rows name; all others stay as they are."""
    rederived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(table_path)


def partition_prints(table: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows of each partition and an order-free fingerprint of their contents."""
    h = F.xxhash64(*sorted(table.columns))
    return table.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"))


def replacement_proof(before: DataFrame, after: DataFrame, partition_by: list[str]) -> DataFrame:
    """From the prints taken before and after, each partition's rows and whether its contents are unchanged."""
    old, new = (df.select(*partition_by, F.struct("n", "hash_xor", "hash_sum").alias(c)) for df, c in ((before, "old"), (after, "new")))
    return old.join(new, partition_by, "full").select(*partition_by, F.col("old.n").alias("n_before"), F.col("new.n").alias("n_after"), F.coalesce(F.col("old") == F.col("new"), F.lit(False)).alias("is_unchanged"))


def seeded_files(files: DataFrame, n: int, seed: int, name: str = "file") -> DataFrame:
    """A seeded sample of file names."""
    return files.orderBy(hash_draw(seed, name), name).limit(n)
