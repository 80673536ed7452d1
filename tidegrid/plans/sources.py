"""Queries of the source, schema and sink operators (A).

Those over drifting, corrupt or partitioned files write such files from a given
table into the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.plans.fixtures import KEYS
from tidegrid.plans.registry import query
from tidegrid.sources import readers as a
from tidegrid.sources.scratch import scratch


@query("a1_read_keyed", "SELECT 'orders' AS name, count(*) AS n, min(o_orderkey) AS first FROM orders")
def _(v):
    rows = a.read_keyed(v.spark, f"{v.sf_dir}/orders.parquet", r"(orders)", {"name": "string"})
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def drifting(v):
    """Three files of lineitem whose schemas differ: whole, without l_tax, l_linenumber as double."""
    rows, paths = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag"), []
    for i, part in enumerate((rows, rows.drop("l_tax"), rows.withColumn("l_linenumber", F.col("l_linenumber").cast("double")))):
        paths.append(f"{scratch(v.spark, 'drift')}/{i}")
        part.filter(F.pmod("l_orderkey", F.lit(3)) == i).write.parquet(paths[-1])
    return [v.spark.read.parquet(p) for p in paths]


@query("a2_union_schema", """
SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_orderkey % 3 <> 1 THEN l_tax END) AS n_tax, sum(l_linenumber)::DOUBLE AS lines, 'double' AS line_type FROM lineitem GROUP BY 1
""")
def _(v):
    frames = drifting(v)
    schema = a.union_schema({str(i): f.schema for i, f in enumerate(frames)}, {"l_linenumber": "double"})
    rows = a.align_union(frames, {"l_linenumber": "double"})
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("n_tax"), F.sum("l_linenumber").alias("lines")).withColumn("line_type", F.lit(schema["l_linenumber"].dataType.simpleString()))


@query("a3_read_drifted", """
SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_orderkey % 3 <> 1 THEN l_tax END) AS n_tax, sum(l_linenumber)::DOUBLE AS lines, 3::BIGINT AS n_schemas FROM lineitem GROUP BY 1
""")
def _(v):
    path, rows = scratch(v.spark, "drift"), v.table("lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")
    for i, part in enumerate((rows, rows.drop("l_tax"), rows.withColumn("l_linenumber", F.col("l_linenumber").cast("double")))):
        part.filter(F.pmod("l_orderkey", F.lit(3)) == i).write.parquet(f"{path}/{i}")
    made = a.read_drifted(v.spark, path, {"l_linenumber": "double"}).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("n_tax"), F.sum("l_linenumber").alias("lines"))
    kinds = a.file_states(v.spark, path).filter("state = 'rows'").agg(F.countDistinct(F.to_json("columns")).alias("n_schemas"))
    return made.join(F.broadcast(kinds))


@query("a4_read_skip_unreadable", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 1::BIGINT AS n_unreadable, 1::BIGINT AS n_empty FROM orders GROUP BY 1")
def _(v):
    from pyarrow import fs

    path, orders = scratch(v.spark, "unreadable"), v.table("orders").select("o_orderkey", "o_orderstatus")
    orders.repartitionByRange("o_orderkey").write.parquet(path)  # a first task without rows, as of a split before its row group, would write an empty file as well
    store, inner = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with store.open_output_stream(f"{inner}/broken.parquet") as out:
        out.write(b"not parquet")
    orders.filter(F.lit(False)).coalesce(1).write.mode("append").parquet(path)
    rows, bad = a.read_skip_unreadable(v.spark, path, v.spark.createDataFrame([], "o_orderkey long, o_orderstatus string").schema)
    made = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    empty = a.file_states(v.spark, path).agg(F.count(F.when(F.col("state") == "empty", 1)).alias("n_empty"))
    return made.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("n_unreadable")))).join(F.broadcast(empty))


@query("a5_read_json_reference", """
SELECT o_orderpriority AS "order.priority", count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1
""")
def _(v):
    path = scratch(v.spark, "json")
    rows = v.table("orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority")).alias("order"))
    lists = rows.groupBy(F.floor(F.col("o_orderkey") / 2000).alias("list")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "order"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a list a file
    return a.read_json_reference(v.spark, path).groupBy(F.col("`order.priority`")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("a6_read_csv_reference", "SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 GROUP BY 1")
def _(v):
    path = scratch(v.spark, "csv")
    name = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "# ").otherwise("k"), F.col("o_orderkey").cast("string"))
    wild = F.when(F.col("o_orderkey") % 5 == 0, "*").otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", name, F.col("o_orderkey").cast("string"), wild)
    files = v.table("orders").groupBy(F.floor(F.col("o_orderkey") / 2000).alias("file")).agg(F.concat_ws("\n", F.lit("name,o_orderkey,o_orderpriority"), F.collect_list(line)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a header a file
    rows = a.read_csv_reference(v.spark, path, "*", "o_orderpriority")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query("a13_incremental_build", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'b1' ELSE 'b2' END AS batch, count(*) AS n, sum(2 * o_totalprice) AS total FROM orders GROUP BY 1")
def _(v):
    path = scratch(v.spark, "cache")
    build = lambda rows: rows.select("o_orderkey", (2 * F.col("o_totalprice")).alias("double_price"))
    orders = v.table("orders")
    a.incremental_build(orders.filter("o_orderkey % 2 = 0"), build, path, ["o_orderkey"], "b1")
    return a.incremental_build(orders, build, path, ["o_orderkey"], "b2").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("double_price").alias("total"))


@query("a15_write_table", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def _(v):
    path = scratch(v.spark, "table")
    a.write_table(v.table("orders"), path, ["o_orderstatus"])
    return v.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("a20_replace_session", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n_before, count(*) FILTER (WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)) AS n_after, o_orderstatus <> 'F' AS is_unchanged FROM orders GROUP BY 1, 2
""")
def _(v):
    path, keys = scratch(v.spark, "sessions"), ["o_orderstatus", "o_orderpriority"]
    orders = v.table("orders").select("o_orderkey", "o_totalprice", *keys)
    a.write_table(orders, path, keys)
    kept = scratch(v.spark, "prints")
    a.partition_prints(v.spark.read.parquet(path), keys).write.parquet(kept)  # before the files change
    a.replace_session(path, orders.filter("o_orderstatus = 'F' AND o_orderkey % 2 = 1"), keys)
    v.spark.catalog.refreshByPath(path)
    return a.replacement_proof(v.spark.read.parquet(kept), a.partition_prints(v.spark.read.parquet(path), keys), keys)


@query("a3_align_union", """
SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, round(o_totalprice, 0), o_orderstatus FROM orders WHERE o_orderkey % 2 = 1
""")
def _(v):
    o = v.table("orders")
    even = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    odd = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.round("o_totalprice", 0).cast("long").alias("o_totalprice"), "o_orderstatus")
    return a.align_union([even, odd], {"o_totalprice": "double"})


@query("a7_live_view", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def _(v):
    a.live_view(v.spark, f"{v.sf_dir}/orders.parquet", "live_orders")
    return v.spark.sql("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM live_orders GROUP BY o_orderpriority")


@query("a10_file_census", "SELECT 'orders.parquet' AS file, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders")
def _(v):
    made = a.file_census(v.table("orders"), "o_orderdate")
    return made.select("file", "n", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


@query("a11_presence_class", """
SELECT ticker, event_date, CASE WHEN t AND q THEN 'both' WHEN t THEN 'trades_only' WHEN q THEN 'quotes_only' ELSE 'neither' END AS presence FROM (
  SELECT ticker, event_date, EXISTS (SELECT 1 FROM trades x WHERE x.ticker = e.ticker AND x.et_date = e.event_date AND x.size > 90) AS t,
    EXISTS (SELECT 1 FROM quotes x WHERE x.ticker = e.ticker AND x.et_date = e.event_date AND x.bid_size = 10) AS q FROM event_list e)
""")
def _(v):
    own = lambda df: df.withColumnRenamed("et_date", "event_date")
    return a.presence_class(v.event_list, own(v.trades.filter("size > 90")), own(v.quotes.filter("bid_size = 10")), KEYS)


@query("a12_materialize_sample", "SELECT ticker, event_date, minute_index, volume, 'dev' AS cohort FROM day_bars JOIN (SELECT ticker, event_date FROM event_list WHERE magnitude > 100) USING (ticker, event_date)")
def _(v):
    return a.materialize_sample(v.day_bars.select(*KEYS, "minute_index", "volume"), v.event_list.filter("magnitude > 100"), KEYS, "dev")


@query("a14_append_with_guard", """
SELECT ticker, et_date, count(*) AS n_rows, CASE WHEN EXISTS (SELECT 1 FROM trades x WHERE x.ticker = t.ticker AND x.et_date = t.et_date AND x.size > 90) THEN 'collision_skipped' ELSE 'inserted' END AS outcome FROM trades t GROUP BY 1, 2
""")
def _(v):
    return a.append_with_guard(v.trades.filter("size > 90"), v.trades, ["ticker", "et_date"])[1]


@query("a14_guard_counts", """
, h AS (SELECT ticker, et_date, count(*) FILTER (WHERE size > 90) AS b, count(*) AS n FROM trades GROUP BY 1, 2)
SELECT ticker, et_date, CASE WHEN b > 0 THEN b ELSE n END AS n_after, b AS n_before, CASE WHEN b > 0 THEN 0 ELSE n END AS n_inserted, true AS is_right FROM h
""")
def _(v):
    keys, table = ["ticker", "et_date"], v.trades.filter("size > 90")
    after, ledger = a.append_with_guard(table, v.trades, keys)
    return a.guard_counts(table, after, ledger, keys)


@query("a16_optional_columns", """
, n AS (SELECT et_date AS file, CASE WHEN size > 98 THEN price END AS a, CASE WHEN size > 50 THEN size END AS b FROM trades),
f AS (SELECT file, count(*) AS n, count(a) AS a, count(b) AS b FROM n GROUP BY 1),
u AS (SELECT 'a' AS "column", sum(a) / sum(n) AS rate, count(*) FILTER (WHERE a = 0) AS n_absent, count(*) AS n_files FROM f UNION ALL SELECT 'b', sum(b) / sum(n), count(*) FILTER (WHERE b = 0), count(*) FROM f)
SELECT *, rate < 0.05 AND n_absent > 0 AS is_optional FROM u
""")
def _(v):
    rows = v.trades.select(F.col("et_date").alias("file"), F.when(F.col("size") > 98, F.col("price")).alias("a"), F.when(F.col("size") > 50, F.col("size")).alias("b"))
    return a.optional_columns(rows, "file", ["a", "b"])


@query("a16_column_presence", """
, n AS (SELECT CASE WHEN et_min > 1400 THEN price END AS a, CASE WHEN size > 50 THEN size END AS b, seq AS c FROM trades)
SELECT 'a' AS "column", count(a) / count(*) AS rate, count(a) / count(*) < 0.05 AS is_rare FROM n UNION ALL SELECT 'b', count(b) / count(*), count(b) / count(*) < 0.05 FROM n UNION ALL SELECT 'c', count(c) / count(*), count(c) / count(*) < 0.05 FROM n
""")
def _(v):
    rows = v.trades.select(F.when(F.col("et_min") > 1400, F.col("price")).alias("a"), F.when(F.col("size") > 50, F.col("size")).alias("b"), F.col("seq").alias("c"))
    return a.column_presence(rows)


@query("a17_timestamp_granularity", "SELECT 'ns' AS unit, avg((ts_ns % 1000000000 = 0)::INT) AS whole_second_share, count(DISTINCT ts_ns) AS n_distinct FROM trades")
def _(v):
    return a.timestamp_granularity(v.trades, "ts_ns")


@query("a18_null_signature", """
, s AS (SELECT avg((size > 60 AND price > 40)::INT) AS share FROM trades GROUP BY ticker, et_date)
SELECT CASE WHEN share = 0 THEN 'none' WHEN share = 1 THEN 'all' ELSE 'some' END AS events, count(*) AS n FROM s GROUP BY 1
""")
def _(v):
    rows = v.trades.select("ticker", "et_date", F.when(F.col("size") <= 60, 1).alias("x"), F.when(F.col("price") <= 40, 1).alias("y"))
    return a.null_signature(rows, ["x", "y"], ["ticker", "et_date"])


@query("a18_null_signature_shares", """
SELECT ticker, et_date, count(*) AS n, count(*) FILTER (WHERE size > 60 AND price > 40) AS n_hit, avg((size > 60 AND price > 40)::INT) AS share FROM trades GROUP BY 1, 2
""")
def _(v):
    rows = v.trades.select("ticker", "et_date", F.when(F.col("size") <= 60, 1).alias("x"), F.when(F.col("price") <= 40, 1).alias("y"))
    return a.null_signature_shares(rows, ["x", "y"], ["ticker", "et_date"])


VERSIONS = """
, a AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 > 0)
"""


def versions(v):
    c = v.table("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return c.filter("c_custkey % 10 > 0"), c.filter("c_custkey % 11 > 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


@query("a19_diff_summary", VERSIONS + """
SELECT (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM b) AS n_after, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS delta, count(*) FILTER (WHERE a.c_custkey IS NULL) AS added, count(*) FILTER (WHERE b.c_custkey IS NULL) AS removed,
  count(*) FILTER (WHERE a.c_acctbal <> b.c_acctbal) AS changed, count(*) FILTER (WHERE a.c_acctbal = b.c_acctbal) AS equal FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
""")
def _(v):
    return a.diff_summary(*versions(v), ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query("a19_one_sided_codes", VERSIONS + """
, x AS (SELECT unnest(list_distinct([c_custkey % 40, c_nationkey])) AS code FROM a), y AS (SELECT unnest(list_distinct([c_custkey % 44, c_nationkey])) AS code FROM b)
SELECT code, count(*) AS n, 'before' AS side FROM x WHERE code NOT IN (SELECT code FROM y) GROUP BY 1 UNION ALL SELECT code, count(*), 'after' FROM y WHERE code NOT IN (SELECT code FROM x) GROUP BY 1
""")
def _(v):
    one, two = versions(v)
    listed = lambda df, m: df.select(F.array(F.col("c_custkey") % m, F.col("c_nationkey").cast("long")).alias("codes"))
    return a.one_sided_codes(listed(one, 40), listed(two, 44), "codes")


@query("a19_same_keys", VERSIONS + "SELECT c_custkey, 'before' AS side FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT c_custkey, 'after' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)")
def _(v):
    return a.same_keys(*versions(v), ["c_custkey"])


@query("a19_table_diff", """
, a AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 > 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' END, CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' END) END AS columns
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal OR a.c_mktsegment <> b.c_mktsegment
""")
def _(v):
    c = v.table("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.filter("c_custkey % 11 > 0").withColumns({"c_acctbal": F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment"))})
    return a.table_diff(c.filter("c_custkey % 10 > 0"), new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])
