"""Readers and writers over drifting, corrupt and partitioned files."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import readers


def test_keyed_read(spark, tmp_path):
    for name, n in (("ACME_2024-01-02_31.5", 2), ("XYZ_2024-01-03_40", 3), ("notes", 1)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    rows = readers.read_keyed(spark, str(tmp_path), r"/(\w+)_(\d{4}-\d\d-\d\d)_([\d.]+)/", {"ticker": "string", "event_date": "date", "magnitude": "double"})
    assert {(r.ticker, str(r.event_date), r.magnitude, r["count"]) for r in rows.groupBy("ticker", "event_date", "magnitude").count().collect()} == {("ACME", "2024-01-02", 31.5, 2), ("XYZ", "2024-01-03", 40.0, 3)}


def test_schema_conflicts_need_an_override(spark):
    a, b = spark.range(1).select(F.col("id").alias("x"), F.lit(1).alias("junk")), spark.range(1).select(F.col("id").cast("double").alias("x"), F.lit("t").alias("y"))
    with pytest.raises(ValueError, match="x"):
        readers.align_union([a, b], exclude=("junk",))
    got = readers.align_union([a, b], {"x": "double"}, ("junk",))
    assert got.columns == ["x", "y"] and sorted(map(str, got.collect())) == ["Row(x=0.0, y='t')", "Row(x=0.0, y=None)"]


def test_unreadable_files_are_named(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t" / "broken.parquet").write_bytes(b"not parquet")
    rows, bad = readers.read_skip_unreadable(spark, f"{tmp_path}/t", spark.range(1).schema)
    assert rows.count() == 5 and [r.file for r in bad.collect()] == ["broken.parquet"]


def test_states_of_files(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(5).coalesce(1).write.parquet(f"{path}/a")
    spark.range(0).coalesce(1).write.parquet(f"{path}/b")
    spark.range(3).select(F.col("id").cast("double").alias("id"), F.array(F.lit("x")).alias("l")).coalesce(1).write.parquet(f"{path}/c")
    spark.range(50_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("s")).coalesce(1).write.option("compression", "none").parquet(f"{path}/d")
    (path / "broken.parquet").write_bytes(b"not parquet at all")
    states = readers.file_states(spark, str(path))
    rows = [(r.state, r.n_rows, [tuple(c) for c in r.columns]) for r in states.collect()]
    assert sorted(rows, key=str) == sorted([("rows", 5, [("id", "bigint")]), ("empty", 0, [("id", "bigint")]), ("rows", 3, [("id", "double"), ("l", "array<string>")]), ("rows", 50_000, [("s", "string")]), ("unreadable", None, [])], key=str)
    assert {(r.column, r.type, r.n_files) for r in readers.column_types(states).collect()} == {("id", "bigint", 2), ("id", "double", 1), ("l", "array<string>", 1), ("s", "string", 1)}
    with pytest.raises(ValueError, match="id"):
        readers.schema_of_files(spark, str(path))
    assert readers.schema_of_files(spark, str(path), {"id": "double"}, ("l",)).simpleString() == "struct<id:double,s:string>"
    got = readers.read_drifted(spark, str(path), {"id": "double"}, ("l",))
    assert got.count() == 50_008 and got.filter("id IS NOT NULL").count() == 8


def test_footers_that_come_through_spark(spark, tmp_path, monkeypatch):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t" / "broken.parquet").write_bytes(b"short")
    (tmp_path / "t" / "odd.parquet").write_bytes(b"x" * 40)
    monkeypatch.setattr(readers, "OPENED", ())
    got = {(r.state, r.n_rows, len(r.columns)) for r in readers.file_states(spark, f"{tmp_path}/t").collect()}
    assert got == {("rows", 7, 1), ("unreadable", None, 0)}


def test_partly_readable_files_give_no_rows(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(200_000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("s")).coalesce(1).write.option("compression", "none").parquet(str(path))
    spark.range(0).select("id", F.lit("x").alias("s")).coalesce(1).write.mode("append").parquet(str(path))
    spark.range(4).select("id", F.lit("y").alias("s")).coalesce(1).write.mode("append").parquet(str(path))
    big = max(path.glob("*.parquet"), key=lambda p: p.stat().st_size)
    raw = bytearray(big.read_bytes())
    raw[len(raw) // 2 : len(raw) // 2 + 400_000] = b"\xff" * 400_000
    big.write_bytes(bytes(raw))
    big.with_name(f".{big.name}.crc").unlink(missing_ok=True)
    rows, bad = readers.read_skip_unreadable(spark, str(path), spark.range(1).select("id", F.lit("x").alias("s")).schema)
    assert [(r.file, r.state) for r in bad.collect()] == [(big.name, "partial")]
    assert sorted(r.s for r in rows.collect()) == ["y"] * 4


def test_json_and_csv_references(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": None}}]))
    (tmp_path / "dict.json").write_text(json.dumps({"k1": {"a": 1}, "k2": {"a": 2}}))
    (tmp_path / "r.csv").write_text("# comment\nticker,n\nACME,1\n*,2\n")
    assert [tuple(r) for r in readers.read_json_reference(spark, f"{tmp_path}/list.json").orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert readers.read_json_reference(spark, f"{tmp_path}/list.json").columns == ["a", "b.c"]
    assert sorted(map(tuple, readers.read_json_reference(spark, f"{tmp_path}/dict.json", "struct<a: int>").collect())) == [("k1", 1), ("k2", 2)]
    assert [tuple(r) for r in readers.read_csv_reference(spark, f"{tmp_path}/r.csv", "*", "ticker").collect()] == [("ACME", 1)]


def test_incremental_build_computes_only_new_keys(spark, tmp_path):
    path, seen = f"{tmp_path}/cache", []

    def build(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", (F.col("id") * 2).alias("v"))

    readers.incremental_build(spark.range(3), build, path, ["id"], "b1")
    got = readers.incremental_build(spark.range(5), build, path, ["id"], "b2")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    readers.incremental_build(spark.range(5), build, path, ["id"], "b2")  # run again: the same batch, once
    assert spark.read.parquet(path).count() == 5 and seen == [[0, 1, 2], [3, 4], [3, 4]]


def test_guarded_append_and_replaced_sessions(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "ticker string, session int, v int")
    repair = spark.createDataFrame([("a", 2, 7), ("b", 1, 8), ("b", 1, 9)], "ticker string, session int, v int")
    after, ledger = readers.append_with_guard(table, repair, ["ticker", "session"])
    assert after.count() == 4
    assert {(r.ticker, r.session, r.n_rows, r.outcome) for r in ledger.collect()} == {("a", 2, 1, "collision_skipped"), ("b", 1, 2, "inserted")}
    path = f"{tmp_path}/t"
    readers.write_table(after, path, ["ticker", "session"])
    readers.replace_session(path, spark.createDataFrame([(99, "a", 2)], "v int, ticker string, session int"), ["ticker", "session"])
    assert sorted((r.ticker, r.session, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, 5), ("a", 2, 99), ("b", 1, 8), ("b", 1, 9)]


def test_table_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, None), (4, 7)], "k int, v int")
    assert {(r.k, r.kind, r.columns) for r in readers.table_diff(a, b, ["k"], ["v"]).collect()} == {(2, "changed", "v"), (3, "removed", None), (4, "added", None)}


def test_a_first_split_without_rows_leaves_no_empty_file(spark, tmp_path):
    from tidegrid.plans import catalog

    orders = spark.range(20_000).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")  # one row group, read in splits of which the first holds none
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = catalog.QUERIES["a4_read_skip_unreadable"](spark, str(tmp_path)).orderBy("o_orderstatus").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.o_orderstatus, r.n, r["keys"], r.n_unreadable, r.n_empty) for r in got] == [("F", 10_000, 99_990_000, 1, 1), ("O", 10_000, 100_000_000, 1, 1)]
