"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegrid.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    """A comparable value: floats whole, so that only their tolerance below is forgiven."""
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):  # nullable integers come back as floats from either side
        return float(x) + 0.0
    if isinstance(x, (list, tuple, np.ndarray)):
        return [cell(y) for y in x]
    return str(pd.Timestamp(x)) if hasattr(x, "year") else x


def same(a, b):
    """Equal, floats within a relative 1e-7 (sums in another order)."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), [[cell(x) for x in r] for r in df.astype(object).itertuples(index=False, name=None)]


def aligned(a, b):
    """Both sides' rows in one order: by the columns that hold no fractions, then by the others roughly."""
    whole = [all(not isinstance(r[c], float) or r[c].is_integer() for r in [*a, *b]) for c in range(len(a[0]) if a else 0)]
    key = lambda r: ([repr(x) for x, w in zip(r, whole, strict=True) if w], [f"{x:.5g}" if isinstance(x, float) else repr(x) for x, w in zip(r, whole, strict=True) if not w])
    return zip(sorted(a, key=key), sorted(b, key=key), strict=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [(a, b) for a, b in aligned(got[1], want[1]) if not same(a, b)] == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_twin_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_approximate_counts_are_near_the_exact_ones(spark):
    rows = catalog.QUERIES["d4_dup_prints_approx"](spark, SF).collect()
    exact = {r.ticker: r for r in catalog.QUERIES["d5_dup_prints_exact"](spark, SF).collect()}
    assert {r.ticker for r in rows} == exact.keys()
    for r in rows:
        assert abs(r.dup_strict - exact[r.ticker].dup_strict) <= 0.1 * r.n


def test_sketches_of_bars_give_the_same_counts(spark):
    from pyspark.sql import functions as F

    from tidegrid.operators import bars
    from tidegrid.plans.bars import STRICT
    from tidegrid.plans.fixtures import KEYS, Views

    v = Views(spark, SF)
    sessions = v.spine.filter("session_offset = 0")
    sketches = {"strict": STRICT, "loose": ["ticker", "day", "et_min"]}
    halves = [bars.built_bars(v.trades.filter(F.col("seq") % 2 == half), sessions, KEYS, sketches) for half in (0, 1)]
    made = {r.ticker: r for r in bars.dup_prints_of_bars(halves[0].unionByName(halves[1]), ["ticker"]).collect()}
    own = v.trades.join(sessions.select("ticker", F.col("session_date").alias("et_date")), ["ticker", "et_date"], "left_semi")
    for r in bars.dup_prints_exact(own, ["ticker"], STRICT, sketches["loose"]).collect():
        assert made[r.ticker].n == r.n
        assert abs(made[r.ticker].dup_strict - r.dup_strict) <= 0.05 * r.n and abs(made[r.ticker].dup_loose - r.dup_loose) <= 0.05 * r.n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
