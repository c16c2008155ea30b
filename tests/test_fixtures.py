"""Bars and fills over odd lines against their SQL, and without sorting or shuffling all lines for them."""

import datetime as dt
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import nearest
from panelweave.plans import catalog, fixtures
from panelweave.plans.fixtures import Fixtures, SupplierFixtures
from panelweave.plans.oracle import wrap

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines at several times of a day, an order's lines at different times, lines that differ in one field only, and cents that end in a half."""
    r, d = Random(11), str(tmp_path_factory.mktemp("odd"))
    at = lambda: dt.datetime(1999, 12, 27) + dt.timedelta(days=r.randrange(21), hours=r.choice([0, 0, 1, 23]))
    lines = [(r.randrange(1, 40), r.randrange(3), r.randrange(1, 7), r.randrange(1, 3), float(r.randrange(1, 9)), r.randrange(1, 4000) / 8, r.randrange(9) / 100, r.choice("OF"), at()) for _ in range(2000)]
    spark.createDataFrame([x for x in lines for _ in range(1 + x[0] % 2)], LINE).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(1, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3]) for k in range(1, 40)], "o_orderkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.fixture
def duck(odd):
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "orders"):
        c.sql(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    return c


def rows(found):
    return sorted([[f"{v:.6f}" if isinstance(v, float) else str(v) for v in x] for x in found])


def test_bars_of_odd_lines(spark, odd, duck):
    got = Fixtures(spark, odd).bars.select("date", "ticker", "open", "close", "volume", "n").collect()
    assert rows(got) == rows(duck.sql(wrap("SELECT date, ticker, open, close, volume, n FROM fx_bars")).fetchall()) and len(got) == 9


def test_suppliers_bars_of_odd_lines(spark, odd, duck):
    """The nations' bars are the suppliers' if a nation has one supplier."""
    sql = wrap("SELECT date, ticker, open, close, volume, n FROM fx_bars").replace("'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')", "'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')")
    got = SupplierFixtures(spark, odd).bars.select("date", "ticker", "open", "close", "volume", "n").collect()
    assert rows(got) == rows(duck.sql(sql).fetchall()) and len(got) == 18


def test_drift_exec_split_of_odd_lines(spark, odd, duck):
    columns = ["ticker", "fills", "split", "drift_bps", "exec_bps"]
    got = catalog.queries()["drift_exec_split"](spark, odd).select(*columns).collect()
    assert rows(got) == rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['drift_exec_split']})").fetchall())


def test_the_lines_are_not_sorted_or_shuffled_for_the_bars(spark, odd, monkeypatch):
    plans, cut = [], fixtures.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def kept(df):
        plans.append(plan(df))
        return cut(df)

    monkeypatch.setattr(fixtures, "cut", kept)
    Fixtures(spark, odd).bars.count()
    scans = [p for p in plans if "l_extendedprice" in p]
    assert scans and all("LeftSemi" in p or "partial_min_by" not in p for p in scans)  # the first prices are sought among a few lines
    with monkeypatch.context() as m:
        m.setattr(Fixtures, "_made", {})
        split = plan(catalog.queries()["drift_exec_split"](spark, odd))
    assert "hashpartitioning(week" not in split  # the weeks' rows go to the fills


def test_nearest_is_round(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 1.005 * 100, 1.115 * 100, 4503599627370495.5, 4503599627370497.0, 1e18, -1e18, 0.0, 3.2, -3.7, None]
    r = Random(3)
    values += [r.randrange(10**9) / 100 * 100 for _ in range(500)] + [r.randrange(-(10**6), 10**6) / 8 for _ in range(500)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(nearest(F.col("v")).cast("long").alias("a"), F.round("v").cast("long").alias("b")).collect()
    assert len(out) == len(values) and all(x.a == x.b for x in out)
