"""Panels, events and books derived from the given tables; `plans/oracle.py` states the same rules in SQL."""

from __future__ import annotations

import tempfile
from functools import cached_property
from threading import RLock
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, clip, nearest, rolling_std
from panelweave.operators import bars as B
from panelweave.operators import universe as U


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session is local."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget the lineage; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def files_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files in a folder and in those within it, through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    top = [x for x in system.listStatus(path)]
    inner = [x for d in top if d.isDirectory() for x in system.listStatus(d.getPath())]
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in (*top, *inner)))


class Fixtures:
    """Each property is a DataFrame over the tables in sf_dir. The bars and the panel with returns, from which most queries start several times, are
    materialised once for each application; nothing else is computed before an action."""

    _made: ClassVar[dict[tuple[str, str], tuple[tuple, Fixtures]]] = {}
    _lock: ClassVar[RLock] = RLock()

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._own = RLock()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Fixtures:
        """The application's fixtures over a folder: queries share what is materialised, as long as the folder's files stay as they are."""
        key, now = (spark.sparkContext.applicationId, sf_dir), files_of(spark, sf_dir)
        with cls._lock:
            if key not in cls._made or cls._made[key][0] != now:
                cls._made[key] = now, cls(spark, sf_dir)
            return cls._made[key][1]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def ticker(key: str):  # noqa: ANN205
        return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))

    @property
    def prints(self) -> DataFrame:
        names = self.table("supplier").select("s_suppkey", self.ticker("s_nationkey").alias("ticker"))
        return self.table("lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "ticker", F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
            nearest(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_tax",
        )

    @staticmethod
    def week(ts: str):  # noqa: ANN205
        return F.trunc(F.to_date(ts), "week")

    @staticmethod
    def few(cells: DataFrame) -> DataFrame:
        """A row per nation and week, whatever the tables' size: sent to the lines, not the lines to it."""
        return F.broadcast(cells)

    @staticmethod
    def first_price():  # noqa: ANN205
        return F.min_by("price", F.struct("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("p0")

    def _cells(self) -> DataFrame:
        """(ticker, date, ext, vol, n, p0): money, quantity and number of a week's lines, and its first price.

        One pass sums the lines of each name and time in hash tables. The first price needs lines in order, which only sorting gives: a second pass sorts those of each cell's first order alone.
        """
        times = self.prints.groupBy("ticker", "ts").agg(F.sum("cents").alias("ext"), F.sum(F.col("qty").cast("long")).alias("vol"), F.count("*").alias("n"), F.min("l_orderkey").alias("l_orderkey"))
        cells = times.groupBy("ticker", self.week("ts").alias("date")).agg(*[F.sum(c).alias(c) for c in ("ext", "vol", "n")], F.min(F.struct("ts", "l_orderkey")).alias("first"))
        cells = cut(cells)
        first = cells.select(F.col("ticker").alias("_t"), F.col("first.ts").alias("_s"), F.col("first.l_orderkey").alias("_o"))
        lines = self.prints.join(self.few(first), F.col("ticker").eqNullSafe(F.col("_t")) & F.col("ts").eqNullSafe(F.col("_s")) & F.col("l_orderkey").eqNullSafe(F.col("_o")), "left_semi")
        prices = lines.groupBy(F.col("ticker").alias("_t"), self.week("ts").alias("_d")).agg(self.first_price())
        cells = cells.join(prices, F.col("ticker").eqNullSafe(F.col("_t")) & F.col("date").eqNullSafe(F.col("_d")))
        return cut(cells.select("ticker", "date", "ext", "vol", "n", "p0"))  # read twice, for the level too

    def _build_bars(self) -> DataFrame:
        cells = self._cells()
        cells = cells.withColumn("v", F.col("ext").cast("double") / 100 / F.col("vol").cast("double"))
        level = cells.agg(F.avg("v").alias("level"))
        step = clip(F.col("v") / F.col("level") - 1, -1.0, 1.0) / 25
        close = 100 * F.exp(F.sum(step).over(by("ticker").rowsBetween(Window.unboundedPreceding, 0)))
        out = cells.crossJoin(F.broadcast(level)).withColumn("close", close).withColumn("gap", clip(F.col("p0") / F.col("v") - 1, -1.0, 1.0))
        before = F.coalesce(F.lag("close").over(by("ticker")), F.lit(100.0))
        return out.select("date", "ticker", (before * (1 + F.col("gap") / 100)).alias("open"), "close", F.col("vol").cast("double").alias("volume"), "n")

    @property
    def calendar(self) -> DataFrame:
        return B.calendar(self.bars)

    @property
    def sectors(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(self.ticker("n_nationkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("company"))

    @property
    def changes(self) -> DataFrame:
        """(date, members): per quarter the nations whose customers' orders reach that quarter's 30th percentile."""
        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        totals = orders.groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date"), self.ticker("c_nationkey").alias("ticker")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("total"))
        floor = totals.groupBy("date").agg(F.percentile("total", F.lit(0.3)).alias("floor"))
        return totals.join(floor, "date").where("total >= floor").groupBy("date").agg(F.array_sort(F.collect_list("ticker")).alias("members"))

    @property
    def panel(self) -> DataFrame:
        """(date, ticker, open, close, volume, member): every week and ticker."""
        grid = B.densify(self.bars, self.calendar.select("date"))
        return U.membership_mask(self.changes, grid)

    @cached_property
    def _bars(self) -> DataFrame:
        return cut(self._build_bars())

    @property
    def bars(self) -> DataFrame:
        """(date, ticker, open, close, volume, n): weekly bars; missing cells stay missing."""
        with self._own:  # queries may run side by side
            return self._bars

    @cached_property
    def _returns(self) -> DataFrame:
        return cut(B.daily_returns(self.panel).join(self.sectors.select("ticker", "sector"), "ticker"))

    @property
    def returns(self) -> DataFrame:
        """(date, ticker, open, close, volume, member, ret, sector): every week and ticker, with the return on the week before."""
        with self._own:
            return self._returns

    @property
    def factor(self) -> DataFrame:
        """(date, ticker, ret, close, open, volume, member, sector, f, m): with the sector's and the market's mean return."""
        r = self.returns
        return r.withColumn("f", F.avg("ret").over(Window.partitionBy("date", "sector"))).withColumn("m", F.avg("ret").over(Window.partitionBy("date")))

    @property
    def market(self) -> DataFrame:
        """(date, ret, close): the market and its level."""
        m = self.returns.groupBy("date").agg(F.avg("ret").alias("ret"))
        return m.withColumn("close", 100 * F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))

    @property
    def macro(self) -> DataFrame:
        """(date, mkt, mkt_ret, volx, cash, cash_ret, r0..r4, r0_ret..r4_ret): a row per date of the market, its volatility index, cash, and the regions' levels in order of their names."""
        level = lambda ret, *keys: 100 * F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(by(*keys).rowsBetween(Window.unboundedPreceding, 0)))
        regions = self.returns.groupBy("date", "sector").agg(F.avg("ret").alias("ret"))
        names = self.returns.select("sector").distinct().withColumn("k", F.row_number().over(Window.orderBy("sector")) - 1)  # a row per region
        regions = regions.join(F.broadcast(names), "sector").withColumn("close", level(F.col("ret"), "sector"))
        wide = regions.groupBy("date").agg(*[F.max(F.when(F.col("k") == i, F.col(c))).alias(f"r{i}{end}") for i in range(5) for c, end in (("close", ""), ("ret", "_ret"))])
        days = self.calendar.select("date", "pos", "month_first", "month_end_confirmed")
        m = self.market.select("date", F.col("close").alias("mkt"), F.col("ret").alias("mkt_ret")).join(days, "date").join(wide, "date")
        volx = 100 * F.sqrt(F.lit(52.0)) * rolling_std("mkt_ret", 8)
        return m.withColumns({"volx": volx, "cash": F.pow(F.lit(1.0005), F.col("pos")), "cash_ret": F.when(F.col("pos") > 1, F.lit(1.0005) - 1)})

    @property
    def weights(self) -> DataFrame:
        """(book, date, ticker, w): equal weight, 12-week momentum (five best against five worst), best region."""
        p = self.returns.withColumn("mom", F.lag("close", 1).over(by("ticker")) / F.lag("close", 13).over(by("ticker")) - 1)
        priced = p.where("close is not null")
        ew = priced.select(F.lit("bk_ew").alias("book"), "date", "ticker", (1 / F.count("*").over(Window.partitionBy("date"))).alias("w"))
        ok = p.where("mom is not null")
        up, down = (F.row_number().over(Window.partitionBy("date").orderBy(o, "ticker")) for o in (F.desc("mom"), F.asc("mom")))
        mom = ok.withColumn("u", up).withColumn("d", down).where("u <= 5 or d <= 5").select(F.lit("bk_mom").alias("book"), "date", "ticker", F.when(F.col("u") <= 5, 0.2).otherwise(-0.2).alias("w"))
        region = ok.groupBy("date", "sector").agg(F.avg("mom").alias("rm")).withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("rm"), "sector"))).where("k = 1")
        rot = ok.join(region.select("date", "sector"), ["date", "sector"]).select(F.lit("bk_rot").alias("book"), "date", "ticker", (1 / F.count("*").over(Window.partitionBy("date"))).alias("w"))
        return ew.unionByName(mom).unionByName(rot)

    @property
    def nets(self) -> DataFrame:
        """(book, date, gross, cost, net, turnover)."""
        from panelweave.operators import pnl as L

        return L.backtest(self.weights, self.returns.select("date", "ticker", "ret"), self.returns.select("date").distinct(), cost_bps=10.0)

    @property
    def earnings(self) -> DataFrame:
        """(symbol, period, report_date, hour, estimate, actual, point_in_time)."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        q = o.groupBy(self.ticker("c_nationkey").alias("symbol"), F.col("c_nationkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 1e8).alias("actual"))
        report = F.date_add(F.add_months("period", 3), (F.lit(19) + F.col("k") % 10).cast("int"))
        return q.select("symbol", "period", report.alias("report_date"), F.when(F.col("k") % 2 == 0, "bmo").otherwise("amc").alias("hour"), F.lag("actual").over(by("symbol", order="period")).alias("estimate"), "actual", (F.col("period") >= F.lit("1998-01-01").cast("date")).alias("point_in_time"))

    @property
    def series(self) -> DataFrame:
        """(series, obs_date, value): daily mean of an event type's values."""
        return self.table("events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("obs_date")).agg((F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double") / 10000 / F.count("value")).alias("value"))

    @property
    def signals(self) -> DataFrame:
        """(signalname, port, date, ret): monthly, in percent; LS is port 03 less 01."""
        x = self.table("lineitem").join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        port = F.when(F.col("l_returnflag") == "A", "01").when(F.col("l_returnflag") == "N", "02").otherwise("03")
        cell = x.groupBy(F.col("p_brand").alias("signalname"), port.alias("port"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / F.count("*") - 5).alias("ret"))
        side = lambda p, n: cell.where(F.col("port") == p).select("signalname", "date", F.col("ret").alias(n))
        ls = side("03", "hi").join(side("01", "lo"), ["signalname", "date"]).select("signalname", F.lit("LS").alias("port"), "date", (F.col("hi") - F.col("lo")).alias("ret"))
        return cell.unionByName(ls)

    @property
    def fills(self) -> DataFrame:
        """(ticker, side, status, qty, filled_qty, price, submitted_at, filled_at, client_order_id, close)."""
        p = self.prints.join(self.table("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
        p = p.withColumn("week", self.week("ts")).join(self.few(self.bars.select(F.col("date").alias("week"), "ticker", "close")), ["week", "ticker"])
        status = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "O", "partially_filled").otherwise("rejected")
        return p.select(
            "ticker", F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), status.alias("status"), "qty", F.when(status == "rejected", 0.0).when(status == "filled", F.col("qty")).otherwise(F.floor(F.col("qty") / 2).cast("double")).alias("filled_qty"),
            (F.col("close") * (1 + (F.col("l_tax") - 0.04) / 20)).alias("price"), "close", F.col("ts").cast("date").alias("session"), "week",
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("client_order_id"), F.expr("cast(ts as timestamp_ntz) - interval 1 day + make_interval(0, 0, 0, 0, cast(l_orderkey % 24 as int))").alias("submitted_at"),
        )


class SupplierFixtures(Fixtures):
    """The same panels with a name for each supplier instead of each nation: as many names as the supplier table has rows."""

    _made: ClassVar[dict[tuple[str, str], tuple[tuple, Fixtures]]] = {}

    @staticmethod
    def few(cells: DataFrame) -> DataFrame:
        """A row per supplier and week grows with the tables: joined by key."""
        return cells

    def _cells(self) -> DataFrame:
        """As of nations, in one pass: a supplier's week has few lines, so sums in hash tables would save no sorting."""
        return self.prints.groupBy("ticker", self.week("ts").alias("date")).agg(F.sum("cents").alias("ext"), F.sum(F.col("qty").cast("long")).alias("vol"), F.count("*").alias("n"), self.first_price())

    @staticmethod
    def ticker(key: str):  # noqa: ANN205
        return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))

    @property
    def prints(self) -> DataFrame:
        return super().prints.withColumn("ticker", self.ticker("l_suppkey"))

    @property
    def sectors(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(self.ticker("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("s_name").alias("company"))

    @property
    def changes(self) -> DataFrame:
        """(date, members): per quarter the suppliers whose lines reach that quarter's 30th percentile."""
        totals = self.prints.groupBy(F.to_date(F.date_trunc("quarter", "ts")).alias("date"), "ticker").agg(F.sum("cents").cast("double").alias("total"))
        floor = totals.groupBy("date").agg(F.percentile("total", F.lit(0.3)).alias("floor"))
        return totals.join(floor, "date").where("total >= floor").groupBy("date").agg(F.array_sort(F.collect_list("ticker")).alias("members"))
