"""Sources and sinks. Schemas are stated, torn rows are counted and not dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL = "date date, ticker string, open double, close double, volume double, member boolean"


def read_panel(spark: SparkSession, *paths: str) -> DataFrame:
    """Panel parts (train, holdout) read with the panel's schema and put one under the other."""
    out = spark.read.schema(PANEL).parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.schema(PANEL).parquet(p))
    return out


def parse_factors(lines: DataFrame, names: list[str]) -> DataFrame:
    """A ragged factor file's lines (value): those whose first field is eight digits, percent to decimal; header and footer go."""
    f = F.split("value", ",")
    rows = lines.where(F.trim(F.get(f, F.lit(0))).rlike("^[0-9]{8}$"))
    return rows.select(F.to_date(F.trim(F.get(f, F.lit(0))), "yyyyMMdd").alias("date"), *[(F.trim(F.get(f, F.lit(i))).try_cast("double") / 100).alias(n) for i, n in enumerate(names, 1)])


def parse_ledger(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (value) with their fields; blank lines go, torn ones stay with torn true and null fields."""
    rows = lines.where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").withColumn("torn", F.col("_bad").isNotNull()).drop("_bad")


def parse_changes(lines: DataFrame) -> DataFrame:
    """`date,"A,B,C"` lines to (date, members): cleaned, distinct, sorted."""
    from panelweave.operators.universe import clean_ticker

    m = F.regexp_extract("value", r'^([0-9-]+),"?([^"]*)"?$', 1), F.regexp_extract("value", r'^([0-9-]+),"?([^"]*)"?$', 2)
    return lines.where(m[0] != "").select(F.to_date(m[0]).alias("date"), F.array_sort(F.array_distinct(F.transform(F.split(m[1], ","), lambda t: clean_ticker(t)))).alias("members"))


def explode_news(items: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(created_at UTC, symbols, headline) to one row per (local date, ticker, headline), the earliest."""
    rows = items.select("created_at", F.explode("symbols").alias("ticker"), "headline").withColumn("date", F.to_date(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone)))
    return rows.groupBy("date", "ticker", "headline").agg(F.min("created_at").alias("published_at"), F.count("*").alias("copies"))


def annual_facts(facts: DataFrame) -> DataFrame:
    """(ticker, fy_end, form, fp, filed, assets): the last filed annual value for each fiscal year end."""
    ok = facts.where((F.col("form") == "10-K") & (F.col("fp") == "FY"))
    return ok.groupBy("ticker", "fy_end").agg(F.max_by("assets", "filed").alias("assets"), F.count("*").alias("filings"))


def constituents(rows: DataFrame) -> DataFrame:
    """Symbol, sector and name under whichever alias they come; the first of each ticker in name order; malformed symbols go."""
    from panelweave.operators.universe import clean_ticker

    pick = lambda names: F.coalesce(*[F.col(c) for c in names if c in rows.columns])
    out = rows.select(clean_ticker(pick(["symbol", "ticker"])).alias("ticker"), pick(["sector", "gics_sector"]).alias("sector"), pick(["security", "company", "name"]).alias("company")).where(F.col("ticker").rlike("^[A-Z][A-Z0-9-]*$"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("company", "sector"))).where("_n = 1").drop("_n")


def write_panel(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by year; refuses to overwrite unless told to."""
    df.withColumn("year", F.year("date")).write.mode(mode).partitionBy("year").parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def register(spark: SparkSession, path: str, name: str, source: str, rows: int, params: dict[str, str] | None = None, n_trials: int = 1) -> None:
    """One line of lineage; an honest count of trials is at least one."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    row = spark.createDataFrame([(name, source, rows, params or {}, n_trials)], "name string, source string, rows long, params map<string,string>, n_trials int")
    row.withColumn("pulled_at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
