"""Operators across the names of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelweave.functions.columns import average_rank, corr_from_sums, ratio
from panelweave.operators.joins import pairs


def per_date() -> WindowSpec:
    return Window.partitionBy("date")


def quantile_bucket(scores: DataFrame, q: int, score: str = "score") -> DataFrame:
    """bucket 0..q-1 by right-closed, linearly interpolated edges of the rank; ties by ticker; null scores are left out."""
    ok = scores.where(F.col(score).isNotNull())
    ok = ok.withColumn("_r", F.row_number().over(per_date().orderBy(score, "ticker"))).withColumn("_n", F.count("*").over(per_date()))
    bucket = F.greatest(F.ceil(ratio(((F.col("_r") - 1) * q).cast("double"), (F.col("_n") - 1).cast("double")) - 1e-12), F.lit(1)) - 1
    return ok.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int")).drop("_r")


def quantile_weights(scores: DataFrame, q: int, score: str = "score") -> DataFrame:
    """Top bucket +1/n, bottom bucket -1/n; nothing on dates with fewer names than buckets."""
    b = quantile_bucket(scores, q, score).where(F.col("_n") >= q).where(F.col("bucket").isin(0, q - 1))
    n = F.count("*").over(Window.partitionBy("date", "bucket"))
    return b.select("date", "ticker", F.when(F.col("bucket") == 0, -1 / n).otherwise(1 / n).alias("w"))


def neutralize(scores: DataFrame, least: int = 10) -> DataFrame:
    """Residual of score on size and sector dummies per date, exactly, by demeaning within (date, sector); thin dates are left out."""
    ok = scores.where("score is not null and size is not null")
    cell = Window.partitionBy("date", "sector")
    d = ok.withColumn("_y", F.col("score") - F.avg("score").over(cell)).withColumn("_x", F.col("size") - F.avg("size").over(cell)).withColumn("_n", F.count("*").over(per_date()))
    slope = ratio(F.sum(F.col("_x") * F.col("_y")).over(per_date()), F.sum(F.col("_x") * F.col("_x")).over(per_date()))
    return d.where(F.col("_n") >= least).withColumn("resid", F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")).select("date", "ticker", "resid")


def rank_ic(scores: DataFrame, least: int = 50) -> DataFrame:
    """Spearman correlation of score and fwd per date with at least so many names."""
    ok = scores.where("score is not null and fwd is not null").withColumn("_a", average_rank("score", "date")).withColumn("_b", average_rank("fwd", "date"))
    return ok.groupBy("date").agg(F.count("*").alias("n"), corr_from_sums(F.col("_a"), F.col("_b")).alias("ic")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, t and hit rate by year and over all (a rollup; year null is the total)."""
    y = ic.where("ic is not null").withColumn("year", F.year("date"))
    out = y.rollup("year").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))
    return out.select("year", "n", "mean", ratio(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t"), "hit")


def pooled_rank(rows: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    """rows with out: the average rank of value over the whole table. Values are dealt into stretches between quantiles, ranked within them and moved up by how many lie below."""
    steps = sorted(set(rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01)))  # `buckets` numbers; any cut gives the same ranks
    stretch = sum(((F.col(value) >= v).cast("int") for v in steps), F.lit(0))
    x = rows.withColumn("_stretch", stretch)
    sizes = x.groupBy("_stretch").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_stretch", (F.sum("_n").over(Window.orderBy("_stretch")) - F.col("_n")).alias("_below"))  # one row per stretch
    return x.withColumn(out, average_rank(value, "_stretch")).join(F.broadcast(sizes), "_stretch").withColumn(out, F.col(out) + F.col("_below")).drop("_stretch", "_below")


def pooled_ic(scores: DataFrame) -> DataFrame:
    ok = scores.where("score is not null and fwd is not null")
    ok = pooled_rank(pooled_rank(ok, "score", "_a"), "fwd", "_b")
    out = ok.agg(F.count("*").alias("n"), corr_from_sums(F.col("_a"), F.col("_b")).alias("ic"))
    return out.withColumn("t", F.when(F.col("n") >= 3, ratio(F.col("ic") * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(1 - F.col("ic") * F.col("ic")))))


def cross_z(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.withColumn("z", ratio(F.col(score) - F.avg(score).over(per_date()), F.stddev_pop(score).over(per_date())))


def topk_inverse_vol(scores: DataFrame, k: int) -> DataFrame:
    """The k best by mom among names with a positive vol, weighted by 1 / vol."""
    top = scores.where("mom is not null and vol > 0").withColumn("_r", F.row_number().over(per_date().orderBy(F.desc("mom"), "ticker"))).where(F.col("_r") <= k)
    return top.select("date", "ticker", ((1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(per_date())).alias("w"))


def argmax_pick(scores: DataFrame, gate: float, otherwise: str) -> DataFrame:
    best = scores.where("mom is not null").groupBy("date").agg(F.min_by("ticker", F.struct(-F.col("mom"), F.col("ticker"))).alias("best"), F.max("mom").alias("mom"))
    return best.select("date", F.when(F.col("mom") > gate, F.col("best")).otherwise(otherwise).alias("ticker"), "mom")


def closest_pairs(norm: DataFrame, n: int, within: str | None = None) -> DataFrame:
    """The n pairs with the least mean squared distance of normalised paths."""
    p = pairs(norm.where("norm is not null"), "ticker", within, "date", value="norm")
    d = p.groupBy("a", "b").agg(F.avg(F.pow(F.col("va") - F.col("vb"), F.lit(2))).alias("ssd"), F.count("*").alias("days"))
    return d.withColumn("ssd", F.round("ssd", 9)).orderBy("ssd", "a", "b").limit(n)


def pair_corr(rets: DataFrame, key: str = "ticker") -> DataFrame:
    p = pairs(rets.where("ret is not null"), key, None, "date", value="ret")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), corr_from_sums(F.col("va"), F.col("vb")).alias("corr"))


def jaccard_down(rets: DataFrame, key: str = "ticker") -> DataFrame:
    p = pairs(rets.where("ret is not null"), key, None, "date", value="ret")
    both, either = F.count_if((F.col("va") < 0) & (F.col("vb") < 0)), F.count_if((F.col("va") < 0) | (F.col("vb") < 0))
    return p.groupBy("a", "b").agg(both.alias("both"), either.alias("any")).withColumn("jaccard", F.try_divide(F.col("both").cast("double"), F.col("any").cast("double")))


def concentration(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Per group: Herfindahl index of the keys' shares and the share of the five largest."""
    s = rows.groupBy(group, key).agg(F.sum(value).alias("v"))
    s = s.withColumn("share", ratio(F.col("v"), F.sum("v").over(Window.partitionBy(group)))).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("v"), key)))
    return s.groupBy(group).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.when(F.col("_r") <= 5, F.col("share"))).alias("top5"), F.count("*").alias("n"))


def effective_rank(corr: DataFrame, names: int) -> DataFrame:
    """N^2 over the sum of squared correlations, the diagonal included."""
    return corr.agg((F.lit(float(names * names)) / (names + 2 * F.sum(F.coalesce(F.col("corr") * F.col("corr"), F.lit(0.0))))).alias("eff_rank"))


def tercile_ic(scores: DataFrame) -> DataFrame:
    """Rank IC of score within the lowest and highest third (by literal edges) of `by`, per date."""
    ok = scores.where("score is not null and fwd is not null and by is not null")
    edge = lambda p: F.percentile("by", F.lit(p)).over(per_date())
    ok = ok.withColumn("cell", F.when(F.col("by") <= edge(1 / 3), "low").when(F.col("by") > edge(2 / 3), "high")).where("cell is not null")
    ok = ok.withColumn("_a", average_rank("score", "date", "cell")).withColumn("_b", average_rank("fwd", "date", "cell"))
    return ok.groupBy("date", "cell").agg(F.count("*").alias("n"), corr_from_sums(F.col("_a"), F.col("_b")).alias("ic"))
