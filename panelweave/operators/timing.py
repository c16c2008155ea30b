"""Does a book time the market, and more than its parent; does a gate beat gates that know nothing.

Regressions are two passes of sums (`inference.nw_ols`); resamples and placebos are group keys with scrambled, seedless draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, ratio
from panelweave.operators.inference import nw_ols, positions, scramble, stationary_draws

#: Sums in another order may differ by as much.
TIE = 1e-12


def _convexity(rows: DataFrame, y: str, lags: int, name: str) -> DataFrame:
    """(book, n, alpha, gamma, t) of y on m and its square."""
    fit = nw_ols(rows, ["book"], y, ["m", "m_sq"], lags)
    of = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    return fit.groupBy("book").agg(F.first("n").alias(f"n{name}"), of("const", "coef").alias(f"alpha{name}"), of("m_sq", "coef").alias(f"gamma{name}"), of("m_sq", "t").alias(f"t{name}"))


def _resampled(rows: DataFrame, sims: int, mean_block: int) -> DataFrame:
    """(book, boot_p): share of stationary resamples in which gamma isn't positive; a gamma that is only rounding is zero."""
    s = positions(rows, ["book"])
    x = stationary_draws(s.select("book", "n").distinct(), ["book"], sims, mean_block).join(s.select("book", "pos", "net", "m", "m_sq"), ["book", "pos"])
    top = F.covar_pop("net", "m_sq") * F.var_pop("m") - F.covar_pop("net", "m") * F.covar_pop("m", "m_sq")
    below = F.var_pop("m") * F.var_pop("m_sq") - F.covar_pop("m", "m_sq") * F.covar_pop("m", "m_sq")
    size = F.sqrt(F.var_pop("net") * F.var_pop("m_sq")) * F.var_pop("m")  # top comes to as much at most, up to a factor
    gamma = F.when(F.abs(top) <= TIE * size, ratio(F.lit(0.0), below)).otherwise(ratio(top, below))
    return x.groupBy("book", "sim").agg(gamma.alias("_g")).groupBy("book").agg(F.avg((F.col("_g") <= 0).cast("double")).alias("boot_p"))


def timing_verdicts(rows: DataFrame, gross: DataFrame, parents: DataFrame, lags: int, per_year: int, sims: int = 200, mean_block: int = 21, weak: float = 2.0, strong: float = 2.4, rf: float = 0.0) -> DataFrame:
    """(book, n, gamma, t, t_long, value, alpha, stressed, least_value, parent, parent_gamma, beats_parent, difference, difference_se, distinct, boot_p, verdict).

    rows: (book, date, net, m); gross: (book, gross), the mean gross exposure; parents: (book, parent). gamma is the coefficient on the squared market; value is what it earned a year; stressed is value and alpha less
    the cost of borrowing what is above one; least_value would show with 80 % power. A child's gamma must beat its parent's for the gross held. As both are regressed on
    the same market, the difference of their gammas on common dates is the gamma of the difference of their returns, whose HAC error therefore knows their covariance.
    """
    rows = rows.dropna(subset=["net", "m"]).select("book", "date", "net", "m").withColumn("m_sq", F.col("m") * F.col("m"))
    fit = _convexity(rows, "net", lags, "").join(_convexity(rows, "net", 4 * lags, "_long").select("book", "t_long"), "book").join(gross, "book")
    fit = fit.join(rows.groupBy("book").agg((F.avg("m_sq") * per_year).alias("_var")), "book")
    above = rows.join(parents, "book").join(rows.select(F.col("book").alias("parent"), "date", F.col("net").alias("_p")), ["parent", "date"]).withColumn("_d", F.col("net") - F.col("_p"))
    gap = _convexity(above, "_d", lags, "_d").select("book", F.col("gamma_d").alias("difference"), F.abs(ratio(F.col("gamma_d"), F.col("t_d"))).alias("difference_se"))
    parent = parents.join(fit.select(F.col("book").alias("parent"), F.col("gamma").alias("parent_gamma"), F.col("gross").alias("_pg")), "parent")
    x = fit.join(parent, "book", "left").join(gap, "book", "left").join(_resampled(rows, sims, mean_block), "book")
    value, alpha = F.col("gamma") * F.col("_var"), F.col("alpha") * per_year
    stressed = alpha + value - F.greatest(F.col("gross") - 1, F.lit(0.0)) * (rf + 0.005)
    per_gross = F.col("gamma") / F.col("gross") > F.col("parent_gamma") / F.col("_pg")
    beats = F.when(F.col("parent").isNotNull(), F.when(F.col("parent_gamma") > 0, per_gross).otherwise(F.col("gamma") > 0))
    x = x.withColumns({"value": value, "alpha": alpha, "stressed": stressed, "least_value": 2.84 * F.abs(ratio(F.col("gamma"), F.col("t"))) * F.col("_var"), "beats_parent": beats, "distinct": F.abs("difference") >= F.col("difference_se")})
    times = (F.col("t") >= weak) & (F.col("value") > 0) & F.coalesce("beats_parent", F.lit(True)) & (F.col("stressed") > 0)
    verdict = F.when(times & (F.col("t") >= strong), "strong").when(times, "times").otherwise("none")
    return x.withColumn("verdict", verdict).select("book", "n", "gamma", "t", "t_long", "value", "alpha", "stressed", "least_value", "parent", "parent_gamma", "beats_parent", "difference", "difference_se", "distinct", "boot_p", "verdict")


def gate_runs(s: DataFrame) -> DataFrame:
    """(book, on, k, count, length): the gate's runs, numbered from 0 among those of their state. s: (book, pos, gate)."""
    w = by("book", order="pos")
    x = s.withColumn("_on", F.col("gate") > 0).withColumn("_new", F.coalesce(F.col("_on") != F.lag("_on").over(w), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = x.groupBy("book", F.col("_on").alias("on"), "_run").agg(F.count("*").alias("length"))
    state = Window.partitionBy("book", "on")
    return runs.select("book", "on", (F.row_number().over(state.orderBy("_run")) - 1).cast("long").alias("k"), F.count("*").over(state).alias("count"), "length")


def _sims(s: DataFrame, sims: int) -> DataFrame:
    return s.select("book", "n").distinct().withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(sims).cast("long"))))


def shuffled_blocks(s: DataFrame, sims: int, block: int) -> DataFrame:
    """(book, sim, pos, gate): the gate, moved in a circle, cut into blocks that are put in scrambled order."""
    x = _sims(s, sims).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    w = Window.partitionBy("book", "sim").orderBy(scramble(F.col("sim"), F.col("b") + 100), "b")
    size = F.least(F.lit(block), F.col("n") - F.col("b") * block)
    x = x.withColumn("_size", size).withColumn("_start", F.sum("_size").over(w) - F.col("_size")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    at = (scramble(F.col("sim"), F.lit(11).cast("long")) + F.col("b") * block + F.col("_j")) % F.col("n")
    return x.select("book", "sim", (F.col("_start") + F.col("_j")).alias("to"), at.alias("pos")).join(s.select("book", "pos", "gate"), ["book", "pos"]).select("book", "sim", F.col("to").alias("pos"), "gate")


def random_runs(s: DataFrame, sims: int) -> DataFrame:
    """(book, sim, pos, gate): on and off in turn, each run as long as a scrambled pick of the gate's own runs of that state. A gate that never changes has none."""
    runs = gate_runs(s)
    first = F.when(scramble(F.col("sim"), F.lit(13).cast("long")) % 2 == 0, 1).otherwise(0)
    x = _sims(s, sims).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("on", (F.col("i") + first) % 2 == 0)
    counts = runs.select("book", "on", "count").distinct()
    pick = (scramble(F.col("sim"), F.col("i") + 1000) % F.col("count")).alias("k")
    x = x.join(counts, ["book", "on"]).select("book", "sim", "n", "i", "on", pick).join(runs.select("book", "on", "k", "length"), ["book", "on", "k"])
    both = counts.groupBy("book").agg(F.count("*").alias("_s")).where("_s = 2").select("book")
    w = Window.partitionBy("book", "sim").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(both, "book").withColumn("_start", F.coalesce(F.sum("length").over(w), F.lit(0).cast("long"))).where("_start < n")
    stop = F.least(F.col("_start") + F.col("length"), F.col("n")) - 1
    return x.select("book", "sim", F.explode(F.sequence(F.col("_start"), stop)).alias("pos"), F.col("on").cast("double").alias("gate"))


def calm_gate(s: DataFrame, n: int, share_off: Column | float) -> DataFrame:
    """(book, pos, gate): off where the trailing deviation over n rows reaches its own quantile, whatever the market's signal; on before there are n."""
    w = by("book", order="pos").rowsBetween(-(n - 1), 0)
    x = s.withColumn("_v", F.when(F.count("net").over(w) == n, F.stddev_samp("net").over(w)))
    bar = x.groupBy("book").agg(F.percentile("_v", F.lit(1.0) - share_off).alias("_bar"))
    return x.join(bar, "book").select("book", "pos", F.coalesce((F.col("_v") < F.col("_bar")).cast("double"), F.lit(1.0)).alias("gate"))


def placebo_gates(rows: DataFrame, sims: int, per_year: int, block: int, delay: int, calm: int, share_off: float) -> DataFrame:
    """(book, placebo, actual, level, share_below): the gate's yearly excess log growth over the ungated book, against gates that know nothing.

    rows: (book, date, net, gate). placebo `blocks` and `runs`: level is the 95th percentile over simulations, share_below how many lie under the actual; `delayed` and `calm` are one gate each. A null net earns nothing.
    """
    s = positions(rows.withColumn("net", F.coalesce("net", F.lit(0.0))), ["book"])
    worth = lambda gate: F.avg(F.log1p(F.col("net") * gate) - F.log1p("net")) * per_year
    real = s.groupBy("book").agg(worth(F.col("gate")).alias("actual"))

    def simulated(gates: DataFrame, name: str) -> DataFrame:
        each = gates.withColumnRenamed("gate", "_g").join(s.select("book", "pos", "net"), ["book", "pos"]).groupBy("book", "sim").agg(worth(F.col("_g")).alias("e")).join(real, "book")
        return each.groupBy("book").agg(F.lit(name).alias("placebo"), F.first("actual").alias("actual"), F.percentile("e", F.lit(0.95)).alias("level"), F.avg((F.col("e") < F.col("actual") - TIE).cast("double")).alias("share_below"))

    def single(gates: DataFrame, name: str) -> DataFrame:
        one = gates.withColumnRenamed("gate", "_g").join(s.select("book", "pos", "net"), ["book", "pos"]).groupBy("book").agg(worth(F.col("_g")).alias("level")).join(real, "book")
        return one.select("book", F.lit(name).alias("placebo"), "actual", "level", (F.col("level") < F.col("actual") - TIE).cast("double").alias("share_below"))

    later = s.select("book", "pos", F.coalesce(F.lag("gate", delay).over(by("book", order="pos")), F.lit(1.0)).alias("gate"))
    out = simulated(shuffled_blocks(s, sims, block), "blocks").unionByName(simulated(random_runs(s, sims), "runs"))
    return out.unionByName(single(later, "delayed")).unionByName(single(calm_gate(s, calm, share_off), "calm"))
