"""Factor structure per window: Spark builds the windows, scores and summaries; one window is one group for the dense step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, StringType, StructField, StructType

from panelweave.functions.columns import by, ratio
from panelweave.operators import state as P


def _wide(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot(index="date", columns="ticker", values="ret").sort_index()


def residualize_window(rows: DataFrame, market: DataFrame) -> DataFrame:
    """(month, date, ticker, ret): returns in units of the window's deviation, less their window beta times the market. Window sums only."""
    x = rows.join(market.select("date", F.col("ret").alias("_m")), "date").where("_m is not null")
    w = Window.partitionBy("month", "ticker")
    x = x.withColumn("_z", ratio(F.col("ret") - F.avg("ret").over(w), F.stddev_samp("ret").over(w)))
    beta = ratio(F.covar_pop("_z", "_m").over(w), F.var_pop("_m").over(w))
    return x.withColumn("_r", F.col("_z") - beta * (F.col("_m") - F.avg("_m").over(w))).select("month", "date", "ticker", F.col("_r").alias("ret"))


def loadings(rows: DataFrame, k: int) -> DataFrame:
    """(month, factor, ticker, load, share): unit loadings of the k strongest components, signed so that the largest in size is positive."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf)
        x = wide.to_numpy() - wide.to_numpy().mean(axis=0)
        _, s, v = np.linalg.svd(x, full_matrices=False)
        take = min(k, len(s))
        v = v[:take]
        anchor = np.abs(v).argmax(axis=1)
        v = v * np.sign(v[np.arange(take), anchor])[:, None]
        share = s[:take] ** 2 / max((s**2).sum(), 1e-300)
        return pd.DataFrame({"month": pdf["month"].iloc[0], "factor": np.repeat(np.arange(1, take + 1), len(wide.columns)), "ticker": np.tile(wide.columns, take), "load": v.ravel(), "share": np.repeat(share, len(wide.columns))})

    return rows.groupBy("month").applyInPandas(solve, "month date, factor int, ticker string, load double, share double")


def project(load: DataFrame, returns: DataFrame) -> DataFrame:
    """(month, date, factor, score): out-of-sample projection of the month's own returns on loadings that were fitted before it."""
    r = returns.where("ret is not null").withColumn("month", F.to_date(F.date_trunc("month", "date")))
    return load.join(r, ["month", "ticker"]).groupBy("month", "date", "factor").agg(F.sum(F.col("load") * F.col("ret")).alias("score"))


def signal_weights(load: DataFrame, tilts: DataFrame) -> DataFrame:
    """(month, ticker, w): tilts demeaned across factors, mapped by the loadings, gross one."""
    t = tilts.withColumn("_t", F.col("tilt") - F.avg("tilt").over(Window.partitionBy("month")))
    x = load.join(t.select("month", "factor", "_t"), ["month", "factor"]).groupBy("month", "ticker").agg(F.sum(F.col("load") * F.col("_t")).alias("_w"))
    return x.select("month", "ticker", ratio(F.col("_w"), F.sum(F.abs("_w")).over(Window.partitionBy("month"))).alias("w"))


def vetting(load: DataFrame, least_share: float, most_local: float) -> DataFrame:
    """(month, factor, share, local, overlap, label): a factor's concentration on one name, its likeness to the same factor a window before."""
    months = load.select("month").distinct().withColumn("_next", F.lead("month").over(Window.orderBy("month")))  # one row per month
    before = load.join(months, "month").select(F.col("_next").alias("month"), "factor", "ticker", F.col("load").alias("_b"))
    x = load.join(before, ["month", "factor", "ticker"], "left").groupBy("month", "factor").agg(F.first("share").alias("share"), ratio(F.max(F.col("load") * F.col("load")), F.sum(F.col("load") * F.col("load"))).alias("local"), F.abs(F.sum(F.col("load") * F.col("_b"))).alias("overlap"))
    label = F.when(F.col("share") < least_share, "weak").when(F.col("local") > most_local, "local").otherwise("pervasive")
    return x.withColumn("label", label)


def subspace_average(load: DataFrame, months: int, k: int) -> DataFrame:
    """(month, factor, stability): eigenvalues of the mean of the last `months` projectors; 1 means the direction never moved."""
    m = load.select("month").distinct().withColumn("_i", F.row_number().over(Window.orderBy("month")))
    x = load.join(m, "month")
    last = m.select(F.col("month").alias("at"), F.explode(F.sequence(F.col("_i") - months + 1, F.col("_i"))).alias("_i")).where("_i > 0")
    x = x.join(last, "_i").select("at", "_i", "factor", "ticker", "load")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["_i", "factor"], columns="ticker", values="load").fillna(0.0)
        each = wide.index.get_level_values(0).nunique()
        s = np.linalg.svd(wide.to_numpy() / np.sqrt(each), compute_uv=False)[:k] ** 2
        return pd.DataFrame({"month": pdf["at"].iloc[0], "factor": np.arange(1, len(s) + 1), "stability": s})

    return x.groupBy("at").applyInPandas(solve, "month date, factor int, stability double")


def clusters(edges: DataFrame, nodes: DataFrame, cut) -> DataFrame:  # noqa: ANN001
    """(ticker, cluster): the smallest name reachable over edges (a, b). Each round takes the least label of the neighbours and then the label's own label."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select("ticker", F.col("ticker").alias("cluster")).distinct()
    while True:
        near = both.join(labels.select(F.col("ticker").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("ticker")).agg(F.min("cluster").alias("_n"))
        step = labels.join(near, "ticker", "left").select("ticker", F.col("cluster").alias("_o"), F.least("cluster", F.coalesce("_n", "cluster")).alias("cluster"))
        jump = step.select(F.col("ticker").alias("cluster"), F.col("cluster").alias("_j"))
        step = cut(step.join(jump, "cluster").select("ticker", "_o", F.least("cluster", "_j").alias("cluster")))
        labels = step.select("ticker", "cluster")
        if step.where("_o <> cluster").limit(1).count() == 0:
            return labels


def drift_grid(weights: DataFrame, returns: DataFrame, bands: list[float], levels: list[float]) -> DataFrame:
    """(book, band, level, date, net, turnover): weights drift with returns; a name whose drifted weight is off its target by more than the
    relative band is reset, all are scaled to the level. A fold over a book's dates whose state is what each cell of the grid holds, a matrix of cells by names."""
    cells = [(float(b), float(v)) for b in bands for v in levels]
    band, level = (np.array(c)[:, None] for c in zip(*cells, strict=True))
    names = weights.select("book", "ticker").distinct()
    known = returns.join(weights.select("date").distinct(), "date", "left_semi").join(names, "ticker").select("book", "date", "ticker", "ret")
    rows = weights.join(known, ["book", "date", "ticker"], "full")  # a name that is held also earns on dates without a target

    def step(held: np.ndarray, key: str, date: object, ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, tuple | None]:
        w, r = values
        if np.isnan(w).all():
            return held, None
        ret, want = np.zeros(held.shape[1]), np.zeros(held.shape[1])
        ret[ids], want[ids] = np.nan_to_num(r), np.nan_to_num(w)
        earned = held @ ret
        solvent = earned > -1
        drifted = np.where(solvent[:, None], held * (1 + ret) / np.where(solvent, 1 + earned, 1.0)[:, None], held)
        target = want * level
        own = np.where(np.abs(drifted - target) > band * np.abs(target), target, drifted)
        return own, (earned, np.abs(own - drifted).sum(axis=1))

    out = [StructField("net", ArrayType(DoubleType())), StructField("turnover", ArrayType(DoubleType()))]
    made = P.fold_vectors(rows, "book", ["w", "ret"], lambda n: np.zeros((len(cells), n)), step, out)
    grid = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(v).alias("level")) for b, v in cells])
    each = made.select("book", "date", F.explode(F.arrays_zip(grid.alias("cell"), "net", "turnover")).alias("_c"))
    return each.select("book", "_c.cell.band", "_c.cell.level", "date", "_c.net", "_c.turnover")


def slot_grid(candidates: DataFrame, slots: list[int], holds: list[int]) -> DataFrame:
    """(slots, hold, date, ticker, age): the candidates of least depth (the most negative) take free slots first; a name leaves on its exit signal, at the longest hold, or
    without a price. candidates: (date, ticker, depth or null, leave, priced), a row for each date and ticker.

    Only what can matter reaches the fold over dates: of `slots` names held at most, the 2 * slots deepest candidates of a date fill all free ones, and a held name was
    one of them within the longest hold.
    """
    grid = candidates.sparkSession.createDataFrame([(s, h) for s in slots for h in holds], "slots int, hold int")
    most, longest = max(slots), max(holds)
    open_ = F.col("depth").isNotNull() & F.col("priced") & ~F.col("leave")
    place = F.when(open_, F.row_number().over(Window.partitionBy("date", open_).orderBy("depth", "ticker")))
    x = candidates.withColumn("_top", F.coalesce(place <= 2 * most, F.lit(False)).cast("int"))
    x = x.withColumn("_near", F.max("_top").over(by("ticker").rowsBetween(-longest, 0))).where("_near = 1").withColumn("_take", (F.col("_top") == 1))
    days = candidates.select("date").distinct().crossJoin(F.broadcast(grid))  # a date without rows empties all slots
    rows = days.join(x.select("date", "depth", "ticker", "leave", "priced", "_take"), "date", "left")

    def step(age: dict, key: tuple, date: object, rows: list[tuple]) -> tuple[dict, list[tuple]]:
        own_slots, own_hold = key
        stay = {t for _, t, leave, priced, _ in rows if priced and not leave}
        age = {t: a + 1 for t, a in age.items() if t in stay and a < own_hold}
        for _, t in sorted((d, t) for d, t, _, _, take in rows if take):
            if len(age) >= own_slots:
                break
            age.setdefault(t, 1)
        return age, [(own_slots, own_hold, date, t, a) for t, a in age.items()]

    schema = StructType([StructField("slots", IntegerType()), StructField("hold", IntegerType()), StructField("date", DateType()), StructField("ticker", StringType()), StructField("age", IntegerType())])
    return P.fold_days(rows, ["slots", "hold"], ["depth", "ticker", "leave", "priced", "_take"], {}, step, schema)


def meta_features(rows: DataFrame, numbers: list[str], category: str, values: list[str]) -> DataFrame:
    """numbers with nulls replaced by the column's median, the category as one column per listed value."""
    medians = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in numbers])
    hot = [F.coalesce((F.col(category) == v).cast("double"), F.lit(0.0)).alias(f"is_{v.lower().replace(' ', '_')}") for v in values]
    keep = [c for c in rows.columns if c not in (*numbers, category)]
    return rows.crossJoin(F.broadcast(medians)).select(*keep, *[F.coalesce(c, f"_{c}").alias(c) for c in numbers], *hot)  # one row of medians


def auc(scored: DataFrame, *keys: str) -> DataFrame:
    """Rank form of the area under the curve of p against y (0/1), ties at their mean rank; null with one class."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    rank = F.rank().over(w.orderBy("p")) + (F.count("*").over(Window.partitionBy(*keys, "p")) - 1) / 2
    g = scored.withColumn("_r", rank).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("_u"), F.sum(F.when(F.col("y") == 1, F.col("_r"))).alias("_s"))
    up, down = F.col("_u").cast("double"), (F.col("n") - F.col("_u")).cast("double")
    return g.select(*keys, "n", ratio(F.col("_s") - up * (up + 1) / 2, up * down).alias("auc"))


def gate_positions(runs: DataFrame, share: float, q: float) -> DataFrame:
    """runs: (ticker, start, p, pnl). The q-th percentile of p on the first `share` of the starts gates the others: kept, dropped and their pnl."""
    days = runs.groupBy("start").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.orderBy("start")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))  # one row per date
    place = F.col("_before") + F.rank().over(Window.partitionBy("start").orderBy("ticker")) - 1
    ordered = runs.join(days, "start").withColumn("_k", F.when(F.col("_all") > 1, place / (F.col("_all") - 1)).otherwise(0.0))
    bar = ordered.where(F.col("_k") < share).agg(F.percentile("p", F.lit(q)).alias("bar"))
    later = ordered.where(F.col("_k") >= share).crossJoin(F.broadcast(bar))
    ok = F.col("p") >= F.col("bar")
    return later.groupBy().agg(F.first("bar").alias("bar"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"), F.sum(F.when(ok, F.col("pnl")).otherwise(0.0)).alias("pnl_kept"), F.sum("pnl").alias("pnl_all"))


def walk_forward_logit(features: DataFrame, least: int, folds: int) -> DataFrame:
    """(fold, date, ticker, y, p): a logistic regression per fold, fitted on the rows whose label was known before the fold's first date.

    features: (date, ticker, y, known: the date from which y is known, x: array). Folds are equal stretches of the distinct dates; one with
    fewer than `least` earlier rows or one class is left out. Fits are distributed; the loop is over folds.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dates = features.select("date").distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy("date")))  # one row per date
    x = features.join(dates, "date").withColumn("features", array_to_vector("x"))
    out = x.where("false").select("fold", "date", "ticker", "y", F.lit(0.0).alias("p"))
    for fold in dates.groupBy("fold").agg(F.min("date").alias("start")).orderBy("fold").collect():  # a row per fold
        train = x.where(F.col("known") < F.lit(fold["start"]))
        n, up = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if n < least or up in (0, n):
            continue
        model = LogisticRegression(labelCol="y", regParam=0.01, maxIter=30).fit(train)
        out = out.unionByName(model.transform(x.where(F.col("fold") == fold["fold"])).select("fold", "date", "ticker", "y", vector_to_array("probability")[1].alias("p")))
    return out


def sign_p(k: Column, n: Column) -> Column:
    """Two-sided probability of k or fewer (or as many from the other end) of n fair signs."""
    low = F.least(k, n - k).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), low), start, step, lambda s: s["sum"])
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def cluster_signs(clusters: DataFrame, returns: DataFrame) -> DataFrame:
    """(cluster, names, up, median, p): of each group of series the number with a positive mean return, the median of the means, and a sign test on cluster level."""
    means = returns.where("ret is not null").groupBy("ticker").agg(F.avg("ret").alias("_m"))
    g = means.join(clusters, "ticker").groupBy("cluster").agg(F.count("*").alias("names"), F.count_if(F.col("_m") > 0).alias("up"), F.percentile("_m", F.lit(0.5)).alias("median"))
    return g.withColumn("p", sign_p(F.col("up"), F.col("names")))
