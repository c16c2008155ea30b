"""Factor covariances of return windows from their dual spectrum.

A window is n dates by p names; its spectrum is that of the n x n sums of products over the names. Names are dealt out in buckets, each bucket adds up its own
n x n matrix, and one small group per window solves it, so p has no bound. Loadings, idiosyncratic variances, rotations and weights are then columns
of one row per name: a covariance V diag(lam) V' + diag(d) is never formed, and its inverse needs k x k sums per window only.

`keys` name a window (the month, and its length, universe and whatever else). A window needs more than k + 1 names and dates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave.functions.columns import paired_t, ratio, t_p

#: Names of a window that one task adds up at once.
BUCKET = 4096
#: Least squared correction of a factor, and least idiosyncratic variance.
TAU, FLOOR = 0.01, 1e-8
#: Draws of the rotation bound.
DRAWS = 200


class Estimator(NamedTuple):
    """k components plus a diagonal; `rotate` turns loadings toward equal ones: none, all, or those whose signal and eigengap reach psi_min and gap_min.

    idio: share of the mean in each idiosyncratic variance; flat: one variance for all instead. trust: multiple of the rotation bound by which loadings are distrusted.
    """

    name: str
    k: int
    rotate: str = "none"
    psi_min: float = 0.0
    gap_min: float = 0.0
    idio: float = 0.0
    trust: float = 0.0
    flat: bool = False


def windows(returns: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """(n, month, keys, date, ticker, ret): for each month and length the n dates before it. Every length has the same months: those with more dates before them than the longest."""
    days = returns.select("date").distinct().withColumn("_pos", F.row_number().over(Window.orderBy("date")))  # one row per date
    first = days.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.min("_pos").alias("_at")).where(F.col("_at") > max(lengths))
    each = first.select("month", "_at", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    each = each.select("n", "month", F.explode(F.sequence(F.col("_at") - F.col("n"), F.col("_at") - 1)).alias("_pos")).join(days, "_pos")
    return each.join(returns.where("ret is not null").select(*keys, "date", "ticker", "ret"), "date").select("n", "month", *keys, "date", "ticker", "ret")


def vectors(rows: DataFrame, keys: list[str], length: str | None = None, centred: bool = True) -> DataFrame:
    """(keys, ticker, n, x): each name's returns in order of the dates, less their mean unless not centred; of windows with a column of their length only complete ones."""
    x = rows.groupBy(*keys, "ticker").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("_x"))
    x = x.withColumn("_x", F.transform("_x", lambda e: e["ret"])).withColumn("_n", F.size("_x"))
    x = x.where(F.col("_n") == F.col(length)) if length else x
    mean = F.aggregate("_x", F.lit(0.0), lambda s, e: s + e) / F.col("_n")
    return x.select(*keys, "ticker", F.col("_n").alias("_dates"), (F.transform("_x", lambda e: e - mean) if centred else F.col("_x")).alias("x"))


def _fields(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def spectrum(x: DataFrame, keys: list[str], k: int, buckets: int | None = None) -> DataFrame:
    """(keys, dates, p, total, size2, u): total sum of squares, its falling parts by component (as many as there are dates), and the k first unit vectors over dates."""
    if buckets is None:
        buckets = max(1, -(-x.select("ticker").distinct().count() // BUCKET))
    kinds = _fields(x, keys)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["x"].to_numpy())
        return pdf.head(1)[keys].assign(p=len(m), g=[(m.T @ m).ravel()])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum(np.stack(pdf["g"].to_numpy()), axis=0)
        n = int(round(len(g) ** 0.5))
        value, vector = np.linalg.eigh(g.reshape(n, n))
        value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1]
        return pdf.head(1)[keys].assign(dates=n, p=int(pdf["p"].sum()), total=float(np.trace(g.reshape(n, n))), size2=[value], u=[vector[:, :k].T.tolist()])

    bucket = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).alias("_bucket")
    sums = x.select(*keys, bucket, "x").groupBy(*keys, "_bucket").applyInPandas(own, f"{kinds}, p long, g array<double>")
    out = sums.groupBy(*keys).applyInPandas(solve, f"{kinds}, dates int, p long, total double, size2 array<double>, u array<array<double>>")
    return out.where((F.col("p") > k + 1) & (F.col("dates") > k + 1) & (F.element_at("size2", k) > F.col("total") * 1e-12))


def scores(spec: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, factor, score): the components' series over the window's dates; dates: (keys, date)."""
    at = dates.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    x = spec.select(*keys, "size2", F.posexplode("u").alias("_f", "_u"))
    x = x.select(*keys, (F.col("_f") + 1).alias("factor"), F.sqrt(F.element_at("size2", F.col("_f") + 1)).alias("_s"), F.posexplode("_u").alias("_j", "_v"))
    return x.withColumn("_i", F.col("_j") + 1).join(at, [*keys, "_i"]).select(*keys, "date", "factor", (F.col("_s") * F.col("_v")).alias("score"))


def noise(spec: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, factor, strength, noise, snr, floor, cut, trusted): strengths per name and date, the mean of all beyond the k first, and their ratio less one
    against the edge 2 sqrt(n / p) + n / p + 1/2. floor: noise over strength, corrected by n / 2p where names are seven times the dates."""
    n, p = F.col("dates").cast("double"), F.col("p").cast("double")
    x = spec.withColumn("_theta", F.transform("size2", lambda v: v / (n * p)))
    ell = F.aggregate(F.slice("_theta", k + 1, F.col("dates")), F.lit(0.0), lambda s, v: s + v) / (n - k)
    x = x.select(*keys, "dates", "p", ell.alias("noise"), F.posexplode(F.slice("_theta", 1, k)).alias("_f", "strength"))
    snr = ratio(F.col("strength"), F.col("noise")) - 1
    cut = 2 * F.sqrt(n / p) + n / p + 0.5
    floor = ratio(F.col("noise"), F.col("strength")) + F.when(p / n >= 7, 0.5 * n / p).otherwise(0.0)
    return x.select(*keys, (F.col("_f") + 1).alias("factor"), "strength", "noise", snr.alias("snr"), floor.alias("floor"), cut.alias("cut"), (snr > cut).alias("trusted"))


def loadings(x: DataFrame, spec: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, ticker, dates, p, total, size2, x2, s): each name's sum of squares and its loadings times the components' sizes, signed so that a component's loadings sum to no less than zero."""
    dot = lambda a: F.aggregate(F.zip_with(a, F.col("x"), lambda c, e: c * e), F.lit(0.0), lambda s, v: s + v)
    own = x.join(spec, keys).select(*keys, "ticker", "dates", "p", "total", "size2", F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e).alias("x2"), F.transform("u", dot).alias("_s"))
    signs = own.groupBy(*keys).agg(F.array(*[F.when(F.sum(F.element_at("_s", i + 1)) < 0, -1.0).otherwise(1.0) for i in range(k)]).alias("_sign"))
    return own.join(signs, keys).select(*keys, "ticker", "dates", "p", "total", "size2", "x2", F.zip_with("_s", "_sign", lambda s, g: s * g).alias("s"))


def rotation_bound(rho: np.ndarray, n: int, draws: int = DRAWS, tail: bool = True) -> np.ndarray:
    """Mean squared sine of the angle between a factor's axis and the sample eigenvector that belongs to it, over draws of n dates of factors of strengths rho.

    The draws depend on n and the number of factors only, so every window of a length sees the same ones; tail: Student's t with 6 degrees of freedom.
    """
    rng = np.random.default_rng([n, len(rho)])
    f = rng.standard_t(6, size=(draws, len(rho), n)) / np.sqrt(1.5) if tail else rng.standard_normal((draws, len(rho), n))
    f = f * np.sqrt(np.maximum(rho, 0.0))[None, :, None]
    f = f - f.mean(axis=2, keepdims=True)
    _, vector = np.linalg.eigh(f @ f.transpose(0, 2, 1) / n)
    aligned = np.diagonal(vector[:, :, ::-1], axis1=1, axis2=2)
    return 1.0 - (aligned**2).mean(axis=0)


def state(load: DataFrame, keys: list[str], estimators: list[Estimator]) -> DataFrame:
    """(keys, est, k, psi, gap, lam, lift, slope, spread, idio, level): for each window and estimator how a loading becomes its corrected form, lift / sqrt(p) + slope * s.

    psi: share of the signal in each component, before its floor; gap: how far its strength lies above the next one's, as a share of it.
    """
    k = max(e.k for e in estimators)
    sums = load.groupBy(*keys).agg(F.first("dates").alias("dates"), F.first("p").alias("p"), F.first("total").alias("total"), F.first("size2").alias("size2"), F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(k)]).alias("sum"))
    kinds = _fields(load, keys)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row, window in zip(pdf.itertuples(index=False), pdf[keys].itertuples(index=False), strict=True):
                n, p, all2 = row.dates, row.p, np.asarray(row.size2)
                for e in estimators:
                    size2 = all2[: e.k]
                    lam = size2 / n
                    delta2 = max(row.total - size2.sum(), 0.0) / ((p - e.k) * n)
                    psi2 = 1.0 - p * delta2 / size2
                    gap = (size2 - all2[1 : e.k + 1]) / size2
                    hq = np.minimum(np.asarray(row.sum)[: e.k] / np.sqrt(size2 * p), 1.0)
                    c = np.clip(hq / np.sqrt(np.maximum(psi2, TAU)), -1.0, 1.0)
                    rest = np.sqrt(np.maximum(1 - hq**2, 0.0))
                    turn = np.where(rest > 1e-8, np.sqrt(np.maximum(1 - c**2, 0.0)) / np.maximum(rest, 1e-8), 0.0)
                    lift = np.where(rest > 1e-8, c - turn * hq, 1.0)
                    psi = np.sqrt(np.maximum(psi2, 0.0))
                    use = np.full(e.k, e.rotate == "all") if e.rotate != "gated" else (psi >= e.psi_min) & (gap >= e.gap_min)
                    sin2 = np.clip(e.trust * rotation_bound(size2 / p * np.maximum(psi2, 0.0), n), 0, 0.999) if e.trust else np.zeros(e.k)
                    out.append((*window, e.name, e.k, psi, gap, lam * (1 - 2 * sin2), np.where(use, lift, 0.0), np.where(use, turn, 1.0) / np.sqrt(size2), float((lam * sin2).sum()), e.idio, delta2 if e.flat else None))
            yield pd.DataFrame(out, columns=[*keys, "est", "k", "psi", "gap", "lam", "lift", "slope", "spread", "idio", "level"])

    arrays = ", ".join(f"{c} array<double>" for c in ("psi", "gap", "lam", "lift", "slope"))
    return sums.mapInPandas(solve, f"{kinds}, est string, k int, {arrays}, spread double, idio double, level double")


def parts(load: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, est, ticker, d, v, lam): each name's diagonal entry and loadings of the covariance V diag(lam) V' + diag(d)."""
    x = load.join(states, keys)
    own = F.slice("s", 1, F.col("k"))
    rest = F.col("x2") - F.aggregate(own, F.lit(0.0), lambda a, s: a + s * s)
    x = x.withColumn("_d", F.greatest(rest / F.col("dates"), F.lit(FLOOR)))
    mean = F.avg("_d").over(Window.partitionBy(*keys, "est"))
    d = F.col("idio") * mean + (1 - F.col("idio")) * F.col("_d") + F.col("spread")
    d = F.coalesce("level", d)
    root = F.sqrt(F.col("p").cast("double"))
    v = F.zip_with(F.zip_with(own, "slope", lambda s, b: s * b), "lift", lambda s, a: s + a / root)
    return x.select(*keys, "est", "ticker", d.alias("d"), v.alias("v"), "lam")


def _solve(system: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, est, y): of (I + lam A) y = lam b for each row of sums a (k x k) and b (k)."""
    fields = StructType([*[f for f in system.schema.fields if f.name in (*keys, "est")]])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            y = []
            for lam, a, b in zip(pdf["lam"], pdf["a"], pdf["b"], strict=True):
                own = len(lam)
                a, b = np.asarray(a, dtype=float).reshape(k, k)[:own, :own], np.asarray(b, dtype=float)[:own]
                y.append(np.linalg.solve(np.eye(own) + np.asarray(lam)[:, None] * a, np.asarray(lam) * b))
            yield pdf[[*keys, "est"]].assign(y=y)

    return system.mapInPandas(solve, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fields)}, y array<double>")


def _inverse_times(part: DataFrame, keys: list[str], k: int, target: Column) -> DataFrame:
    """part with `_z`, the inverse covariance times the column `target`. The sums of a window are k x k; the rest is by row."""
    at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    a = F.array(*[F.sum(at(i) * at(j) / F.col("d")) for i in range(k) for j in range(k)])
    b = F.array(*[F.sum(at(i) * target / F.col("d")) for i in range(k)])
    y = _solve(part.groupBy(*keys, "est").agg(F.first("lam").alias("lam"), a.alias("a"), b.alias("b")), keys, k)
    common = F.aggregate(F.zip_with("v", "y", lambda v, s: v * s), F.lit(0.0), lambda s, v: s + v)
    return part.join(y, [*keys, "est"]).withColumn("_z", (target - common) / F.col("d")).drop("y")


def _booked(w: DataFrame, keys: list[str], cap: float | None) -> DataFrame:
    """Weights `w` of books: unconstrained, and long only (negative ones cut, then brought to one); both capped and brought to one. Books without a positive sum are left out."""
    books = F.explode(F.array(F.lit("unconstrained"), F.lit("long_only"))).alias("book")
    group = Window.partitionBy(*keys, "est", "book")
    x = w.select(*keys, "est", books, "ticker", "w")
    x = x.withColumn("w", F.when(F.col("book") == "long_only", F.greatest("w", F.lit(0.0))).otherwise(F.col("w")))
    for limit in (None, cap) if cap else (None,):
        x = x.withColumn("w", F.greatest(F.least("w", F.lit(limit)), F.lit(-limit))) if limit else x
        x = x.withColumn("_t", F.sum("w").over(group)).where(F.abs("_t") > 1e-9).withColumn("w", F.col("w") / F.col("_t")).drop("_t")
    return x


def minimum_variance(part: DataFrame, keys: list[str], k: int, cap: float | None = None) -> DataFrame:
    """(keys, est, book, ticker, w): weights of least variance that sum to one."""
    z = _inverse_times(part, keys, k, F.lit(1.0)).withColumn("_t", F.sum("_z").over(Window.partitionBy(*keys, "est")))
    return _booked(z.where(F.abs("_t") > 1e-12).withColumn("w", F.col("_z") / F.col("_t")), keys, cap)


def tracking(part: DataFrame, index: DataFrame, keys: list[str], k: int, cap: float | None = None) -> DataFrame:
    """(keys, est, book, ticker, w): weights on a basket that sum to one and differ from an index with least variance.

    index: (keys, ticker, wb, basket). The covariance of the index with a name of the basket is its own share of the diagonal plus what the components carry.
    """
    x = part.join(index, [*keys, "ticker"])
    at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    carried = x.groupBy(*keys, "est").agg(F.array(*[F.sum(at(i) * F.col("wb")) for i in range(k)]).alias("_g"))
    x = x.join(carried, [*keys, "est"]).where("basket")
    product = F.zip_with(F.zip_with("v", "lam", lambda v, m: v * m), F.slice("_g", 1, F.size("lam")), lambda v, g: v * g)
    x = x.withColumn("_c", F.col("d") * F.col("wb") + F.aggregate(product, F.lit(0.0), lambda s, v: s + v)).drop("_g")
    own = _inverse_times(x, keys, k, F.col("_c")).withColumnRenamed("_z", "_zc")
    both = _inverse_times(own, keys, k, F.lit(1.0))
    group = Window.partitionBy(*keys, "est")
    scale = ratio(1 - F.sum("_zc").over(group), F.sum("_z").over(group))
    return _booked(both.withColumn("w", F.col("_zc") + scale * F.col("_z")).where("w is not null"), keys, cap)


def outcomes(weights: DataFrame, returns: DataFrame, keys: list[str], per_year: int, cost_bps: float = 5.0) -> DataFrame:
    """(keys, est, book, vol, ret, turnover, net): what each window's weights did in their own month, and how far they are from the month before.

    A name without a return earns none. vol is per year; turnover is null in a book's first month, which costs nothing.
    """
    group = [*keys, "est", "book"]
    r = returns.where("ret is not null").withColumn("month", F.to_date(F.date_trunc("month", "date"))).select("month", "date", "ticker", "ret")
    days = r.select("month", "date").distinct()
    earned = weights.join(r, ["month", "ticker"]).groupBy(*group, "date").agg(F.sum(F.col("w") * F.col("ret")).alias("_r"))
    all_days = weights.select(*group).distinct().join(days, "month").join(earned, [*group, "date"], "left")
    x = all_days.groupBy(*group).agg((F.stddev_samp(F.coalesce("_r", F.lit(0.0))) * F.sqrt(F.lit(float(per_year)))).alias("vol"), F.sum(F.coalesce("_r", F.lit(0.0))).alias("ret"))
    others = [c for c in group if c != "month"]
    months = weights.select(*group).distinct().withColumn("_next", F.lead("month").over(Window.partitionBy(*others).orderBy("month")))
    before = weights.join(months, group).select(*others, F.col("_next").alias("month"), "ticker", F.col("w").alias("_b")).where("month is not null")
    gone = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    moved = weights.join(before, [*group, "ticker"], "full").groupBy(*group).agg(F.when(F.count("_b") > 0, F.sum(gone)).alias("turnover"))
    return x.join(moved, group).withColumn("net", F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * cost_bps / 1e4)


def compared(done: DataFrame, keys: list[str], base: str) -> DataFrame:
    """(keys without the month, est, book, months, vol, t, p, sharpe, turnover): each estimator's mean volatility, its paired t against the base, and its net Sharpe ratio over months."""
    others = [c for c in keys if c != "month"]
    pair = done.join(done.where(F.col("est") == base).select(*keys, "book", F.col("vol").alias("_v")), [*keys, "book"]).withColumn("_d", F.when(F.col("est") != base, F.col("vol") - F.col("_v")))
    t, dof = paired_t("_d")
    sd = F.stddev_samp("net")
    x = pair.groupBy(*others, "est", "book").agg(F.count("*").alias("months"), F.avg("vol").alias("vol"), t.alias("t"), dof.alias("_dof"), F.when(sd > 1e-15, F.avg("net") / sd * F.sqrt(F.lit(12.0))).alias("sharpe"), F.avg("turnover").alias("turnover"))
    return x.withColumn("p", t_p(F.col("t"), F.col("_dof"))).drop("_dof")


def crossover_rows(done: DataFrame, states: DataFrame, spec: DataFrame, keys: list[str], pair: tuple[str, str]) -> DataFrame:
    """(keys, book, p_over_n, psi_median, eigengap, delta): for each window the second estimator's volatility less the first's, beside what was known before."""
    first, second = (done.where(F.col("est") == e).select(*keys, "book", F.col("vol").alias(f"_v{i}")) for i, e in enumerate(pair))
    known = states.where(F.col("est") == pair[1])
    floored = F.transform("psi", lambda v: F.greatest(v, F.lit(TAU**0.5)))
    k = F.size("psi")
    ordered = F.array_sort(floored)
    half = lambda i: F.get(ordered, i)
    middle = F.when(k % 2 == 1, half((k / 2).cast("int"))).otherwise((half((k / 2).cast("int") - 1) + half((k / 2).cast("int"))) / 2)
    known = known.select(*keys, middle.alias("psi_median"), F.get("gap", F.lit(0)).alias("eigengap"))
    x = first.join(second, [*keys, "book"]).join(known, keys).join(spec.select(*keys, (F.col("p") / F.col("dates")).alias("p_over_n")), keys)
    return x.select(*keys, "book", "p_over_n", "psi_median", "eigengap", (F.col("_v1") - F.col("_v0")).alias("delta"))


def crossover_map(rows: DataFrame, keys: list[str], length: str = "n") -> DataFrame:
    """(length and keys without the month, book, months, psi_median, p_over_n, delta, t, p, crossing): the mean paired difference by window length, and the length, between this one and the next longer,
    at which it changes its sign (linear in between; null where it doesn't)."""
    others = [c for c in keys if c not in ("month", length)]
    t, dof = paired_t("delta")
    x = rows.groupBy(length, *others, "book").agg(F.count("*").alias("months"), F.percentile("psi_median", F.lit(0.5)).alias("psi_median"), F.avg("p_over_n").alias("p_over_n"), F.avg("delta").alias("delta"), t.alias("t"), dof.alias("_dof"))
    w = Window.partitionBy(*others, "book").orderBy(length)
    after, to = F.lead("delta").over(w), F.lead(length).over(w)
    crossing = F.when(F.signum("delta") * F.signum(after) < 0, F.col(length) + (to - F.col(length)) * F.col("delta") / (F.col("delta") - after))
    return x.withColumn("crossing", crossing).withColumn("p", t_p(F.col("t"), F.col("_dof"))).drop("_dof")


def regime_map(done: DataFrame, states: DataFrame, keys: list[str], pair: tuple[str, str], book: str = "long_only") -> DataFrame:
    """(keys without the month, months, psi1, turnover of both, delta_turnover, t, p, delta_vol, effect): medians over months of a factor correction's effect by universe and window length.

    effect: stabilises or destabilises where the paired difference of turnovers is significant at 5 %, else none.
    """
    others = [c for c in keys if c != "month"]
    own = done.where((F.col("book") == book) & F.col("turnover").isNotNull())
    first, second = (own.where(F.col("est") == e).select(*keys, F.col("turnover").alias(f"_t{i}"), F.col("vol").alias(f"_v{i}")) for i, e in enumerate(pair))
    x = first.join(second, keys).join(states.where(F.col("est") == pair[1]).select(*keys, F.get("psi", F.lit(0)).alias("_psi")), keys)
    t, dof = paired_t(F.col("_t1") - F.col("_t0"))
    half = F.lit(0.5)
    x = x.groupBy(*others).agg(
        F.count("*").alias("months"), F.avg("_psi").alias("psi1"), F.percentile("_t0", half).alias("turnover_base"), F.percentile("_t1", half).alias("turnover"), F.percentile(F.col("_t1") - F.col("_t0"), half).alias("delta_turnover"),
        t.alias("t"), dof.alias("_dof"), F.percentile(F.col("_v1") - F.col("_v0"), half).alias("delta_vol"),
    ).withColumn("p", t_p(F.col("t"), F.col("_dof"))).drop("_dof")
    sure = F.col("p") < 0.05
    return x.withColumn("effect", F.when(sure & (F.col("t") < 0), "stabilises").when(sure, "destabilises").otherwise("none"))
