"""Regressions with few clusters: robust errors, Wald tests and the wild cluster bootstrap, from one row of sums per cluster.

With the slopes' null imposed, a bootstrap sample only turns the signs of whole clusters' residuals, so its slopes and scores are linear in the clusters'
sums and no row is read again: all 2^G sign vectors are the numbers from 0 to 2^G - 1, read as bits, and dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import f_p, t_p

#: Clusters up to which all sign vectors are tried; with more, so many scrambled ones. Sign vectors that a task tries at once.
EXACT, DRAWS, BLOCK = 12, 4096, 512


def cluster_sums(rows: DataFrame, key: str, cluster: str, y: str, xs: list[str]) -> DataFrame:
    """(key, n, sizes, deviations, s, h, x, m): for each key arrays over its clusters, in their order, of the sums that the tests need.

    Regressors are less their mean. s: their products (k x k each); h: with the outcome less its mean; x, m: their and its sums. Rows with a null don't count.
    """
    rows = rows.dropna(subset=[key, cluster, y, *xs]).select(F.col(key).alias("_k"), F.col(cluster).alias("_g"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)])
    k = len(xs)
    whole = rows.groupBy("_k").agg(F.count("*").alias("n"), F.avg("_y").alias("_my"), F.array(*[F.avg(f"_x{i}") for i in range(k)]).alias("_mx"), F.array(*[F.stddev_samp(f"_x{i}") for i in range(k)]).alias("deviations"), F.var_pop("_y").alias("_vy"))
    x = rows.join(whole, "_k")
    d = [F.col(f"_x{i}") - F.get("_mx", F.lit(i)) for i in range(k)]
    u = F.col("_y") - F.col("_my")
    part = x.groupBy("_k", "_g").agg(
        F.first("n").alias("n"), F.first("deviations").alias("deviations"), F.first("_vy").alias("_vy"), F.count("*").alias("size"), F.array(*[F.sum(a * b) for a in d for b in d]).alias("s"), F.array(*[F.sum(a * u) for a in d]).alias("h"),
        F.array(*[F.sum(a) for a in d]).alias("x"), F.sum(u).alias("m"),
    )
    listed = F.array_sort(F.collect_list(F.struct("_g", "size", "s", "h", "x", "m")))
    out = part.groupBy("_k").agg(F.first("n").alias("n"), F.first("deviations").alias("deviations"), (F.first("_vy") * F.first("n")).alias("total"), listed.alias("_c"))
    return out.select(F.col("_k").alias(key), "n", "deviations", "total", F.col("_c.size").alias("sizes"), F.flatten("_c.s").alias("s"), F.flatten("_c.h").alias("h"), F.flatten("_c.x").alias("x"), F.col("_c.m").alias("m"))


def _arrays(row, k: int) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    m = np.asarray(row.m, dtype=float)
    g = len(m)
    return np.asarray(row.s, dtype=float).reshape(g, k, k), np.asarray(row.h, dtype=float).reshape(g, k), np.asarray(row.x, dtype=float).reshape(g, k), m


def _fit(signs: np.ndarray, n: int, s: np.ndarray, h: np.ndarray, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of signs (one per cluster): slopes, their CR1 covariance, and the Wald statistic that all are zero."""
    g, k = h.shape
    inverse = np.linalg.inv(s.sum(axis=0))
    b = signs @ h @ inverse
    level = signs @ m / n
    score = signs[:, :, None] * h - level[:, None, None] * x - np.einsum("gij,rj->rgi", s, b)
    meat = np.einsum("rgi,rgj->rij", score, score)
    cov = g / (g - 1) * (n - 1) / (n - k - 1) * (inverse @ meat @ inverse)
    return b, cov, np.einsum("ri,rij,rj->r", b, np.linalg.pinv(cov, rcond=1e-12, hermitian=True), b)


def _usable(s: np.ndarray, n: int) -> bool:
    g, k, _ = s.shape
    whole = s.sum(axis=0)
    scale = np.sqrt(np.diag(whole))
    return g > k and n > k + 1 and bool((scale > 0).all()) and np.linalg.matrix_rank(whole / np.outer(scale, scale), tol=1e-10) == k


def slopes(sums: DataFrame, key: str, xs: list[str], cut: float = 0.05) -> DataFrame:
    """(key, term, clusters, slope, t, p, least, most, stable): slopes per deviation of the regressor, with cluster-robust (CR1) t and p of clusters - 1 degrees of freedom; the least and the largest slope
    with one cluster left out, and whether these all have the slope's sign. A key whose clusters are no more than its regressors, or whose regressors are collinear, has no rows."""
    k = len(xs)
    kind = dict(sums.dtypes)[key]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                s, h, x, m = _arrays(row, k)
                g, sizes = len(m), np.asarray(row.sizes, dtype=float)
                if not _usable(s, row.n):
                    continue
                b, cov, _ = _fit(np.ones((1, g)), row.n, s, h, x, m)
                # without a cluster the means move, so the sums are centred anew
                left = row.n - sizes
                xr, mr = x.sum(axis=0) - x, m.sum() - m
                sr = s.sum(axis=0) - s - xr[:, :, None] * xr[:, None, :] / left[:, None, None]
                hr = h.sum(axis=0) - h - xr * (mr / left)[:, None]
                without = np.einsum("gij,gj->gi", np.linalg.pinv(sr, rcond=1e-10, hermitian=True), hr)
                sd = np.asarray(row.deviations, dtype=float)
                for i, name in enumerate(xs):
                    se = np.sqrt(cov[0, i, i])
                    out.append((getattr(row, key), name, g, b[0, i] * sd[i], b[0, i] / se if se > 0 else None, without[:, i].min() * sd[i], without[:, i].max() * sd[i], bool((np.sign(without[:, i]) == np.sign(b[0, i])).all())))
            yield pd.DataFrame(out, columns=[key, "term", "clusters", "slope", "t", "least", "most", "stable"])

    x = sums.mapInPandas(solve, f"{key} {kind}, term string, clusters int, slope double, t double, least double, most double, stable boolean")
    return x.select(key, "term", "clusters", "slope", "t", t_p(F.col("t"), F.col("clusters") - 1).alias("p"), "least", "most", "stable")


def wald(sums: DataFrame, key: str, k: int, exact: int = EXACT, draws: int = DRAWS) -> DataFrame:
    """(key, n, clusters, r2, wald, p, draws, p_wild): the test that all k slopes are zero: by the F distribution with clusters - 1 degrees of freedom below, and the share of sign vectors, the null
    imposed, that reach the statistic. Keys as in `slopes`."""
    kind = dict(sums.dtypes)[key]
    count = F.size("m")
    total = F.when(count <= exact, F.call_function("shiftleft", F.lit(1).cast("long"), F.least(count, F.lit(exact)))).otherwise(F.lit(draws).cast("long"))
    blocks = sums.withColumn("draws", total).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / BLOCK))))

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                s, h, x, m = _arrays(row, k)
                g = len(m)
                if not _usable(s, row.n):
                    continue
                at = np.arange(row.block * BLOCK, min((row.block + 1) * BLOCK, row.draws))
                if g <= exact:
                    signs = 1.0 - 2.0 * (at[:, None] >> np.arange(g)[None, :] & 1)
                else:
                    signs = np.array([np.random.default_rng([i, g]).integers(0, 2, g) for i in at]) * 2.0 - 1.0
                b, _, real = _fit(np.ones((1, g)), row.n, s, h, x, m)
                _, _, null = _fit(signs, row.n, s, h, x, m)
                r2 = float(b[0] @ h.sum(axis=0) / row.total) if row.total > 0 else None
                out.append((getattr(row, key), row.n, g, r2, real[0], row.draws, int((null >= real[0] * (1 - 1e-9)).sum())))
            yield pd.DataFrame(out, columns=[key, "n", "clusters", "r2", "wald", "draws", "reached"])

    x = blocks.mapInPandas(tried, f"{key} {kind}, n long, clusters int, r2 double, wald double, draws long, reached long")
    x = x.groupBy(key).agg(*[F.first(c).alias(c) for c in ("n", "clusters", "r2", "wald", "draws")], F.sum("reached").alias("reached"))
    return x.select(key, "n", "clusters", "r2", "wald", f_p(F.col("wald") / k, F.lit(k), F.col("clusters") - 1).alias("p"), "draws", (F.col("reached") / F.col("draws")).alias("p_wild"))
