"""Registered queries of the inference operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators import inference as I
from panelweave.operators import rolling as W
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import bartlett, nw_line, r, scramble, sharpe
from panelweave.plans.registry import add


def _market(x: Fixtures) -> DataFrame:
    """(book, date, net, m)."""
    return x.nets.select("book", "date", "net").join(x.market.select("date", F.col("ret").alias("m")), "date")


def _menu(x: Fixtures) -> DataFrame:
    """(book, date, net, m, and the return of one region against another)."""
    part = lambda name: F.avg(F.when(F.col("sector") == name, F.col("ret")))
    return _market(x).join(x.returns.groupBy("date").agg((part("ASIA") - part("EUROPE")).alias("tilt")), "date")


def _pairs(x: Fixtures, *others: str) -> DataFrame:
    a = x.nets.where(F.col("book").isin(*others)).select(F.col("book").alias("pair"), "date", F.col("net").alias("x"))
    return a.join(x.nets.where("book = 'bk_ew'").select("date", F.col("net").alias("y")), "date")


_NET = "WITH b0 AS (SELECT book, date, net AS y, ret AS x FROM fx_nets JOIN fx_market USING (date))"
_OUT = f"n, {r('r2', 'r2')}, term, {r('coef', 'coef')}, {r('t', 't')} FROM nw"
add("nw_ols", lambda x: I.nw_ols(_market(x), ["book"], "net", ["m"], 6), f"{_NET}, {nw_line('b0', 'book', 6, 'm')} SELECT book, {_OUT}")
add(
    "rolling_attribution", lambda x: I.nw_ols(I.windows(_market(x).where("m is not null"), ["book"], 52, 13), ["book", "start"], "net", ["m"], 4),
    f"""{_NET}, b1 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY book) AS c FROM b0 WHERE x IS NOT NULL),
    b2 AS (SELECT book, CAST(k * 13 AS INTEGER) AS start, date, y, x FROM b1, range(1000) q(k) WHERE i BETWEEN k * 13 AND k * 13 + 51 AND k * 13 + 52 <= c), {nw_line('b2', 'book, start', 4, 'm')} SELECT book, start, {_OUT}""",
)
add(
    "one_sample_t", lambda x: I.one_sample(x.nets),
    f"SELECT book, count(net) AS n, {r('avg(net)', 'mean')}, {r('avg(net) * sqrt(count(net)) / nullif(stddev_samp(net), 0)', 't')}, {r('avg(CAST(net > 0 AS DOUBLE))', 'share')}, {r('(2.0 * count(*) FILTER (net > 0) - count(*) FILTER (net <> 0)) / sqrt(nullif(count(*) FILTER (net <> 0), 0))', 'sign_z')} FROM fx_nets GROUP BY book",
)
_P, _V = bartlett("e", 4)
add(
    "forward_descriptive", lambda x: I.forward_descriptive(_market(x).where("m is not null and date >= date'1997-01-01'").withColumnRenamed("m", "bench"), 4, 40, 52),
    f"""WITH a AS (SELECT book, date, net, net - ret AS d FROM fx_nets JOIN fx_market USING (date) WHERE ret IS NOT NULL AND date >= DATE '1997-01-01'), b AS (SELECT *, d - avg(d) OVER (PARTITION BY book) AS e FROM a), c AS (SELECT *, {_P} FROM b WINDOW w AS (PARTITION BY book ORDER BY date)),
    m AS (SELECT book, avg(CAST(l > 0 AS DOUBLE)) AS up FROM (SELECT book, date_trunc('month', date) AS mo, sum(ln(1 + net)) AS l FROM a GROUP BY 1, 2) GROUP BY book)
    SELECT book, count(*) AS n, {r('exp(sum(ln(1 + net))) - 1', 'growth')}, {r('stddev_samp(d) * sqrt(52.0)', 'tracking')}, {r('first(up)', 'months_up')}, {r('avg(d)', 'mean_gap')}, {r(f'CASE WHEN count(*) >= 40 THEN avg(d) * count(*) / nullif(sqrt(greatest({_V}, 0)), 0) END', 't')} FROM c JOIN m USING (book) GROUP BY book""",
)

_POS = "s AS (SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY {k}) AS n, {v} FROM {src})"
_BLOCKS = "z AS (SELECT DISTINCT {k}, n FROM s), g AS (SELECT {k}, n, sim, b, {h} % n AS st FROM z, range({sims}) q(sim), range(400) u(b) WHERE b * {block} < n), i AS (SELECT {k}, sim, (st + j) % n AS pos FROM g, range({block}) v(j) WHERE b * {block} + j < n)"
_Q = lambda v: f"{r(f'quantile_cont({v}, 0.05)', 'p05')}, {r(f'quantile_cont({v}, 0.5)', 'p50')}, {r(f'quantile_cont({v}, 0.95)', 'p95')}"
_DRAW = scramble("sim", "b")
add(
    "paired_block_bootstrap", lambda x: I.paired_bootstrap(_pairs(x, "bk_mom", "bk_rot"), 100, 20, 52),
    f"""WITH p AS (SELECT a.book AS pair, date, a.net AS x, b.net AS y FROM fx_nets a JOIN (SELECT date, net FROM fx_nets WHERE book = 'bk_ew') b USING (date) WHERE a.book IN ('bk_mom', 'bk_rot')), {_POS.format(k='pair', v='x, y', src='p')}, {_BLOCKS.format(k='pair', h=_DRAW, sims=100, block=20)},
    e AS (SELECT pair, sim, {sharpe('x')} - ({sharpe('y')}) AS d FROM i JOIN s USING (pair, pos) GROUP BY 1, 2) SELECT pair, {_Q('d')}, {r('avg(CAST(d > 0 AS DOUBLE))', 'share')} FROM e GROUP BY pair""",
)
add(
    "alpha_block_ci", lambda x: I.alpha_block_interval(_market(x), 100, 20),
    f"""WITH p AS (SELECT book, date, net, ret AS m FROM fx_nets JOIN fx_market USING (date) WHERE ret IS NOT NULL), {_POS.format(k='book', v='net, m', src='p')}, {_BLOCKS.format(k='book', h=_DRAW, sims=100, block=20)},
    e AS (SELECT book, sim, avg(net) - covar_pop(net, m) / nullif(var_pop(m), 0) * avg(m) AS a FROM i JOIN s USING (book, pos) GROUP BY 1, 2) SELECT book, {_Q('a')} FROM e GROUP BY book""",
)
add(
    "stationary_bootstrap", lambda x: I.stationary_bootstrap(x.nets, 60, 21),
    f"""WITH {_POS.format(k='book', v='net', src='fx_nets')}, z AS (SELECT DISTINCT book, n FROM s), g AS (SELECT book, n, sim, k0, {scramble('sim', 'k0')} AS h FROM z, range(60) q(sim), range(4000) u(k0) WHERE k0 < n),
    f AS (SELECT *, last_value(CASE WHEN k0 = 0 OR h % 21 = 0 THEN h // 21 - k0 END IGNORE NULLS) OVER (PARTITION BY book, sim ORDER BY k0 ROWS UNBOUNDED PRECEDING) AS o FROM g), e AS (SELECT f.book, sim, avg(net) AS m FROM f JOIN s ON s.book = f.book AND s.pos = (f.o + f.k0) % f.n GROUP BY 1, 2) SELECT book, {_Q('m')} FROM e GROUP BY book""",
)


def _gated(x: Fixtures) -> DataFrame:
    gate = F.coalesce((F.sum("net").over(Window.partitionBy("book").orderBy("date").rowsBetween(-8, -1)) > 0).cast("double"), F.lit(0.0))
    return x.nets.select("book", "date", "net").withColumn("gate", gate)


add(
    "placebo_signals", lambda x: I.placebo_signals(_gated(x), 80, 52),
    f"""WITH p AS (SELECT book, date, net, coalesce(CAST(sum(net) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) > 0 AS DOUBLE), 0.0) AS gate FROM fx_nets), {_POS.format(k='book', v='net, gate', src='p')},
    z AS (SELECT DISTINCT book, n, sim, {scramble('sim', '7')} % n AS sh FROM s, range(1, 81) q(sim)), mv AS (SELECT z.book, sim, (pos + sh) % z.n AS pos, gate AS g FROM z JOIN s ON s.book = z.book), e AS (SELECT book, sim, {sharpe('net * g')} AS sr FROM mv JOIN s USING (book, pos) GROUP BY 1, 2),
    a AS (SELECT book, {sharpe('net * gate')} AS actual FROM s GROUP BY book) SELECT book, {r('first(actual)', 'actual')}, {r('quantile_cont(sr, 0.95)', 'p95')}, {r('avg(CAST(sr < actual AS DOUBLE))', 'share_below')} FROM e JOIN a USING (book) GROUP BY book""",
)
_C = lambda a, b: f"covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0)"
add(
    "permutation_null", lambda x: I.permutation_null(W.forward_return(W.momentum(x.returns, 13, 1), 4).select("date", "ticker", F.col("mom").alias("x"), F.col("fwd").alias("y")), 40),
    f"""WITH p AS (SELECT * FROM (SELECT date, ticker, mom AS x, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS y FROM fx_mom) WHERE x IS NOT NULL AND y IS NOT NULL), {_POS.format(k='ticker', v='x, y', src='p')},
    d AS (SELECT ticker, sim, row_number() OVER (PARTITION BY ticker, sim ORDER BY {scramble('sim', 'pos')}, pos) - 1 AS pos, y AS v FROM s, range(1, 41) q(sim)), e AS (SELECT ticker, sim, {_C('x', 'v')} AS c FROM d JOIN s USING (ticker, pos) GROUP BY 1, 2),
    a AS (SELECT ticker, count(*) AS n, {_C('x', 'y')} AS corr FROM s GROUP BY ticker) SELECT ticker, first(n) AS n, {r('first(corr)', 'corr')}, {r('avg(CAST(abs(c) >= abs(corr) - 1e-9 AS DOUBLE))', 'p')} FROM e JOIN a USING (ticker) GROUP BY ticker""",
)
add(
    "cluster_robust_ols", lambda x: I.cluster_ols(x.factor.withColumn("year", F.year("date")), "ticker", "year", "ret", "m"),
    f"""WITH p AS (SELECT ticker, year(date) AS g, ret AS y, m AS x FROM fx_factor WHERE ret IS NOT NULL AND m IS NOT NULL), f AS (SELECT ticker, count(*) AS n, avg(x) AS mx, covar_pop(y, x) / nullif(var_pop(x), 0) AS b, avg(y) - covar_pop(y, x) / nullif(var_pop(x), 0) * avg(x) AS a, var_pop(x) * count(*) AS d FROM p GROUP BY ticker),
    s AS (SELECT ticker, g, sum((x - mx) * (y - a - b * x)) AS s FROM p JOIN f USING (ticker) GROUP BY 1, 2), w AS (SELECT s.ticker, s.g, covar_pop(p.y, p.x) / nullif(var_pop(p.x), 0) AS o FROM s JOIN p ON p.ticker = s.ticker AND p.g <> s.g GROUP BY 1, 2),
    c AS (SELECT s.ticker, count(*) AS k, sum(s * s) AS m, min(o) AS least, max(o) AS most FROM s LEFT JOIN w ON w.ticker = s.ticker AND w.g = s.g GROUP BY 1)
    SELECT ticker, n, k AS clusters, {r('b', 'slope')}, {r('b / nullif(sqrt(k / nullif(k - 1.0, 0) * (n - 1.0) / nullif(n - 2.0, 0) * m) / d, 0)', 't')}, {r('least', 'least')}, {r('most', 'most')} FROM c JOIN f USING (ticker)""",
)
