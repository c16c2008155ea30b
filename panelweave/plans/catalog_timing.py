"""Registered queries of timing tests and placebo gates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import timing as Q
from panelweave.plans import catalog_inference as base
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import bartlett, r, scramble
from panelweave.plans.registry import add

LAGS, WEEKS, SIMS, MEAN_BLOCK = 4, 52, 60, 13


def _verdicts(x: Fixtures) -> DataFrame:
    """The three books; the equal-weight one is the others' parent."""
    gross = x.weights.groupBy("book", "date").agg(F.sum(F.abs("w")).alias("g")).groupBy("book").agg(F.avg("g").alias("gross"))
    parents = x.nets.select("book").distinct().where("book <> 'bk_ew'").withColumn("parent", F.lit("bk_ew"))
    return Q.timing_verdicts(base._market(x), gross, parents, LAGS, WEEKS, SIMS, MEAN_BLOCK)


def _gamma(src: str, name: str, lags: int) -> str:
    """CTEs up to {name}: gamma of y on m and its square in src(book, date, y, m), by partialling the market out, with a Newey-West t."""
    products, variance = bartlett("g", lags)
    return f"""{name}1 AS (SELECT *, m * m AS q, covar_pop(m * m, m) OVER k / var_pop(m) OVER k AS bq, covar_pop(y, m) OVER k / var_pop(m) OVER k AS by_, avg(m * m) OVER k AS mq, avg(m) OVER k AS mm, avg(y) OVER k AS my FROM {src} WINDOW k AS (PARTITION BY book)),
    {name}2 AS (SELECT book, date, q - mq - bq * (m - mm) AS xt, y - my - by_ * (m - mm) AS yt, mq, mm, my, bq, by_ FROM {name}1),
    {name}3 AS (SELECT *, sum(xt * yt) OVER k / sum(xt * xt) OVER k AS gamma, sum(xt * xt) OVER k AS sxx FROM {name}2 WINDOW k AS (PARTITION BY book)),
    {name}4 AS (SELECT *, xt * (yt - gamma * xt) / sxx AS g FROM {name}3), {name}5 AS (SELECT *, {products} FROM {name}4 WINDOW w AS (PARTITION BY book ORDER BY date)),
    {name} AS (SELECT book, count(*) AS n, first(gamma) AS gamma, first(gamma) / nullif(sqrt(greatest({variance}, 0)), 0) AS t, first(my) - (first(by_) - first(gamma) * first(bq)) * first(mm) - first(gamma) * first(mq) AS alpha, first(mq) AS mq FROM {name}5 GROUP BY book)"""


_H = scramble("sim", "at_")
_VERDICTS = f"""WITH b AS (SELECT book, date, net AS y, ret AS m FROM fx_nets JOIN fx_market USING (date) WHERE net IS NOT NULL AND ret IS NOT NULL),
    dd AS (SELECT b.book, b.date, b.y - p.y AS y, b.m FROM b JOIN b p ON p.book = 'bk_ew' AND p.date = b.date WHERE b.book <> 'bk_ew'),
    {_gamma("b", "s", LAGS)}, {_gamma("b", "l", 4 * LAGS)}, {_gamma("dd", "d", LAGS)},
    gr AS (SELECT book, avg(g) AS gross FROM (SELECT book, date, sum(abs(w)) AS g FROM fx_weights GROUP BY book, date) GROUP BY book),
    o AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY book) AS n, y, m FROM b),
    u0 AS (SELECT book, n, sim, at_, {_H} AS h FROM (SELECT DISTINCT book, n FROM o), range({SIMS}) q(sim), range(2000) v(at_) WHERE at_ < n),
    u1 AS (SELECT *, CASE WHEN at_ = 0 OR h % {MEAN_BLOCK} = 0 THEN at_ END AS ra, CASE WHEN at_ = 0 OR h % {MEAN_BLOCK} = 0 THEN h // {MEAN_BLOCK} END AS rs FROM u0),
    u2 AS (SELECT *, last_value(ra IGNORE NULLS) OVER k AS la, last_value(rs IGNORE NULLS) OVER k AS ls FROM u1 WINDOW k AS (PARTITION BY book, sim ORDER BY at_ ROWS UNBOUNDED PRECEDING)),
    u3 AS (SELECT book, sim, (ls + at_ - la) % n AS pos FROM u2),
    u4 AS (SELECT book, sim, (covar_pop(y, m * m) * var_pop(m) - covar_pop(y, m) * covar_pop(m, m * m)) / nullif(var_pop(m) * var_pop(m * m) - covar_pop(m, m * m) * covar_pop(m, m * m), 0) AS g FROM u3 JOIN o USING (book, pos) GROUP BY book, sim),
    bp AS (SELECT book, avg(CAST(g <= 0 AS DOUBLE)) AS boot_p FROM u4 GROUP BY book),
    x AS (SELECT s.*, l.t AS t_long, gross, s.gamma * s.mq * 52 AS value, s.alpha * 52 + s.gamma * s.mq * 52 - greatest(gross - 1, 0) * 0.005 AS stressed, 2.84 * abs(s.gamma / s.t) * s.mq * 52 AS least_value, boot_p FROM s JOIN l USING (book) JOIN gr USING (book) JOIN bp USING (book)),
    z AS (SELECT x.*, CASE WHEN x.book <> 'bk_ew' THEN 'bk_ew' END AS parent, p.gamma AS parent_gamma, CASE WHEN p.gamma > 0 THEN x.gamma / x.gross > p.gamma / p.gross WHEN p.gamma IS NOT NULL THEN x.gamma > 0 END AS beats_parent, d.gamma AS difference, abs(d.gamma / d.t) AS difference_se
        FROM x LEFT JOIN x p ON p.book = 'bk_ew' AND x.book <> 'bk_ew' LEFT JOIN d ON d.book = x.book),
    v AS (SELECT *, t >= 2 AND value > 0 AND coalesce(beats_parent, true) AND stressed > 0 AS times FROM z)
    SELECT book, n, {r("gamma", "gamma")}, {r("t", "t")}, {r("t_long", "t_long")}, {r("value", "value")}, {r("alpha * 52", "alpha")}, {r("stressed", "stressed")}, {r("least_value", "least_value")}, parent, {r("parent_gamma", "parent_gamma")}, beats_parent, {r("difference", "difference")},
    {r("difference_se", "difference_se")}, abs(difference) >= difference_se AS distinct, {r("boot_p", "boot_p")}, CASE WHEN times AND t >= 2.4 THEN 'strong' WHEN times THEN 'times' ELSE 'none' END AS verdict FROM v"""
add("timing_verdicts", _verdicts, _VERDICTS)

BLOCK, DELAY, CALM, OFF = 21, 5, 8, 0.2
_worth = lambda g: f"avg(ln(1 + net * {g}) - ln(1 + net)) * 52"
_PLACEBOS = f"""WITH p AS (SELECT book, date, coalesce(net, 0) AS net, coalesce(CAST(sum(net) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) > 0 AS DOUBLE), 0.0) AS gate FROM fx_nets),
    s AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY book) AS n, net, gate FROM p), z AS (SELECT DISTINCT book, n, sim FROM s, range(1, {SIMS + 1}) q(sim)),
    b0 AS (SELECT z.*, b, least({BLOCK}, n - b * {BLOCK}) AS size FROM z, range(500) v(b) WHERE b * {BLOCK} < n),
    b1 AS (SELECT *, sum(size) OVER (PARTITION BY book, sim ORDER BY {scramble("sim", "b + 100")}, b) - size AS start FROM b0),
    b2 AS (SELECT book, sim, start + j AS pos, ({scramble("sim", "11")} + b * {BLOCK} + j) % n AS src FROM b1, range({BLOCK}) w(j) WHERE j < size),
    bg AS (SELECT b2.book, sim, b2.pos, gate AS g FROM b2 JOIN s ON s.book = b2.book AND s.pos = b2.src),
    r0 AS (SELECT *, coalesce((gate > 0) <> (lag(gate) OVER (PARTITION BY book ORDER BY pos) > 0), true) AS new FROM s), r1 AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY book ORDER BY pos) AS run FROM r0),
    r2 AS (SELECT book, gate > 0 AS is_on, run, count(*) AS length FROM r1 GROUP BY 1, 2, 3), r3 AS (SELECT *, row_number() OVER (PARTITION BY book, is_on ORDER BY run) - 1 AS k, count(*) OVER (PARTITION BY book, is_on) AS c FROM r2),
    e0 AS (SELECT z.*, i, (i + CASE WHEN {scramble("sim", "13")} % 2 = 0 THEN 1 ELSE 0 END) % 2 = 0 AS is_on FROM z, range(2000) v(i) WHERE i < n),
    e1 AS (SELECT e0.*, {scramble("sim", "i + 1000")} % c AS k FROM e0 JOIN (SELECT DISTINCT book, is_on, c FROM r3) USING (book, is_on) WHERE book IN (SELECT book FROM r3 GROUP BY book HAVING count(DISTINCT is_on) = 2)),
    e2 AS (SELECT e1.*, length, coalesce(sum(length) OVER (PARTITION BY book, sim ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e1 JOIN r3 USING (book, is_on, k)),
    eg AS (SELECT book, sim, unnest(range(CAST(start AS BIGINT), CAST(least(start + length, n) AS BIGINT))) AS pos, CAST(is_on AS DOUBLE) AS g FROM e2 WHERE start < n),
    a AS (SELECT book, {_worth("gate")} AS actual FROM s GROUP BY book),
    m AS (SELECT book, 'blocks' AS placebo, sim, {_worth("g")} AS e FROM bg JOIN s USING (book, pos) GROUP BY book, sim UNION ALL SELECT book, 'runs', sim, {_worth("g")} FROM eg JOIN s USING (book, pos) GROUP BY book, sim),
    c0 AS (SELECT *, CASE WHEN count(net) OVER w = {CALM} THEN stddev_samp(net) OVER w END AS v, coalesce(lag(gate, {DELAY}) OVER (PARTITION BY book ORDER BY pos), 1.0) AS gd FROM s WINDOW w AS (PARTITION BY book ORDER BY pos ROWS BETWEEN {CALM - 1} PRECEDING AND CURRENT ROW)),
    c1 AS (SELECT *, coalesce(CAST(v < quantile_cont(v, {1 - OFF}) OVER (PARTITION BY book) AS DOUBLE), 1.0) AS gc FROM c0),
    o AS (SELECT book, 'delayed' AS placebo, {_worth("gd")} AS level FROM c1 GROUP BY book UNION ALL SELECT book, 'calm', {_worth("gc")} FROM c1 GROUP BY book)
    SELECT book, placebo, {r("first(actual)", "actual")}, {r("quantile_cont(e, 0.95)", "level")}, {r("avg(CAST(e < actual - 1e-12 AS DOUBLE))", "share_below")} FROM m JOIN a USING (book) GROUP BY book, placebo
    UNION ALL SELECT book, placebo, {r("actual", "actual")}, {r("level", "level")}, CAST(level < actual - 1e-12 AS DOUBLE) FROM o JOIN a USING (book)"""
add("placebo_gates", lambda x: Q.placebo_gates(base._gated(x), SIMS, WEEKS, BLOCK, DELAY, CALM, OFF), _PLACEBOS)
