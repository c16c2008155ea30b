"""Registered queries of alphas, projections and audits that must block, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import ratio
from panelweave.operators import alphas as A
from panelweave.operators import events as V
from panelweave.operators import inference as I
from panelweave.operators import metrics as M
from panelweave.plans import catalog as base
from panelweave.plans import catalog_inference as inference
from panelweave.plans import catalog_more as more
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import bartlett, nw_line, r, scramble, sharpe
from panelweave.plans.registry import add, add_fold

XS, LAGS, WEEKS, TRIALS = ["m", "tilt"], 6, 52, 20


def nw_plane(src: str, keys: str, lags: int, a: str, b: str, p: str = "n") -> str:
    """CTEs up to {p}8, a row per key, and {p}p: (keys, n, r2, term, coef, t) of y on a constant, a and b in src(keys, date, y, a, b)."""
    parts = {c: bartlett(c, lags) for c in ("gc", "ga", "gb")}
    return f"""{p}0 AS (SELECT * FROM {src} WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
    {p}1 AS (SELECT *, count(*) OVER k AS n, avg(y) OVER k AS my, avg(a) OVER k AS ma, avg(b) OVER k AS mb, var_pop(y) OVER k AS vy, var_pop(a) OVER k AS vaa, var_pop(b) OVER k AS vbb, covar_pop(a, b) OVER k AS vab, covar_pop(y, a) OVER k AS vya, covar_pop(y, b) OVER k AS vyb FROM {p}0 WINDOW k AS (PARTITION BY {keys})),
    {p}2 AS (SELECT *, vaa * vbb - vab * vab AS det FROM {p}1), {p}3 AS (SELECT *, (vbb * vya - vab * vyb) / det AS ca, (vaa * vyb - vab * vya) / det AS cb FROM {p}2), {p}4 AS (SELECT *, my - ca * ma - cb * mb AS cc, (y - my) - ca * (a - ma) - cb * (b - mb) AS u FROM {p}3),
    {p}5 AS (SELECT *, (vbb * (a - ma) - vab * (b - mb)) / det / n * u AS ga, (vaa * (b - mb) - vab * (a - ma)) / det / n * u AS gb FROM {p}4), {p}6 AS (SELECT *, u / n - ma * ga - mb * gb AS gc FROM {p}5),
    {p}7 AS (SELECT *, {parts["gc"][0]}, {parts["ga"][0]}, {parts["gb"][0]} FROM {p}6 WINDOW w AS (PARTITION BY {keys} ORDER BY date)),
    {p}8 AS (SELECT {keys}, first(n) AS n, 1 - sum(u * u) / nullif(first(vy) * first(n), 0) AS r2, first(cc) AS cc, first(ca) AS ca, first(cb) AS cb, sqrt(greatest({parts["gc"][1]}, 0)) AS sc, sqrt(greatest({parts["ga"][1]}, 0)) AS sa, sqrt(greatest({parts["gb"][1]}, 0)) AS sb, first(ma) AS ma, first(mb) AS mb FROM {p}7 GROUP BY {keys}),
    {p}p AS (SELECT {keys}, n, r2, 'const' AS term, cc AS coef, cc / nullif(sc, 0) AS t FROM {p}8 UNION ALL SELECT {keys}, n, r2, '{a}', ca, ca / nullif(sa, 0) FROM {p}8 UNION ALL SELECT {keys}, n, r2, '{b}', cb, cb / nullif(sb, 0) FROM {p}8)"""


_MENU = """t0 AS (SELECT date, avg(ret) FILTER (sector = 'ASIA') - avg(ret) FILTER (sector = 'EUROPE') AS tilt FROM fx_returns GROUP BY date), mn AS (SELECT book, date, net, ret AS m, tilt FROM fx_nets JOIN fx_market USING (date) JOIN t0 USING (date))"""
_PLANE = "me AS (SELECT book, date, net AS y, m AS a, tilt AS b FROM mn)"
add("menu_ols", lambda x: I.nw_ols(inference._menu(x), ["book"], "net", XS, LAGS), f"WITH {_MENU}, {_PLANE}, {nw_plane('me', 'book', LAGS, 'm', 'tilt')} SELECT book, n, {r('r2', 'r2')}, term, {r('coef', 'coef')}, {r('t', 't')} FROM np")
add("fitted_alpha_menu", lambda x: I.nw_ols(inference._menu(x), ["book"], "net", XS, LAGS).where("term = 'const'").select("book", "n", "r2", F.col("coef").alias("alpha"), "t"), f"WITH {_MENU}, {_PLANE}, {nw_plane('me', 'book', LAGS, 'm', 'tilt')} SELECT book, n, {r('r2', 'r2')}, {r('cc', 'alpha')}, {r('cc / nullif(sc, 0)', 't')} FROM n8")
_SQUARE = "sq AS (SELECT book, date, net AS y, ret AS a, ret * ret AS b FROM fx_nets JOIN fx_market USING (date))"
add(
    "timing_gate", lambda x: I.timing_gate(inference._market(x), "net", "m", 5),
    f"""WITH {_SQUARE}, {nw_plane("sq", "book", 5, "m", "x_sq")}, {nw_plane("sq", "book", 20, "m", "x_sq", "o")}, v AS (SELECT n8.*, n8.cb / nullif(n8.sb, 0) AS t, o8.cb / nullif(o8.sb, 0) AS tl FROM n8 JOIN o8 USING (book))
    SELECT book, n, {r("ca", "beta")}, {r("cb", "gamma")}, {r("t", "t")}, {r("tl", "t_long")}, {r("2.8 * abs(cb / nullif(t, 0))", "least_effect")}, CASE WHEN t > 2 AND tl > 2 THEN 'TIMES' WHEN t < -2 AND tl < -2 THEN 'ANTI' ELSE 'NONE' END AS verdict FROM v""",
)
_CP, _CV = bartlett("gc", LAGS)
LEAST, SPREAD = 30, 0.005
PERIODS = {"1995-1996": ("1995-01-01", "1996-12-31"), "1997-1998": ("1997-01-01", "1998-12-31"), "1999 on": ("1999-01-01", "9999-12-31")}
_GROSS = "gr AS (SELECT book, avg(g) AS gross FROM (SELECT book, date, sum(abs(w)) AS g FROM fx_weights GROUP BY book, date) GROUP BY book)"


def _gross(x: Fixtures) -> DataFrame:
    """(book, gross): the mean gross exposure."""
    return x.weights.groupBy("book", "date").agg(F.sum(F.abs("w")).alias("g")).groupBy("book").agg(F.avg("g").alias("gross"))


def _over_cash(x: Fixtures) -> DataFrame:
    """The menu with cash, and the market over it."""
    return inference._menu(x).join(x.macro.select("date", F.col("cash_ret").alias("cash")), "date").withColumn("m", F.col("m") - F.col("cash"))


_PARTS = ", ".join(["'all'", "CASE WHEN i <= floor(c / 2) THEN 'first' ELSE 'second' END", *[f"CASE WHEN date BETWEEN DATE '{a}' AND DATE '{z}' THEN '{name}' END" for name, (a, z) in PERIODS.items()]])
add(
    "attribution_table", lambda x: I.attribution(_over_cash(x), "net", {"M0": [], "M1": ["m"], "M2": XS}, LAGS, _gross(x), "cash", PERIODS, WEEKS, LEAST, SPREAD),
    f"""WITH {_MENU}, {_GROSS}, ex AS (SELECT book, date, net - cash_ret AS y, m - cash_ret AS a, tilt AS b, cash_ret FROM mn JOIN fx_macro USING (date) WHERE net IS NOT NULL AND m IS NOT NULL AND tilt IS NOT NULL AND cash_ret IS NOT NULL),
    pi AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) AS i, count(*) OVER (PARTITION BY book) AS c FROM ex), pu AS (SELECT book, date, y, a AS x, a, b, cash_ret, unnest([{_PARTS}]) AS part FROM pi),
    pa AS (SELECT * FROM pu WHERE part IS NOT NULL QUALIFY count(*) OVER (PARTITION BY book, part) >= {LEAST}),
    z1 AS (SELECT book, part, date, y, avg(y) OVER k AS my, count(*) OVER k AS n, (y - avg(y) OVER k) / count(*) OVER k AS gc FROM pa WHERE y IS NOT NULL WINDOW k AS (PARTITION BY book, part)), z2 AS (SELECT *, {_CP} FROM z1 WINDOW w AS (PARTITION BY book, part ORDER BY date)),
    pl AS (SELECT book, part, date, y, x FROM pa), {nw_line("pl", "book, part", LAGS, "m")}, {nw_plane("pa", "book, part", LAGS, "m", "tilt")},
    un AS (SELECT book, part, 'M0' AS model, first(n) AS n, CAST(0 AS DOUBLE) AS r2, 'const' AS term, first(my) AS coef, first(my) / nullif(sqrt(greatest({_CV}, 0)), 0) AS t FROM z2 GROUP BY book, part
    UNION ALL SELECT book, part, 'M1', n, r2, term, coef, t FROM nw UNION ALL SELECT book, part, 'M2', n, r2, term, coef, t FROM np),
    co AS (SELECT book, part, greatest(first(gross) - 1, 0) * (avg(cash_ret) * {WEEKS} + {SPREAD}) AS cost FROM pa JOIN gr USING (book) GROUP BY book, part)
    SELECT book, part, model, n, {r("r2", "r2")}, term, {r("coef", "coef")}, {r("t", "t")}, {r(f"CASE WHEN term = 'const' THEN coef * {WEEKS} END", "alpha")}, {r(f"CASE WHEN term = 'const' THEN coef * {WEEKS} - cost END", "stressed")} FROM un JOIN co USING (book, part)""",
)
_LUCKY = f"""{base._MOM}, lb AS (SELECT *, {more._LUCK!r} / sqrt(n - 1) AS bar, {more._LUCK!r} * coalesce(stddev_samp(sr) OVER (), 0) AS bar_trials FROM ms), lc AS (SELECT *, {more._Z.format(bar="bar")} AS z1, {more._Z.format(bar="bar_trials")} AS z2 FROM lb),
    ll AS (SELECT book, CASE WHEN n >= 10 THEN coalesce({more.cdf("z1")}, 0) ELSE 0 END AS sharpe_p, CASE WHEN n >= 10 THEN coalesce({more.cdf("z2")}, 0) ELSE 0 END AS trials_p FROM lc)"""
add(
    "fitted_menu", lambda x: A.fitted_menu(inference._menu(x), XS, LAGS, WEEKS, TRIALS),
    f"WITH {_LUCKY}, {_MENU}, {_PLANE}, {nw_plane('me', 'book', LAGS, 'm', 'tilt')} SELECT book, n, {r('r2', 'r2')}, {r('cc * 52', 'alpha')}, {r('cc / nullif(sc, 0)', 't')}, {r('(ca * ma + cb * mb) * 52', 'explained')}, {r('sharpe_p', 'sharpe_p')}, {r('trials_p', 'trials_p')} FROM n8 JOIN ll USING (book)",
)


def _series(x: Fixtures) -> DataFrame:
    """The first region's return over cash, the market's and another region's."""
    return x.macro.select("date", (F.col("r0_ret") - F.col("cash_ret")).alias("y"), F.col("mkt_ret").alias("a"), F.col("r1_ret").alias("b"))


def _projection(where: str) -> str:
    return f"""WITH s AS (SELECT date, r0_ret - cash_ret AS y, mkt_ret AS a, r1_ret AS b FROM fx_macro WHERE r0_ret IS NOT NULL AND cash_ret IS NOT NULL AND mkt_ret IS NOT NULL AND r1_ret IS NOT NULL),
    c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, (var_pop(b) * covar_pop(y, a) - covar_pop(a, b) * covar_pop(y, b)) / (var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2)) AS ca, (var_pop(a) * covar_pop(y, b) - covar_pop(a, b) * covar_pop(y, a)) / (var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2)) AS cb FROM s {where})
    SELECT date, {r("(y - my) - ca * (a - ma) - cb * (b - mb)", "residual")} FROM s, c"""


add("projection_residual", lambda x: A.projection_residual(_series(x), "y", ["a", "b"]), _projection(""))
add("projection_residual_pit", lambda x: A.projection_residual(_series(x), "y", ["a", "b"], F.lit("1998-06-30").cast("date")), _projection("WHERE date <= DATE '1998-06-30'"))

SIZE, SIMS = 26, 300


def _ladder(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Plain mean, then the market, then a region's tilt too; the premium is short volatility: the fall of the volatility index."""
    premium = x.macro.select("date", (-(F.col("volx") / F.lag("volx").over(base.Window.orderBy("date")) - 1)).alias("premium"))
    return A.alpha_ladder(inference._menu(x).join(premium, "date"), [[], ["m"], ["m", "tilt"]], "premium", SIZE, SIMS)


_LADDER = f"""{_MENU}, pr AS (SELECT date, -(volx / lag(volx) OVER (ORDER BY date) - 1) AS premium FROM fx_macro), l0 AS (SELECT mn.*, premium, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY book) AS c FROM mn JOIN pr USING (date) WHERE net IS NOT NULL AND m IS NOT NULL AND tilt IS NOT NULL AND premium IS NOT NULL),
    l1 AS (SELECT *, i // {SIZE} AS w FROM l0 WHERE (i // {SIZE}) * {SIZE} + {SIZE} <= c),
    l2 AS (SELECT book, w, avg(net) AS my, avg(m) AS ma, avg(tilt) AS mb, var_pop(m) AS aa, var_pop(tilt) AS bb, covar_pop(m, tilt) AS ab, covar_pop(net, m) AS ya, covar_pop(net, tilt) AS yb FROM l1 GROUP BY book, w),
    al AS (SELECT book, w, 1 AS layer, my AS alpha FROM l2 UNION ALL SELECT book, w, 2, my - ya / aa * ma FROM l2 UNION ALL SELECT book, w, 3, my - (bb * ya - ab * yb) / (aa * bb - ab * ab) * ma - (aa * yb - ab * ya) / (aa * bb - ab * ab) * mb FROM l2),
    re AS (SELECT book, layer, count(*) AS windows, avg(alpha) AS mean, avg(alpha) * sqrt(count(*)) / nullif(stddev_samp(alpha), 0) AS t, greatest(avg(CAST(alpha > 0 AS DOUBLE)), avg(CAST(alpha < 0 AS DOUBLE))) AS share FROM al GROUP BY book, layer),
    fl AS (SELECT book, layer, sim, avg(alpha * CASE WHEN {scramble("sim", "w")} // 1024 % 2 = 0 THEN 1.0 ELSE -1.0 END) AS m FROM al, range(1, {SIMS + 1}) q(sim) GROUP BY book, layer, sim),
    pv AS (SELECT book, layer, avg(CAST(abs(m) >= abs(mean) - 1e-15 AS DOUBLE)) AS p FROM fl JOIN re USING (book, layer) GROUP BY book, layer), ta AS (SELECT * FROM re JOIN pv USING (book, layer))"""
add("alpha_ladder", lambda x: _ladder(x)[0], f"WITH {_LADDER} SELECT book, CAST(layer AS INTEGER) AS layer, windows, {r('mean', 'mean')}, {r('t', 't')}, {r('share', 'share')}, {r('p', 'p')} FROM ta")
add(
    "alpha_labels", lambda x: _ladder(x)[1],
    f"""WITH {_LADDER}, rs AS (SELECT l1.book, net - my - ya / aa * (m - ma) AS u, premium FROM l1 JOIN l2 USING (book, w)), ro AS (SELECT book, CASE WHEN var_pop(u) > 1e-18 AND var_pop(premium) > 1e-18 THEN covar_pop(u, premium) / sqrt(var_pop(u) * var_pop(premium)) END AS rho FROM rs GROUP BY book),
    ha AS (SELECT book, sign(avg(alpha) FILTER (w < n // 2)) = sign(avg(alpha) FILTER (w >= n // 2)) AS halves FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM al WHERE layer = 3) GROUP BY book),
    su AS (SELECT book, max(abs(t)) FILTER (layer = 1) AS t1, bool_or(p <= 0.05 AND share >= 0.6) FILTER (layer = 1) AS s1, bool_or(p <= 0.05 AND share >= 0.6) FILTER (layer = 2) AS s2, bool_or(p <= 0.05 AND share >= 0.6) FILTER (layer = 3) AS s3 FROM ta GROUP BY book)
    SELECT book, {r("rho", "rho")}, halves, CASE WHEN coalesce(t1 < 1, true) THEN 'little' WHEN abs(rho) >= 0.5 THEN 'premium' WHEN s1 AND NOT s2 THEN 'layer 2' WHEN s2 AND NOT s3 THEN 'layer 3' WHEN s3 AND halves THEN 'alpha' ELSE 'mixed' END AS label FROM su JOIN ro USING (book) JOIN ha USING (book)""",
)

FLIPS = 10_000


def _layered(x: Fixtures) -> DataFrame:
    """Plain mean, then the market, then a region's tilt, then what is left of the first region after one projection on both; all over cash."""
    days = x.macro.select("date", F.col("cash_ret").alias("cash"), (F.col("r0_ret") - F.col("cash_ret")).alias("own"), (F.col("mkt_ret") - F.col("cash_ret")).alias("m"), (F.col("r2_ret") - F.col("r3_ret")).alias("tilt"), (1 - ratio(F.col("volx"), F.lag("volx").over(base.Window.orderBy("date")))).alias("premium"))
    rows = x.nets.select("book", "date", "net").join(days.join(A.projection_residual(days, "own", XS), "date"), "date").withColumn("net", F.col("net") - F.col("cash"))
    luck = M.deflated_sharpe(x.nets.select("book", "date", "net"), TRIALS).select("book", F.col("p").alias("sharpe_p"), F.col("p_trials").alias("trials_p"))
    return A.layered_alpha(rows, [[], ["m"], XS, [*XS, "residual"]], "premium", "cash", _gross(x), luck, SIZE, FLIPS, WEEKS, spread=SPREAD)


_LAYERED = f"""{_LUCKY}, {_GROSS}, fd AS (SELECT date, cash_ret AS cash, r0_ret - cash_ret AS own, mkt_ret - cash_ret AS m, r2_ret - r3_ret AS tilt, 1 - volx / nullif(lag(volx) OVER (ORDER BY date), 0) AS premium FROM fx_macro),
    fo AS (SELECT * FROM fd WHERE own IS NOT NULL AND m IS NOT NULL AND tilt IS NOT NULL), fc AS (SELECT avg(own) AS mo, avg(m) AS mm, avg(tilt) AS mt, var_pop(m) AS vm, var_pop(tilt) AS vt, covar_pop(m, tilt) AS vmt, covar_pop(own, m) AS vom, covar_pop(own, tilt) AS vot FROM fo),
    fr AS (SELECT date, own - mo - (vt * vom - vmt * vot) / (vm * vt - vmt * vmt) * (m - mm) - (vm * vot - vmt * vom) / (vm * vt - vmt * vmt) * (tilt - mt) AS residual FROM fo, fc),
    l0 AS (SELECT book, date, net - cash AS y, m AS a, tilt AS b, residual AS c, premium, cash, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY book) AS k FROM fx_nets JOIN fd USING (date) JOIN fr USING (date) WHERE net IS NOT NULL AND premium IS NOT NULL),
    l1 AS (SELECT *, i // {SIZE} AS w FROM l0 WHERE (i // {SIZE}) * {SIZE} + {SIZE} <= k),
    l2 AS (SELECT book, w, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(y, c) AS yc FROM l1 GROUP BY book, w),
    l3 AS (SELECT *, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS pa, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS pb, (bb * ac - ab * bc) / (aa * bb - ab * ab) AS qa, (aa * bc - ab * ac) / (aa * bb - ab * ab) AS qb FROM l2),
    l4 AS (SELECT *, my - pa * ma - pb * mb AS a3, my - pa * ma - pb * mb - (yc - qa * ya - qb * yb) / (cc - qa * ac - qb * bc) * (mc - qa * ma - qb * mb) AS a4 FROM l3),
    al AS (SELECT book, w, 1 AS layer, my AS alpha FROM l4 UNION ALL SELECT book, w, 2, my - ya / aa * ma FROM l4 UNION ALL SELECT book, w, 3, a3 FROM l4 UNION ALL SELECT book, w, 4, a4 FROM l4),
    fl AS (SELECT book, layer, sim, avg(alpha * CASE WHEN {scramble("sim", "w")} // 1024 % 2 = 0 THEN 1.0 ELSE -1.0 END) AS m FROM al, range(1, {FLIPS + 1}) q(sim) GROUP BY book, layer, sim),
    re AS (SELECT book, layer, count(*) AS windows, avg(alpha) AS mean, avg(alpha) * sqrt(count(*)) / nullif(stddev_samp(alpha), 0) AS t, avg(CAST(alpha > 0 AS DOUBLE)) AS share_up, greatest(avg(CAST(alpha > 1e-15 AS DOUBLE)), avg(CAST(alpha < -1e-15 AS DOUBLE))) AS share FROM al GROUP BY book, layer),
    pv AS (SELECT book, layer, avg(CAST(abs(m) >= abs(mean) - 1e-15 AS DOUBLE)) AS p FROM fl JOIN re USING (book, layer) GROUP BY book, layer), ta AS (SELECT *, p <= 0.05 AND share >= 0.6 AS sure FROM re JOIN pv USING (book, layer)),
    rs AS (SELECT l1.book, y - a3 - pa * a - pb * b AS u, premium, cash FROM l1 JOIN l4 USING (book, w)), ro AS (SELECT book, CASE WHEN var_pop(u) > 1e-18 AND var_pop(premium) > 1e-18 THEN covar_pop(u, premium) / sqrt(var_pop(u) * var_pop(premium)) END AS rho, avg(cash) * {WEEKS} + {SPREAD} AS cost FROM rs GROUP BY book),
    ha AS (SELECT book, avg(alpha) FILTER (w < n // 2) AS half1, avg(alpha) FILTER (w >= n // 2) AS half2 FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM al WHERE layer = 4) GROUP BY book),
    su AS (SELECT book, max(abs(t)) FILTER (layer = 1) AS t1, max(mean) FILTER (layer = 4) AS mean4, {", ".join(f"bool_or(sure) FILTER (layer = {i}) AS s{i}" for i in range(1, 5))} FROM ta GROUP BY book),
    sv AS (SELECT *, mean4 * {WEEKS} - greatest(gross - 1, 0) * cost AS stressed FROM su JOIN ro USING (book) JOIN ha USING (book) JOIN gr USING (book) JOIN ll USING (book))"""
add(
    "layered_alpha", _layered,
    f"""WITH {_LAYERED} SELECT book, CAST(layer AS INTEGER) AS layer, windows, {r("mean", "mean")}, {r("share_up", "share_up")}, {r("share", "share")}, {r("p", "p")}, {r("half1", "half1")}, {r("half2", "half2")}, {r("rho", "rho")}, {r("stressed", "stressed")}, {r("sharpe_p", "sharpe_p")}, {r("trials_p", "trials_p")},
    CASE WHEN coalesce(t1 < 1, true) THEN 'little' WHEN abs(rho) >= 0.5 THEN 'premium' {" ".join(f"WHEN s{i} AND NOT s{i + 1} THEN 'layer {i + 1}'" for i in range(1, 4))} WHEN s4 AND sign(half1) = sign(half2) AND sharpe_p >= 0.5 AND trials_p >= 0.5 AND stressed > 0 THEN 'alpha' ELSE 'mixed' END AS label FROM ta JOIN sv USING (book)""",
)

# audits of an input that knows the future: both sides are computed, and the verdict must be BLOCK
_CUT = "1999-01-01"
_MID = "avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
add(
    "leakage_audit_blocks", lambda x: V.truncation_audit(A.centred_mean(x.returns, 2), A.centred_mean(x.returns.where(f"date < date'{_CUT}'"), 2), ["date", "ticker"], "mid"),
    f"""WITH f AS (SELECT date, ticker, {_MID} AS y FROM fx_returns), c AS (SELECT date, ticker, {_MID} AS x FROM fx_returns WHERE date < DATE '{_CUT}')
    SELECT count(*) AS cells, count(*) FILTER (coalesce(abs(x - y) > 1e-9, (x IS NULL) <> (y IS NULL))) AS leaks, CASE WHEN count(*) FILTER (coalesce(abs(x - y) > 1e-9, (x IS NULL) <> (y IS NULL))) = 0 THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM c LEFT JOIN f USING (date, ticker)""",
)

# studies by asset and cell of a grid: the volatility target moves only beyond a width, and the gate has a band, so both are folds
_CELLS = ", ".join(f"({s}, {n}, {m})" for s, n, m in more._GRID)
_SIZES = sorted({n for _, n, _ in more._GRID})
_AVERAGES = sorted({m for *_, m in more._GRID})
_WIN = lambda n: f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_STUDY = f"""WITH g(sigma, lookback, sma) AS (VALUES {_CELLS}),
    a0 AS (SELECT ticker, date, ret, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, {", ".join(f"CASE WHEN count(ret) {_WIN(n)} = {n} THEN stddev_samp(ret) {_WIN(n)} * sqrt(52.0) END AS v{n}" for n in _SIZES)}, {", ".join(f"CASE WHEN count(close) {_WIN(m)} = {m} THEN close / avg(close) {_WIN(m)} - 1 END AS m{m}" for m in _AVERAGES)} FROM fx_returns WHERE close IS NOT NULL),
    a1 AS (SELECT ticker, date, i, ret, CAST(sigma AS DOUBLE) AS sigma, lookback, sma, greatest(0, least(2, CAST(sigma AS DOUBLE) / nullif(CASE lookback {" ".join(f"WHEN {n} THEN v{n}" for n in _SIZES)} END, 0))) AS target, CASE sma {" ".join(f"WHEN {m} THEN m{m}" for m in _AVERAGES)} END AS above, CASE lookback {" ".join(f"WHEN {n} THEN v{n}" for n in _SIZES)} END AS v FROM a0, g),
    a2 AS (SELECT * REPLACE (CASE WHEN v IS NULL OR v = 0 THEN NULL ELSE target END AS target) FROM a1),
    z AS (SELECT ticker, sigma, lookback, sma, i, CASE WHEN target IS NOT NULL AND abs(target - 0) > 0.1 THEN target ELSE CAST(0 AS DOUBLE) END AS held, CASE WHEN above IS NULL THEN NULL WHEN above > 0.01 THEN 1.0 WHEN above < -0.01 THEN 0.0 ELSE CAST(above > 0 AS DOUBLE) END AS gate FROM a2 WHERE i = 1
    UNION ALL SELECT o.ticker, o.sigma, o.lookback, o.sma, o.i, CASE WHEN o.target IS NOT NULL AND abs(o.target - z.held) > 0.1 THEN o.target ELSE z.held END, CASE WHEN o.above IS NULL THEN z.gate WHEN o.above > 0.01 THEN 1.0 WHEN o.above < -0.01 THEN 0.0 WHEN z.gate IS NOT NULL THEN z.gate ELSE CAST(o.above > 0 AS DOUBLE) END
        FROM z JOIN a2 o ON o.ticker = z.ticker AND o.sigma = z.sigma AND o.lookback = z.lookback AND o.sma = z.sma AND o.i = z.i + 1),
    b0 AS (SELECT a2.*, lag(CASE WHEN target IS NOT NULL AND gate IS NOT NULL THEN held END) OVER k AS h, lag(CASE WHEN target IS NOT NULL AND gate IS NOT NULL THEN gate END) OVER k AS gt FROM a2 JOIN z USING (ticker, sigma, lookback, sma, i) WINDOW k AS (PARTITION BY ticker, sigma, lookback, sma ORDER BY i)),
    b1 AS (SELECT ticker, sigma, lookback, sma, date, variant, CASE variant WHEN 'hold' THEN ret WHEN 'managed' THEN h * ret WHEN 'gate' THEN gt * ret ELSE h * gt * ret END AS net FROM b0, (VALUES ('hold'), ('managed'), ('gate'), ('both')) v(variant) WHERE h IS NOT NULL AND gt IS NOT NULL AND ret IS NOT NULL),
    b2 AS (SELECT *, CASE WHEN count(net) OVER y = 52 THEN exp(sum(ln(1 + net)) OVER y) - 1 END AS yr FROM b1 WINDOW y AS (PARTITION BY ticker, sigma, lookback, sma, variant ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
    st AS (SELECT ticker, sigma, lookback, sma, variant, count(*) AS n, exp(sum(ln(1 + net)) * 52 / count(*)) - 1 AS cagr, {sharpe("net")} AS sharpe, min(yr) AS worst FROM b2 GROUP BY ticker, sigma, lookback, sma, variant)"""
_int = lambda c: f"CAST({c} AS INTEGER) AS {c}"


def _classes(x: Fixtures) -> DataFrame:
    """Medians over the assets of a class (their region) by variant."""
    s = more._study(x).where("lookback = 13 and sma = 40 and sigma = 0.01").join(x.sectors.select("ticker", "sector"), "ticker")
    half = F.lit(0.5)
    return s.groupBy("sector", "variant").agg(F.count("*").alias("assets"), *[F.percentile(c, half).alias(c) for c in ("cagr", "sharpe", "worst")])


_STUDIED = f"{r('sigma', 'sigma')}, {_int('lookback')}, {_int('sma')}"
add_fold("xmarket_study", lambda x: more._study(x).where("lookback = 13 and sma = 40"), f"{_STUDY} SELECT ticker, {_STUDIED}, variant, n, {r('cagr', 'cagr')}, {r('sharpe', 'sharpe')}, {r('worst', 'worst')} FROM st WHERE lookback = 13 AND sma = 40")
add_fold(
    "param_map", lambda x: more._study(x).groupBy("sigma", "lookback", "sma").agg(F.percentile("worst", F.lit(0.5)).alias("median_worst"), F.avg("sharpe").alias("sharpe"), F.count("*").alias("assets")),
    f"{_STUDY} SELECT {_STUDIED}, {r('median(worst)', 'median_worst')}, {r('avg(sharpe)', 'sharpe')}, count(*) AS assets FROM st GROUP BY st.sigma, st.lookback, st.sma",
)
_gain = lambda v: F.max(F.when(F.col("variant") == v, F.col("cagr")))
_GAIN = "max(cagr) FILTER (variant = 'managed') - max(cagr) FILTER (variant = 'hold')"
add_fold(
    "vol_managed_benefit", lambda x: more._study(x).where("lookback = 13 and sma = 40 and sigma = 0.01").groupBy("ticker").agg((_gain("managed") - _gain("hold")).alias("benefit")),
    f"{_STUDY} SELECT ticker, {r(_GAIN, 'benefit')} FROM st WHERE lookback = 13 AND sma = 40 AND sigma = 0.01 GROUP BY ticker",
)
add_fold("xmarket_classes", _classes, f"{_STUDY} SELECT sector, variant, count(*) AS assets, {r('median(cagr)', 'cagr')}, {r('median(sharpe)', 'sharpe')}, {r('median(worst)', 'worst')} FROM st JOIN fx_sectors USING (ticker) WHERE lookback = 13 AND sma = 40 AND sigma = 0.01 GROUP BY sector, variant")
