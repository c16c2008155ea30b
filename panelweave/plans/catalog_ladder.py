"""Registered queries of the model ladder, with SQL twins of its linear steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import factors as N
from panelweave.operators import ladder as L
from panelweave.plans import catalog as base
from panelweave.plans import catalog_jobs as jobs
from panelweave.plans.fixtures import Fixtures, cut
from panelweave.plans.oracle import r
from panelweave.plans.registry import add

XS, LEAST, EVERY = ["mom", "vol"], 24, 12


def _linear(penalty: float) -> str:
    return f"""WITH {base._LSIG}, o AS (SELECT signalname, date, mom, vol, y FROM lf WHERE mom IS NOT NULL AND vol IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT date, count(*) AS n, sum(y) AS y, sum(mom) AS a, sum(vol) AS b, sum(mom * y) AS va, sum(vol * y) AS vb, sum(mom * mom) AS aa, sum(mom * vol) AS ab, sum(vol * vol) AS bb, row_number() OVER (ORDER BY date) - 1 AS i FROM o GROUP BY date),
    s AS (SELECT date, i, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(va) OVER w AS va, sum(vb) OVER w AS vb, sum(aa) OVER w AS aa, sum(ab) OVER w AS ab, sum(bb) OVER w AS bb FROM c WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, va - a * y / n AS ya, vb - b * y / n AS yb, aa - a * a / n + {penalty} AS paa, ab - a * b / n AS pab, bb - b * b / n + {penalty} AS pbb FROM s WHERE i >= {LEAST} AND (i - {LEAST}) % {EVERY} = 0),
    f AS (SELECT i, (pbb * ya - pab * yb) / (paa * pbb - pab * pab) AS ba, (paa * yb - pab * ya) / (paa * pbb - pab * pab) AS bb2, y / n AS my, a / n AS ma, b / n AS mb FROM t)
    SELECT signalname, o.date, {r("o.y", "y")}, {r("my + ba * (mom - ma) + bb2 * (vol - mb)", "prediction")} FROM o JOIN c USING (date) JOIN f ON f.i = {LEAST} + (c.i - {LEAST}) // {EVERY} * {EVERY} WHERE c.i >= {LEAST}"""


def _features(x: Fixtures) -> DataFrame:
    f = N.meta_features(jobs._entries(x), ["s", "vol"], "sector", jobs._SECTORS)
    return cut(f.select(F.col("start").alias("date"), "ticker", F.date_add("end", 7).alias("known"), (F.col("pnl") > 0).cast("int").alias("y"), F.array("s", "vol", *[c for c in f.columns if c.startswith("is_")]).alias("x")))


def _aucs(x: Fixtures) -> DataFrame:
    """Out-of-fold areas of three models; smaller ensembles than research would take."""
    models = {"logistic": L.logistic, "forest": lambda: L.forest(50), "boosted": lambda: L.boosted(10, 3, 0.1)}
    return N.auc(L.walk_forward(_features(x), models, 20, 4), "model")


add("expanding_ols_2", lambda x: L.expanding_linear(base._feat(x), XS, "y", LEAST, EVERY), _linear(0.0))
add("expanding_ridge_2", lambda x: L.expanding_linear(base._feat(x), XS, "y", LEAST, EVERY, 1.0), _linear(1.0))
add("expanding_boosted", lambda x: L.expanding_boosted(cut(base._feat(x)), XS, "y", LEAST, 24, trees=10))
add("oof_auc_by_model", _aucs)
