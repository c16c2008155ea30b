"""Registered queries of regressions with few clusters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import by
from panelweave.operators import clusters as C
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import r
from panelweave.plans.registry import add

TERMS = ["m", "before"]


def t_two_sided(t: str, dof: str, steps: int = 4000) -> str:
    """Student's two-sided probability in SQL: Simpson's rule over the angle, in which the density is a power of the cosine."""
    def area(low: str) -> str:
        at = f"({low} + (pi() / 2 - {low}) * i / {steps})"
        weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        return f"((pi() / 2 - {low}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(greatest(cos({at}), 0), {dof} - 1))))"

    return f"{area(f'atan(abs({t}) / sqrt({dof}))')} / {area('CAST(0 AS DOUBLE)')}"


def _sums(x: Fixtures) -> DataFrame:
    """A name's returns on the market's and its own return before, in clusters of a year."""
    rows = x.factor.withColumn("before", F.lag("ret").over(by("ticker"))).withColumn("year", F.year("date"))
    return C.cluster_sums(rows, "ticker", "year", "ret", TERMS)


_SUMS = """q0 AS (SELECT ticker, year(date) AS g, ret AS y, m AS a, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS b FROM fx_factor), q1 AS (SELECT * FROM q0 WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
q2 AS (SELECT ticker, g, a - avg(a) OVER k AS a, b - avg(b) OVER k AS b, y - avg(y) OVER k AS u FROM q1 WINDOW k AS (PARTITION BY ticker)),
c AS (SELECT ticker, g, count(*) AS size, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * u) AS ha, sum(b * u) AS hb, sum(a) AS xa, sum(b) AS xb, sum(u) AS m, row_number() OVER (PARTITION BY ticker ORDER BY g) - 1 AS j FROM q2 GROUP BY ticker, g),
k AS (SELECT ticker, CAST(sum(size) AS BIGINT) AS n, count(*) AS k, sum(aa) AS ta, sum(ab) AS tb, sum(bb) AS tc, sum(aa) * sum(bb) - sum(ab) * sum(ab) AS det, sum(ha) AS th, sum(hb) AS ti, sum(xa) AS sxa, sum(xb) AS sxb, sum(m) AS sm FROM c GROUP BY ticker HAVING count(*) > 2 AND sum(size) > 3),
f AS (SELECT *, k / (k - 1.0) * (n - 1.0) / (n - 3.0) AS c FROM k),
z AS (SELECT ticker, sum(u * u) AS total FROM q2 GROUP BY ticker),
d AS (SELECT c.*, f.n, f.k, f.c, ta, tb, tc, det, draw, CASE WHEN (draw >> j) & 1 = 1 THEN -1.0 ELSE 1.0 END AS s FROM (SELECT *, unnest(range(0, {draws})) AS draw FROM f) f JOIN c USING (ticker)),
e AS (SELECT *, sum(s * ha) OVER w AS va, sum(s * hb) OVER w AS vb, sum(s * m) OVER w / n AS level FROM d WINDOW w AS (PARTITION BY ticker, draw)),
o AS (SELECT *, (tc * va - tb * vb) / det AS ba, (ta * vb - tb * va) / det AS bb2 FROM e),
p AS (SELECT *, s * ha - level * xa - aa * ba - ab * bb2 AS sa, s * hb - level * xb - ab * ba - bb * bb2 AS sb FROM o),
v AS (SELECT ticker, draw, first(n) AS n, first(k) AS k, first(c) AS c, first(va) AS va, first(vb) AS vb, first(ba) AS ba, first(bb2) AS bb, first(ta) AS ta, first(tb) AS tb, first(tc) AS tc, first(det) AS det, sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb FROM p GROUP BY ticker, draw)"""
_WALD = f"""WITH {_SUMS.format(draws="CAST(pow(2, k) AS BIGINT)")}, s AS (SELECT *, (va * va * mbb - 2 * va * vb * mab + vb * vb * maa) / (maa * mbb - mab * mab) / c AS w FROM v),
a AS (SELECT s.*, first_value(w) OVER (PARTITION BY ticker ORDER BY draw) AS w0, (ba * va + bb * vb) / total AS r2 FROM s JOIN z USING (ticker))
SELECT ticker, first(n) AS n, CAST(first(k) AS INTEGER) AS clusters, {r("max(r2) FILTER (draw = 0)", "r2")}, {r("first(w0)", "wald")}, {r("pow(1 + first(w0) / (first(k) - 1), -(first(k) - 1) / 2.0)", "p")}, count(*) AS draws, {r("avg(CAST(w >= w0 * (1 - 1e-9) AS DOUBLE))", "p_wild")} FROM a GROUP BY ticker"""
#: Without a cluster the means move, so the sums are centred anew.
_SLOPES = f"""WITH {_SUMS.format(draws="1")},
l0 AS (SELECT c.ticker, n - size AS r, ta - aa - pow(sxa - xa, 2) / (n - size) AS aa, tb - ab - (sxa - xa) * (sxb - xb) / (n - size) AS ab, tc - bb - pow(sxb - xb, 2) / (n - size) AS bb, th - ha - (sxa - xa) * (sm - m) / (n - size) AS ha, ti - hb - (sxb - xb) * (sm - m) / (n - size) AS hb FROM c JOIN f USING (ticker)),
l AS (SELECT ticker, (bb * ha - ab * hb) / (aa * bb - ab * ab) AS wa, (aa * hb - ab * ha) / (aa * bb - ab * ab) AS wb FROM l0),
y AS (SELECT ticker, stddev_samp(a) AS da, stddev_samp(b) AS db FROM q2 GROUP BY ticker),
i AS (SELECT v.*, c * (tc * tc * maa - 2 * tc * tb * mab + tb * tb * mbb) / (det * det) AS qa, c * (tb * tb * maa - 2 * tb * ta * mab + ta * ta * mbb) / (det * det) AS qb FROM v),
u AS (SELECT ticker, 'm' AS term, k, ba * da AS slope, ba / sqrt(qa) AS t, (SELECT min(wa) FROM l WHERE l.ticker = i.ticker) * da AS least, (SELECT max(wa) FROM l WHERE l.ticker = i.ticker) * da AS most FROM i JOIN y USING (ticker)
UNION ALL SELECT ticker, 'before', k, bb * db, bb / sqrt(qb), (SELECT min(wb) FROM l WHERE l.ticker = i.ticker) * db, (SELECT max(wb) FROM l WHERE l.ticker = i.ticker) * db FROM i JOIN y USING (ticker))
SELECT ticker, term, CAST(k AS INTEGER) AS clusters, {r("slope", "slope")}, {r("t", "t")}, {r(t_two_sided("t", "(k - 1)"), "p")}, {r("least", "least")}, {r("most", "most")}, sign(least) = sign(slope) AND sign(most) = sign(slope) AS stable FROM u"""

add("cluster_wald", lambda x: C.wald(_sums(x), "ticker", len(TERMS)), _WALD)
add("cluster_slopes", lambda x: C.slopes(_sums(x), "ticker", TERMS), _SLOPES)
