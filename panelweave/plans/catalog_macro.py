"""The books over market series, each with its SQL twin."""

from __future__ import annotations

from panelweave.plans import books_macro as B
from panelweave.plans.oracle import mean, r, roll
from panelweave.plans.registry import add, add_fold

ALL = "ORDER BY date ROWS UNBOUNDED PRECEDING"


def sd(x: str, n: int) -> str:
    return f"({roll(f'stddev_samp({x})', x, n, '1')})"


def vol(x: str, n: int) -> str:
    return f"({sd(x, n)} * sqrt(52.0))"


def back(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (ORDER BY date)"


def held(up: str, down: str) -> str:
    return f"last_value(CASE WHEN {up} THEN 1 WHEN {down} THEN 0 END IGNORE NULLS) OVER ({ALL})"


def on_dates(x: str, when: str) -> str:
    return f"last_value(CASE WHEN {when} THEN {x} END IGNORE NULLS) OVER ({ALL})"


def legs(src: str, weights: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT date, '{t.upper()}' AS ticker, {r(f'CAST(coalesce({w}, 0) AS DOUBLE)', 'w')} FROM {src}" for t, w in weights.items())


add(
    "book_breadth_gated",
    lambda x: B.breadth_gated(x.macro),
    f"""WITH a AS (SELECT date, r0 / mkt / ({back("r0 / mkt", 13)}) - 1 AS b, {vol("mkt_ret", 13)} AS v FROM fx_macro)
    {legs("a", {"mkt": "CASE WHEN b IS NULL OR v IS NULL THEN 0 WHEN b > 0 THEN 2 WHEN v <> 0 THEN least(0.01 / v, 2) END"})}""",
)
_TV = f"""ta AS (SELECT date, mkt / ({mean("mkt", 40, "1")}) - 1 AS a, {vol("mkt_ret", 13)} AS v FROM fx_macro),
    tb AS (SELECT *, coalesce({held("a > 0.01", "a < -0.01")}, first_value(CAST(a > 0 AS INTEGER) IGNORE NULLS) OVER ({ALL})) AS gate FROM ta),
    tc AS (SELECT date, CASE WHEN gate = 1 AND v IS NOT NULL THEN least(0.01 / nullif(v, 0), 2) ELSE -1 END AS want, row_number() OVER (ORDER BY date) AS i FROM tb WHERE a IS NOT NULL)"""
_TO = "CASE WHEN greatest(abs(greatest(o.want, 0) - greatest({s}, 0)), abs(CAST(o.want < 0 AS INTEGER) - CAST({s} < 0 AS INTEGER))) > 0.05 THEN o.want ELSE {s} END"
add_fold(
    "book_trend_vol",
    lambda x: B.trend_vol(x.macro),
    f"""WITH {_TV}, z AS (SELECT date, i, {_TO.format(s="CAST(0 AS DOUBLE)")} AS s FROM tc o WHERE i = 1 UNION ALL SELECT o.date, o.i, {_TO.format(s="z.s")} FROM z JOIN tc o ON o.i = z.i + 1)
    {legs("z", {"mkt": "greatest(s, 0)", "cash": "CAST(s < 0 AS INTEGER)"})}""",
)
add(
    "book_panic_buyer",
    lambda x: B.panic_buyer(x.macro),
    f"""WITH a AS (SELECT date, volx / nullif({roll("median(volx)", "volx", 13, "1")}, 0) AS q FROM fx_macro), b AS (SELECT date, coalesce({held("q >= 1.1", "q < 1")}, 0) AS g FROM a)
    {legs("b", {"mkt": "CASE WHEN g = 1 THEN 2.0 ELSE 1.5 END"})}""",
)
add(
    "book_short_vol_carry",
    lambda x: B.short_vol_carry(x.macro),
    f"""WITH a AS (SELECT date, CAST(coalesce(volx < 1.2 AND volx > 90 * {vol("mkt_ret", 4)}, false) AS INTEGER) AS g FROM fx_macro)
    {legs("a", {"r4": "g * 0.5", "mkt": "g * 0.5", "cash": "1 - g"})}""",
)
add(
    "book_vol_core",
    lambda x: B.vol_core(x.macro),
    f"""WITH a AS (SELECT date, coalesce(CASE WHEN {sd("r0_ret", 13)} > 0 THEN 0.6 * least(0.01 / {vol("r0_ret", 13)}, 2) END, 0) AS a, coalesce(CASE WHEN {sd("mkt_ret", 13)} > 0 THEN 0.4 * least(0.01 / {vol("mkt_ret", 13)}, 2) END, 0) AS b,
        CASE WHEN volx < ({roll("median(volx)", "volx", 26, "1")}) THEN 0.2 ELSE 0 END AS c FROM fx_macro),
    b AS (SELECT *, CASE WHEN a + b + c > 1.5 THEN 1.5 / (a + b + c) ELSE 1 END AS k FROM a) {legs("b", {"r0": "a * k", "mkt": "b * k", "r4": "c * k"})}""",
)
add(
    "book_term_gate",
    lambda x: B.term_gate(x.macro),
    f"""WITH a AS (SELECT date, CAST(volx < 100 * {vol("mkt_ret", 26)} AS INTEGER) AS g FROM fx_macro), b AS (SELECT date, coalesce({back("g", 1)}, 0) AS s FROM a)
    SELECT date, ticker, {r("w", "w")}, {r("avg(w) OVER (PARTITION BY ticker)", "bench")} FROM (SELECT date, 'R4' AS ticker, CAST(s AS DOUBLE) AS w FROM b UNION ALL SELECT date, 'CASH', CAST(1 - s AS DOUBLE) FROM b)""",
)


def _dual(risky: tuple[str, ...], safe: tuple[str, ...]) -> str:
    menu = tuple(dict.fromkeys((*risky, *safe, "cash")))
    best = lambda names: "CASE " + " ".join(f"WHEN m_{c} = greatest({', '.join(f'm_{x}' for x in names)}) THEN '{c.upper()}'" for c in names) + " END"
    known = " AND ".join(f"m_{c} IS NOT NULL" for c in menu)
    top = f"greatest({', '.join(f'm_{c}' for c in risky)})"
    return f"""WITH a AS (SELECT date, month_end_confirmed AS e, {", ".join(f"round({c} / {back(c, 52)} - 1, 9) AS m_{c}" for c in menu)} FROM fx_macro),
    b AS (SELECT *, CASE WHEN NOT ({known}) THEN 'NONE' WHEN {top} > m_cash THEN {best(risky)} ELSE {best(safe)} END AS t, CASE WHEN NOT ({known}) THEN 0 WHEN {top} > m_cash THEN 1.5 ELSE 1 END AS w0 FROM a),
    c AS (SELECT date, {on_dates("t", "e")} AS ticker, {on_dates("w0", "e")} AS w FROM b) SELECT date, ticker, {r("CAST(w AS DOUBLE)", "w")} FROM c WHERE w > 0"""


add("book_dual_momentum_hold", lambda x: B.dual_momentum(x.macro), _dual(("r0", "r1", "r2"), ("r3",)))
add("book_dual_momentum_gold", lambda x: B.dual_momentum_gold(x.macro), _dual(("r0", "r1", "r4"), ("r3", "cash")))


_THIRDS = {"r4": ("r4",), "r2": ("r2",), "none": ()}
add("book_dual_momentum_swapped", lambda x: B.dual_momentum_swapped(x.macro, _THIRDS), " UNION ALL ".join(f"SELECT '{k}' AS third, * FROM ({_dual(('r0', 'r1', *v), ('r3', 'cash'))})" for k, v in _THIRDS.items()))


def _signs(n: int, look: int) -> str:
    """Columns w_r0.. from fx_macro: sign of momentum times inverse volatility, gross one."""
    inverse = {c: f"(1 / greatest({vol(f'{c}_ret', look)}, 1e-6))" for c in B.REGIONS}
    known = " AND ".join(f"{sd(f'{c}_ret', look)} IS NOT NULL AND {back(c, n)} IS NOT NULL" for c in B.REGIONS)
    return ", ".join(f"CASE WHEN {known} THEN sign({c} / {back(c, n)} - 1) * {inverse[c]} / ({' + '.join(inverse.values())}) END AS w_{c}" for c in B.REGIONS)


_SUM5 = " + ".join(f"t.w_{c} * h.{c}_ret" for c in B.REGIONS)
add(
    "book_tsmom_scaled",
    lambda x: B.trend_multi(x.macro),
    f"""WITH a AS (SELECT *, {_signs(26, 13)} FROM fx_macro), s AS (SELECT t.date, stddev_samp({_SUM5}) * sqrt(52.0) AS v FROM a t JOIN a h ON h.pos BETWEEN t.pos - 12 AND t.pos GROUP BY t.date),
    b AS (SELECT a.*, coalesce(least(0.005 / nullif(v, 0), 2), 0) AS k FROM a JOIN s USING (date)),
    c AS (SELECT date, {", ".join(f"{on_dates(f'coalesce(w_{c} * k, 0)', 'month_first AND pos > 1')} AS {c}" for c in B.REGIONS)} FROM b) {legs("c", {c: c for c in B.REGIONS})}""",
)

_NAMES = ("mkt", "cash", *B.REGIONS)
_RISKY, _SAFE = ("mkt", "r0", "r4"), ("r3", "cash")
_A = {"mkt": f"coalesce(g * CASE WHEN {sd('mkt_ret', 13)} > 0 THEN least(0.01 / {vol('mkt_ret', 13)}, 2) END, 0)", "cash": "1 - g"}
_TOP, _LOW = (f"greatest({', '.join(f'm_{c}' for c in names)})" for names in (_RISKY, _SAFE))
_KNOWN = " AND ".join(f"m_{c} IS NOT NULL" for c in (*_RISKY, *_SAFE))
_FIRST = lambda names, best: "CASE " + " ".join(f"WHEN m_{c} = {best} THEN '{c}'" for c in names) + " END"
_EARNED = lambda k: " + ".join(f"coalesce({back(f'{k}_{c}', 1)} * {c}_ret, 0)" for c in _NAMES)
_TOTAL = " + ".join(f"coalesce(inv_{k}, 0)" for k in "abc")
add(
    "book_defensive_ensemble",
    lambda x: B.defensive_ensemble(x.macro),
    f"""WITH d0 AS (SELECT *, mkt / ({mean("mkt", 40, "1")}) - 1 AS above, {_signs(52, 13)} FROM fx_macro), d1 AS (SELECT *, coalesce({held("above > 0.01", "above < -0.01")}, 0) AS g FROM d0),
    d2 AS (SELECT *, {", ".join(f"{_A.get(c, '0')} AS a_{c}" for c in _NAMES)}, {", ".join(f"coalesce({on_dates(f'coalesce(w_{c}, 0)', 'month_first')}, 0) AS b_{c}" if c in B.REGIONS else f"0 AS b_{c}" for c in _NAMES)},
        {", ".join(f"round({c} / {back(c, 52)} - 1, 9) AS m_{c}" for c in (*_RISKY, *_SAFE))} FROM d1),
    d3 AS (SELECT *, CASE WHEN NOT ({_KNOWN}) THEN 'none' WHEN {_TOP} > m_cash THEN {_FIRST(_RISKY, _TOP)} ELSE {_FIRST(_SAFE, _LOW)} END AS p0 FROM d2), d4 AS (SELECT *, {on_dates("p0", "month_first")} AS pick FROM d3),
    d5 AS (SELECT *, {", ".join(f"CAST(coalesce(pick = '{c}', false) AS INTEGER) AS c_{c}" for c in _NAMES)} FROM d4), d6 AS (SELECT *, {", ".join(f"CASE WHEN pos > 1 THEN {_EARNED(k)} END AS ret_{k}" for k in "abc")} FROM d5),
    d7 AS (SELECT *, {", ".join(f"1 / nullif(round({sd(f'ret_{k}', 13)}, 12), 0) AS inv_{k}" for k in "abc")} FROM d6),
    d8 AS (SELECT *, {", ".join(f"coalesce({on_dates(f'CASE WHEN {_TOTAL} > 0 THEN coalesce(inv_{k}, 0) / ({_TOTAL}) END', 'month_first')}, 1.0 / 3) AS sw_{k}" for k in "abc")} FROM d7),
    d9 AS (SELECT * EXCLUDE ({", ".join(f"w_{c}" for c in B.REGIONS)}), {", ".join(f"a_{c} * sw_a + b_{c} * sw_b + c_{c} * sw_c AS w_{c}" for c in _NAMES)} FROM d8), e0 AS (SELECT *, CASE WHEN pos > 1 THEN {_EARNED("w")} END AS book, {" + ".join(f"abs(w_{c})" for c in _NAMES)} AS size FROM d9),
    e1 AS (SELECT *, round({vol("book", 13)}, 12) AS v FROM e0), e2 AS (SELECT *, CASE WHEN v > 0 THEN least(0.01 / v, 2 / nullif(size, 0)) ELSE 1 END AS lev FROM e1) {legs("e2", {c: f"w_{c} * lev" for c in _NAMES})}""",
)
