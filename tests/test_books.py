"""Books and studies that SQL cannot say, against plain loops over small panels."""

import datetime as dt
from random import Random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.columns import norm_cdf
from panelweave.operators import factors, metrics
from panelweave.operators import rolling as W
from panelweave.plans import books_panel as B
from panelweave.plans.books import gap_events

DAY0 = dt.date(2001, 1, 1)


def panel(spark, seed=2, names=6, days=80):
    r, rows, level = Random(seed), [], {}
    for d in range(days):
        for t in range(names):
            priced = not (t == 1 and 20 <= d < 24)
            ret = r.gauss(0, 0.06) if d and priced else None
            level[t] = level.get(t, 100.0) * (1 + (ret or 0.0))
            rows.append((DAY0 + dt.timedelta(7 * d), f"T{t}", ret, level[t] if priced else None, not (t == 2 and d % 30 > 20)))
    return rows, spark.createDataFrame(rows, "date date, ticker string, ret double, close double, member boolean")


def by_date(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


def test_equal_weights_with_a_band(spark):
    rows, frame = panel(spark)
    got = {(r.date, r.ticker): r.w for r in B.equal_weight_band(frame, 0.2).collect()}
    w, seen = {}, 0
    for d, day in sorted(by_date(rows).items()):
        ret, names = {t: r or 0.0 for _, t, r, *_ in day}, [t for _, t, _, c, m in day if m and c is not None]
        w = {t: x * (1 + ret[t]) for t, x in w.items() if t in names}
        for t in names:
            if t not in w or abs(w[t] * len(names) - 1) > 0.2:
                w[t] = 1 / len(names)
        total = sum(w.values())
        w = {t: x / total for t, x in w.items()}
        assert all(abs(got[d, t] - x) < 1e-12 for t, x in w.items())
        seen += len(w)
    assert seen == len(got)


def test_levered_gate(spark):
    rows, frame = panel(spark, 5)
    r = Random(9)
    index = {d: None if r.random() < 0.1 else r.uniform(0.5, 1.3) for d in sorted({x[0] for x in rows})}
    got = {(x.date, x.ticker): x.w for x in B.levered_gate(frame, spark.createDataFrame(list(index.items()), "date date, v double"), 1.1).collect()}
    w, before, seen = {}, set(), 0
    first = index[min(index)]
    level, below = (1.0 if first is not None and first >= 1.1 else 2.0), 0
    for d, day in sorted(by_date(rows).items()):
        ret, names = {t: x or 0.0 for _, t, x, *_ in day}, [t for _, t, _, c, m in day if m and c is not None]
        grown = 1 + sum(x * ret[t] for t, x in w.items())
        w = {t: x * (1 + ret[t]) / grown for t, x in w.items()}
        v, new = index[d], level
        if v is not None:
            if v >= 1.1:
                new, below = 1.0, 0
            elif level == 1.0:
                below += 1
                new = 2.0 if below >= 3 else 1.0
        target = new / len(names)
        if new != level:
            w = dict.fromkeys(names, target)
        else:
            w = {t: target if t not in before or t not in w or abs(w[t] / target - 1) > 0.2 else w[t] for t in names}
        level, before = new, set(names)
        gross = sum(w.values())
        w = {t: x * min(1, 2 / gross) for t, x in w.items()}
        assert all(abs(got[d, t] - x) < 1e-9 for t, x in w.items()), d
        seen += len(w)
    assert seen == len(got)


def test_slots_with_only_the_deepest_candidates(spark):
    r, cells = Random(1), []
    for d in range(60):
        for t in range(30):
            depth = r.uniform(-3, -1) if r.random() < 0.4 else None
            cells.append((DAY0 + dt.timedelta(d), f"T{t:02d}", depth, r.random() < 0.1, r.random() < 0.97))
    frame = spark.createDataFrame(cells, "date date, ticker string, depth double, leave boolean, priced boolean")
    got = sorted((x.slots, x.hold, x.date, x.ticker, x.age) for x in factors.slot_grid(frame, [2, 5], [3, 9]).collect())
    expected = []
    for slots in (2, 5):
        for hold in (3, 9):
            age = {}
            for d, day in sorted(by_date(cells).items()):
                stay = {t for _, t, _, leave, priced in day if priced and not leave}
                age = {t: a + 1 for t, a in age.items() if t in stay and a < hold}
                for depth, t in sorted((x[2], x[1]) for x in day if x[2] is not None and x[1] in stay):
                    if len(age) < slots and t not in age:
                        age[t] = 1
                expected += [(slots, hold, d, t, a) for t, a in age.items()]
    assert got == sorted(expected)


def test_asset_study_follows_a_loop(spark):
    rows, frame = panel(spark, 7, 3, 150)
    rows = [x for x in rows if x[3] is not None]
    got = {(x.ticker, x.variant): x for x in metrics.asset_study(frame.where("close is not null").select("ticker", "date", "ret", "close"), [(0.1, 8, 20)]).collect()}
    for t in ("T0", "T2"):
        own = sorted(x for x in rows if x[1] == t)
        ret, close = np.array([np.nan if x[2] is None else x[2] for x in own]), np.array([x[3] for x in own])
        held, gate, nets, before = 0.0, None, {k: [] for k in ("hold", "managed", "gate", "both")}, None
        for i in range(len(own)):
            if before is not None and not np.isnan(ret[i]):
                h, g = before
                for k, w in (("hold", 1.0), ("managed", h), ("gate", g), ("both", h * g)):
                    nets[k].append(w * ret[i])
            sd = ret[i - 7 : i + 1].std(ddof=1) * 52**0.5 if i >= 7 else np.nan
            above = close[i] / close[i - 19 : i + 1].mean() - 1 if i >= 19 else None
            if not np.isnan(sd) and abs(min(0.1 / sd, 2) - held) > 0.1:
                held = min(0.1 / sd, 2)
            if above is not None:
                gate = 1.0 if above > 0.01 else 0.0 if above < -0.01 else gate if gate is not None else float(above > 0)
            before = (held, gate) if not np.isnan(sd) and gate is not None else None
        for k, x in nets.items():
            assert got[t, k].n == len(x) and abs(got[t, k].cagr - (np.exp(np.log1p(x).sum() * 52 / len(x)) - 1)) < 1e-9, (t, k)
            worst = min(np.exp(np.log1p(x[i - 51 : i + 1]).sum()) - 1 for i in range(51, len(x)))
            assert abs(got[t, k].worst - worst) < 1e-9


def test_normal_distribution(spark):
    from statistics import NormalDist

    zs = [-9.0, -3.3, -1.0, 0.0, 0.4, 1.96, 5.0, 30.0]
    got = [r.p for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").select("i", norm_cdf(F.col("z")).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, [NormalDist().cdf(z) for z in zs], atol=1e-9) and metrics.luck(1) == 0 and 1.8 < metrics.luck(20) < 1.95


def test_composite_is_its_parts_under_the_gate(spark):
    rows, frame = panel(spark, 3)
    frame = frame.withColumn("volume", F.lit(100.0) + F.pmod(F.hash("ticker", "date"), F.lit(50)))
    r = Random(2)
    dates = sorted({x[0] for x in rows})
    index = [(d, r.uniform(0.6, 1.4)) for d in dates]
    gauge = spark.createDataFrame(index, "date date, v double")
    got = {(x.date, x.ticker): x.w for x in B.composite(frame, gauge, drift=0.9, cap=0.2, gross=1.6).collect()}
    held = {}
    for x in B.equal_weight_band(frame).collect():
        held[x.date, x.ticker] = x.w
    active = {}
    for x in gap_events(frame).where("active = 1").collect():
        active.setdefault(x.date, []).append(x.ticker)
    wait, want = 0.0, {}
    for d, v in index:
        wait = 3.0 if v >= 1.2 or (wait > 0 and v >= 1.0) else max(wait - 1, 0.0)
        day = {t: w for (e, t), w in held.items() if e == d}
        used = 0.0
        for t in active.get(d, []):
            own = min(0.2, 1 / len(active[d])) * 0.9
            day[t] = day.get(t, 0.0) + own
            used += own
        day["MKT"] = max(0.9 - used, 0.0) + 0.3
        day = {t: w * (0.5 if wait > 0 else 1.0) for t, w in day.items()}
        size = sum(map(abs, day.values()))
        want |= {(d, t): w * min(1.0, 1.6 / size) for t, w in day.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len({round(sum(w for (e, _), w in want.items() if e == d), 9) for d in dates}) > 1


def test_deep_dips_take_slots_a_date_later(spark):
    rows, frame = panel(spark, 7)
    frame = frame.withColumn("f", F.avg("ret").over(Window.partitionBy("date"))).withColumn("m", F.col("f"))
    got = {}
    for x in B.deep_dip(frame, slots=2, hold=3, n=4, entry=-0.5).collect():
        got.setdefault(x.date, {})[x.ticker] = x.w
    s = W.s_score(W.residual(frame, 4), 4).collect()
    close = {(x[0], x[1]): x[3] for x in rows}
    age, before, some = {}, set(), 0
    for d in sorted({x[0] for x in rows}):
        day = {x.ticker: x for x in s if x.date == d}
        names = {t for t in before if close.get((d, t)) is not None}
        want = dict.fromkeys(names, 0.75) | {"MKT": 1.5 - 0.75 * len(names)}
        assert got[d].keys() == want.keys() and all(abs(got[d][t] - w) < 1e-12 for t, w in want.items())
        some += len(names)
        stay = {t for t, x in day.items() if x.close is not None and not (x.s is not None and x.s >= 0)}
        age = {t: a + 1 for t, a in age.items() if t in stay and a < 3}
        for _, t in sorted((x.s, t) for t, x in day.items() if x.member and x.s is not None and x.s <= -0.5 and t in stay):
            if len(age) < 2:
                age.setdefault(t, 1)
        before = set(age)
    assert some > 3
