"""Expanding linear models against numpy, trees where a line can't see, and no look ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import ladder as L
from panelweave.operators.factors import auc

MONTHS = [dt.date(2012 + i // 12, i % 12 + 1, 1) for i in range(40)]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(7)
    out = []
    for i, d in enumerate(MONTHS):
        for j in range(6):
            a, b = rng.normal(size=2)
            out.append((f"s{j}", d, float(a), float(b) if (i, j) != (5, 2) else None, float(0.4 * a - 0.2 * b + rng.normal(0, 0.5)) if (i, j) != (7, 1) else None))
    return out


@pytest.mark.parametrize("penalty", [0.0, 25.0])
def test_linear_equals_refits_by_hand(spark, panel, penalty):
    frame = spark.createDataFrame(panel, "signalname string, date date, a double, b double, y double")
    got = {(r["signalname"], r["date"]): r["prediction"] for r in L.expanding_linear(frame, ["a", "b"], "y", 12, 6, penalty).collect()}
    ok = [r for r in panel if None not in r]
    want = {}
    for i in range(12, 40):
        fit = 12 + (i - 12) // 6 * 6
        train = [r for r in ok if r[1] < MONTHS[fit]]
        x, y = np.array([r[2:4] for r in train]), np.array([r[4] for r in train])
        xc = x - x.mean(axis=0)
        b = np.linalg.solve(xc.T @ xc + penalty * np.eye(2), xc.T @ (y - y.mean()))
        want |= {(r[0], r[1]): y.mean() + (np.array(r[2:4]) - x.mean(axis=0)) @ b for r in ok if r[1] == MONTHS[i]}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_no_prediction_uses_its_own_date_or_later(spark, panel):
    frame = spark.createDataFrame(panel, "signalname string, date date, a double, b double, y double")
    cut = MONTHS[30]
    moved = frame.withColumn("y", F.when(F.col("date") >= F.lit(cut), F.col("y") * 100 + 7).otherwise(F.col("y")))
    for model in (lambda f: L.expanding_linear(f, ["a", "b"], "y", 12, 6, 1.0), lambda f: L.expanding_boosted(f, ["a", "b"], "y", 18, 12, trees=4)):
        a, b = ({(r["signalname"], r["date"]): r["prediction"] for r in model(f).where(F.col("date") <= F.lit(cut)).collect()} for f in (frame, moved))
        assert a and all(np.isclose(a[k], b[k]) for k in a)


def test_boosted_regression_bends(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{j}", d, float(x), float(np.sin(2 * x))) for d in MONTHS for j in range(12) for x in [rng.uniform(-3, 3)]]
    frame = spark.createDataFrame(rows, "signalname string, date date, a double, y double")
    error = lambda df: df.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert error(L.expanding_boosted(frame, ["a"], "y", 24, 12, trees=20, depth=3, rate=0.3)) < 0.3 * error(L.expanding_linear(frame, ["a"], "y", 24, 12))


def test_trees_see_what_a_line_does_not(spark):
    rng = np.random.default_rng(4)
    rows = [(d, f"t{j}", int(a * b > 0), MONTHS[min(i + 1, 39)], [float(a), float(b)]) for i, d in enumerate(MONTHS) for j in range(12) for a, b in [rng.normal(size=2)]]
    frame = spark.createDataFrame(rows, "date date, ticker string, y int, known date, x array<double>")
    models = {"logistic": L.logistic, "forest": lambda: L.forest(40), "boosted": lambda: L.boosted(12, 3, 0.3)}
    told = L.walk_forward(frame, models, 60, 3).cache()
    got = {r["model"]: r["auc"] for r in auc(told, "model").collect()}
    assert got["logistic"] < 0.65 and got["forest"] > 0.85 and got["boosted"] > 0.85
    assert {r["fold"] for r in told.select("fold").distinct().collect()} == {2, 3}
    late = frame.withColumn("known", F.lit(dt.date(2030, 1, 1)))
    assert L.walk_forward(late, models, 60, 3).count() == 0
