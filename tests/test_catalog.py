"""Registered queries against their SQL twins in DuckDB, on the smallest tables: all of them, several at a time."""

from concurrent.futures import Future, ThreadPoolExecutor

import duckdb
import pytest

from panelweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def answers(spark, request):
    """Each wanted query's columns and rows, in the making: small jobs leave most cores idle, so they run side by side."""
    wanted = [item.callspec.params["name"] for item in request.session.items if item.originalname == "test_matches_sql"]

    def answer(name: str) -> tuple[list[str], list]:
        frame = catalog.queries()[name](spark, SF)
        columns = sorted(frame.columns)
        return columns, frame.select(*columns).collect()

    with ThreadPoolExecutor(6) as pool:
        made: dict[str, Future] = {name: pool.submit(answer, name) for name in wanted}
        yield made
        for f in made.values():
            f.cancel()


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(answers, duck, name):
    columns, rows = answers[name].result()
    mine = sorted([[plain(v) for v in row] for row in rows], key=str)
    answer = duck.sql(catalog.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    order = [answer.columns.index(c) for c in columns]
    assert mine == sorted([[plain(row[i]) for i in order] for row in answer.fetchall()], key=str)


def test_every_twin_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 120


def test_the_entry_can_be_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 250 and len(e.oracle_sql()) > 200"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=False).returncode == 0
