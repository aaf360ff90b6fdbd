from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weftline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the driver's tables."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, list):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Holds a query's rows and columns against its SQL."""

    def check(run, sql):
        df = run(spark, sf_dir)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = [tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()]
        got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)

    return check
