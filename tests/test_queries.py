"""Every query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from terragrid import fixtures, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted(([plain(v[k]) for k in order] for v in values), key=lambda r: [(x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", round(x, 3)) for x in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, db, name):
    out = queries.QUERIES[name](spark, SF)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    want_df = db.execute(queries.ORACLE[name])
    names = [d[0] for d in want_df.description]
    want = rows(names, want_df.fetchall())
    assert sorted(out.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-4) if all(isinstance(x, (int, float)) for x in a) else all(x == y or isinstance(x, float) and x == pytest.approx(float(y), rel=1e-4, abs=1e-4) for x, y in zip(a, b, strict=True))


def test_demand_model(spark):
    out = queries.demand_cross_validation(spark, SF.replace("0.001", "0.01"))
    from terragrid.plans import demand

    assert demand.mean_absolute_error(out).first()["mae"] < 0.2
    assert queries.demand_prediction(spark, SF.replace("0.001", "0.01")).where("mw is null").count() == 0
