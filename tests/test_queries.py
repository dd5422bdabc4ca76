"""Every registered query of the rest of the library against its SQL, row for row."""

import duckdb
import pytest

from casegraph.plans import queries as plans

TABLES = ("events", "orders", "documents", "pages")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([str(r[k]) for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_same_as_sql(spark, sf_dir, name):
    got = plans.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got.columns, [tuple(r) for r in got.collect()]), _rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
