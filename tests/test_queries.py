"""Every query with an SQL twin against DuckDB, as bags of rows."""

from collections import Counter

import pytest

from evidara.plans import access, accounts, adjudication, records, registry, toolkit  # noqa: F401


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert sum(b.values()) > 0
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert {r["route"] for r in __spark_entry__.queries()["gate_route"](spark, sf_dir).collect()} <= {"extract", "ask_customer", "triage"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
