import __spark_entry__ as entry_points
from decoylens.operators.features import SESSION_FEATURES


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["src_ip", *SESSION_FEATURES] and df.count() > 0


def test_registry():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries)
