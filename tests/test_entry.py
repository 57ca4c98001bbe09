import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    n = {r["bucket"]: r["count"] for r in e.entry(spark).groupBy("bucket").count().collect()}
    assert n == {"depth1": 338, "depth2": 1388, "depth3+": 92}
