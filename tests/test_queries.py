import pytest
from oracle import connect, spark_rows, sql_rows

from lodestone import queries_catalog  # noqa: F401
from lodestone.queries import REGISTRY

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_equals_sql(spark, con, name):
    run, sql = REGISTRY[name]
    assert spark_rows(run(spark, SF)) == sql_rows(con, sql)


def test_queries_without_sql(spark):
    from lodestone.operators.batching import LIMITS, Search

    want, last = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id):
        size, why = last.setdefault(r.user_id, Search(*LIMITS["vlm"])).after(r.value or 0.0, r.event_id % 20 / 22.0)
        want[r.user_id, r.event_id] = size, why
    assert {(r.run, r.step): (r["size"], r.why) for r in REGISTRY["m18_batch_sizes"][0](spark, SF).collect()} == want
