import hashlib

import pytest

from hexloom.plans import catalog, engine  # noqa: F401 - registers its queries
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    assert_same(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


def test_sha512(spark, sf_dir):
    rows = catalog.fn_sha512(spark, sf_dir).limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.h == hashlib.sha512(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["component", "edges"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # so that filters are listed in full
    try:
        plan = catalog.q8_dependents_of(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "PushedFilters: [" in plan and "l_comment" not in plan and "EqualTo(l_returnflag,N)" in plan
