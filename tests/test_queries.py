"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_is_registered_on_both_sides():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_twin(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert 15 <= entry.entry(spark).count() <= 50


def test_time_ranges_reach_the_scan(spark):
    from lorekeep.plans.queries import QUERIES

    for name in ("time_range", "time_neighbours", "chat_search"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts," in plan, name


def test_a_table_in_a_folder_is_streamed_like_one_file(spark, tmp_path):
    from lorekeep.plans.queries import QUERIES

    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.read.parquet(f"{SF}/events.parquet").limit(50).write.parquet(str(tmp_path / "events_old.parquet"))
    got = QUERIES["streamed_session_tail"](spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(QUERIES["session_tail"](spark, SF).collect()) and got
