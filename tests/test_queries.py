import pytest

from lodestone.plans.catalogue import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_topk_plan_has_no_full_sort(spark, sf_dir):
    plan = QUERIES["q02_dense_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PythonRunner" not in plan


def test_pull_goes_on_after_a_full_batch(spark, tmp_path):
    events = spark.range(250_000).selectExpr("id AS event_id", "id % 7 AS user_id", "'click' AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["q08_incremental_pull"](spark, str(tmp_path))
    assert [r.seq for r in got.select("seq").collect()] == list(range(250_000))


@pytest.mark.parametrize("name, trainer", [("q27_kmeans", "centroids"), ("q27b_kmeans_tree", "centroid_tree"), ("q27c_metric", "fit_metric")])
def test_training_takes_all_its_steps(spark, sf_dir, monkeypatch, name, trainer):
    import inspect

    from lodestone.operators import training

    whole, seen = getattr(training, trainer), []
    form = inspect.signature(whole)

    def traced(*args, **kwargs):
        given = form.bind(*args, **kwargs)
        given.apply_defaults()
        seen.append(given.arguments["steps"])
        return whole(*args, **kwargs)

    monkeypatch.setattr(training, trainer, traced)
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert seen == [form.parameters["steps"].default]
