"""Run names of any length."""

from docketry.plans.registry import QUERIES


def test_run_names_of_long_numbers(spark, tmp_path):
    spark.createDataFrame([(1, "buy", 7), (2, "buy", 999), (3, "see", 1000), (4, "see", 1234567)], "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.event_id, r.run) for r in QUERIES["o93_run_names"](spark, str(tmp_path)).collect()) == [(1, 7), (2, 999), (3, 1000), (4, 1234567)]
