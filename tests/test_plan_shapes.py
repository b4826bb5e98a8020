"""What is costly stands once in a query's plan."""

import pytest

from docketry.plans.registry import QUERIES
from tests.conftest import DATA


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["o41_omissions", "o73_cooking_plan", "o74_plan_start_now", "o34_dangling_uses"])
def test_documents_are_read_once(spark, name):
    assert plan(spark, name).count("from_json(") == 1


@pytest.mark.parametrize("name", ["o15_edited_documents", "o15_edited_counts", "a9_document_branches", "o96_document_sweep"])
def test_documents_are_made_once(spark, name):
    assert sum("FileScan" in line and "l_partkey" in line for line in plan(spark, name).splitlines()) == 1


@pytest.mark.parametrize("name, scans", [("o63_ref_resolution", 2), ("o65_capture_support", 1), ("o66_claim_support", 2), ("o69_title_grounding", 2), ("o50_prose_lines", 1)])
def test_lines_are_split_once_for_each_reading(spark, name, scans):
    assert plan(spark, name).count("split(text") == scans


@pytest.mark.parametrize("name", ["o72_iso_durations", "o41_mapped_times"])
def test_units_are_looked_up_once(spark, name):
    assert plan(spark, name).count("lower(trim(") == 1


@pytest.mark.parametrize("name, lines", [("o11_shopping", 1), ("o11_shopping_nested", 1)])
def test_shopping_makes_the_latest_documents_alone(spark, name, lines):
    """Lines meet the latest documents before they meet parts."""
    steps = plan(spark, name).splitlines()
    part = next(k for k, line in enumerate(steps) if "p_name" in line and "Join" not in line and "FileScan" in line)
    assert any("LeftSemi" in line for line in steps[:part]) and sum("FileScan" in line and "l_partkey" in line for line in steps) == lines


def test_tables_meet_once_when_documents_come_back(spark):
    text = plan(spark, "o22_recomposition")
    assert text.count("hashpartitioning(recipe_id") == 1 and "group_ordinal#" in text and not any("Exchange" in line and "group_ordinal" in line for line in text.splitlines())


def test_a_rebuilt_projection_meets_the_stored_one_by_document(spark):
    """Rows are compared where their order lies: none is shuffled by its columns, lines are by their order's key alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "o09_projection_rebuild")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(recipe_id" not in text and "hashpartitioning(l_orderkey" not in text
    met = text.splitlines()
    met = met[next(k for k, line in enumerate(met) if "FullOuter" in line):]
    assert sum("Exchange hashpartitioning(doc_key" in line for line in met) == 4  # versions and lines, on either side


@pytest.mark.parametrize("name", ["o86_field_checks", "o91_disagreements"])
def test_truths_and_captures_are_made_in_one_go(spark, name):
    """Only the orders that are either one meet their parts."""
    steps = plan(spark, name).splitlines()
    assert sum("FileScan" in line and "l_partkey" in line for line in steps) == 1
    part = next(k for k, line in enumerate(steps) if "p_name" in line and "Join" not in line and "FileScan" in line)
    assert any("LeftSemi" in line for line in steps[:part])


def test_an_amount_is_looked_through_once(spark):
    from pyspark.sql import functions as F

    from docketry.functions.text import quantity_norm

    text = spark.range(1).select(quantity_norm(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("regexp_extract(") == 7 and text.count("lower(") == 1


@pytest.mark.parametrize("name", ["o14_document_leaves", "o68_payload_leaves", "o64_document_claims", "o66_document_claims"])
def test_whole_documents_are_opened_by_a_generator(spark, name):
    """Nodes of documents are rows, not lists that expressions copy at every level."""
    assert plan(spark, name).count("Generate variant_explode") == 9
