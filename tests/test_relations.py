"""Documents as relations and back: lossless at every depth, for lists that are absent, empty and long."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import trees
from docketry.operators import relations as rl
from docketry.operators import versions as ops
from docketry.plans.bindings import documents
from tests.conftest import DATA
from tests.test_recipes import RECIPE, line, use, value


def cases() -> list[dict]:
    bare = {k: RECIPE[k] for k in ("id", "schemaVersion", "provenance")} | {"title": {"state": "not_in_source"}, "yields": [], "ingredientGroups": [], "instructionSections": []}
    rich = copy.deepcopy(RECIPE)
    rich["authors"], rich["times"], rich["preparedComponents"] = ["b", "a", "b"], [], []
    rich["sourceClassifications"] = [{"kind": "diet", "sourceText": "vegan", "sourceRefs": []}, {"kind": "cuisine", "sourceText": "", "normalizedValue": "x", "sourceRefs": [{"blockId": "p"}, {"payloadPointer": "/q"}]}]
    rich["media"] = {"heroImage": {"storageIdentity": "s", "origin": "other"}}
    rich["nutritionStatements"] = [{"id": f"n{k}", "basis": {"kind": "per_yield"}, "facts": [{"nutrient": "energy", "valueExpression": value("9", number=9.5), "sourceRefs": []}] * k, "sourceRefs": []} for k in range(3)]
    rich["provenance"] = rich["provenance"] | {"normalizationPromptVersions": ["1", "2"], "normalizationModel": "m"}
    rich["ingredientGroups"][0]["ingredients"] = [line(f"i{k}", f"n{k}", optional=k % 2 == 0, qualifiers=["fine", "dry"][: k % 3]) for k in range(25)]
    rich["ingredientGroups"].append({"id": "empty", "sourceRefs": [], "ingredients": []})
    rich["instructionSections"][0]["steps"][1]["ingredientUses"] = [use(f"i{k}", sourceText="x") for k in range(12)]
    media = copy.deepcopy(RECIPE)
    media["media"] = {}
    del media["equipment"]
    return [bare, RECIPE, rich, media]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, i % 2, json.dumps(d)) for i, d in enumerate(cases())]
    return spark.createDataFrame(rows, "doc int, version int, json string").repartition(3)


def same(got, frame):
    got = got.toDF("doc", "version", "doc_back")
    want = {r.doc: r.j for r in frame.select("doc", trees.canonical(F.col("json")).alias("j")).collect()}
    back = {r.doc: r.j for r in got.select("doc", trees.canonical(F.to_json("doc_back")).alias("j")).collect()}
    assert back == want


def test_round_trip_through_one_pass(docs):
    same(rl.assembled(rl.shredded(docs, ["doc", "version"]), ["doc", "version"]), docs)


def test_round_trip_through_stored_tables(spark, docs, tmp_path):
    rl.shredded(docs, ["doc", "version"]).write.partitionBy("relation").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    tables = {one.name: rl.table(stored, one.name, ["doc", "version"]) for one in rl.relations()}
    assert tables["ingredientGroups_ingredients"].where("doc = 2").count() == 27
    assert [r.o for r in tables["instructionSections_steps_ingredientUses"].where("doc = 2 AND o[0] = 0 AND o[1] = 1").orderBy("o").collect()][:3] == [[0, 1, 0], [0, 1, 1], [0, 1, 2]]
    assert tables["authors"].select("doc", "o", "value").orderBy("o").collect() == [(2, [0], "b"), (2, [1], "a"), (2, [2], "b")]
    with pytest.raises(ValueError, match="rename the key"):
        rl.table(stored, "yields", ["id"])
    same(rl.recomposed(tables, ["doc", "version"]), docs)


def test_whole_table_round_trip(spark):
    docs = documents(spark, DATA)
    key = ["recipe_id", "version"]
    again = rl.assembled(rl.shredded(docs, key), key).select(*key, trees.canonical(F.to_json("doc")).alias("a"))
    both = docs.select(*key, trees.canonical(F.col("json")).alias("b")).join(again, key, "full_outer")
    assert both.where("NOT a <=> b").count() == 0 and both.count() == docs.count()


def test_relations_are_those_of_the_contract():
    names = [one.name for one in rl.relations()]
    assert len(names) == len(set(names)) == 45 and {"title_sourceRefs", "nutritionStatements_facts_sourceRefs", "instructionSections_steps_producesComponents"} <= set(names)
    assert [one.name for one in rl.relations("Snapshot")] == ["documents", "blocks", "captureProvenance_capturePromptVersions"]


def test_shredding_takes_one_pass_and_one_shuffle_back(spark, docs):
    plan = rl.assembled(rl.shredded(docs, ["doc", "version"]), ["doc", "version"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_rows_compared_inside_their_document(spark):
    """As differences() of the rows: duplicates, nulls, NaN, and documents that one side alone has."""
    rows = "k int, n int, x double"
    left = [(1, 1, 0.5), (1, 1, 0.5), (1, 2, None), (2, None, float("nan")), (3, 1, 0.0), (4, 7, 1.0), (None, 1, 1.0), (6, 1, 1.0)]
    right = [(1, 2, None), (1, 1, 0.5), (2, None, float("nan")), (3, 1, -0.0), (5, 7, 1.0), (None, 1, 1.0), (6, 1, 2.0)]
    a, b = (spark.createDataFrame(x, rows) for x in (left, right))
    lists = lambda f, name: f.groupBy("k").agg(F.collect_list(F.struct("n", "x")).alias(name))
    found = ops.gathered_differences(lists(a, "a").join(lists(b, "b"), "k", "full_outer"), ["k"], "a", "b")
    assert sorted(map(str, found.collect())) == sorted(map(str, ops.differences(a, b).collect()))
    assert tuple(ops.agreement_of(found).first()) == (3, 2)


def test_a_changed_projection_is_found(spark):
    """One stored row that differs, one that is gone and one that is there twice."""
    from docketry.plans.bindings import ingredients, nested
    from docketry.plans.version_queries import _rebuilt

    stored = ingredients(spark, DATA)
    first, second, third = stored.orderBy("recipe_id", "version", "group_ordinal", "ordinal").limit(3).collect()
    at = lambda r: (F.col("doc_key") == r.doc_key) & (F.col("group_ordinal") == r.group_ordinal) & (F.col("ordinal") == r.ordinal)
    changed = stored.withColumn("name", F.when(at(first), "another").otherwise(F.col("name"))).where(~at(second))
    changed = changed.union(stored.where(at(third)))
    assert tuple(ops.agreement_of(_rebuilt(changed, nested(spark, DATA))).first()) == (2, 2)


def test_projection_inside_a_row_gives_the_extracted_rows(spark):
    from docketry.plans.bindings import nested

    docs = nested(spark, DATA)
    rows = docs.select("recipe_id", "version", F.explode(ops.projection(F.col("doc"))).alias("p")).select("recipe_id", "version", "p.group_ordinal", "p.ordinal", "p.i.*")
    want = ops.extracted(docs)
    assert rows.columns == want.columns and want.count() > 0
    assert tuple(ops.agreement(rows, want).first()) == (0, 0)
