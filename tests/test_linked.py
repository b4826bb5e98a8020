"""Structured data in pages: what is read, what counts as one item, what is enough, and the blocks made of it."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import linked
from docketry.plans.registry import QUERIES
from tests.conftest import DATA


def page(*nodes):
    return "<html>" + "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes) + "</html>"


FULL = {"@type": "Recipe", "name": "Pie", "recipeIngredient": ["flour"], "recipeInstructions": "Mix.\nBake.", "recipeYield": 4}
CASES = [
    (page(FULL), "sufficient", 1), (page({"@graph": [FULL]}, FULL | {"name": " pie "}), "sufficient", 1), (page(FULL | {"@id": "a"}, FULL | {"@id": "b"}), "multiple", 2),
    (page(FULL, FULL | {"name": "Cake"}), "multiple", 2), (page({**FULL, "recipeYield": ""}), "insufficient", 1), (page("{broken"), "insufficient", 0),
    (page({**FULL, "@type": ["Thing", "Recipe"]}), "sufficient", 1), (page("/* c */ <!-- -->" + json.dumps(FULL)), "sufficient", 1), ("<p>none</p>", "insufficient", 0),
    (page({"@type": "Page", "mainEntity": FULL}), "insufficient", 0), (page(FULL | {"@id": "a"}, FULL, FULL | {"@id": "a"}), "sufficient", 1),
    (page({"@graph": FULL}), "insufficient", 0), (page([[FULL, [FULL | {"name": "PIE"}]], 7, "x", None]), "sufficient", 1), (page({"@type": "Recipe"}, {"@type": "Recipe"}), "multiple", 2),
    (page({"@type": "Recipe", "@id": "a"}, {"@type": "Recipe", "@id": "a", "name": " "}), "insufficient", 1), (page("{broken", FULL, "", "  "), "sufficient", 1), (None, "insufficient", 0),
    (page({"@type": "recipe"}), "insufficient", 0), (page(json.dumps(FULL) + " trailing"), "insufficient", 0), (page({**FULL, "recipeYield": 0}), "sufficient", 1), (page({**FULL, "recipeYield": None}), "insufficient", 1),
]


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page int, html string")


def test_decisions(spark):
    rows = {r.page: (r.decision, r.n_items) for r in linked.decided(frame(spark, *[c[0] for c in CASES]), "page").collect()}
    for i, (html, decision, n) in enumerate(CASES):
        assert rows[i] == (decision, n), html


def test_items_stand_in_page_order_and_the_richest_is_kept(spark):
    html = page([{"@type": "Recipe", "name": "Z"}, {"@graph": [{"@type": "Recipe", "name": "A"}, FULL | {"name": "z", "recipeYield": None}]}], {"@type": "Recipe", "name": "M", "@id": "2"}, {"@type": "Recipe", "name": "m", "@id": "1"})
    r = linked.decided(frame(spark, html), "page").first()
    assert (r.decision, r.titles, r.missing) == ("multiple", ["z", "A", "M", "m"], [])
    one = linked.decided(frame(spark, page({**FULL, "recipeIngredient": []}, FULL | {"recipeYield": "first"}, FULL)), "page").select("missing", linked.blocks(F.col("item")).alias("b")).first()
    assert one.missing == [] and ("metadata", "recipeYield", "first") in [tuple(b) for b in one.b]
    lacking = linked.decided(frame(spark, page({"@type": "Recipe", "name": "x", "recipeInstructions": {}})), "page").first()
    assert lacking.missing == ["recipeIngredient", "recipeInstructions", "recipeYield"] and lacking.present


def blocks(spark, **members):
    row = linked.decided(frame(spark, page({"@type": "Recipe", **members})), "page").select(linked.blocks(F.col("item")).alias("b")).first()
    return [tuple(b) for b in row.b]


def test_blocks_of_every_shape(spark):
    section = {"@type": ["HowToSection"], "name": "Dough", "itemListElement": [{"text": "Mix."}, " Rest. ", {"itemListElement": [{"name": "Fold."}, {"@type": "HowToSection", "name": "Deep", "itemListElement": ["Chill."]}]}, {"text": ""}, 4, None]}
    got = blocks(spark, name=" Pie ", author=[[], ["", {"name": " "}, {"name": "Ann"}], "Bo"], recipeYield=["", {}, 6], prepTime="PT5M", description=" d ", recipeIngredient=["a", " ", 2, {"x": 1}],
                 recipeInstructions=[section, {"@type": "HowToStep", "text": "Bake.", "name": "n"}, {"@type": "HowToSection", "name": "Empty"}])
    assert got == [
        ("title", None, "Pie"), ("author", None, "Ann"), ("metadata", "recipeYield", "6"), ("metadata", "prepTime", "PT5M"), ("metadata", "description", "d"), ("ingredient", None, "a"), ("ingredient", None, "2"),
        ("instruction", "Dough", "Mix."), ("instruction", "Dough", "Rest."), ("instruction", "Dough", "Fold."), ("instruction", "Deep", "Chill."), ("instruction", None, "Bake."),
    ]
    assert blocks(spark, recipeInstructions="One.\r\n\r\n Two. \n", recipeIngredient="flour", author="Cy") == [("author", None, "Cy"), ("ingredient", None, "flour"), ("instruction", None, "One."), ("instruction", None, "Two.")]
    assert blocks(spark, recipeInstructions={"text": "Stir."}, recipeYield={"value": 3}) == [("instruction", None, "Stir.")]
    assert blocks(spark, recipeInstructions="  ", name=None) == [] and blocks(spark) == []


def test_captured_text(spark):
    row = linked.decided(frame(spark, page(FULL | {"recipeInstructions": [{"name": "S", "itemListElement": ["a"]}, "b"]})), "page").select(linked.captured(linked.blocks(F.col("item"))).alias("t")).first()
    assert row.t == "Pie\nrecipeYield: 4\nflour\nS: a\nb"


@pytest.mark.parametrize("image, picture", [
    ("/a.png", "https://x.org/a.png"), (["", "mailto:a@b", "b.png"], "https://x.org/p/b.png"), ({"url": "//cdn.org/c.png"}, "https://cdn.org/c.png"), ([{"contentUrl": "d.png"}, "e.png"], "https://x.org/p/d.png"),
    ([[{"url": 5, "contentUrl": " f.png "}]], "https://x.org/p/f.png"), (None, None), ("javascript:1", None), ({}, None), (7, None),
])
def test_pictures(spark, image, picture):
    rows = linked.decided(frame(spark, page(FULL | {"image": image})), "page").withColumn("base", F.lit("https://x.org/p/q"))
    assert linked.first_pictures(rows, "page", "base").first().picture == picture


@pytest.mark.parametrize("publisher, name", [("Desk", "Desk"), ({"name": " P "}, "P"), ([{"name": "a"}, "b"], "a"), ([], None), ({"name": 4}, None), (" ", None)])
def test_publisher(spark, publisher, name):
    assert linked.decided(frame(spark, page(FULL | {"publisher": publisher})), "page").select(linked.publisher(F.col("item"))).first()[0] == name


def test_coverage_counts_fetched_pages_alone(spark):
    pages = [page(FULL | {"name": "a"}, FULL | {"name": "b", "image": "x"}), page(FULL | {"recipeInstructions": [{"@type": "HowToStep", "text": "t"}], "author": " "}), page({"@type": "Recipe", "recipeInstructions": ["t"]}), page(), "", None, page(FULL)]
    rows = frame(spark, *pages).withColumn("status", F.when(F.col("page") == 6, 403).otherwise(200))
    r = linked.coverage(rows, fetched=F.col("status") == 200).first()
    assert (r.total, r.fetched, r.present, r.sufficient, r.has_name, r.has_author, r.has_image) == (7, 4, 3, 2, 2, 1, 0)
    assert (r.shape_string, r.shape_objects, r.shape_texts, r.shape_absent) == (1, 1, 1, 0)
    # in one list the last of equally rich nodes is the one that is measured
    assert linked.coverage(frame(spark, page([FULL, FULL | {"image": "x"}]))).first().has_image == 1


def test_long_pages_are_read_once(spark):
    took = []
    for n in (1, 1, 4):  # the first also compiles
        html = "<script " * (20_000 * n) + page(FULL | {"recipeIngredient": ["flour"] * (500 * n)}) + "<script type='application/ld+json'>" * (5000 * n)
        began = time.time()
        assert linked.decided(frame(spark, html), "page").first().decision == "sufficient"
        took.append(time.time() - began)
    assert took[2] < 8 * max(took[1], 0.5)


def test_no_python_worker(spark):
    plan = linked.decided(frame(spark, page(FULL)).repartition(2), "page").select("decision", linked.blocks(F.col("item")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["o56_page_decisions", "o56_sufficiency", "o57_page_blocks", "o58_captured_text", "o59_pictures"])
def test_pages_are_resolved_well_within_the_analyzer_s_turns(spark, name):
    """Spark gives up after 100; callers put some more around these."""
    spark.conf.set("spark.sql.analyzer.maxIterations", "70")
    try:
        QUERIES[name](spark, DATA)
    finally:
        spark.conf.unset("spark.sql.analyzer.maxIterations")
