"""Nested documents: walks, leaves, references, claims, pointers and the contract, against plain recursion."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import trees
from docketry.operators import contract as ct
from docketry.operators import versions as vs
from docketry.plans.bindings import documents
from docketry.plans.registry import QUERIES
from tests.conftest import DATA

KEYS = ["a", "b/c", "~", "0", "sourceRefs", "sourceText", "e e", "é", "{x}", "*"]


def made(rng: random.Random, depth: int):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(KEYS): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if depth and kind < 0.7:
        return {"sourceRefs": [{"blockId": "b1"}, {"payloadPointer": "/p"}][: rng.randint(0, 2)], "sourceText": rng.choice(["x", " ", "two words"]), "n": made(rng, depth - 1)}
    return rng.choice([None, True, False, 0, -3, 1.5, "", "text", "4", 4, 12345678.25, 1e30, 1e-9])


def printed(x) -> tuple[str, str]:
    if x is None:
        return "null", "null"
    if isinstance(x, bool):
        return "boolean", str(x).lower()
    if isinstance(x, str):
        return "string", x
    return "number", {1e30: "1e+30", 1e-9: "1e-9"}.get(x, repr(int(x)) if x == int(x) else repr(x))


def walked(x, path=""):
    if isinstance(x, dict):
        return [r for k, v in x.items() for r in walked(v, f"{path}/{k}")]
    if isinstance(x, list):
        return [r for k, v in enumerate(x) for r in walked(v, f"{path}/{k}")]
    return [(path, *printed(x))]


def text_or_none(x):
    return x if isinstance(x, str) else None


def refs_of(x, path=""):
    out = []
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else []:
        if k == "sourceRefs" and isinstance(v, list):
            out += [(path, i, text_or_none(r.get("blockId")) if isinstance(r, dict) else None, text_or_none(r.get("payloadPointer")) if isinstance(r, dict) else None) for i, r in enumerate(v)]
        else:
            out += refs_of(v, f"{path}/{k}")
    return out


def claims_of(x, path="", refs=(), owner=""):
    if isinstance(x, list):
        return [c for k, v in enumerate(x) for c in claims_of(v, f"{path}/{k}", refs, owner)]
    if not isinstance(x, dict):
        return []
    if isinstance(x.get("sourceRefs"), list) and x["sourceRefs"]:
        refs, owner = x["sourceRefs"], path
    text, out = x.get("sourceText"), []
    if isinstance(text, str) and text.strip():
        named = lambda name: [r[name] for r in refs if isinstance(r, dict) and isinstance(r.get(name), str)]
        out.append((path, text, owner, named("blockId"), named("payloadPointer")))
    return out + [c for k, v in x.items() if k not in ("sourceRefs", "sourceText") for c in claims_of(v, f"{path}/{k}", refs, owner)]


@pytest.fixture(scope="module")
def trees_made(spark):
    rng = random.Random(8)
    docs = [made(rng, rng.randint(0, 6)) for _ in range(150)] + [{"x": {}}, [], {}]
    deep = {"sourceText": "leaf"}
    for k in range(70):
        deep = {"d": deep} if k % 2 else [deep]
    docs.append(deep)
    return docs, spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(docs)], "id int, doc string")


@pytest.mark.parametrize("columns, plain", [(trees.leaves, walked), (trees.source_refs, refs_of), (trees.claims, claims_of)])
def test_walks_against_plain_recursion(trees_made, columns, plain):
    docs, frame = trees_made
    for r in frame.select("id", columns(F.col("doc")).alias("x")).collect():
        assert sorted(map(repr, map(tuple, r.x))) == sorted(map(repr, plain(docs[r.id]))), docs[r.id]


def test_what_is_not_json_has_no_nodes(spark):
    bad = [None, "", "{bad", '{"a":1} x', '"id":1', "1]", "1,2", '{"a":1,"a":2}', '{"a":01}']
    rows = spark.createDataFrame([(b,) for b in bad], "doc string")
    assert all(not r.x for r in rows.select(trees.leaves(F.col("doc")).alias("x")).collect())
    good = spark.createDataFrame([(b,) for b in ["null", " 7 ", '"s"', "[]"]], "doc string")
    assert [[tuple(x) for x in r.x] for r in good.select(trees.leaves(F.col("doc")).alias("x")).collect()] == [[("", "null", "null")], [("", "number", "7")], [("", "string", "s")], []]


def test_positions_sort_into_document_order(spark):
    row = spark.createDataFrame([('{"b":[{"z":1},2],"a":{"c":3}}',)], "doc string")
    found = row.select(F.array_sort(F.transform(trees.nodes(F.col("doc")), lambda n: F.struct(n["pos"], n["path"]))).alias("x")).first().x
    assert [x.path for x in found] == ["", "/a", "/a/c", "/b", "/b/0", "/b/0/z", "/b/1"]


def test_pointers(spark):
    doc = {"a/b": [1, {"~c": "x", "": 5}], "n": None, "l": list(range(12))}
    frame = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    want = {"": doc, "/a~1b/1/~0c": "x", "/a~1b/1/": 5, "/n": None, "/l/11": 11, "/l": doc["l"]}
    for pointer, value in want.items():
        assert json.loads(frame.select(F.to_json(trees.resolved(trees.parsed(F.col("doc")), F.lit(pointer)))).first()[0]) == value
    for pointer in ("/l/12", "/l/01", "/l/-1", "/l/x", "/zz", "/n/a", "a", "/a~1b/0/0", "/l/"):
        assert frame.select(trees.resolved(trees.parsed(F.col("doc")), F.lit(pointer)).isNull()).first()[0], pointer


def test_value_leaves_leave_nulls_out(spark):
    frame = spark.createDataFrame([('{"a":[1,null,{"b":"x","c":true}],"d":2.5}',)], "doc string")
    assert sorted(frame.select(trees.value_leaves(trees.parsed(F.col("doc")))).first()[0]) == ["1", "2.5", "true", "x"]


def test_references_as_rows_are_those_of_the_list(trees_made):
    """Also where documents are deeper than the levels that are opened one by one, or a list of references is cut in two."""
    docs, frame = trees_made
    for levels in (0, 1, 2, 3, 9):
        got = sorted(map(repr, ((r.id, r.owner, r.ord, r.block, r.pointer) for r in trees.source_ref_rows(frame, ["id"], "doc", levels).collect())))
        assert got == sorted(repr((i, *r)) for i, d in enumerate(docs) for r in refs_of(d)), levels


def test_leaves_and_claims_as_rows_are_those_of_the_lists(spark, trees_made):
    """Also of documents that are deeper than the levels that a generator opens, and of what is none."""
    docs, frame = trees_made
    frame = frame.union(spark.createDataFrame([(1000, "{"), (1001, None), (1002, '{"a":"}]{[","b":["\\\\\\"{"]}')], frame.schema)).withColumn("v", trees.parsed(F.col("doc")))
    docs = [*docs, {"a": "}]{[", "b": ['\\"{']}]
    ids = [*range(len(docs) - 1), 1002]
    for levels in (1, 3, 9):
        leaves = trees.leaf_rows(frame, ["id"], "v", "doc", levels).collect()
        assert {r.id for r in leaves} == {*ids, 1000, 1001} and not any(r.kind for r in leaves if r.id in (1000, 1001))
        assert sorted(repr(tuple(r)) for r in leaves if r.kind) == sorted(repr((i, *x)) for i, d in zip(ids, docs) for x in walked(d)), levels
        claims = trees.claim_rows(frame, ["id"], "v", "doc", levels).collect()
        assert sorted(r.id for r in claims if r.root) == sorted([*ids, 1000, 1001])
        assert sorted(repr((r.id, *c)) for r in claims for c in r.found) == sorted(repr((i, *c)) for i, d in zip(ids, docs) for c in claims_of(d)), levels


def test_leaves_are_counted_as_they_are_listed(spark, trees_made):
    docs, frame = trees_made
    assert {r.id: r.n for r in frame.select("id", trees.leaf_count(F.col("doc")).alias("n")).collect()} == {i: len(walked(d)) for i, d in enumerate(docs)}
    odd = spark.createDataFrame([(t,) for t in ['{"a,":"{},[]"}', r'["\"", "\\", ","]', "[[],{},[{}],1]", "7", "{", None]], "doc string")
    assert [r.n for r in odd.select(trees.leaf_count(F.col("doc")).alias("n")).collect()] == [1, 3, 1, 1, 0, 0]


def test_numbers_in_pointers_may_be_keys(spark):
    doc = {"0": [{"1": "x"}, {"1": ["y"]}], "o": {"2": {"'": 5}}}
    frame = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    for pointer, value in {"/0/0/1": "x", "/0/1/1/0": "y", "/o/2/'": 5, "/0/2": None, "/o/2/0": None}.items():
        assert frame.select(trees.scalar_text(trees.resolved(trees.parsed(F.col("doc")), F.lit(pointer)))).first()[0] == (value and str(value)), pointer


# the contract


def broken(spark, *docs, root="Recipe"):
    frame = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    return sorted((r.id, r.path, r.reason) for r in ct.violations(frame, ["id"], "doc", ct.contract(root)).collect())


@pytest.fixture(scope="module")
def recipe(spark):
    rows = documents(spark, DATA).orderBy(F.desc(F.length("json")), "doc_key").limit(1).collect()
    out = json.loads(rows[0].json)
    out["title"] = {"state": "from_source", "sourceText": "A title", "sourceRefs": [{"blockId": "b"}]}
    value = lambda: {"sourceText": "9", "kind": "exact", "value": 9}
    out["nutritionStatements"] = [{"id": "n", "basis": {"kind": "per_yield", "quantityExpression": value()}, "facts": [{"nutrient": "energy", "valueExpression": value(), "sourceRefs": []}], "sourceRefs": []}]
    out["media"] = {"heroImage": {"storageIdentity": "s", "origin": "source_url"}}
    return out


def test_whole_documents_keep_the_contract(spark, recipe):
    assert broken(spark, recipe) == []
    docs = documents(spark, DATA)
    assert ct.violations(docs, ["doc_key"], "json", ct.contract("Recipe")).count() == 0


def changed(document, path, value):
    """A copy with the value at a path replaced; KeyError takes the member out."""
    out = copy.deepcopy(document)
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_every_required_member_at_every_depth(spark, recipe):
    rules = ct.contract("Recipe")
    required = {shell: need for shell, _, need, _ in rules.objects}
    cases, want = [], []

    def visit(x, steps, pattern):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else []:
            visit(v, [*steps, k], f"{pattern}/{k if isinstance(x, dict) else '*'}" if pattern != "/title" else f"/title{{from_source}}/{k}")
        shell = "/title{from_source}" if pattern == "/title" else pattern
        for key in required.get(shell, []):
            if (shell, key) not in seen:
                seen.add((shell, key))
                cases.append(changed(recipe, [*steps, key], KeyError))
                want.append(("/" + "/".join(map(str, [*steps, key])), "not_allowed" if key == "state" else "missing"))

    seen: set = set()
    visit(recipe, [], "")
    assert len(cases) > 60
    found = broken(spark, *cases)
    for i, w in enumerate(want):
        assert (i, *w) in found, w
    # taking the member out that tells titles apart leaves nothing more to say about the title
    assert sorted(set(found) - {(i, *w) for i, w in enumerate(want)}) == []


def test_each_kind_of_violation(spark, recipe):
    line = ["ingredientGroups", 0, "ingredients", 0]
    cases = [
        (["inventedField"], "nope", ("/inventedField", "unknown_key")),
        (["yields", 0, "inventedField"], {"deep": {"er": 1}}, ("/yields/0/inventedField", "unknown_key")),
        (["a/b"], 1, ("/a/b", "unknown_key")),
        (["schemaVersion"], "3.0.0", ("/schemaVersion", "not_allowed")),
        (["provenance", "sourceSnapshotVersion"], 1.5, ("/provenance/sourceSnapshotVersion", "wrong_type")),
        (["provenance", "sourceSnapshotVersion"], -1, ("/provenance/sourceSnapshotVersion", "negative")),
        (["provenance", "runId"], "", ("/provenance/runId", "empty")),
        (["title", "sourceRefs"], [], ("/title/sourceRefs", "empty")),
        (["title", "sourceRefs"], [{}], ("/title/sourceRefs/0", "needs_one_of")),
        (["title", "state"], "guessed", ("/title/state", "not_allowed")),
        (["title"], "a bare string", ("/title", "wrong_type")),
        ([*line, "name"], None, ("/ingredientGroups/0/ingredients/0/name", "wrong_type")),
        ([*line, "qualifiers"], "x", ("/ingredientGroups/0/ingredients/0/qualifiers", "wrong_type")),
        ([*line, "quantityExpression"], {"sourceText": "4", "kind": "exact", "value": "4"}, ("/ingredientGroups/0/ingredients/0/quantityExpression/value", "wrong_type")),
        ([*line, "optional"], "yes", ("/ingredientGroups/0/ingredients/0/optional", "wrong_type")),
        (["instructionSections", 0, "steps", 0, "producesComponents"], ["", "c"], ("/instructionSections/0/steps/0/producesComponents/0", "empty")),
        (["nutritionStatements", 0, "facts", 0, "nutrient"], "magic", ("/nutritionStatements/0/facts/0/nutrient", "not_allowed")),
        (["media", "heroImage", "storageIdentity"], "", ("/media/heroImage/storageIdentity", "empty")),
    ]
    found = broken(spark, *[changed(recipe, path, value) for path, value, _ in cases])
    assert found == sorted((i, *want) for i, (_, _, want) in enumerate(cases))
    # numbers that no double holds, documents that are none
    text = json.dumps(changed(recipe, ["yields", 0, "valueExpression", "value"], 987654321)).replace("987654321", "1e999")
    assert broken(spark, text) == [(0, "/yields/0/valueExpression/value", "not_finite")]
    deep = {"x": 1}
    for _ in range(12):
        deep = {"x": [deep]}
    assert broken(spark, changed(recipe, ["deep"], deep), changed({**recipe, "deep": deep}, ["provenance", "runId"], "")) == [(0, "/deep", "unknown_key"), (1, "/deep", "unknown_key"), (1, "/provenance/runId", "empty")]
    assert broken(spark, "{", "[]", "null") == [(0, "", "not_json"), (1, "", "wrong_type"), (2, "", "wrong_type")]


def test_snapshots_contract(spark):
    good = {"id": "s", "version": 0, "sourceType": "url", "capturedText": "", "structuredSourcePayload": {"any": [1, {"thing": None}]}, "blocks": [{"id": "b", "order": 0, "type": "title", "text": "T"}],
            "captureProvenance": {"sourceAdapter": "a", "adapterVersion": "1", "runId": "r"}}
    assert broken(spark, good, root="Snapshot") == []
    assert broken(spark, {**good, "inventedField": 1}, changed(good, ["blocks", 0, "order"], -2), root="Snapshot") == [(0, "/inventedField", "unknown_key"), (1, "/blocks/0/order", "negative")]


def test_tree_queries_use_no_python_worker(spark):
    for name in ("o14_document_leaves", "o61_document_contract", "o62_source_refs", "o64_document_claims", "o66_document_claims", "o67_pointers", "o68_payload_leaves"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan, name


# comparing whole documents


def edited(rng: random.Random, x):
    """A copy of a document with a few changes anywhere."""
    if rng.random() < 0.08:
        return made(rng, 2)
    if isinstance(x, dict):
        out = {k: edited(rng, v) for k, v in x.items() if rng.random() > 0.04}
        return {**out, "new": 1} if rng.random() < 0.05 else out
    if isinstance(x, list):
        return [edited(rng, v) for v in x][: rng.choice([len(x), len(x), len(x), max(0, len(x) - 1)])]
    return str(x) if isinstance(x, int) and not isinstance(x, bool) and rng.random() < 0.2 else x


def test_pruned_comparison_equals_that_of_all_leaves(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(200):
        a = made(rng, rng.randint(1, 6))
        pairs.append((a, rng.choice([a, edited(rng, a), edited(rng, a), made(rng, 3)])))
    pairs += [({"0": 1, "1": {"a": 2}}, [1, {"a": 2}, 3]), ([], {}), ({"a": {}}, {"a": []}), (4, "4"), (None, "null"), ({"a": None}, {}), ([[[]]], [[[1]]])]
    frame = lambda side: vs.with_digests(spark.createDataFrame([(i, json.dumps(p[side], ensure_ascii=False)) for i, p in enumerate(pairs)], "id int, json string"))
    diff = vs.document_diff(frame(0), frame(1), ["id"])
    rows: dict = {}
    for r in vs.change_rows(diff, ["id"]).collect():
        rows.setdefault(r.id, set()).add((r.path, r.before, r.after))
    counts = {r.id: (r.n_changes, r.same) for r in vs.change_counts(diff, ["id"]).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = ({p: (k, t) for p, k, t in walked(d)} for d in (a, b))
        # a list and an object can give the same paths, and a key the path of another: such documents are not compared here
        if len(x) != len(walked(a)) or len(y) != len(walked(b)):
            continue
        want = set()
        for path in x.keys() | y.keys():
            p, q = x.get(path), y.get(path)
            if p != q:
                typed = p and q and p[1] == q[1]
                want.add((path, p and (f"{p[1]} ({p[0]})" if typed else p[1]), q and (f"{q[1]} ({q[0]})" if typed else q[1])))
        assert rows.get(i, set()) == want, (a, b)
        assert counts[i] == (len(want), sum(x[p] == y[p] for p in x.keys() & y.keys())), (a, b)


def test_comparison_opens_only_what_differs(spark):
    doc = {"groups": [{"items": [{"name": f"n{i}-{k}", "value": {"kind": "exact", "n": k}} for k in range(50)]} for i in range(20)], "title": "T"}
    other = copy.deepcopy(doc)
    other["groups"][7]["items"][3]["value"]["n"] = "3"
    frames = [vs.with_digests(spark.createDataFrame([(1, json.dumps(x)), (2, json.dumps(doc, indent=1, sort_keys=True)), (3, json.dumps(doc) if x is doc else "{")], "id int, json string")) for x in (doc, other)]
    found = {r.id: r for r in vs.document_diff(*frames, ["id"]).collect()}
    assert found[1].n_leaves == 3001 and found[1].n_opened == 7 and [tuple(c) for c in found[1].changes] == [("/groups/7/items/3/value/n", "number", "3", "string", "3")]
    assert found[2].n_opened == 0 and found[2].changes == []
    assert len(found[3].changes) == 3001  # the other side is no document: every leaf is gone
    assert [tuple(r) for r in vs.change_rows(vs.document_diff(*frames, ["id"]), ["id"]).where("id = 1").collect()] == [(1, "/groups/7/items/3/value/n", "3 (number)", "3 (string)")]
