"""Scoring, adjudication, projection, run scores and snapshots on own fixtures."""

from pyspark.sql import functions as F

from docketry.operators import derivations as dv
from docketry.operators import scoring as sc

FLAT = (
    "fixture int, title string, yields array<string>, times map<string,string>, temperatures array<string>, "
    "ingredients array<struct<name:string,quantity:string,unit:string,group:string>>, instructions array<string>, "
    "split_reserved array<struct<use:string,reserve:string>>, nutrition map<string,string>, classifications map<string,string>"
)
TRUTH = (1, "Soup", ["4 bowls", "1 pot"], {"prep": "5 min", "cook": ""}, ["180-200"], [("Salt", "1/2", "TL", "base"), ("Leek", "2 to 3", "can", "base")],
         ["Cut.", "Boil"], [("150 g", "50 g")], {"Fat": "1.0"}, {"cuisine": "French"})


def checks(spark, truth, capture):
    rows = sc.field_checks(spark.createDataFrame([truth], FLAT), spark.createDataFrame([capture], FLAT)).collect()
    return sorted((r.field, r.edge or "", r.ok) for r in rows)


def changed(at, value):
    return (*TRUTH[:at], value, *TRUTH[at + 1 :])


def test_a_capture_like_its_truth_holds_in_every_field(spark):
    found = checks(spark, TRUTH, TRUTH)
    assert all(ok for _, _, ok in found)
    assert ("multiple_yields", "multiple_yields", True) in found and ("temperature", "ranges", True) in found
    assert ("ingredient.quantity", "fractions", True) in found and ("ingredient.quantity", "ranges", True) in found
    assert ("ingredient.unit", "ambiguous_units", True) in found and len(found) == 17


#: A capture that differs from its truth in one field, by that field's place, and what it loses.
CHANGES = [
    (1, "Stew", ["title"]),
    (2, ["1 pot"], ["multiple_yields"]),
    (2, ["1 POT", "4  bowls"], []),
    (3, {"prep": "6 min"}, ["time"]),
    (3, {}, ["time"]),
    (4, ["180-200", "90"], ["temperature"]),
    (5, [("leek.", "2-3", "Dose", "BASE")], ["ingredient.name", "ingredient.quantity", "ingredient.unit", "ingredient_group"]),
    (5, None, ["ingredient.name"] * 2 + ["ingredient.quantity"] * 2 + ["ingredient.unit"] * 2 + ["ingredient_group"]),
    (6, ["boil", "cut"], ["instruction.order"]),
    (6, ["cut"], ["instruction.order", "instruction.text"]),
    (7, [("150 g of it", "the other 50 g")], []),
    (7, [("50 g", "150 g")], ["split_reserved"]),
    (8, {"fat": "1"}, []),
    (8, {"fat": "2"}, ["nutrition"]),
    (9, None, ["classification"]),
]


def test_what_a_changed_capture_loses(spark):
    numbered = lambda rows: spark.createDataFrame([(k, *row[1:]) for k, row in enumerate(rows)], FLAT)
    found = sc.field_checks(numbered([TRUTH] * len(CHANGES)), numbered([changed(at, value) for at, value, _ in CHANGES])).where("NOT ok").collect()
    for k, (at, value, lost) in enumerate(CHANGES):
        assert sorted(r.field for r in found if r.fixture == k) == sorted(lost), (at, value)


def test_fields_that_a_truth_does_not_state_are_not_scored(spark):
    bare = (1, None, None, None, None, None, None, None, None, None)
    assert checks(spark, bare, TRUTH) == [("instruction.order", "", False), ("title", "", False), ("yield", "", False)]
    assert [ok for _, _, ok in checks(spark, bare, bare)] == [True] * 3


def test_labels_among_times_are_malformed(spark):
    truth = changed(3, {"prep": "5 min", "Prep_LABEL": "PREP"})
    assert "time" not in {f for f, _, _ in checks(spark, truth, TRUTH)}
    frame = spark.createDataFrame([truth, TRUTH], FLAT)
    assert [r["keys"] for r in sc.malformed(frame).collect()] == [["Prep_LABEL"]]


def test_missing_and_circular_captures(spark):
    truth = spark.createDataFrame([TRUTH, (2, *TRUTH[1:])], FLAT)
    capture = spark.createDataFrame([TRUTH], FLAT)
    assert [r.fixture for r in sc.missing_runs(truth, capture).collect()] == [2]
    assert tuple(sc.circular(truth, capture).first()) == (1, 1)
    assert tuple(sc.circular(truth, spark.createDataFrame([changed(1, None)], FLAT)).first()) == (1, 0)


def test_disagreements(spark):
    frame = lambda row: spark.createDataFrame([row], FLAT)
    assert sc.disagreements(frame(TRUTH), frame(TRUTH)).count() == 0
    other = (1, "soup.", ["1 pot", "4 bowls"], {"cook": "9"}, ["180-200"], [("salt", "1", "TL", None), ("mint", "1", "", None)], ["Cut", "fry", "eat"], None, None, None)
    found = {r.field: (r.truth, r.capture) for r in sc.disagreements(frame(TRUTH), frame(other)).collect()}
    assert found == {
        "yields": ("4 bowls|1 pot", "1 pot|4 bowls"), "times.prep": ("5 min", ""), "times.cook": ("", "9"), "ingredient.missing": ("leek", ""), "ingredient.extra": ("", "mint"),
        "ingredient.quantity [salt]": ("1/2", "1"), "instruction.count": ("2", "3"), "instruction[1]": ("boil", "fry")}


def test_split_pairs_take_the_first_label_of_either_kind(spark):
    uses = "array(" + ", ".join(f"named_struct('id', {i}, 'usage', '{u}', 'label', {t})" for i, u, t in (
        ("'a'", "use_remaining", "'rest'"), ("'a'", "use_partial_unspecified", "'half'"), ("'a'", "reserve_for_later", "'some'"), ("'a'", "use_remaining", "'end'"),
        ("'b'", "use_remaining", "'lone'"), ("'c'", "use_partial_unspecified", "' '"), ("'c'", "use_remaining", "'x'"), ("null", "use_remaining", "'x'"))) + ")"
    found = spark.range(1).select(sc.split_pairs(F.expr(uses)).alias("x")).first().x
    assert [tuple(p) for p in found] == [("half", "rest")]


def test_run_scores(spark):
    runs = spark.createDataFrame(
        [("capture", "f", "m", 1, True, ["b", "a", "a"], None), ("capture", "f", "m", 2, False, ["a", "b"], None), ("normalization", "f", "m", 1, True, None, ["k", "x", "x"]),
         ("normalization", "g", "m", 1, True, None, ["k"]), ("combined", "f", "m", 1, True, ["a"], ["a"]), ("combined", "f", "m", 2, True, [], None)],
        "shape string, fixture string, model string, run int, valid boolean, block_ids array<string>, refs array<string>")
    scores = sc.run_scores(runs, spark.createDataFrame([("f", ["k"])], "fixture string, known array<string>"))
    lone = {r.fixture: (r.refs_total, r.refs_resolved, r.unresolved) for r in scores.where("shape = 'normalization'").collect()}
    assert lone == {"f": (3, 1, ["x"]), "g": (1, 0, ["k"])}
    found = {(r.shape, r.fixture): tuple(r)[3:] for r in sc.run_summary(scores).collect()}
    assert found[("capture", "f")] == (2, 1, None, None, 0, 1, True)
    assert found[("combined", "f")] == (2, 2, 1, 1, 1, 1, True)
    assert found[("normalization", "g")] == (1, 1, 1, 0, 0, 0, True)


def test_array_equality(spark):
    row = spark.sql("SELECT array('a', 'b', 'b') AS x, array('b', 'a', 'b') AS y, array('a', 'b') AS z, cast(null AS array<string>) AS n")
    x, y, z, n = (F.col(c) for c in "xyzn")
    found = row.select(sc.same_in_any_order(x, y), sc.same_sequence(x, y), sc.same_in_any_order(x, z), sc.same_in_any_order(n, n), sc.same_sequence(x, n)).first()
    assert tuple(found) == (True, False, False, True, False)


def test_snapshots_keep_block_order_and_captures_without_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, "text", None, None, "B", "b"), (1, 0, "text", None, None, "B", "b")], "snapshot_id int, ord int, type string, heading string, heading_norm string, text string, text_norm string")
    captures = spark.createDataFrame([(1, "photo", "B B", None), (2, "url", "", "{}")], "snapshot_id int, source_type string, captured_text string, payload string")
    found = {r.snapshot_id: r.snapshot for r in dv.snapshots(captures, blocks, "reader", "1", "r").collect()}
    ids = [b.id for b in found[1].blocks]
    assert ids[1] == ids[0] + "-1" and [b.ord for b in found[1].blocks] == [0, 1]
    assert found[2].blocks == [] and found[2].payload == "{}" and found[1].provenance.run_id == "r"
