"""Unit and negative cases of functions and operators on our own fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions import web
from docketry.operators import derivations as dv
from docketry.operators import evaluation as ev
from docketry.operators import verification as vf
from docketry.operators import versions as ops


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a</p><p>b</p>", "a\nb"),
        ("fl<b>ou</b>r", "flour"),
        ("<script>var t='</p>x'</script><style>p{}</style>y<!-- <p>no</p> -->", "y"),
        ('<a title="a > b">link</a>', "link"),
        ("1 &#189; c&#xE9;&eacute; &unknown; &amp;lt;", "1 ½ céé &unknown; &lt;"),
        ("a&nbsp;&nbsp; b\t c<br>d", "a b c\nd"),
        ("&#1114112; &#55296;", "&#1114112; &#55296;"),
        ("", ""),
    ],
)
def test_html_to_text(spark, html, want):
    assert one(spark, tx.html_to_text(F.col("h")), h=html) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("ge-\nhen Lassen", "gehen lassen"), ("180–200", "180-200"), ("it’s “x”", "it's \"x\""), ("a  b", "a b"), ("ﬁne ½", "fine 1⁄2"), ("  ", "")],
)
def test_normal_form(spark, text, want):
    assert one(spark, tx.normal(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 1/2", "1.5000"), ("1½", "1.5000"), ("2–3", "2.0000..3.0000"), ("1 to 2 h", "1.0000..2.0000"), ("a pinch", "a pinch"), ("1/0", "1/0"), ("2.50", "2.5000")],
)
def test_quantity_norm(spark, text, want):
    assert one(spark, tx.quantity_norm(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("kind", "value", "unit", "iso", "reason"),
    [
        ("exact", 90.0, "min", "PT1H30M", None), ("exact", 1.1, "h", "PT1H6M", None), ("exact", 2.0, " Tage ", "PT48H", None), ("exact", 2.5, "sec", None, "not_representable"),
        ("exact", float("inf"), "h", None, "not_representable"), ("exact", float("nan"), "h", None, "not_representable"), ("exact", 0.0, "h", None, "not_representable"),
        ("range", 1.0, "h", None, "non_exact_value"), ("exact", None, "h", None, "non_exact_value"), ("exact", 1.0, " ", None, "missing_unit"), ("exact", 1.0, "cups", None, "unrecognized_unit"),
    ],
)
def test_iso_duration(spark, kind, value, unit, iso, reason):
    row = spark.createDataFrame([(kind, value, unit)], "k string, v double, u string")
    got = row.select(dv.iso_duration(F.col("k"), F.col("v"), F.col("u")).alias("x")).first().x
    assert (got.iso, got.reason) == (iso, reason)


def test_first_time_claims_its_field(spark):
    times = spark.createDataFrame([(1, 0, "cook", "range", None, "min", "20-30"), (1, 1, "bake", "exact", 40.0, "min", "40"), (1, 2, "rest", "exact", 1.0, "h", "1")], "doc int, pos int, type string, kind string, value double, unit string, wording string")
    got = {r.pos: (r.field, r.iso, r.omission) for r in dv.mapped_times(times, ["doc"]).collect()}
    assert got == {0: ("cookTime", None, "non_exact_value"), 1: ("cookTime", None, "duplicate_time_type"), 2: ("times.rest", None, "unmapped_time_type")}


def test_start_now(spark):
    rule = dv.starts_now(F.col("c"), F.col("a"), F.col("n"))
    for cue, action, n, want in [("hot oven", "Bake it.", 2, True), ("hot oil", "Heat oil until hot.", 2, False), ("hot oven", "Bake it.", 1, False), ("at 8", "Go.", 3, True)]:
        assert one(spark, rule, c=cue, a=action, n=n) is want


@pytest.mark.parametrize(
    ("literal", "code"),
    [
        ("8.8.8.8", "OK"), ("127.0.0.1", "LOOPBACK"), ("::1", "LOOPBACK"), ("::ffff:10.0.0.1", "PRIVATE_RANGE"), ("::ffff:8.8.8.8", "OK"), ("169.254.169.254", "LINK_LOCAL"),
        ("100.64.1.1", "CGNAT"), ("fd00::1", "UNIQUE_LOCAL"), ("224.0.0.1", "NON_UNICAST"), ("0.0.0.0", "NON_UNICAST"), ("64:ff9b::7f00:1", "NON_UNICAST"), ("1.2.3", "UNPARSEABLE_ADDRESS"),
    ],
)
def test_address_code(literal, code):
    assert web.address_code(literal) == code


def test_inspect_url(spark):
    urls = {"https://example.com/x": "OK", "ftp://example.com": "SCHEME_NOT_ALLOWED", "http://localhost:80/": "LOOPBACK", "http://[::1]/": "LOOPBACK", "http://10.1.2.3/": "PRIVATE_RANGE", "not a url": "UNPARSEABLE_URL", "http://u@127.0.0.1/": "LOOPBACK"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.code for r in web.inspect_url(rows).collect()} == urls


def test_kind_change_is_a_difference(spark):
    a = spark.createDataFrame([(1, "/p", "number", "4"), (1, "/q", "string", "x")], "id int, path string, kind string, text string")
    b = spark.createDataFrame([(1, "/p", "string", "4"), (1, "/q", "string", "x")], a.schema)
    assert [tuple(r) for r in ops.leaf_diff(a, b, ["id"]).collect()] == [(1, "/p", "4 (number)", "4 (string)")]


def test_shopping_never_sums_what_is_not_exact(spark):
    rows = spark.createDataFrame(
        [(1, " Salt ", None, "exact", 2.0, "2", "2 salt"), (2, "salt", None, "range", None, " 1-2 ", "1-2 salt"), (2, "SALT", None, None, None, "  ", " some salt"), (3, "salt", None, "exact", None, None, "salt")],
        "recipe_id int, name string, unit string, val_kind string, val_value double, val_source_text string, source_text string")
    r = ops.shopping(rows).first()
    assert (r.recipe_count, r.exact_count, r.summed_value, r.unsummable_count, r.unsummable) == (3, 1, 2.0, 2, [" some salt", "1-2"])


def test_claims_are_held_by_one_block_not_by_their_sum(spark):
    claims = spark.createDataFrame([(1, "a", "x y"), (2, "a", ""), (3, "b", "q")], "claim_id int, block string, claim_norm string")
    evidence = spark.createDataFrame([("a", "w x"), ("a", "y z")], "block string, evidence_norm string")
    got = {r.claim_id: r.supported for r in vf.claim_support(claims, evidence, ["block"]).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_contract(spark):
    rules = vf.contract_violations(F.col("j"), {"id": "string", "order": "int"}, {"note": "string"})
    for doc, want in [('{"id":"a","order":0}', []), ('{"id":"","order":-1,"x":1}', ["unknown_key:x", "wrong_type:id", "wrong_type:order"]), ('{"order":1}', ["missing:id"]), ("[1]", ["not_an_object"]), ('{"id":"a","order":NaN}', ["not_an_object"])]:
        assert one(spark, rules, j=doc) == want


def test_fail_closed(spark):
    vf.assert_empty(spark.range(0), "none")
    with pytest.raises(vf.Violation):
        vf.assert_empty(spark.range(1), "some")


def test_report_never_prints_an_unmeasured_cell(spark):
    assert "| 1 |" in ev.rendered(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError):
        ev.rendered(spark.createDataFrame([(None,)], "a int"))


def test_nearest_rank_is_not_percentile_disc(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 9)], "k string, v double")
    assert ev.nearest_ranks(rows, "k", "v", {"p": 0.5}).first().p == 5.0
    assert rows.groupBy("k").agg(ev.nearest_rank("v", 0.5).alias("p")).first().p == 5.0


def test_sealed_mark_does_not_occur_in_its_text(spark):
    first = one(spark, tx.sealed(F.col("t"), F.lit("k")), t="x").split("\n")[0]
    again = one(spark, tx.sealed(F.col("t"), F.lit("k")), t=f"x {first}")
    assert not again.startswith(first)


def test_html_of_hostile_pages(spark):
    """Tags of 100,000 attributes, quotes left open, large pages and all kinds of white space end well."""
    many = "<p " + " ".join(f'a{k}="x>{k}"' for k in range(100_000)) + ">text</p>"
    assert one(spark, tx.html_to_text(F.col("h")), h=many) == "text"
    assert one(spark, tx.html_to_text(F.col("h")), h='a<b title="open>c</b>') == "ac"
    assert one(spark, tx.html_to_text(F.col("h")), h="<div>" + "word " * 250_000 + "</div>").count("word") == 250_000
    assert one(spark, tx.html_to_text(F.col("h")), h="<p>\u00a0a\u00a0\u2003b\t</p>\u3000<p>c</p>") == "a b\nc"
    assert one(spark, tx.html_to_text(F.col("h")), h="&#0000000000065;&#x0000000041;&#99999999999999;") == "AA&#99999999999999;"


def test_white_space_at_the_ends(spark):
    assert one(spark, tx.string_norm(F.col("t")), t="\tFoo\u00a0 Bar\n") == "foo bar"
    assert one(spark, tx.prose_lines(F.col("t")), t="\ta\u00a0\n\u2003\nb") == ["a", "b"]
    assert one(spark, tx.paragraphs(F.col("t")), t="\ta\n\u00a0\nb\n") == ["a", "b"]


def test_containment_of_short_claims(spark):
    claims = spark.createDataFrame([(1, "alpha beta", ["alpha", "beta"]), (2, "gam", ["gam"]), (3, "x alpha beta gamma", "x alpha beta gamma".split()), (4, "", [""])], "claim_id int, claim_norm string, words array<string>")
    texts = spark.createDataFrame([(1, "x alpha beta gamma y", "x alpha beta gamma y".split()), (2, "other", ["other"])], "text_id int, text_norm string, words array<string>")
    got = {tuple(r) for r in vf.containment_join(claims, texts).select("claim_id", "text_id").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (4, 2)}


def test_nearest_ranks_of_many_values(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS k", "cast(pmod(xxhash64(id), 1700) AS double) AS v")
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(r.v)
    qs = {"least": 0.0, "p50": 0.5, "p90": 0.9, "most": 1.0}
    for r in ev.nearest_ranks(rows, "k", "v", qs).collect():
        v = sorted(want[r.k])
        assert [r[n] for n in qs] == [v[min(len(v) - 1, int(len(v) * q))] for q in qs.values()]


def test_short_claims_by_automaton(spark, monkeypatch):
    import random

    rng = random.Random(2)
    letters = "abcdé "
    claims = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))).strip()) for k in range(300)] + [(1000, None), (1001, "")]
    texts = [(f"t{k}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for k in range(80)] + [("none", None), ("t0", "repeated id")]
    frames = spark.createDataFrame([c for c in claims if c[1] is not None], "claim_id long, claim_norm string"), spark.createDataFrame(texts, "text_id string, text_norm string")
    want = sorted((c, t) for c, claim in claims for t, text in texts if claim is not None and text is not None and claim in text)
    for size in (1 << 20, 200):  # one automaton, or several of 200 bytes
        monkeypatch.setattr(vf, "AUTOMATON_BYTES", size)
        monkeypatch.setattr(vf, "ROWS_AT_ONCE", 50)
        assert sorted(map(tuple, vf.short_claims_held(*frames).collect())) == want
    assert vf.short_claims_held(frames[0].limit(0), frames[1]) is None


def test_containment_plan_has_no_cross_join(spark):
    from docketry.plans.registry import QUERIES
    from tests.conftest import DATA

    plan = QUERIES["o40_containment"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_normal_form_and_trimming_of_every_kind_of_white_space(spark):
    """Against the plain form of both patterns, over every character of the basic plane that is no surrogate."""
    signs = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF)
    texts = [" ".join(signs[k : k + 64]) + f"  {signs[k]}\t {signs[k]} " for k in range(0, len(signs), 64)] + ["a-\n b -c", "x \u00a0 y", None, "", " ", "\ufeff a \u3000"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    table = str.maketrans({**dict.fromkeys(tx.DASHES, "-"), **dict.fromkeys(tx.SINGLE, "'"), **dict.fromkeys(tx.DOUBLE, '"'), "\u00a0": " "})
    white = F.regexp_replace(F.regexp_replace("m", r"(\p{L})-\s*(\p{L})", "$1$2"), r"(?U)\s+", " ")
    frame = spark.createDataFrame([(t, t and t.translate(table)) for t in texts], "t string, m string")
    edges = F.regexp_replace("t", rf"\A[{tx.SPACES}]++|(?<![{tx.SPACES}])[{tx.SPACES}]++\z", "")
    got = frame.select(tx.normal(F.col("t"), False).alias("a"), F.lower(F.trim(white)).alias("b"), tx.trimmed(F.col("t")).alias("c"), edges.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
