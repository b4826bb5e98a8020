"""Queries over derivations and evaluation roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators import derivations as dv
from docketry.operators import evaluation as ev
from docketry.operators import verification as vf
from docketry.plans.bindings import SQL, ingredients, nested, table, versions

S, D = SparkSession, DataFrame


def _times(s: S, d: str) -> D:
    """Lines as stated times of their order."""
    kinds = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'range' ELSE 'exact' END")
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value"), F.max("l_discount").alias("share"))
    return rows.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.expr("element_at(array('prep', 'cook', 'bake', 'total', 'rest'), l_linenumber % 5 + 1)").alias("type"),
        kinds.alias("kind"), F.when(F.col("l_linenumber") % 7 == 6, F.col("share")).otherwise(F.col("value")).alias("value"),
        F.expr("element_at(array('min', 'h', 'Std', 'sec', 'cups', ''), cast(l_orderkey % 6 + 1 AS int))").alias("unit"), F.col("value").cast("string").alias("wording"))


def o72_iso_durations(s: S, d: str) -> D:
    t = _times(s, d)
    iso = dv.iso_duration(F.col("kind"), F.col("value"), F.col("unit"))
    return t.select("doc", "pos", iso.alias("x")).select("doc", "pos", "x.iso", "x.reason")


def o41_mapped_times(s: S, d: str) -> D:
    return dv.mapped_times(_times(s, d), ["doc"]).select("doc", "pos", "field", "iso", "omission")


def o41_mapped_yields(s: S, d: str) -> D:
    y = dv.mapped_yields(F.col("val_kind"), F.col("val_value"), F.col("unit"), F.col("source_text"))
    return ingredients(s, d).select(y.alias("y")).groupBy("y.omission").agg(F.count("*").alias("n"), F.count("y.value").alias("valued"), F.count("y.unit_text").alias("with_unit"))


def o75_use_routing(s: S, d: str) -> D:
    uses = table(s, d, "conversations").select(
        "conv_id", "turn", F.expr("CASE WHEN role = 'system' THEN 'reserve_for_later' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'use_partial_unspecified' WHEN role = 'assistant' THEN 'use_remaining' ELSE 'use_now' END").alias("usage"),
        F.expr("CASE WHEN turn % 3 = 0 THEN cast(turn AS string) END").alias("use_text"), F.lit("g").alias("use_unit"), F.expr("CASE WHEN turn % 3 = 0 THEN 'exact' END").alias("use_kind"),
        F.lit("all").alias("whole_text"), F.lit(None).cast("string").alias("whole_unit"), F.lit("qualitative").alias("whole_kind"))
    return dv.amounts(uses).select("conv_id", "turn", "route", "text", "measurable", "whole")


def o74_start_now(s: S, d: str) -> D:
    """The first words of a turn as a cue, the turn before as the action."""
    t = table(s, d, "conversations").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("action"))
    cue = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", dv.starts_now(cue, F.col("action"), F.col("turn")).alias("start_now"))


def o73_plan(s: S, d: str) -> D:
    return dv.plan(nested(s, d))


def o78_critical(s: S, d: str) -> D:
    items = dv.critical(F.array(F.col("l_returnflag")), F.array(), F.array(F.col("l_linestatus")), F.array(F.lit("wait")))
    return table(s, d, "lineitem").select(F.explode(items).alias("x")).groupBy("x.text", "x.kind").agg(F.count("*").alias("n"))


def o79_at_hand(s: S, d: str) -> D:
    flat = F.flatten(F.transform("doc.groups", lambda g: g["ingredients"]))
    return nested(s, d).select("recipe_id", "version", F.size(dv.at_hand_suppressed(flat, True)).alias("kept"), F.size(dv.at_hand_suppressed(flat)).alias("everything"))


def o80_cards(s: S, d: str) -> D:
    return dv.card(nested(s, d))


def o81_media_carry(s: S, d: str) -> D:
    log = versions(s, d).withColumn("media", F.when(F.col("doc_key") % 3 == 0, F.concat(F.lit("sha256:"), F.col("doc_key").cast("string"))))
    return dv.carried_media(log).select("recipe_id", "version", "carried")


def o71_value_violations(s: S, d: str) -> D:
    return vf.value_violations(ingredients(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


def o83_string_norm(s: S, d: str) -> D:
    return table(s, d, "part").select("p_partkey", tx.string_norm(F.concat(F.lit("\t \n"), F.upper("p_name"), F.lit("\u00a0\t&  co...\r\n"))).alias("norm"))


def o84_unit_norm(s: S, d: str) -> D:
    unit = F.expr("element_at(array('Teaspoons', 'EL', 'gramm', 'Prise.', 'LITRE', 'box', NULL), cast(p_partkey % 7 + 1 AS int))")
    return table(s, d, "part").groupBy(tx.unit_norm(unit).alias("unit")).agg(F.count("*").alias("n"))


def o85_quantity_norm(s: S, d: str) -> D:
    text = F.expr("element_at(array('1 1/2', '3/4', '2.50', '2-3', '1½', 'a few', '1 to 2 h'), cast(p_partkey % 7 + 1 AS int))")
    return table(s, d, "part").groupBy(tx.quantity_norm(text).alias("quantity")).agg(F.count("*").alias("n"))


def _predictions(s: S, d: str) -> D:
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.size(F.split("text", " ")).alias("n"), F.size(F.regexp_extract_all("text", F.lit(r"[#*$%&|<>]"), F.lit(0))).alias("signs"))
    return table(s, d, "labels").join(docs, "doc_id").withColumn("ok", F.expr("(CASE WHEN signs * 5 < n THEN 1 ELSE 0 END) = quality"))


def a5_field_tally(s: S, d: str) -> D:
    out = ev.tally(_predictions(s, d), ["lang"])
    return out.withColumn("rate", F.round("rate", 6))


def o87_verdict(s: S, d: str) -> D:
    rates = ev.tally(_predictions(s, d), ["lang"]).withColumnRenamed("lang", "field")
    bars = s.createDataFrame([("en", 0.5), ("de", 0.99), ("xx", 0.1)], "field string, bar double")
    return ev.verdict(rates, bars, F.lit(False))


def a7_median(s: S, d: str) -> D:
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median"))


def a8_nearest_rank(s: S, d: str) -> D:
    return ev.nearest_ranks(table(s, d, "events"), "event_type", "value", {"least": 0.0, "p50": 0.5, "p90": 0.9, "most": 1.0})


def a6_first_best(s: S, d: str) -> D:
    """The line of each order with the greatest discount, the first of equals."""
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("discount"), F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber"))).alias("line"))


def a10_stability(s: S, d: str) -> D:
    runs = table(s, d, "events").groupBy("user_id", "event_type").agg(F.collect_set(F.get_json_object("props", "$.k")).alias("ids"))
    return ev.stability(runs, ["event_type"], "ids")


def a11_cost(s: S, d: str) -> D:
    runs = table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("value") > 20).alias("ok"))
    return ev.cost(runs, ["event_type"], "tokens", "ok")


def a12_coverage_rates(s: S, d: str) -> D:
    pages = table(s, d, "pages").select("page_id", F.regexp_extract("html", "lang=\"([a-z]+)\"", 1).alias("lang"), F.contains("html", F.lit("<h1")).alias("headed"), F.contains("html", F.lit("<table")).alias("tabular"))
    n = pages.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("headed").alias("headed"), F.count_if("tabular").alias("tabular"))
    return n.withColumns({"headed_percent": ev.percent(F.col("headed"), F.col("n")), "tabular_percent": ev.percent(F.col("tabular"), F.col("n"))})


def a13_outcomes(s: S, d: str) -> D:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(s, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def o88_active_bars(s: S, d: str) -> D:
    return ev.active_bars(_registry(s, d)).select("seq", "kind", "bar", "value")


def _registry(s: S, d: str) -> D:
    """Parts as registrations: every fourth one supersedes the one two before."""
    return table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'field' ELSE 'edge' END").alias("kind"), F.col("p_brand").alias("bar"), (F.col("p_size") / 100).alias("value"), F.expr("CASE WHEN p_partkey % 4 = 0 AND p_partkey >= 2 THEN p_partkey - 2 END").alias("supersedes"))


def o88_append_only(s: S, d: str) -> D:
    old = _registry(s, d).drop("supersedes")
    new = old.where("seq % 50 != 7").withColumn("value", F.when(F.col("seq") % 40 == 3, 0.0).otherwise(F.col("value")))
    return ev.not_append_only(old, new).select("seq")


def o90_first_match(s: S, d: str) -> D:
    rules = [("torn", ("torn", "ripped")), ("stained", ("stain", "spill")), ("faded", ("pale", "bleached")), ("intact", ("whole", "undamaged"))]
    notes = F.expr("element_at(array('Ripped at a stain', 'whole, one SPILL', 'pale ink', 'undamaged', 'no remark'), cast(page_id % 5 + 1 AS int))")
    return table(s, d, "pages").select("page_id", ev.first_match(notes, rules, "unclassified").alias("label"))


def _padded(number: Column) -> Column:
    """At least three digits; lpad alone would cut longer numbers."""
    return F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)


def o93_run_names(s: S, d: str) -> D:
    name = F.concat(F.lit("two__"), "event_type", F.lit("__m-1__run"), _padded(F.col("user_id").cast("string")), F.lit(".json"))
    x = ev.run_names(name)
    return table(s, d, "events").select("event_id", x["shape"].alias("shape"), x["fixture"].alias("fixture"), x["model"].alias("model"), x["run"].alias("run"))


def o37_paired_runs(s: S, d: str) -> D:
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    a = e.where("event_type = 'click'").select("user_id", F.col("n").alias("captures"), F.col("total").alias("capture_total"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("n").alias("normalizations"), F.col("total").alias("normalization_total"))
    return a.join(b, "user_id")


def o38_first_name_match(s: S, d: str) -> D:
    """For each name of version 1 the first line of version 2 with the same normal name."""
    rows = ingredients(s, d).withColumn("norm", tx.string_norm(F.col("name")))
    truth = rows.where("version = 1").select("recipe_id", "norm").distinct()
    capture = rows.where("version = 2").groupBy("recipe_id", "norm").agg(F.min_by("source_text", F.struct("group_ordinal", "ordinal")).alias("matched"))
    return truth.join(capture, ["recipe_id", "norm"], "left")


QUERIES = {n: f for n, f in globals().items() if n[0] in "oa" and n.split("_")[0][1:].isdigit() and callable(f)}
W = f"WITH {SQL}"
_TIMES = """
times AS (
  SELECT l_orderkey AS doc, l_linenumber AS pos, (['prep', 'cook', 'bake', 'total', 'rest'])[l_linenumber % 5 + 1] AS type,
         CASE WHEN l_linenumber % 4 = 1 THEN 'range' ELSE 'exact' END AS kind, CASE WHEN l_linenumber % 7 = 6 THEN max(l_discount) ELSE max(l_quantity) END AS value,
         (['min', 'h', 'Std', 'sec', 'cups', ''])[l_orderkey % 6 + 1] AS unit
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
secs AS (SELECT *, value * CASE unit WHEN 'min' THEN 60 WHEN 'h' THEN 3600 WHEN 'Std' THEN 3600 WHEN 'sec' THEN 1 END AS x FROM times),
iso AS (
  SELECT *, CASE WHEN kind != 'exact' THEN 'non_exact_value' WHEN unit = '' THEN 'missing_unit' WHEN x IS NULL THEN 'unrecognized_unit'
              WHEN abs(x - floor(x + 0.5)) > 1e-9 OR floor(x + 0.5) <= 0 THEN 'not_representable' END AS reason, floor(x + 0.5)::BIGINT AS n FROM secs),
written AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'PT' || CASE WHEN n // 3600 > 0 THEN (n // 3600) || 'H' ELSE '' END || CASE WHEN n % 3600 // 60 > 0 THEN (n % 3600 // 60) || 'M' ELSE '' END
              || CASE WHEN n % 60 > 0 THEN (n % 60) || 'S' ELSE '' END END AS iso FROM iso)
"""
_PRED = r"pred AS (SELECT lang, (CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) * 5 < len(string_split(text, ' ')) THEN 1 ELSE 0 END) = quality AS ok FROM labels JOIN documents USING (doc_id))"

ORACLES = {
    "o72_iso_durations": f"WITH {_TIMES} SELECT doc, pos, iso, reason FROM written",
    "o41_mapped_times": f"WITH {_TIMES}, f AS (SELECT *, CASE type WHEN 'prep' THEN 'prepTime' WHEN 'cook' THEN 'cookTime' WHEN 'bake' THEN 'cookTime' WHEN 'total' THEN 'totalTime' END AS f FROM written), r AS (SELECT *, row_number() OVER (PARTITION BY doc, f ORDER BY pos) AS k FROM f), o AS (SELECT *, CASE WHEN f IS NULL THEN 'unmapped_time_type' WHEN k > 1 THEN 'duplicate_time_type' ELSE reason END AS omission FROM r) SELECT doc, pos, coalesce(f, 'times.' || type) AS field, CASE WHEN omission IS NULL THEN iso END AS iso, omission FROM o",
    "o41_mapped_yields": f"{W} SELECT CASE WHEN val_kind = 'exact' AND val_value IS NOT NULL THEN NULL ELSE 'non_exact_value' END AS omission, count(*) AS n, count(CASE WHEN val_kind = 'exact' THEN val_value END) AS valued, count(CASE WHEN val_kind = 'exact' AND val_value IS NOT NULL THEN unit END) AS with_unit FROM ingredients GROUP BY 1",
    "o75_use_routing": "WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'reserved' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'part_of' WHEN role = 'assistant' THEN 'remaining' ELSE 'amounts' END AS route, turn % 3 = 0 AS stated FROM conversations) SELECT conv_id, turn, route, CASE WHEN stated THEN turn || ' g' WHEN route = 'amounts' THEN 'all' ELSE '' END AS text, stated AS measurable, CASE WHEN route IN ('part_of', 'remaining') THEN 'all' END AS whole FROM u",
    "o74_start_now": r"WITH t AS (SELECT a.conv_id, a.turn, lower(array_to_string(string_split(a.text, ' ')[1:2], ' ')) AS cue, lower(b.text) AS action FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1), w AS (SELECT *, list_filter(string_split_regex(cue, '[^\p{L}\p{N}°]+'), lambda x: length(x) > 2) AS ws FROM t) SELECT conv_id, turn, turn >= 2 AND NOT (len(ws) > 0 AND len(list_filter(ws, lambda x: NOT contains(action, x))) = 0) AS start_now FROM w",
    "o73_plan": f"{W} SELECT recipe_id, version, row_number() OVER (PARTITION BY recipe_id, version ORDER BY group_ordinal, ordinal)::INTEGER AS n, group_title AS section, source_text AS action, concat_ws(' ', trim(val_source_text, ' '), unit) AS amount, coalesce(val_kind NOT IN ('qualitative', 'none'), false) AS measurable, coalesce(val_kind NOT IN ('qualitative', 'none'), false) AS needs_block FROM ingredients",
    "o78_critical": "SELECT text, kind, count(*) AS n FROM (SELECT l_returnflag AS text, 'duration' AS kind FROM lineitem UNION ALL SELECT l_linestatus, 'doneness' FROM lineitem UNION ALL SELECT 'wait', 'wait' FROM lineitem) GROUP BY 1, 2",
    "o79_at_hand": f"{W} SELECT v.recipe_id, v.version, count(val_kind)::INTEGER AS kept, count(i.name)::INTEGER AS everything FROM versions v LEFT JOIN ingredients i USING (recipe_id, version) GROUP BY 1, 2",
    "o80_cards": f"{W}, f AS (SELECT recipe_id, version, count(*) AS n, arg_min(concat_ws(' ', trim(val_source_text, ' '), unit), group_ordinal * 1000 + ordinal) AS a FROM ingredients GROUP BY 1, 2) SELECT v.recipe_id, v.version, coalesce(title, '(no title in source)') AS title, coalesce(n, 0)::INTEGER AS n_ingredients, coalesce(a, '') AS first_amount FROM versions v LEFT JOIN f USING (recipe_id, version)",
    "o81_media_carry": f"{W} SELECT recipe_id, version, last_value(CASE WHEN doc_key % 3 = 0 THEN 'sha256:' || doc_key END IGNORE NULLS) OVER (PARTITION BY recipe_id ORDER BY version) AS carried FROM versions",
    "o71_value_violations": f"{W} SELECT 'exact_without_value' AS reason, count(*) AS n FROM ingredients WHERE val_kind = 'exact' AND val_value IS NULL",
    "o83_string_norm": r"SELECT p_partkey, lower(p_name) || ' & co' AS norm FROM part",
    "o84_unit_norm": "SELECT (['tsp', 'tbsp', 'g', 'pinch', 'l', 'box', ''])[p_partkey % 7 + 1] AS unit, count(*) AS n FROM part GROUP BY 1",
    "o85_quantity_norm": "SELECT (['1.5000', '0.7500', '2.5000', '2.0000..3.0000', '1.5000', 'a few', '1.0000..2.0000'])[p_partkey % 7 + 1] AS quantity, count(*) AS n FROM part GROUP BY 1",
    "a5_field_tally": f"WITH {_PRED} SELECT lang, count(*) FILTER (ok) AS hits, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM pred GROUP BY 1",
    "o87_verdict": f"WITH {_PRED}, r AS (SELECT lang, count(*) FILTER (ok) / count(*) AS rate FROM pred GROUP BY 1), b(lang, bar) AS (VALUES ('en', 0.5), ('de', 0.99), ('xx', 0.1)), x AS (SELECT count(*) FILTER (rate < bar) AS failing, count(*) FILTER (rate IS NULL) AS unmeasured FROM b LEFT JOIN r USING (lang)) SELECT failing, unmeasured, CASE WHEN failing + unmeasured > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM x",
    "a7_median": "SELECT event_type, round(median(value), 4) AS median FROM events GROUP BY 1",
    "a8_nearest_rank": "WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[1] AS least, v[least(len(v) - 1, floor(0.5 * len(v)))::INTEGER + 1] AS p50, v[least(len(v) - 1, floor(0.9 * len(v)))::INTEGER + 1] AS p90, v[len(v)] AS most FROM v",
    "a6_first_best": "SELECT l_orderkey, m AS discount, min(l_linenumber) AS line FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_discount = m GROUP BY 1, 2",
    "a10_stability": "WITH r AS (SELECT user_id, event_type, array_to_string(list_sort(list(DISTINCT props->>'$.k')), ',') AS s FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS runs, count(DISTINCT nullif(s, '')) AS signatures, count(DISTINCT nullif(s, '')) <= 1 AS stable FROM r GROUP BY 1",
    "a11_cost": "WITH r AS (SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 20) AS successes, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1) SELECT *, floor(tokens / attempts + 0.5)::BIGINT AS per_attempt, floor(tokens / nullif(successes, 0) + 0.5)::BIGINT AS per_success FROM r",
    "a12_coverage_rates": "WITH p AS (SELECT regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, contains(html, '<h1') AS h, contains(html, '<table') AS t FROM pages), n AS (SELECT lang, count(*) AS n, count(*) FILTER (h) AS headed, count(*) FILTER (t) AS tabular FROM p GROUP BY 1) SELECT *, 100 * headed // n AS headed_percent, 100 * tabular // n AS tabular_percent FROM n",
    "a13_outcomes": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "o88_active_bars": "WITH r AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'field' ELSE 'edge' END AS kind, p_brand AS bar, p_size / 100 AS value FROM part) SELECT * FROM r WHERE seq NOT IN (SELECT p_partkey - 2 FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 2)",
    "o88_append_only": "SELECT p_partkey AS seq FROM part WHERE p_partkey % 50 = 7 OR (p_partkey % 40 = 3 AND p_size != 0)",
    "o90_first_match": "SELECT page_id, (['torn', 'stained', 'faded', 'intact', 'unclassified'])[page_id % 5 + 1] AS label FROM pages",
    "o93_run_names": "SELECT event_id, 'two' AS shape, event_type AS fixture, 'm-1' AS model, user_id::INTEGER AS run FROM events",
    "o37_paired_runs": "WITH e AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT a.user_id, a.n AS captures, a.total AS capture_total, b.n AS normalizations, b.total AS normalization_total FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'",
    "o38_first_name_match": f"{W}, c AS (SELECT recipe_id, lower(name) AS norm, arg_min(source_text, group_ordinal * 1000 + ordinal) AS matched FROM ingredients WHERE version = 2 GROUP BY 1, 2) SELECT DISTINCT i.recipe_id, lower(i.name) AS norm, matched FROM ingredients i LEFT JOIN c ON c.recipe_id = i.recipe_id AND c.norm = lower(i.name) WHERE i.version = 1",
}
