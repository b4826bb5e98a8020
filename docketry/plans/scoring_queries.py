"""Queries over scoring, projection, run scores, sweeps and snapshot assembly, with their SQL.

A truth is a recipe's first version and its capture the second one; lines are ingredients, steps and uses at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import derivations as dv
from docketry.operators import scoring as sc
from docketry.operators import verification as vf
from docketry.plans.bindings import SQL, lines, table, versions

S, D = SparkSession, DataFrame


def _whole(s: S, d: str, *wanted: int) -> D:
    """Whole documents of the wanted versions, with their recipe as fixture. No others are made."""
    log = versions(s, d).where(F.col("version") <= max(wanted)).where(F.col("version").isin(*wanted))
    amount = F.trim(F.coalesce("val_source_text", F.lit("")))
    share = F.when((F.col("val_kind") == "exact") & (F.col("doc_key") % 3 == 0), "/4").otherwise("")
    heat = F.concat(amount, F.when(F.col("doc_key") % 2 == 0, "-99").otherwise(""))
    usage = F.expr("CASE val_kind WHEN 'exact' THEN 'use_partial_unspecified' WHEN 'range' THEN 'use_remaining' WHEN 'qualitative' THEN 'reserve_for_later' ELSE 'use_now' END")
    name = F.split("name", " ")[0]
    rows = lines(s, d, log).select(
        "doc_key", "group_ordinal", "group_title", F.struct(
            "ordinal", F.struct(name.alias("name"), F.concat(amount, share).alias("quantity"), F.when(F.col("unit").isNotNull(), "Cans").alias("unit")).alias("ingredient"),
            F.struct(
                F.concat(F.lit("step "), "group_title").alias("text"), F.filter(F.array(heat), lambda x: F.col("val_kind").eqNullSafe(F.lit("range"))).alias("temperatures"),
                F.array(F.struct(F.col("group_title").alias("id"), usage.alias("usage"), F.substring(name, 1, 1).alias("label"))).alias("uses")).alias("step")).alias("x"))
    groups = rows.groupBy("doc_key", "group_ordinal", "group_title").agg(F.sort_array(F.collect_list("x")).alias("x")).groupBy("doc_key").agg(
        F.sort_array(F.collect_list(F.struct("group_ordinal", "group_title", "x"))).alias("g"))
    pair = lambda a, b, x, y: F.struct(F.lit(x).alias(a), y.cast("string").alias(b))
    n = F.coalesce(F.aggregate("g", F.lit(0), lambda a, x: a + F.size(x["x"])), F.lit(0))
    return log.join(groups, "doc_key", "left").select(
        F.col("recipe_id").alias("fixture"), "version", "title", F.transform("g", lambda x: x["group_title"]).alias("yields"),
        F.transform("g", lambda x: F.struct(x["group_title"].alias("title"), F.transform(x["x"], lambda i: i["ingredient"]).alias("ingredients"))).alias("groups"),
        F.transform("g", lambda x: F.struct(F.transform(x["x"], lambda i: i["step"]).alias("steps"))).alias("sections"),
        F.array(pair("type", "text", "prep", F.col("status")), pair("type", "text", "rest", F.lit("5")), pair("type", "text", "total", F.floor(F.col("total") / 100000))).alias("times"),
        F.array(pair("name", "text", "lines", n)).alias("nutrition"), F.array(pair("kind", "text", "year", F.year("created"))).alias("classifications"))


def _labelled(fixture: Column, times: Column) -> Column:
    """The times of a truth, of which some are malformed."""
    return F.when(fixture % 10 == 0, F.map_concat(times, F.create_map(F.lit("prep_label"), F.lit("PREP")))).otherwise(times)


def _both(s: S, d: str) -> tuple[D, D]:
    """Truths and captures."""
    truth, capture = (sc.projected(_whole(s, d, k)) for k in (1, 2))
    return truth.withColumn("times", _labelled(F.col("fixture"), F.col("times"))), capture


def _pairs(s: S, d: str) -> D:
    """Truths beside their captures: both are made in one go and meet by their recipe."""
    flat = sc.projected(_whole(s, d, 1, 2), ["version"]).where("fixture IS NOT NULL")
    doc = F.struct(*[c for c in flat.columns if c not in ("fixture", "version")])
    met = flat.groupBy("fixture").agg(F.collect_list(F.struct("version", doc.alias("doc"))).alias("docs")).where(F.size("docs") == 2)
    of = lambda k: F.get(F.filter("docs", lambda x: x["version"] == k), F.lit(0))["doc"]
    pairs = met.select("fixture", of(1).alias("t"), of(2).alias("c"))
    return pairs.withColumn("t", F.col("t").withField("times", _labelled(F.col("fixture"), F.col("t")["times"])))


def o86_field_checks(s: S, d: str) -> D:
    return sc.pair_checks(_pairs(s, d)).groupBy("fixture", "field", "edge").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))


def o86_malformed(s: S, d: str) -> D:
    return sc.malformed(_both(s, d)[0]).select("fixture", F.array_join("keys", ",").alias("keys"))


def o86_missing_runs(s: S, d: str) -> D:
    return sc.missing_runs(*_both(s, d))


def o87_circular(s: S, d: str) -> D:
    """Captures of recipes that third parties copied: every fourth one is its truth."""
    truth = sc.projected(_whole(s, d, 1))
    return sc.circular(truth, truth.withColumn("title", F.when(F.col("fixture") % 4 == 0, F.col("title")).otherwise(F.lit("another"))))


def o89_projection(s: S, d: str) -> D:
    flat = sc.projected(_whole(s, d, 1))
    pairs = F.transform("split_reserved", lambda p: F.concat(p["use"], F.lit(">"), p["reserve"]))
    return flat.select(
        "fixture", F.array_join(F.transform("ingredients", lambda i: F.concat_ws("/", i["group"], i["name"], i["unit"])), "|").alias("ingredients"),
        F.array_join("instructions", "|").alias("instructions"), F.array_join("temperatures", "|").alias("temperatures"), F.array_join(F.array_sort(pairs), "|").alias("splits"),
        F.array_join(F.array_sort(F.map_keys("times")), ",").alias("times"), F.try_element_at("nutrition", F.lit("lines")).alias("lines"))


def o91_disagreements(s: S, d: str) -> D:
    return sc.pair_disagreements(_pairs(s, d))


def _runs(s: S, d: str) -> D:
    k = (F.get_json_object("props", "$.k").cast("long") % 6).cast("string")
    return table(s, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("fixture")).agg(
        F.collect_set(k).alias("block_ids"), F.collect_list((F.col("event_id") % 7).cast("string")).alias("refs"), (F.count("*") > 1).alias("valid")).withColumns(
        {"shape": F.expr("element_at(array('capture', 'normalization', 'combined'), cast(run % 3 + 1 AS int))"), "model": F.lit("m-1")})


def o92_run_scores(s: S, d: str) -> D:
    known = table(s, d, "events").select(F.col("event_type").alias("fixture")).distinct().withColumn("known", F.array(*[F.lit(str(x)) for x in range(4)]))
    return sc.run_summary(sc.run_scores(_runs(s, d), known))


def _judged(s: S, d: str) -> D:
    rows = table(s, d, "documents").select("doc_id", "lang", F.struct(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.length("text")).alias("n_chars"), F.when(F.col("doc_id") % 7 == 0, "x").alias("extra"),
        F.when(F.col("doc_id") % 11 == 0, "0").otherwise("v1").alias("kind"), F.when(F.col("doc_id") % 13 == 0, F.lit(0.5)).alias("weight")).alias("doc"))
    found = vf.contract_violations(F.to_json("doc"), {"doc_id": "int", "n_chars": "int", "kind": "string"}, {"weight": "int"})
    return rows.select("doc_id", "lang", found.alias("violations"))


def o96_validity_sweep(s: S, d: str) -> D:
    return sc.validity_sweep(_judged(s, d), ["lang"])


def o96_sweep_failures(s: S, d: str) -> D:
    return sc.sweep_failures(_judged(s, d), ["doc_id"])


def o82_snapshots(s: S, d: str) -> D:
    turns = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("type"), F.max("text").alias("text")).withColumns(
        {"heading": F.lit(None).cast("string"), "heading_norm": F.lit(None).cast("string"), "text_norm": F.lower("text")})
    blocks = turns.select(F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("ord"), "type", "heading", "heading_norm", "text", "text_norm")
    captures = table(s, d, "conversations").select(F.col("conv_id").alias("snapshot_id")).distinct().select(
        "snapshot_id", F.lit("photo").alias("source_type"), F.lit("captured").alias("captured_text"), F.when(F.col("snapshot_id") % 2 == 0, "{}").alias("payload"))
    out = dv.snapshots(captures, blocks, adapter="reader", adapter_version="1", run_id="r-7")
    x = F.col("snapshot")
    return out.select(
        "snapshot_id", x["version"].alias("version"), x["payload"].alias("payload"), F.size(x["blocks"]).alias("n_blocks"),
        F.get(x["blocks"], F.lit(0))["id"].alias("first_id"), F.array_join(F.transform(x["blocks"], lambda b: b["type"]), ",").alias("types"), x["provenance"]["run_id"].alias("run_id"))


def x2_array_equality(s: S, d: str) -> D:
    """Flags of an order's lines by number, against those of the next order."""
    flags = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("x"))
    flags = flags.select("l_orderkey", F.transform("x", lambda i: i["l_returnflag"]).alias("a"))
    after = flags.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a").alias("b"))
    return flags.join(after, "l_orderkey").select("l_orderkey", sc.same_in_any_order(F.col("a"), F.col("b")).alias("any_order"), sc.same_sequence(F.col("a"), F.col("b")).alias("sequence"))


QUERIES = {f.__name__: f for f in (
    o82_snapshots, o86_field_checks, o86_malformed, o86_missing_runs, o87_circular, o89_projection, o91_disagreements, o92_run_scores, o96_validity_sweep, o96_sweep_failures, x2_array_equality)}

_FLAT = f"""
WITH {SQL},
l AS (
  SELECT recipe_id AS fixture, version, doc_key, group_ordinal * 1000 + ordinal AS pos, group_title AS g, string_split(name, ' ')[1] AS name, val_kind AS kind,
         trim(coalesce(val_source_text, ''), ' ') AS amount, CASE WHEN val_kind = 'exact' AND doc_key % 3 = 0 THEN '/4' ELSE '' END AS share,
         CASE WHEN unit IS NOT NULL THEN 'Cans' ELSE '' END AS unit FROM ingredients WHERE version <= 2),
m AS (SELECT *, amount || share AS q, CASE WHEN amount = '' THEN -1 WHEN share = '' THEN amount::DOUBLE ELSE amount::DOUBLE / 4 END AS nq, amount || CASE WHEN doc_key % 2 = 0 THEN '-99' ELSE '' END AS heat FROM l),
g AS (SELECT fixture, version, list(DISTINCT g ORDER BY g) AS gs, list('step ' || lower(g) ORDER BY pos) AS steps, count(*) AS n,
             list(heat ORDER BY heat) FILTER (kind = 'range') AS heats, string_agg(heat, '|' ORDER BY pos) FILTER (kind = 'range') AS heat_text,
             string_agg('step ' || g, '|' ORDER BY pos) AS step_text, string_agg(concat_ws('/', g, name, nullif(unit, '')), '|' ORDER BY pos) AS item_text FROM m GROUP BY 1, 2),
p AS (SELECT fixture, version, g, arg_min(name[1], pos) FILTER (kind IN ('exact', 'qualitative')) AS use, arg_min(name[1], pos) FILTER (kind = 'range') AS reserve FROM m GROUP BY 1, 2, 3 HAVING use IS NOT NULL AND reserve IS NOT NULL),
f AS (SELECT v.recipe_id AS fixture, v.version, doc_key, title, status AS prep, floor(total / 100000)::BIGINT::VARCHAR AS whole, year(created) AS y, coalesce(gs, []) AS gs, coalesce(steps, []) AS steps,
             coalesce(heats, []) AS heats, coalesce(n, 0) AS n, coalesce(heat_text, '') AS heat_text, coalesce(step_text, '') AS step_text, coalesce(item_text, '') AS item_text
      FROM versions v LEFT JOIN g ON g.fixture = v.recipe_id AND g.version = v.version WHERE v.version <= 2),
b AS (SELECT t.fixture, t, c FROM (SELECT * FROM f WHERE version = 1) t JOIN (SELECT * FROM f WHERE version = 2) c ON t.fixture = c.fixture)
"""
_CHECKS = """
, first AS (SELECT fixture, lower(name) AS name, arg_min(struct_pack(nq := nq, unit := unit, g := g), pos) AS x FROM m WHERE version = 2 GROUP BY 1, 2),
i AS (SELECT m.fixture, m.nq, m.unit, m.g, m.share, first.x FROM m JOIN b ON b.fixture = m.fixture LEFT JOIN first ON first.fixture = m.fixture AND first.name = lower(m.name) WHERE m.version = 1),
checks AS (
  SELECT fixture, 'title' AS field, NULL AS edge, coalesce(lower(t.title), '') = coalesce(lower(c.title), '') AS ok FROM b
  UNION ALL SELECT fixture, CASE WHEN len(t.gs) > 1 THEN 'multiple_yields' ELSE 'yield' END, CASE WHEN len(t.gs) > 1 THEN 'multiple_yields' END, t.gs = c.gs FROM b
  UNION ALL SELECT fixture, 'time', NULL, t.prep = c.prep AND t.whole = c.whole FROM b WHERE fixture % 10 != 0
  UNION ALL SELECT fixture, 'temperature', CASE WHEN t.doc_key % 2 = 0 THEN 'ranges' END, list_has_all(c.heats, t.heats) AND len(c.heats) = len(t.heats) FROM b WHERE len(t.heats) > 0
  UNION ALL SELECT fixture, 'ingredient.name', NULL, x IS NOT NULL FROM i
  UNION ALL SELECT fixture, 'ingredient.quantity', CASE WHEN share != '' THEN 'fractions' END, coalesce(x.nq = nq, false) FROM i
  UNION ALL SELECT fixture, 'ingredient.unit', CASE WHEN unit != '' THEN 'ambiguous_units' END, coalesce(x.unit = unit, false) FROM i
  UNION ALL SELECT fixture, 'ingredient_group', NULL, bool_and(coalesce(x.g = g, false)) FROM i GROUP BY 1
  UNION ALL SELECT fixture, 'instruction.text', NULL, list_contains(c.steps, s) FROM (SELECT fixture, c, unnest(t.steps) AS s FROM b)
  UNION ALL SELECT fixture, 'instruction.order', NULL, t.steps = c.steps FROM b
  UNION ALL SELECT p.fixture, 'split_reserved', NULL, bool_and(EXISTS (FROM p o WHERE o.fixture = p.fixture AND o.version = 2 AND o.use = p.use AND o.reserve = p.reserve)) FROM p JOIN b ON b.fixture = p.fixture WHERE p.version = 1 GROUP BY 1
  UNION ALL SELECT fixture, 'nutrition', NULL, t.n = c.n FROM b
  UNION ALL SELECT fixture, 'classification', NULL, t.y = c.y FROM b)
"""
_DIFFERENCES = """
, last AS (SELECT fixture, version, lower(name) AS name, arg_max(q, pos) AS q, arg_max(unit, pos) AS unit FROM m GROUP BY 1, 2, 3),
j AS (SELECT coalesce(x.fixture, y.fixture) AS fixture, x.name AS tn, y.name AS cn, x.q AS tq, y.q AS cq, x.unit AS tu, y.unit AS cu
      FROM (SELECT last.* FROM last JOIN b ON b.fixture = last.fixture WHERE version = 1) x FULL JOIN (SELECT last.* FROM last JOIN b ON b.fixture = last.fixture WHERE version = 2) y ON x.fixture = y.fixture AND x.name = y.name),
s AS (SELECT fixture, t, c, unnest(range(least(len(t.steps), len(c.steps)))) AS k FROM b)
SELECT fixture, 'title' AS field, coalesce(t.title, '') AS truth, coalesce(c.title, '') AS capture FROM b WHERE coalesce(t.title, '') != coalesce(c.title, '')
UNION ALL SELECT fixture, 'yields', lower(array_to_string(t.gs, '|')), lower(array_to_string(c.gs, '|')) FROM b WHERE t.gs != c.gs
UNION ALL SELECT fixture, 'times.prep', t.prep, c.prep FROM b WHERE t.prep != c.prep
UNION ALL SELECT fixture, 'times.total', t.whole, c.whole FROM b WHERE t.whole != c.whole
UNION ALL SELECT fixture, 'temperatures', array_to_string(t.heats, '|'), array_to_string(c.heats, '|') FROM b WHERE t.heats != c.heats
UNION ALL SELECT fixture, 'ingredient.missing', tn, '' FROM j WHERE cn IS NULL
UNION ALL SELECT fixture, 'ingredient.extra', '', cn FROM j WHERE tn IS NULL
UNION ALL SELECT fixture, 'ingredient.quantity [' || tn || ']', tq, cq FROM j WHERE tq != cq
UNION ALL SELECT fixture, 'ingredient.unit [' || tn || ']', tu, cu FROM j WHERE tu != cu
UNION ALL SELECT fixture, 'instruction.count', len(t.steps)::VARCHAR, len(c.steps)::VARCHAR FROM b WHERE len(t.steps) != len(c.steps)
UNION ALL SELECT fixture, 'instruction[' || k || ']', t.steps[k + 1], c.steps[k + 1] FROM s WHERE t.steps[k + 1] != c.steps[k + 1]
"""
_JUDGED = "j AS (SELECT doc_id, lang, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'missing:n_chars' END, CASE WHEN doc_id % 7 = 0 THEN 'unknown_key:extra' END, CASE WHEN doc_id % 13 = 0 THEN 'wrong_type:weight' END], lambda x: x IS NOT NULL), '; ') AS message FROM documents)"

ORACLES = {
    "o82_snapshots": "WITH u AS (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id AS snapshot_id, count(*)::INTEGER AS n_blocks, 'b-' || substr(sha256(arg_min(role || chr(0) || chr(0) || lower(text), turn)), 1, 12) AS first_id, string_agg(role, ',' ORDER BY turn) AS types FROM u GROUP BY 1) SELECT snapshot_id, 1 AS version, CASE WHEN snapshot_id % 2 = 0 THEN '{}' END AS payload, n_blocks, first_id, types, 'r-7' AS run_id FROM s",
    "o86_field_checks": f"{_FLAT}{_CHECKS} SELECT fixture, field, edge, count(*) FILTER (ok) AS hits, count(*) AS total FROM checks GROUP BY 1, 2, 3",
    "o86_malformed": f"{_FLAT} SELECT fixture, 'prep_label' AS keys FROM f WHERE version = 1 AND fixture % 10 = 0",
    "o86_missing_runs": "SELECT o_custkey AS fixture FROM orders GROUP BY 1 HAVING count(*) = 1",
    "o87_circular": f"{_FLAT} SELECT count(*) AS captures, count(*) FILTER (fixture % 4 = 0) AS identical FROM f WHERE version = 1",
    "o89_projection": f"{_FLAT}, q AS (SELECT fixture, string_agg(use || '>' || reserve, '|' ORDER BY use || '>' || reserve) AS splits FROM p WHERE version = 1 GROUP BY 1) SELECT fixture, item_text AS ingredients, step_text AS instructions, heat_text AS temperatures, coalesce(splits, '') AS splits, 'prep,total' AS times, n::VARCHAR AS lines FROM f LEFT JOIN q USING (fixture) WHERE version = 1",
    "o91_disagreements": f"{_FLAT}{_DIFFERENCES}",
    "o92_run_scores": """
WITH r AS (SELECT user_id, event_type AS fixture, (['capture', 'normalization', 'combined'])[user_id % 3 + 1] AS shape, list(DISTINCT ((props->>'$.k')::BIGINT % 6)::VARCHAR) AS ids, list((event_id % 7)::VARCHAR) AS refs, count(*) > 1 AS valid FROM events GROUP BY 1, 2),
k AS (SELECT *, len(refs) AS n, len(list_filter(refs, lambda x: list_contains(CASE WHEN shape = 'combined' THEN ids ELSE ['0', '1', '2', '3'] END, x))) AS hit, CASE WHEN shape != 'normalization' THEN array_to_string(list_sort(ids), ',') END AS sig FROM r)
SELECT shape, fixture, 'm-1' AS model, count(*) AS runs, count(*) FILTER (valid) AS valid, sum(CASE WHEN shape != 'capture' THEN n END)::BIGINT AS refs_total, sum(CASE WHEN shape != 'capture' THEN hit END)::BIGINT AS refs_resolved,
       count(*) FILTER (shape != 'capture' AND n > 0 AND hit = n) AS fully_resolved, count(DISTINCT nullif(sig, '')) AS signatures, count(DISTINCT nullif(sig, '')) <= 1 AS stable FROM k GROUP BY 1, 2""",
    "o96_validity_sweep": f"WITH {_JUDGED} SELECT lang, count(*) AS total, count(*) FILTER (message = '') AS valid FROM j GROUP BY 1",
    "o96_sweep_failures": f"WITH {_JUDGED} SELECT doc_id, message FROM j WHERE message != ''",
    "x2_array_equality": "WITH f AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS a FROM lineitem GROUP BY 1) SELECT x.l_orderkey, list_sort(x.a) = list_sort(y.a) AS any_order, x.a = y.a AS sequence FROM f x JOIN f y ON y.l_orderkey = x.l_orderkey + 1",
}
