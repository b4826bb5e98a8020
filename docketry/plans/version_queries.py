"""Queries over the version log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import versions as ops
from docketry.plans.bindings import SQL, ingredients, nested, table, versions

S, D = SparkSession, DataFrame


def _joined(df: D) -> D:
    return df.withColumns({"unsummable": F.array_join("unsummable", "|"), "summed_value": F.round("summed_value", 2)})


def o07_snapshot_upsert(s: S, d: str) -> D:
    return ops.upserted(table(s, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "props"])


def _split_log(s: S, d: str) -> tuple[D, D]:
    log = versions(s, d)
    return log.where("created < '1998-01-01'"), log.where("created >= '1998-01-01'").drop("version")


def o08_append_version(s: S, d: str) -> D:
    existing, new = _split_log(s, d)
    return ops.appended(existing, new, ["created", "doc_key"]).select("recipe_id", "doc_key", "version")


def o08_version_conflicts(s: S, d: str) -> D:
    existing, new = _split_log(s, d)
    return ops.version_conflicts(existing, new.withColumn("version", F.lit(3))).select("recipe_id", "version", "doc_key")


def o09_projection_rebuild(s: S, d: str) -> D:
    """Stored rows and rows made anew meet by their document, and are compared inside it."""
    return ops.agreement_of(_rebuilt(ingredients(s, d), nested(s, d)))


def _rebuilt(stored: D, documents: D) -> D:
    fields = ["name", "unit", "val_kind", "val_value", "val_source_text", "source_text"]
    before = stored.groupBy("doc_key").agg(F.collect_list(F.struct("recipe_id", "version", "group_ordinal", "ordinal", *fields)).alias("stored"))
    own = lambda x: F.struct("recipe_id", "version", x["group_ordinal"].alias("group_ordinal"), x["ordinal"].alias("ordinal"), *[x["i"][f].alias(f) for f in fields])
    rows = documents.select("doc.doc_key", F.transform(ops.projection(F.col("doc")), own).alias("rows"))
    after = rows.groupBy("doc_key").agg(F.flatten(F.collect_list("rows")).alias("rebuilt"))
    return ops.gathered_differences(before.join(after, "doc_key", "full_outer"), ["doc_key"], "stored", "rebuilt")


def _latest(s: S, d: str) -> D:
    """The latest version of each recipe: the only documents that shopping makes."""
    return ops.latest_rows(versions(s, d).select("recipe_id", "version", "doc_key", "title"))


def o11_shopping(s: S, d: str) -> D:
    return _joined(ops.shopping(ingredients(s, d, _latest(s, d))))


def o11_shopping_nested(s: S, d: str) -> D:
    return _joined(ops.shopping(ops.extracted(nested(s, d, _latest(s, d)))))


def o12_library(s: S, d: str) -> D:
    return ops.library(versions(s, d))


def o13_extraction(s: S, d: str) -> D:
    return ops.extracted(nested(s, d))


def o16_two_versions(s: S, d: str) -> D:
    return versions(s, d).where(F.col("version").isin(1, 2)).select("recipe_id", "version", "doc_key", "title")


def o17_latest_rows(s: S, d: str) -> D:
    return ops.latest_rows(versions(s, d)).select("recipe_id", "version", "doc_key", "status")


def o18_load_by_key(s: S, d: str) -> D:
    return versions(s, d).where("recipe_id = 7 AND version = 1").select("recipe_id", "version", "doc_key")


def o19_plan_violations(s: S, d: str) -> D:
    log = versions(s, d)
    plans = log.select("recipe_id", (F.col("version") + F.expr("CASE WHEN doc_key % 3 = 0 THEN 1 ELSE 0 END")).alias("version"), "doc_key")
    return ops.dangling(plans, log, ["recipe_id", "version"]).select("recipe_id", "version", "doc_key")


def _digests(s: S, d: str) -> D:
    return table(s, d, "events").withColumn("digest", F.sha2(F.concat(F.lit("grant-"), F.col("user_id").cast("string")), 256))


def o20_grants_inserted(s: S, d: str) -> D:
    return ops.inserted_if_absent(_digests(s, d).where("event_type = 'signup'"), "digest", ["ts", "event_id"]).select("digest", "user_id", "event_id")


def o20_grants_resolved(s: S, d: str) -> D:
    mints = ops.inserted_if_absent(_digests(s, d).where("event_type = 'signup'"), "digest", ["ts", "event_id"])
    return ops.resolved_grants(mints, _digests(s, d).where("event_type = 'error' AND value > 40")).select("digest", "user_id", "event_id")


def o21_decomposition(s: S, d: str) -> D:
    out = None
    for name, t in ops.decomposed(nested(s, d)).items():
        one = t.agg(F.lit(name).alias("relation"), F.count("*").alias("n_rows"), F.count_distinct("recipe_id").alias("n_recipes"))
        out = one if out is None else out.union(one)
    return out


def o22_recomposition(s: S, d: str) -> D:
    again = ops.recomposed(ops.decomposed(nested(s, d)))
    names = F.array_join(F.flatten(F.transform("doc.groups", lambda g: F.transform(g["ingredients"], lambda i: i["name"]))), "|")
    return again.select("recipe_id", "version", "doc.doc_key", "doc.title", F.size("doc.groups").alias("n_groups"), names.alias("names"))


def o22_round_trip(s: S, d: str) -> D:
    docs = nested(s, d)
    text = lambda x: x.select("recipe_id", "version", F.to_json("doc").alias("doc"))
    return ops.agreement(text(docs), text(ops.recomposed(ops.decomposed(docs))))


def o23_agreement(s: S, d: str) -> D:
    return ops.agreement(o11_shopping(s, d), o11_shopping_nested(s, d))


def _leaves(log: D) -> D:
    """Scalar leaves of each version, as path, kind and text."""
    items = F.array(
        F.struct(F.lit("/title").alias("path"), F.lit("string").alias("kind"), F.col("title").alias("text")),
        F.struct(F.lit("/status").alias("path"), F.lit("string").alias("kind"), F.col("status").alias("text")),
        F.struct(F.lit("/source/key").alias("path"), F.when(F.col("doc_key") % 2 == 0, "number").otherwise("string").alias("kind"), F.col("recipe_id").cast("string").alias("text")),
        F.struct(F.lit("/source/doc").alias("path"), F.lit("number").alias("kind"), F.col("doc_key").cast("string").alias("text")),
    )
    return log.select("recipe_id", "version", F.explode(items).alias("x")).select("recipe_id", "version", "x.*").where("text IS NOT NULL")


def _last_two(s: S, d: str) -> tuple[D, D]:
    log = versions(s, d)
    last = ops.latest(log)
    before = log.join(last.select("recipe_id", (F.col("version") - 1).alias("version")), ["recipe_id", "version"])
    after = log.join(last.where("version > 1"), ["recipe_id", "version"])
    return _leaves(before).drop("version"), _leaves(after).drop("version")


def o15_version_diff(s: S, d: str) -> D:
    return ops.leaf_diff(*_last_two(s, d), ["recipe_id"])


def o15_same_leaves(s: S, d: str) -> D:
    return ops.same_leaves(*_last_two(s, d), ["recipe_id"])


def a9_diff_branches(s: S, d: str) -> D:
    return ops.branches(o15_version_diff(s, d))


def o25_json_path(s: S, d: str) -> D:
    return table(s, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')").alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


def o26_null_safe(s: S, d: str) -> D:
    rows = ingredients(s, d)
    return rows.groupBy("val_kind").agg(
        F.count(F.when(~F.col("val_kind").eqNullSafe(F.lit("exact")), 1)).alias("not_exact"),
        F.count(F.nullif(F.trim("val_source_text"), F.lit(""))).alias("with_wording"), F.count("*").alias("n"))


def o27_optional_filter(s: S, d: str, recipe_id: int | None = None) -> D:
    rows = versions(s, d)
    return (rows if recipe_id is None else rows.where(F.col("recipe_id") == recipe_id)).select("recipe_id", "version")


def o29_existence(s: S, d: str) -> D:
    return versions(s, d).agg((F.count_if(F.col("recipe_id") == 7) > 0).alias("known"), (F.count_if((F.col("recipe_id") == 7) & (F.col("version") == 999)) > 0).alias("version_known"))


def o32_latest_join(s: S, d: str) -> D:
    return ingredients(s, d).join(ops.latest(versions(s, d)), ["recipe_id", "version"]).groupBy("recipe_id", "version").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def o33_lateral_unnest(s: S, d: str) -> D:
    groups = nested(s, d).select("recipe_id", "version", F.posexplode("doc.groups").alias("group_ordinal", "g"))
    return groups.select("recipe_id", "version", "group_ordinal", "g.title", F.size("g.ingredients").alias("n"))


def o34_lookup_missing(s: S, d: str) -> D:
    """Uses of entities that do not exist: suppliers of lines against suppliers with a positive balance."""
    uses = table(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return ops.dangling(uses, table(s, d, "supplier").where("s_acctbal > 0"), ["s_suppkey"]).groupBy("s_suppkey").agg(F.count("*").alias("uses"))


def o35_dangling_refs(s: S, d: str) -> D:
    return ops.dangling(table(s, d, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey")), table(s, d, "orders"), ["o_custkey"]).select("c_custkey")


def o36_full_outer(s: S, d: str) -> D:
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(s, d, "supplier").where("s_nationkey % 3 != 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer")


def o39_set_difference(s: S, d: str) -> D:
    """Names that only one of a recipe's first two versions has, or both with another unit; the last duplicate counts."""
    rows = ingredients(s, d).where("version IN (1, 2)")
    last = rows.groupBy("recipe_id", "version", "name").agg(F.max_by(F.coalesce("unit", F.lit("")), F.struct("group_ordinal", "ordinal")).alias("unit"))
    a, b = (last.where(f"version = {v}").select("recipe_id", "name", F.col("unit").alias(f"u{v}")) for v in (1, 2))
    both = a.join(b, ["recipe_id", "name"], "full_outer")
    state = F.when(F.col("u2").isNull(), "missing").when(F.col("u1").isNull(), "extra").when(F.col("u1") != F.col("u2"), "changed")
    return both.select("recipe_id", "name", state.alias("state")).where("state IS NOT NULL")


def w1_first_per_key(s: S, d: str) -> D:
    return ops.latest_rows(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def w3_step_positions(s: S, d: str) -> D:
    docs = nested(s, d)
    flat = F.flatten(F.transform("doc.groups", lambda g: g["ingredients"]))
    out = docs.select("recipe_id", "version", F.posexplode(flat).alias("pos", "i"))
    return out.select("recipe_id", "version", (F.col("pos") + 1).alias("n"), "i.name")


def x1_set_operations(s: S, d: str) -> D:
    rows = ingredients(s, d)
    first, second = (rows.where(f"version = {v}").select("name") for v in (1, 2))
    tagged = [("union", first.union(second).distinct()), ("only_first", first.distinct().exceptAll(second.distinct())), ("both", first.intersect(second))]
    out = None
    for name, df in tagged:
        one = df.agg(F.lit(name).alias("operation"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


QUERIES = {n: f for n, f in globals().items() if n[0] in "oawx" and n.split("_")[0][1:].isdigit() and callable(f)}

_SHOP = """
latest AS (SELECT recipe_id, max(version) AS version FROM versions GROUP BY recipe_id),
lines AS (
  SELECT lower(trim(name, ' ')) AS ingredient, coalesce(unit, '') AS unit, recipe_id,
         CASE WHEN val_kind = 'exact' THEN val_value END AS exact,
         CASE WHEN val_kind IS DISTINCT FROM 'exact' THEN coalesce(nullif(trim(val_source_text, ' '), ''), source_text) END AS wording
  FROM ingredients JOIN latest USING (recipe_id, version)),
shopping AS (
  SELECT ingredient, unit, count(DISTINCT recipe_id) AS recipe_count, count(exact) AS exact_count, round(sum(exact), 2) AS summed_value,
         count(wording) AS unsummable_count, coalesce(array_to_string(list_sort(list(wording) FILTER (wording IS NOT NULL)), '|'), '') AS unsummable
  FROM lines GROUP BY ingredient, unit)
"""
_TWO = """
last AS (SELECT recipe_id, max(version) AS m FROM versions GROUP BY 1 HAVING max(version) > 1),
leaves AS (
  SELECT recipe_id, version, unnest([
    {'path': '/title', 'kind': 'string', 'text': title}, {'path': '/status', 'kind': 'string', 'text': status},
    {'path': '/source/key', 'kind': CASE WHEN doc_key % 2 = 0 THEN 'number' ELSE 'string' END, 'text': recipe_id::VARCHAR},
    {'path': '/source/doc', 'kind': 'number', 'text': doc_key::VARCHAR}], recursive := true)
  FROM versions),
a AS (SELECT recipe_id, path, kind, text FROM leaves JOIN last USING (recipe_id) WHERE version = m - 1 AND text IS NOT NULL),
b AS (SELECT recipe_id, path, kind, text FROM leaves JOIN last USING (recipe_id) WHERE version = m AND text IS NOT NULL),
diff AS (
  SELECT coalesce(a.recipe_id, b.recipe_id) AS recipe_id, coalesce(a.path, b.path) AS path,
         CASE WHEN a.text IS NOT DISTINCT FROM b.text THEN a.text || ' (' || a.kind || ')' ELSE a.text END AS before,
         CASE WHEN a.text IS NOT DISTINCT FROM b.text THEN b.text || ' (' || b.kind || ')' ELSE b.text END AS after
  FROM a FULL OUTER JOIN b ON a.recipe_id = b.recipe_id AND a.path = b.path
  WHERE a.text IS DISTINCT FROM b.text OR a.kind IS DISTINCT FROM b.kind)
"""
W = f"WITH {SQL}"
_DIGEST = "sha256('grant-' || user_id)"

ORACLES = {
    "o07_snapshot_upsert": "SELECT user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "o08_append_version": f"{W}, old AS (SELECT recipe_id, max(version) AS m FROM versions WHERE created < '1998-01-01' GROUP BY 1) SELECT v.recipe_id, doc_key, (coalesce(m, 0) + row_number() OVER (PARTITION BY v.recipe_id ORDER BY created, doc_key))::INTEGER AS version FROM versions v LEFT JOIN old USING (recipe_id) WHERE created >= '1998-01-01'",
    "o08_version_conflicts": f"{W} SELECT n.recipe_id, 3 AS version, n.doc_key FROM versions n WHERE n.created >= '1998-01-01' AND EXISTS (SELECT 1 FROM versions e WHERE e.created < '1998-01-01' AND e.recipe_id = n.recipe_id AND e.version = 3)",
    "o09_projection_rebuild": "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right",
    "o11_shopping": f"{W}, {_SHOP} SELECT * FROM shopping",
    "o11_shopping_nested": f"{W}, {_SHOP} SELECT * FROM shopping",
    "o12_library": f"{W} SELECT v.recipe_id, v.version AS latest_version, v.title FROM versions v JOIN (SELECT recipe_id, max(version) AS m FROM versions GROUP BY 1) USING (recipe_id) WHERE version = m",
    "o13_extraction": f"{W} SELECT recipe_id, version, group_ordinal, ordinal, name, unit, val_kind, val_value, val_source_text, source_text FROM ingredients",
    "o15_version_diff": f"{W}, {_TWO} SELECT * FROM diff",
    "o15_same_leaves": f"{W}, {_TWO} SELECT recipe_id, count(*) AS same FROM a JOIN b USING (recipe_id, path, kind, text) GROUP BY 1",
    "a9_diff_branches": f"{W}, {_TWO} SELECT string_split(path, '/')[2] AS branch, count(*) AS n FROM diff GROUP BY 1",
    "o16_two_versions": f"{W} SELECT recipe_id, version, doc_key, title FROM versions WHERE version IN (1, 2)",
    "o17_latest_rows": f"{W} SELECT recipe_id, version, doc_key, status FROM versions QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY version DESC) = 1",
    "o18_load_by_key": f"{W} SELECT recipe_id, version, doc_key FROM versions WHERE recipe_id = 7 AND version = 1",
    "o19_plan_violations": f"{W}, plans AS (SELECT recipe_id, version + CASE WHEN doc_key % 3 = 0 THEN 1 ELSE 0 END AS version, doc_key FROM versions) SELECT recipe_id, version, doc_key FROM plans p WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.recipe_id = p.recipe_id AND v.version = p.version)",
    "o20_grants_inserted": f"SELECT {_DIGEST} AS digest, user_id, event_id FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "o20_grants_resolved": f"SELECT {_DIGEST} AS digest, user_id, event_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "o21_decomposition": f"{W} SELECT 'documents' AS relation, count(*) AS n_rows, count(DISTINCT recipe_id) AS n_recipes FROM versions UNION ALL SELECT 'groups', count(*), count(DISTINCT recipe_id) FROM (SELECT DISTINCT recipe_id, version, group_ordinal FROM ingredients) UNION ALL SELECT 'ingredients', count(*), count(DISTINCT recipe_id) FROM ingredients",
    "o22_recomposition": f"{W}, g AS (SELECT recipe_id, version, count(DISTINCT group_ordinal) AS n, string_agg(name, '|' ORDER BY group_ordinal, ordinal) AS names FROM ingredients GROUP BY 1, 2) SELECT v.recipe_id, v.version, doc_key, title, coalesce(n, 0)::INTEGER AS n_groups, coalesce(names, '') AS names FROM versions v LEFT JOIN g USING (recipe_id, version)",
    "o22_round_trip": "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right",
    "o23_agreement": "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right",
    "o25_json_path": "SELECT event_id, (props->>'$.k')::DOUBLE AS k, props->>'$.k' AS k_text FROM events",
    "o26_null_safe": f"{W} SELECT val_kind, count(*) FILTER (val_kind IS DISTINCT FROM 'exact') AS not_exact, count(nullif(trim(val_source_text, ' '), '')) AS with_wording, count(*) AS n FROM ingredients GROUP BY 1",
    "o27_optional_filter": f"{W} SELECT recipe_id, version FROM versions",
    "o29_existence": f"{W} SELECT count(*) FILTER (recipe_id = 7) > 0 AS known, count(*) FILTER (recipe_id = 7 AND version = 999) > 0 AS version_known FROM versions",
    "o32_latest_join": f"{W}, latest AS (SELECT recipe_id, max(version) AS version FROM versions GROUP BY 1) SELECT recipe_id, version, count(*) AS n, min(name) AS first_name FROM ingredients JOIN latest USING (recipe_id, version) GROUP BY 1, 2",
    "o33_lateral_unnest": f"{W} SELECT recipe_id, version, group_ordinal, group_title AS title, count(*)::INTEGER AS n FROM ingredients GROUP BY 1, 2, 3, 4",
    "o34_lookup_missing": "SELECT l_suppkey AS s_suppkey, count(*) AS uses FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "o35_dangling_refs": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "o36_full_outer": "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) FULL OUTER JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_nationkey % 3 != 0 GROUP BY 1) USING (nation)",
    "o39_set_difference": f"{W}, last AS (SELECT recipe_id, version, name, arg_max(coalesce(unit, ''), group_ordinal * 1000 + ordinal) AS unit FROM ingredients WHERE version IN (1, 2) GROUP BY 1, 2, 3) SELECT recipe_id, name, CASE WHEN b.unit IS NULL THEN 'missing' WHEN a.unit IS NULL THEN 'extra' ELSE 'changed' END AS state FROM (SELECT * FROM last WHERE version = 1) a FULL OUTER JOIN (SELECT * FROM last WHERE version = 2) b USING (recipe_id, name) WHERE a.unit IS DISTINCT FROM b.unit",
    "w1_first_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "w3_step_positions": f"{W} SELECT recipe_id, version, row_number() OVER (PARTITION BY recipe_id, version ORDER BY group_ordinal, ordinal)::INTEGER AS n, name FROM ingredients",
    "x1_set_operations": f"{W}, p AS (SELECT DISTINCT name FROM ingredients WHERE version = 1), q AS (SELECT DISTINCT name FROM ingredients WHERE version = 2) SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM p UNION SELECT * FROM q) UNION ALL SELECT 'only_first', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM q)",
}
