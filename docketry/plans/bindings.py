"""How the driver's tables stand for the document model.

recipe = customer; its versions = the customer's orders by (date, key); title = order priority, declared absent for
status P; ingredient groups = return flags of an order's lines; ingredients = lines. Line keys repeat, so ordinals
are ordered by all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recipe_id, version, doc_key, title, total, status, created)"""
    orders = table(spark, sf_dir, "orders")
    at = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("recipe_id"), F.row_number().over(at).alias("version"), F.col("o_orderkey").alias("doc_key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"),
        F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"),
    )


def ingredients(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """The flattened projection of every version, or of those whose (recipe_id, version, doc_key) are wanted: a row for each line."""
    return (versions(spark, sf_dir) if wanted is None else wanted).select("recipe_id", "version", "doc_key").join(lines(spark, sf_dir, wanted), "doc_key")


def lines(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """The lines of all orders as ingredients(), or of those whose doc_key is wanted: the others do not meet their parts."""
    raw = table(spark, sf_dir, "lineitem")
    if wanted is not None:
        raw = raw.join(wanted.select(F.col("doc_key").alias("l_orderkey")), "l_orderkey", "left_semi")
    return lines_of(raw, spark, sf_dir)


def lines_of(lineitem: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of whole orders as ingredients().

    Lines are dealt out by doc_key, the name they keep, so that what meets them by it needs no further shuffle; texts are
    made when the lines have met, or they would be shuffled too.
    """
    lines = lineitem.withColumnRenamed("l_orderkey", "doc_key").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    group = Window.partitionBy("doc_key").orderBy("l_returnflag")
    item = Window.partitionBy("doc_key", "l_returnflag").orderBy(*LINE_ORDER)
    placed = lines.withColumns({"group_ordinal": F.dense_rank().over(group) - 1, "ordinal": F.row_number().over(item) - 1})
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'range' WHEN 2 THEN 'qualitative' END")
    return placed.select(
        "doc_key", "group_ordinal", "ordinal",
        F.col("l_returnflag").alias("group_title"), F.col("p_name").alias("name"), F.expr("nullif(l_linestatus, 'O')").alias("unit"), kind.alias("val_kind"),
        F.expr("CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 11 != 0 THEN l_quantity END").alias("val_value"),
        F.expr("CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 2 AND l_suppkey % 5 = 0 THEN '  ' ELSE concat(' ', cast(cast(l_quantity AS int) AS string), ' ') END").alias("val_source_text"),
        F.expr("concat(cast(cast(l_quantity AS int) AS string), ' of ', p_name)").alias("source_text"),
    )


def nested(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """(recipe_id, version, doc): one nested document for each version; versions without lines have no groups.

    wanted holds (recipe_id, version, doc_key, title) of the documents to make; without it, all are made. An order's lines
    meet once, by its key, for their places and their document alike.
    """
    fields = ["name", "unit", "val_kind", "val_value", "val_source_text", "source_text"]
    log = versions(spark, sf_dir) if wanted is None else wanted
    items = lines(spark, sf_dir, wanted).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("group_ordinal", "ordinal", "group_title", *fields))).alias("items"))
    of = lambda items, k: F.filter(items, lambda x: x["group_ordinal"] == k)
    ordinals = F.array_distinct(F.transform("items", lambda x: x["group_ordinal"]))
    group = lambda own: F.struct(F.get(own, F.lit(0))["group_title"].alias("title"), F.transform(own, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("ingredients"))
    docs = items.select("doc_key", F.transform(ordinals, lambda k: group(of(F.col("items"), k))).alias("groups"))
    joined = log.join(docs, "doc_key", "left")
    empty = F.array().cast(dict(docs.dtypes)["groups"])
    return joined.select("recipe_id", "version", F.struct("doc_key", "title", F.coalesce("groups", empty).alias("groups")).alias("doc"))


_ITEM = """named_struct(
  'g', group_ordinal, 'o', ordinal, 'title', group_title,
  'ingredient', named_struct(
    'id', concat('i', group_ordinal, '-', ordinal), 'sourceText', CASE WHEN doc_key % 9 = 4 AND ordinal = 1 THEN ' ' ELSE source_text END,
    'quantityExpression', CASE WHEN val_kind IS NOT NULL THEN named_struct('sourceText', val_source_text, 'kind', val_kind, 'value', val_value) END,
    'unit', unit, 'name', name, 'qualifiers', cast(array() AS array<string>), 'scalingEligibility', CASE WHEN unit IS NULL THEN 'unknown' ELSE 'proportional' END,
    'sourceRefs', filter(array(named_struct('blockId', concat_ws('-', 'b', doc_key, group_ordinal, ordinal))), x -> ordinal % 3 != 0)),
  'step', named_struct(
    'id', concat('t', group_ordinal, '-', ordinal), 'sourceText', CASE WHEN doc_key % 9 = 5 AND ordinal = 1 THEN '' ELSE concat('Add ', source_text) END, 'normalizedActionText', concat('add ', name),
    'sourceRefs', array(named_struct('blockId', concat_ws('-', 'b', doc_key, group_ordinal, ordinal))),
    'ingredientUses', array(named_struct(
      'ingredientId', concat('i', group_ordinal, '-', ordinal),
      'usage', element_at(array('use_now', 'reserve_for_later', 'use_remaining', 'use_partial_unspecified', 'use_all'), cast((group_ordinal + ordinal) % 5 + 1 AS int)),
      'quantityExpression', CASE WHEN val_kind = 'range' AND ordinal % 2 = 0 THEN named_struct('sourceText', val_source_text, 'kind', val_kind) END,
      'unit', CASE WHEN val_kind = 'range' AND ordinal % 2 = 0 THEN unit END, 'sourceRefs', cast(array() AS array<string>))),
    'componentUses', filter(array(named_struct('componentId', concat('c', group_ordinal - 1), 'usage', 'use_all', 'sourceRefs', cast(array() AS array<string>))), x -> ordinal = 0 AND group_ordinal > 0),
    'equipmentUses', cast(array() AS array<string>),
    'producesComponents', filter(array(concat('c', group_ordinal)), x -> ordinal = 0),
    'durations', filter(array(named_struct('durationExpression', named_struct('sourceText', val_source_text, 'kind', val_kind, 'value', val_value, 'unit', 'min'), 'sourceRefs', cast(array() AS array<string>))), x -> val_value IS NOT NULL),
    'temperatures', cast(array() AS array<string>), 'donenessCues', cast(array() AS array<string>),
    'prerequisiteCues', filter(array(named_struct('sourceText', CASE WHEN ordinal % 2 = 0 THEN concat('Chill the ', name) ELSE name END, 'sourceRefs', array(named_struct('payloadPointer', '/status')))), x -> val_kind = 'qualitative'),
    'waitCues', filter(array(named_struct('sourceText', concat('wait for ', name), 'sourceRefs', cast(array() AS array<string>))), x -> val_kind IS NULL)))"""
_DOCUMENT = """named_struct(
  'id', concat('r-', recipe_id, '-', version), 'schemaVersion', '2.0.0',
  'title', CASE WHEN title IS NULL THEN named_struct('state', 'not_in_source', 'sourceText', cast(null AS string), 'sourceRefs', cast(null AS array<struct<blockId: string>>))
                ELSE named_struct('state', 'from_source', 'sourceText', title, 'sourceRefs', array(named_struct('blockId', concat('b-', doc_key)))) END,
  'description', CASE WHEN doc_key % 4 = 1 THEN concat('made on ', created) END,
  'authors', element_at(array(cast(null AS array<string>), array('  '), array(' Ann ', ''), array('Bo', 'Cy')), cast(doc_key % 4 + 1 AS int)),
  'sourceName', CASE WHEN status = 'F' THEN 'archive' END,
  'sourcePublisher', CASE WHEN doc_key % 3 = 0 THEN 'press' END,
  'yields', array(named_struct('id', 'y1', 'sourceText', concat('about ', status), 'valueExpression', named_struct('sourceText', status, 'kind', 'exact', 'value', total),
                               'scalingEligibility', 'unknown', 'sourceRefs', array(named_struct('payloadPointer', '/total')))),
  'times', array(
    named_struct('type', 'prep', 'durationExpression', named_struct('sourceText', 'prep time', 'kind', CASE WHEN status = 'P' THEN 'range' ELSE 'exact' END, 'value', doc_key % 7 * 15.5D,
                 'unit', element_at(array('min', 'Std', 'fortnight', '', cast(null AS string)), cast(doc_key % 5 + 1 AS int))), 'sourceRefs', cast(array() AS array<string>)),
    named_struct('type', 'bake', 'durationExpression', named_struct('sourceText', 'bake', 'kind', CASE WHEN doc_key % 2 = 0 THEN 'exact' ELSE 'minimum' END, 'value', 1.0D, 'unit', 'h'), 'sourceRefs', cast(array() AS array<string>)),
    named_struct('type', 'cook', 'durationExpression', named_struct('sourceText', 'cook', 'kind', 'exact', 'value', 2.0D, 'unit', 'h'), 'sourceRefs', cast(array() AS array<string>)),
    named_struct('type', 'rest', 'durationExpression', named_struct('sourceText', 'overnight', 'kind', 'qualitative', 'value', cast(null AS double), 'unit', cast(null AS string)), 'sourceRefs', cast(array() AS array<string>)),
    named_struct('type', 'total', 'durationExpression', named_struct('sourceText', 'in all', 'kind', 'exact', 'value', doc_key % 90 + 3600.0D, 'unit', 's'), 'sourceRefs', cast(array() AS array<string>))),
  'equipment', filter(array(named_struct('id', 'e1', 'sourceText', 'a bowl', 'name', 'bowl', 'qualifiers', cast(array() AS array<string>), 'sourceRefs', array(named_struct('blockId', concat('b-', doc_key))))), x -> status = 'O'),
  'ingredientGroups', transform(groups, g -> named_struct(
    'id', concat('g', g), 'title', filter(items, x -> x.g = g)[0].title, 'sourceRefs', array(named_struct('blockId', concat_ws('-', 'b', doc_key, g))),
    'ingredients', transform(filter(items, x -> x.g = g), x -> x.ingredient))),
  'preparedComponents', transform(groups, g -> named_struct('id', concat('c', g), 'label', concat('mix ', g), 'createdByStepId', concat('t', g, '-0'), 'sourceRefs', cast(array() AS array<string>))),
  'instructionSections', transform(groups, g -> named_struct(
    'id', concat('s', g), 'title', filter(items, x -> x.g = g)[0].title, 'sourceRefs', cast(array() AS array<string>),
    'steps', transform(filter(items, x -> x.g = g), x -> x.step))),
  'provenance', named_struct('sourceSnapshotId', concat('snap-', doc_key), 'sourceSnapshotVersion', 1, 'targetOntologyVersion', '1', 'runId', 'run-1'))"""


def documents(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """(recipe_id, version, doc_key, status, total, json): each version as a whole document of the contract, as JSON.

    Groups of lines are ingredient groups, and instruction sections with a step for each line. A version without lines
    has neither. wanted holds the doc_key of the documents to make; without it, all are made.
    """
    log, raw = versions(spark, sf_dir), table(spark, sf_dir, "lineitem")
    if wanted is not None:
        log, raw = log.join(wanted, "doc_key", "left_semi"), raw.join(wanted.withColumnRenamed("doc_key", "l_orderkey"), "l_orderkey", "left_semi")
    lines = lines_of(raw, spark, sf_dir).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.expr(_ITEM))).alias("items"))
    rows = log.join(lines, "doc_key", "left")
    none = F.array().cast(dict(lines.dtypes)["items"])
    rows = rows.withColumn("items", F.coalesce("items", none)).withColumn("groups", F.expr("array_distinct(transform(items, x -> x.g))"))
    return rows.select("recipe_id", "version", "doc_key", "status", "total", F.to_json(F.expr(_DOCUMENT)).alias("json"))


def _object(**members: str) -> str:
    """DuckDB's object of the members that are not null."""
    return "json_merge_patch('{}', json_object(" + ", ".join(f"'{k}', {v}" for k, v in members.items()) + "))"


_NO = "'[]'::JSON"
_LINE_BLOCK = "json_array(json_object('blockId', concat_ws('-', 'b', doc_key, group_ordinal, ordinal)))"
_INGREDIENT = _object(
    id="'i' || group_ordinal || '-' || ordinal", sourceText="CASE WHEN doc_key % 9 = 4 AND ordinal = 1 THEN ' ' ELSE source_text END",
    quantityExpression=f"CASE WHEN val_kind IS NOT NULL THEN {_object(sourceText='val_source_text', kind='val_kind', value='val_value')} END",
    unit="unit", name="name", qualifiers=_NO, scalingEligibility="CASE WHEN unit IS NULL THEN 'unknown' ELSE 'proportional' END",
    sourceRefs=f"CASE WHEN ordinal % 3 != 0 THEN {_LINE_BLOCK} ELSE {_NO} END",
)
_STEP = _object(
    id="'t' || group_ordinal || '-' || ordinal", sourceText="CASE WHEN doc_key % 9 = 5 AND ordinal = 1 THEN '' ELSE 'Add ' || source_text END", normalizedActionText="'add ' || name", sourceRefs=_LINE_BLOCK,
    ingredientUses="json_array(" + _object(
        ingredientId="'i' || group_ordinal || '-' || ordinal",
        usage="['use_now', 'reserve_for_later', 'use_remaining', 'use_partial_unspecified', 'use_all'][(group_ordinal + ordinal) % 5 + 1]",
        quantityExpression="CASE WHEN val_kind = 'range' AND ordinal % 2 = 0 THEN json_object('sourceText', val_source_text, 'kind', val_kind) END",
        unit="CASE WHEN val_kind = 'range' AND ordinal % 2 = 0 THEN unit END", sourceRefs=_NO) + ")",
    componentUses=f"CASE WHEN ordinal = 0 AND group_ordinal > 0 THEN json_array(json_object('componentId', 'c' || (group_ordinal - 1), 'usage', 'use_all', 'sourceRefs', {_NO})) ELSE {_NO} END",
    equipmentUses=_NO, producesComponents=f"CASE WHEN ordinal = 0 THEN json_array('c' || group_ordinal) ELSE {_NO} END",
    durations=f"CASE WHEN val_value IS NOT NULL THEN json_array(json_object('durationExpression', json_object('sourceText', val_source_text, 'kind', val_kind, 'value', val_value, 'unit', 'min'), 'sourceRefs', {_NO})) ELSE {_NO} END",
    temperatures=_NO, donenessCues=_NO,
    prerequisiteCues=f"CASE WHEN val_kind = 'qualitative' THEN json_array(json_object('sourceText', CASE WHEN ordinal % 2 = 0 THEN 'Chill the ' || name ELSE name END, 'sourceRefs', json_array(json_object('payloadPointer', '/status')))) ELSE {_NO} END",
    waitCues=f"CASE WHEN val_kind IS NULL THEN json_array(json_object('sourceText', 'wait for ' || name, 'sourceRefs', {_NO})) ELSE {_NO} END",
)


def _time(kind: str, text: str, how: str, value: str, unit: str) -> str:
    return f"json_object('type', '{kind}', 'durationExpression', {_object(sourceText=f"'{text}'", kind=how, value=value, unit=unit)}, 'sourceRefs', {_NO})"


_TIMES = ", ".join([
    _time("prep", "prep time", "CASE WHEN status = 'P' THEN 'range' ELSE 'exact' END", "doc_key % 7 * 15.5::DOUBLE", "['min', 'Std', 'fortnight', '', NULL][doc_key % 5 + 1]"),
    _time("bake", "bake", "CASE WHEN doc_key % 2 = 0 THEN 'exact' ELSE 'minimum' END", "1.0::DOUBLE", "'h'"), _time("cook", "cook", "'exact'", "2.0::DOUBLE", "'h'"),
    _time("rest", "overnight", "'qualitative'", "NULL", "NULL"), _time("total", "in all", "'exact'", "doc_key % 90 + 3600.0::DOUBLE", "'s'"),
])
_GROUP = _object(id="'g' || group_ordinal", title="group_title", sourceRefs="json_array(json_object('blockId', concat_ws('-', 'b', doc_key, group_ordinal)))", ingredients="ingredients")
_ROOT = _object(
    id="'r-' || recipe_id || '-' || version", schemaVersion="'2.0.0'",
    title="CASE WHEN title IS NULL THEN json_object('state', 'not_in_source') ELSE json_object('state', 'from_source', 'sourceText', title, 'sourceRefs', json_array(json_object('blockId', 'b-' || doc_key))) END",
    description="CASE WHEN doc_key % 4 = 1 THEN 'made on ' || created END",
    authors="CASE doc_key % 4 WHEN 1 THEN json_array('  ') WHEN 2 THEN json_array(' Ann ', '') WHEN 3 THEN json_array('Bo', 'Cy') END",
    sourceName="CASE WHEN status = 'F' THEN 'archive' END", sourcePublisher="CASE WHEN doc_key % 3 = 0 THEN 'press' END",
    times=f"json_array({_TIMES})",
    equipment=f"CASE WHEN status = 'O' THEN json_array(json_object('id', 'e1', 'sourceText', 'a bowl', 'name', 'bowl', 'qualifiers', {_NO}, 'sourceRefs', json_array(json_object('blockId', 'b-' || doc_key)))) ELSE {_NO} END",
    yields="json_array(json_object('id', 'y1', 'sourceText', 'about ' || status, 'valueExpression', json_object('sourceText', status, 'kind', 'exact', 'value', total), 'scalingEligibility', 'unknown', 'sourceRefs', json_array(json_object('payloadPointer', '/total'))))",
    ingredientGroups=f"coalesce(groups, {_NO})", preparedComponents=f"coalesce(components, {_NO})", instructionSections=f"coalesce(sections, {_NO})",
    provenance="json_object('sourceSnapshotId', 'snap-' || doc_key, 'sourceSnapshotVersion', 1, 'targetOntologyVersion', '1', 'runId', 'run-1')",
)
#: documents() for DuckDB, after SQL: (recipe_id, version, doc_key, status, total, json).
DOCUMENTS_SQL = f"""
grouped AS (
  SELECT doc_key, group_ordinal, any_value(group_title) AS group_title, to_json(list({_INGREDIENT} ORDER BY ordinal)) AS ingredients,
         to_json(list({_STEP} ORDER BY ordinal)) AS steps
  FROM ingredients GROUP BY 1, 2),
gathered AS (
  SELECT doc_key, to_json(list({_GROUP} ORDER BY group_ordinal)) AS groups,
         to_json(list(json_object('id', 'c' || group_ordinal, 'label', 'mix ' || group_ordinal, 'createdByStepId', 't' || group_ordinal || '-0', 'sourceRefs', {_NO}) ORDER BY group_ordinal)) AS components,
         to_json(list({_object(id="'s' || group_ordinal", title="group_title", sourceRefs=_NO, steps="steps")} ORDER BY group_ordinal)) AS sections
  FROM grouped GROUP BY 1),
documents_json AS (
  SELECT recipe_id, version, doc_key, status, total, {_ROOT} AS json FROM versions LEFT JOIN gathered USING (doc_key))
"""

#: The same bindings for DuckDB.
SQL = """
versions AS (
  SELECT o_custkey AS recipe_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version,
         o_orderkey AS doc_key, CASE WHEN o_orderstatus != 'P' THEN o_orderpriority END AS title, o_totalprice AS total,
         o_orderstatus AS status, o_orderdate AS created FROM orders),
ingredients AS (
  SELECT v.recipe_id, v.version, l_orderkey AS doc_key,
         (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1)::INTEGER AS group_ordinal,
         (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) - 1)::INTEGER AS ordinal,
         l_returnflag AS group_title, p_name AS name, nullif(l_linestatus, 'O') AS unit,
         CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'range' WHEN 2 THEN 'qualitative' END AS val_kind,
         CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 11 != 0 THEN l_quantity END AS val_value,
         CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 2 AND l_suppkey % 5 = 0 THEN '  ' ELSE ' ' || l_quantity::INTEGER || ' ' END AS val_source_text,
         l_quantity::INTEGER || ' of ' || p_name AS source_text
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN versions v ON v.doc_key = l_orderkey)
"""
