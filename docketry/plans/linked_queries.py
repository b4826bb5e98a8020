"""Queries over structured data in pages, with their SQL.

The driver's pages hold none, so each page is given scripts of one of SHAPES by its id; `#` stands for the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import linked
from docketry.plans.bindings import table

S, D = SparkSession, DataFrame

_WHOLE = '"recipeIngredient":["flour #","  salt "],"recipeInstructions":"Mix #.\\n\\n Bake. ","recipeYield":4'
_OPEN = '<script type="application/ld+json">'
#: The scripts of the pages whose id leaves 0, 1, 2, ... when divided by their number.
SHAPES = [
    "",
    _OPEN + '{"@type":"Recipe","name":" Pie #",' + _WHOLE + ',"author":{"name":"Ann"},"prepTime":"PT5M","image":"/i/#.jpg","publisher":"Desk"}</script>',
    _OPEN + '{"@graph":[{"@type":"WebPage","name":"x"},{"@type":"Recipe","name":"Pie","recipeIngredient":"flour","recipeInstructions":["Mix",{"text":"Bake"}]}]}</script>',
    _OPEN + '[{"@type":"Recipe","name":"Pie #",' + _WHOLE + '},[{"@type":"Recipe","name":"Cake"}]]</script>',
    _OPEN + '{"@type":"Recipe","name":"PIE  #"}</script><p>' + _OPEN + '{"@type":["Thing","Recipe"],"name":"Pie #",' + _WHOLE + ',"author":[[],["",{"name":"Bo"}]]}</script>',
    _OPEN + '[{"@type":"Recipe","@id":"a#","name":"Pie",' + _WHOLE + '},{"@type":"Recipe","@id":"b","name":"pie"},{"@type":"Recipe","name":"Pie"}]</script>',
    "<SCRIPT id='z' type='application/ld+json' async> <!-- {\"@type\":\"Recipe\",\"name\":7," + _WHOLE.replace(":4", ':[{},"6 slices"]') + "} --> </SCRIPT>",
    _OPEN + '{"@graph":{"@type":"Recipe","name":"Pie",' + _WHOLE + '},"mainEntity":{"@type":"Recipe"}}</script>',
    _OPEN + "{broken</script>" + _OPEN + "/* made # */ {\"@type\":\"Recipe\",\"name\":\"Pie\",\"recipeIngredient\":[\"flour\",3],\"recipeYield\":\"  4 \",\"description\":\"A pie\",\"image\":[{\"url\":\" \"},[\"mailto:x\",{\"contentUrl\":\"//cdn.example.org/p/#.png\"}]],\"publisher\":[{\"name\":\" The Press \"},\"other\"],\"recipeInstructions\":["
    + '{"@type":"HowToSection","name":"Dough","itemListElement":[{"text":"Mix #"},"Rest",{"itemListElement":[{"name":"Fold"}]}]},{"@type":"HowToStep","text":" ","name":"Bake"},5]}</script>',
    _OPEN + '{"@type":"Recipe","name":"  ","recipeIngredient":[],"recipeInstructions":{},"recipeYield":0,"image":""}</script><script>var x = "{}"</script>' + _OPEN + "  </script>",
]


def _pages(s: S, d: str) -> D:
    shapes = F.array(*map(F.lit, SHAPES))
    held = F.replace(F.element_at(shapes, (F.col("page_id") % len(SHAPES) + 1).cast("int")), F.lit("#"), F.col("page_id").cast("string"))
    return table(s, d, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), held))


def o56_page_decisions(s: S, d: str) -> D:
    out = linked.decided(_pages(s, d), "page_id")
    titles = F.array_join(F.transform("titles", lambda t: F.coalesce(t, F.lit("-"))), "|")
    return out.select("page_id", "decision", "n_items", "present", F.array_join("missing", ",").alias("missing"), titles.alias("titles"))


def o57_page_blocks(s: S, d: str) -> D:
    rows = linked.decided(_pages(s, d), "page_id").where("n_items = 1")
    return rows.select("page_id", F.posexplode(linked.blocks(F.col("item"))).alias("ord", "b")).select("page_id", "ord", "b.*")


def o58_captured_text(s: S, d: str) -> D:
    rows = linked.decided(_pages(s, d), "page_id").where("decision = 'sufficient'")
    return rows.select("page_id", F.md5(linked.captured(linked.blocks(F.col("item")))).alias("captured"))


def o59_pictures(s: S, d: str) -> D:
    """The first picture address of a page's item that resolves, and its publisher."""
    rows = linked.decided(_pages(s, d), "page_id").where("n_items = 1").join(table(s, d, "pages").select("page_id", "url"), "page_id")
    return linked.first_pictures(rows, "page_id", "url").join(rows.select("page_id", linked.publisher(F.col("item")).alias("publisher")), "page_id")


def o94_structured_coverage(s: S, d: str) -> D:
    """By the parity of the page; every seventh page was not fetched."""
    pages = _pages(s, d).withColumn("odd", F.col("page_id") % 2 == 1)
    return linked.coverage(pages, fetched=F.col("page_id") % 7 != 3, by=["odd"])


QUERIES = {n: f for n, f in globals().items() if n[0] == "o" and n.split("_")[0][1:].isdigit() and callable(f)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _empty(value: str, blank: str) -> str:
    """DuckDB's test for a member that is absent, null or empty."""
    size = f"WHEN 'ARRAY' THEN json_array_length({value}) = 0 WHEN 'OBJECT' THEN len(json_keys({value})) = 0"
    return f"(({value}) IS NULL OR CASE json_type({value}) WHEN 'NULL' THEN true WHEN 'VARCHAR' THEN {blank.format(value + "->>'$'")} = '' {size} ELSE false END)"


def _shown(value: str) -> str:
    return f"CASE json_type({value}) WHEN 'VARCHAR' THEN nullif(trim({value}->>'$'), '') WHEN 'UBIGINT' THEN {value}->>'$' WHEN 'BIGINT' THEN {value}->>'$' END"


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {_empty(f"node->'{f}'", 'trim({})')} THEN '{f}' END" for f in linked.REQUIRED) + "], lambda x: x IS NOT NULL)"
_HELD = "[" + ", ".join(f"CASE WHEN NOT {_empty(f"node->'{f}'", '({})')} THEN '{f}' END" for f in linked.MEASURED) + "]"
W = rf"""
WITH RECURSIVE shaped AS (
  SELECT page_id, coalesce(html, '') || replace(([{", ".join(map(_quoted, SHAPES))}])[page_id % {len(SHAPES)} + 1], '#', page_id::VARCHAR) AS html FROM pages),
scripts AS (
  SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) AS i
  FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '') AS found FROM shaped)),
read AS (
  SELECT page_id, i, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(bare) THEN bare END AS text
  FROM (SELECT *, trim(regexp_replace(replace(replace(raw, '<!--', ''), '-->', ''), '^\s*/\*(?s:.*?)\*/', '')) AS bare FROM scripts)),
walk AS (
  SELECT page_id, [i] AS pos, text::JSON AS node FROM read WHERE text IS NOT NULL
  UNION ALL
  SELECT page_id, list_append(pos, e.key::BIGINT + 1), e.value
  FROM (SELECT page_id, pos, CASE WHEN json_type(node) = 'ARRAY' THEN node WHEN json_type(node->'@graph') = 'ARRAY' THEN node->'@graph' ELSE '[]'::JSON END AS held FROM walk) w, json_each(w.held) e),
recipes AS (
  SELECT page_id, pos, node, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ord, {_shown("node->'name'")} AS name, {_shown("node->'@id'")} AS id, {_MISSING} AS missing
  FROM walk WHERE json_type(node) = 'OBJECT' AND (node->>'@type' = 'Recipe' OR (json_type(node->'@type') = 'ARRAY' AND list_contains(json_extract_string(node, '$."@type"[*]'), 'Recipe')))),
grouped AS (
  SELECT *, coalesce('name:' || regexp_replace(lower(name), '\s+', ' ', 'g'), 'id:' || id, '#' || ord) AS grp FROM recipes),
counted AS (SELECT *, n_ids > 1 AS split FROM (SELECT * FROM grouped JOIN (SELECT page_id, grp, count(DISTINCT id) AS n_ids, min(ord) AS first FROM grouped GROUP BY 1, 2) USING (page_id, grp))),
items AS (
  SELECT *, min(ord) OVER (PARTITION BY page_id, grp, CASE WHEN split THEN id END) AS item_at FROM counted WHERE NOT split OR id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY page_id, grp, CASE WHEN split THEN id END ORDER BY len(missing), ord) = 1)
"""

#: The blocks of each shape's only item, as they have to come out: (type, heading, text).
_EXPECTED = {
    1: [("title", None, "Pie #"), ("author", None, "Ann"), ("metadata", "recipeYield", "4"), ("metadata", "prepTime", "PT5M"), ("ingredient", None, "flour #"), ("ingredient", None, "salt"), ("instruction", None, "Mix #."), ("instruction", None, "Bake.")],
    2: [("title", None, "Pie"), ("ingredient", None, "flour"), ("instruction", None, "Mix"), ("instruction", None, "Bake")],
    4: [("title", None, "Pie #"), ("author", None, "Bo"), ("metadata", "recipeYield", "4"), ("ingredient", None, "flour #"), ("ingredient", None, "salt"), ("instruction", None, "Mix #."), ("instruction", None, "Bake.")],
    6: [("title", None, "7"), ("metadata", "recipeYield", "6 slices"), ("ingredient", None, "flour #"), ("ingredient", None, "salt"), ("instruction", None, "Mix #."), ("instruction", None, "Bake.")],
    8: [("title", None, "Pie"), ("metadata", "recipeYield", "4"), ("metadata", "description", "A pie"), ("ingredient", None, "flour"), ("ingredient", None, "3"), ("instruction", "Dough", "Mix #"),
        ("instruction", "Dough", "Rest"), ("instruction", "Dough", "Fold"), ("instruction", None, "Bake")],
    9: [("metadata", "recipeYield", "0")],
}
_VALUES = ", ".join(f"({shape}, {k}, '{kind}', {_quoted(heading) if heading else 'NULL'}, {_quoted(text)})" for shape, found in _EXPECTED.items() for k, (kind, heading, text) in enumerate(found))
_PLAIN = f"WITH want(shape, ord, type, heading, text) AS (VALUES {_VALUES})"

ORACLES = {
    "o56_page_decisions": f"{W}, found AS (SELECT page_id, count(*) AS n, any_value(missing) AS missing, array_to_string(list(coalesce(name, '-') ORDER BY first, item_at), '|') AS titles FROM items GROUP BY 1) SELECT page_id, CASE WHEN n > 1 THEN 'multiple' WHEN n IS NULL OR len(missing) > 0 THEN 'insufficient' ELSE 'sufficient' END AS decision, coalesce(n, 0)::INTEGER AS n_items, n IS NOT NULL AS present, CASE WHEN n > 1 THEN '' WHEN n IS NULL THEN '{','.join(linked.REQUIRED)}' ELSE array_to_string(missing, ',') END AS missing, coalesce(titles, '') AS titles FROM pages LEFT JOIN found USING (page_id)",
    "o57_page_blocks": f"{_PLAIN} SELECT page_id, ord::INTEGER AS ord, type, heading, replace(text, '#', page_id::VARCHAR) AS text FROM pages JOIN want ON shape = page_id % {len(SHAPES)}",
    "o58_captured_text": f"{_PLAIN} SELECT page_id, md5(string_agg(concat_ws(': ', heading, replace(text, '#', page_id::VARCHAR)), chr(10) ORDER BY ord)) AS captured FROM pages JOIN want ON shape = page_id % {len(SHAPES)} WHERE shape IN (1, 4, 6, 8) GROUP BY 1",
    "o94_structured_coverage": f"{W}, best AS (SELECT page_id, held, node FROM (SELECT page_id, node, list_filter({_HELD}, lambda x: x IS NOT NULL) AS held, list_transform(pos, lambda p, i: CASE WHEN i = 1 THEN p ELSE -p END) AS back FROM recipes) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(list_intersect(held, {linked.REQUIRED})) DESC, back) = 1), rows AS (SELECT page_id % 2 = 1 AS odd, page_id % 7 != 3 AS got, held, CASE json_type(node->'recipeInstructions') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN CASE json_type(node->'recipeInstructions'->0) WHEN 'OBJECT' THEN 'objects' ELSE 'texts' END END AS shape, node IS NOT NULL AS found, json_type(node->'recipeInstructions') IS NULL AS no_steps FROM pages LEFT JOIN best USING (page_id)) SELECT odd, count(*) AS total, count(*) FILTER (got) AS fetched, count(*) FILTER (got AND found) AS present, count(*) FILTER (got AND len(list_intersect(held, {linked.REQUIRED})) = 4) AS sufficient, "
    + ", ".join(f"count(*) FILTER (got AND list_contains(held, '{f}')) AS has_{f}" for f in linked.MEASURED)
    + ", count(*) FILTER (got AND shape = 'string') AS shape_string, count(*) FILTER (got AND found AND no_steps) AS shape_absent, count(*) FILTER (got AND shape = 'texts') AS shape_texts, count(*) FILTER (got AND shape = 'objects') AS shape_objects FROM rows GROUP BY 1",
    "o59_pictures": f"SELECT page_id, CASE page_id % {len(SHAPES)} WHEN 1 THEN regexp_extract(url, '^https?://[^/?#]+') || '/i/' || page_id || '.jpg' WHEN 8 THEN regexp_extract(url, '^https?:') || '//cdn.example.org/p/' || page_id || '.png' END AS picture, CASE page_id % {len(SHAPES)} WHEN 1 THEN 'Desk' WHEN 8 THEN 'The Press' END AS publisher FROM pages WHERE page_id % {len(SHAPES)} IN (1, 2, 4, 6, 8, 9)",
}
