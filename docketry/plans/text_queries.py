"""Queries over texts, pages and evidence, with their SQL.

In these bindings entities are named ones alone, and NFKC is left out: both leave the driver's texts as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions import linked, trees, web
from docketry.operators import verification as vf
from docketry.plans.bindings import table

S, D = SparkSession, DataFrame


def o03_url_preflight(s: S, d: str) -> D:
    return web.inspect_url(table(s, d, "pages").select("page_id", "url")).select("page_id", "allowed", "code")


def o05_content_ids(s: S, d: str) -> D:
    rows = table(s, d, "documents").select("doc_id", web.content_id(F.col("text").cast("binary")).alias("content_id"))
    return rows.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("puts"))


def o06_media_type(s: S, d: str) -> D:
    head = F.expr("CASE page_id % 4 WHEN 0 THEN X'FFD8FFE000' WHEN 1 THEN X'89504E470D0A1A0A00' WHEN 2 THEN X'524946460000000057454250' ELSE X'474946383961' END")
    return table(s, d, "pages").select("page_id", web.media_type(head).alias("media"))


def o42_html_to_text(s: S, d: str) -> D:
    return table(s, d, "pages").select("page_id", tx.html_to_text(F.col("html"), numeric=False).alias("text"))


def o43_entities(s: S, d: str) -> D:
    return table(s, d, "pages").select("page_id", F.length(tx.decoded(F.col("html"), numeric=False)).alias("n"), F.size(F.regexp_extract_all(tx.decoded(F.col("html"), numeric=False), F.lit("&[a-z]+;"), F.lit(0))).alias("left"))


def o44_normal_form(s: S, d: str) -> D:
    return table(s, d, "documents").select("doc_id", F.md5(tx.normal(F.col("text"), False)).alias("digest"))


def o45_word_tokens(s: S, d: str) -> D:
    words = tx.words(tx.normal(F.col("text"), False))
    return table(s, d, "documents").select("doc_id", F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"))


def _lines(s: S, d: str, first: int | None = None) -> D:
    """(doc_id, ord, line) of all lines of documents, or of the first ones alone.

    No list of lines is empty. Spark makes the lists of a plain explode twice, once to look at their size.
    """
    lines = tx.prose_lines(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.posexplode_outer(lines if first is None else F.slice(lines, 1, first)).alias("ord", "line"))


def _blocks(s: S, d: str, first: int | None = None) -> D:
    rows = _lines(s, d, first).select(F.col("doc_id").alias("snapshot_id"), "ord", F.col("line").alias("text"))
    return rows.select("snapshot_id", "ord", F.when(F.col("ord") == 0, "title").otherwise("instruction").alias("type"), F.lit(None).cast("string").alias("heading_norm"), "text", tx.normal(F.col("text"), False).alias("text_norm"))


def o48_block_ids(s: S, d: str) -> D:
    return tx.block_ids(_blocks(s, d)).select("snapshot_id", "ord", "block_id")


def o49_paragraphs(s: S, d: str) -> D:
    return table(s, d, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("ord", "p")).select("doc_id", "ord", F.when(F.col("ord") == 0, "title").otherwise("instruction").alias("type"), F.length("p").alias("n"))


def o50_prose_lines(s: S, d: str) -> D:
    return _lines(s, d)


def o31_wording(s: S, d: str) -> D:
    return table(s, d, "lineitem").groupBy(tx.wording(F.col("l_returnflag"), F.expr("CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END")).alias("wording")).agg(F.count("*").alias("n"))


def o51_sealed(s: S, d: str) -> D:
    return table(s, d, "documents").select("doc_id", F.length(tx.sealed(F.col("text"), F.col("doc_id").cast("string"))).alias("n"))


def _claims(s: S, d: str) -> tuple[D, D]:
    claims = table(s, d, "benchmark").select(F.col("item_id").alias("claim_id"), tx.normal(F.col("text"), False).alias("claim_norm"))
    some = claims.where("claim_id % 20 = 0").withColumn("words", F.split("claim_norm", " "))
    # one- and two-word claims as well
    short = some.select((F.col("claim_id") + 1_000_000).alias("claim_id"), F.array_join(F.slice("words", F.lit(1), F.expr("cast(1 + claim_id div 20 % 2 AS int)")), " ").alias("claim_norm"))
    claims = claims.union(short)
    texts = table(s, d, "documents").select(F.col("doc_id").alias("text_id"), tx.normal(F.col("text"), False).alias("text_norm"))
    return claims.withColumn("words", F.split("claim_norm", " ")), texts.withColumn("words", F.split("text_norm", " "))


def o40_containment(s: S, d: str) -> D:
    return vf.containment_join(*_claims(s, d))


def o47_coverage(s: S, d: str) -> D:
    """Conversation turns as claims, the turn before as evidence: containment first, common subsequence for the rest."""
    turns = table(s, d, "conversations").select("conv_id", "turn", tx.normal(F.col("text"), False).alias("t"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("evidence"))
    pairs = turns.join(before, ["conv_id", "turn"]).withColumnRenamed("t", "claim")
    return tx.coverage(pairs, "claim", "evidence").select("conv_id", "turn", F.round("coverage", 6).alias("coverage"))


def o56_sufficiency(s: S, d: str) -> D:
    return linked.decided(table(s, d, "pages"), "page_id").select("page_id", "decision", F.col("n_items").cast("long").alias("n_items"), F.array_join("missing", ",").alias("missing"))


def o63_ref_resolution(s: S, d: str) -> D:
    """Each document cites its own first block, and every third one a block that is not there."""
    blocks, heads = (tx.block_ids(_blocks(s, d, first)).select(F.col("snapshot_id").alias("snapshot"), "ord", "block_id") for first in (None, 1))
    refs = heads.select(F.col("snapshot").alias("doc"), "snapshot", F.lit("/title").alias("owner"), F.when(F.col("snapshot") % 3 == 0, F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block"), F.lit(None).cast("string").alias("pointer"))
    snapshots = table(s, d, "documents").select(F.col("doc_id").alias("snapshot")).distinct().withColumn("has_payload", F.lit(False))
    return vf.unresolved_refs(refs, blocks, snapshots).select("doc", "reason")


def o65_capture_support(s: S, d: str) -> D:
    """Lines of documents against the documents with their first line taken off: what is not held is reported."""
    inputs = table(s, d, "documents").select(F.col("doc_id").alias("snapshot"), tx.normal(F.expr("substr(text, instr(text, chr(10)) + 1)"), False).alias("input_norm"))
    blocks = _blocks(s, d).select(F.col("snapshot_id").alias("snapshot"), "ord", "text_norm")
    return vf.capture_support(blocks, inputs).groupBy("snapshot").agg(F.count("*").alias("n"))


def o66_claim_support(s: S, d: str) -> D:
    """Every document's last line against its first two blocks, one by one."""
    blocks = _blocks(s, d)
    claims = blocks.groupBy("snapshot_id").agg(F.max_by("text_norm", "ord").alias("claim_norm")).withColumn("claim_id", F.col("snapshot_id"))
    evidence = _blocks(s, d, 2).select("snapshot_id", F.col("text_norm").alias("evidence_norm"))
    return vf.claim_support(claims, evidence, ["snapshot_id"]).select("claim_id", "supported", "n_evidence")


def o69_title_grounding(s: S, d: str) -> D:
    blocks = _blocks(s, d, 2)
    titles = blocks.where("ord = 1").select(F.col("snapshot_id").alias("doc"), F.when(F.col("snapshot_id") % 7 == 0, "not_in_source").otherwise("from_source").alias("state"), F.col("text_norm").alias("title_norm"))
    cited = blocks.where("ord = 0 AND snapshot_id % 5 != 0").select(F.col("snapshot_id").alias("doc"), "type", "text_norm")
    return vf.title_grounding(titles, cited)


def o70_count_gate(s: S, d: str) -> D:
    titles = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("page_id") % 4).cast("int"))
    return table(s, d, "pages").select("page_id", vf.count_gate((F.col("page_id") % 3).cast("int"), titles).alias("gate"))


def o61_contract(s: S, d: str) -> D:
    bad = vf.contract_violations(F.col("props"), {"k": "int"}, {})
    wrong = vf.contract_violations(F.replace("props", F.lit('"k"'), F.lit('"q"')), {"k": "int"}, {"note": "string"})
    return table(s, d, "events").select("event_id", F.array_join(bad, ",").alias("violations"), F.array_join(wrong, ",").alias("renamed"))


def o14_leaf_flatten(s: S, d: str) -> D:
    rows = table(s, d, "events").select("event_id", F.explode(trees.leaves(F.col("props"))).alias("x"))
    return rows.select("event_id", "x.path", "x.kind", "x.text")


QUERIES = {n: f for n, f in globals().items() if n[0] == "o" and n.split("_")[0][1:].isdigit() and callable(f)}

_SIGNS = "‐‑‒–—−‘’‚“”„\u00a0"
_PLAIN = "------''''''\"\"\" "  # three single quotes, each written twice in SQL


def _normal(x: str) -> str:
    folded = rf"regexp_replace(translate({x}, '{_SIGNS}', '{_PLAIN}'), '(\p{{L}})-\s*(\p{{L}})', '\1\2', 'g')"
    return rf"lower(trim(regexp_replace({folded}, '\s+', ' ', 'g'), ' '))"


def _chain() -> str:
    out = "html"
    for region in ("script", "style", "head"):
        out = rf"regexp_replace({out}, '(?is)<{region}\b.*?</{region}\s*>', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    inside = r"""(?:"[^"]*"|''[^'']*''|[^>"''])*"""
    out = rf"regexp_replace({out}, '(?i)</?(?:{'|'.join(tx.BLOCKS)})\b{inside}>', chr(10), 'g')"
    return _entities(rf"regexp_replace({out}, '<{inside}>', '', 'g')")


def _entities(out: str) -> str:
    for name in [n for n in tx.ENTITIES if n != "amp"] + ["amp"]:
        value = tx.ENTITIES[name].replace("'", "''")
        out = f"replace({out}, '&{name};', '{value}')"
    return out


_LINES = r"""
raw_lines AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n+'), lambda x: trim(x, ' ')), lambda x: x != '') AS l, text FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM raw_lines)),
blocks AS (SELECT doc_id AS snapshot_id, ord, CASE WHEN ord = 0 THEN 'title' ELSE 'instruction' END AS type, """ + _normal("line") + """ AS text_norm FROM lines)
"""
_IDS = """
digests AS (SELECT *, 'b-' || substr(sha256(type || chr(0) || '' || chr(0) || text_norm), 1, 12) AS d FROM blocks),
ids AS (SELECT snapshot_id, ord, d || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, d ORDER BY ord) - 1 AS k FROM digests))
"""

_TAIL = r"regexp_replace(text, '^[^\n]*\n', '')"
ORACLES = {
    "o03_url_preflight": "SELECT page_id, regexp_matches(url, '^https?://') AS allowed, CASE WHEN regexp_matches(url, '^https?://') THEN 'OK' ELSE 'SCHEME_NOT_ALLOWED' END AS code FROM pages",
    "o05_content_ids": "SELECT 'sha256:' || sha256(text) AS content_id, min(doc_id) AS doc_id, count(*) AS puts FROM documents GROUP BY 1",
    "o06_media_type": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS media FROM pages",
    "o42_html_to_text": rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace({_chain()}, '[ \t\r\f\v]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x != ''), chr(10)) AS text FROM pages",
    "o43_entities": f"SELECT page_id, length({_entities('html')})::INTEGER AS n, len(regexp_extract_all({_entities('html')}, '&[a-z]+;'))::INTEGER AS left FROM pages",
    "o44_normal_form": f"SELECT doc_id, md5({_normal('text')}) AS digest FROM documents",
    "o45_word_tokens": rf"WITH w AS (SELECT doc_id, regexp_extract_all({_normal('text')}, '[\p{{L}}\p{{N}}_]+') AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n_words, len(list_distinct(w))::INTEGER AS n_distinct FROM w",
    "o48_block_ids": f"WITH {_LINES}, {_IDS} SELECT * FROM ids",
    "o49_paragraphs": r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t\r\f\v]*\n\s*'), lambda x: trim(x, ' ')), lambda x: x != '') AS l FROM documents), q AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS p FROM p) SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'title' ELSE 'instruction' END AS type, length(p)::INTEGER AS n FROM q",
    "o50_prose_lines": f"WITH {_LINES} SELECT doc_id, ord, line FROM lines",
    "o31_wording": "SELECT l_returnflag || CASE WHEN l_linestatus = 'O' THEN '' ELSE ' ' || l_linestatus END AS wording, count(*) AS n FROM lineitem GROUP BY 1",
    "o51_sealed": "SELECT doc_id, (length(text) + 44)::INTEGER AS n FROM documents",
    "o40_containment": f"WITH b AS (SELECT item_id AS claim_id, {_normal('text')} AS n FROM benchmark), c AS (SELECT * FROM b UNION ALL SELECT claim_id + 1000000, array_to_string(string_split(n, ' ')[1:1 + (claim_id // 20) % 2], ' ') FROM b WHERE claim_id % 20 = 0), t AS (SELECT doc_id AS text_id, {_normal('text')} AS n FROM documents) SELECT claim_id, text_id FROM c JOIN t ON contains(t.n, c.n)",
    "o56_sufficiency": "SELECT page_id, 'insufficient' AS decision, 0::BIGINT AS n_items, 'name,recipeIngredient,recipeInstructions,recipeYield' AS missing FROM pages",
    "o63_ref_resolution": f"WITH {_LINES}, {_IDS} SELECT snapshot_id AS doc, 'unknown_block' AS reason FROM ids WHERE ord = 0 AND snapshot_id % 3 = 0",
    "o65_capture_support": f"WITH {_LINES}, i AS (SELECT doc_id, {_normal(_TAIL)} AS n FROM documents) SELECT snapshot_id AS snapshot, count(*) AS n FROM blocks JOIN i ON i.doc_id = snapshot_id WHERE NOT contains(i.n, text_norm) GROUP BY 1",
    "o66_claim_support": f"WITH {_LINES}, c AS (SELECT snapshot_id, arg_max(text_norm, ord) AS claim FROM blocks GROUP BY 1) SELECT c.snapshot_id AS claim_id, bool_or(contains(b.text_norm, claim)) AS supported, count(*) AS n_evidence FROM c JOIN blocks b ON b.snapshot_id = c.snapshot_id AND b.ord < 2 GROUP BY 1",
    "o69_title_grounding": f"WITH {_LINES}, t AS (SELECT snapshot_id AS doc, text_norm AS title FROM blocks WHERE ord = 1 AND snapshot_id % 7 != 0), b AS (SELECT snapshot_id AS doc, text_norm FROM blocks WHERE ord = 0 AND snapshot_id % 5 != 0) SELECT doc, CASE WHEN b.text_norm IS NULL THEN 'no_title_block_cited' ELSE 'wording_not_in_the_title_block' END AS reason FROM t LEFT JOIN b USING (doc) WHERE b.text_norm IS NULL OR NOT contains(b.text_norm, title)",
    "o70_count_gate": "SELECT page_id, CASE WHEN page_id % 3 < 1 OR page_id % 4 != page_id % 3 THEN 'refused_unknown' WHEN page_id % 3 > 1 THEN 'refused_multiple' ELSE 'ok' END AS gate FROM pages",
    "o61_contract": "SELECT event_id, '' AS violations, 'unknown_key:q,missing:k' AS renamed FROM events",
    "o14_leaf_flatten": "SELECT event_id, '/k' AS path, 'number' AS kind, props->>'$.k' AS text FROM events",
}
