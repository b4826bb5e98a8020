"""Structured data in pages: ld+json scripts as variants, opened inside the page's row by built-in functions alone.

A script that does not parse is read once more without comments, and passed over if it still does not. Only lists and
lists under `@graph` are entered; other members are not, nor is a `@graph` that is an object. Nodes stand in page order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import trees
from docketry.functions.text import prose_lines, trimmed
from docketry.functions.trees import let, record
from docketry.functions.web import first_resolvable

#: Members without which a node is not enough, and those whose coverage is measured.
REQUIRED = ["name", "recipeIngredient", "recipeInstructions", "recipeYield"]
MEASURED = [*REQUIRED, "author", "prepTime", "cookTime", "totalTime", "nutrition", "image", "description"]
#: A tag ends at the next sign of another one, so that a page of unclosed tags is read once, not once for each of them.
_SCRIPT = r"""(?is)<script[^<>]*type=["']application/ld\+json["'][^<>]*>(.*?)</script>"""
_TO_LAST_CLOSE = r"(?is)\A.*</script>"


def _found(html: Column) -> Column:
    """The texts of a page's ld+json scripts; what follows the last closing tag holds none."""
    return F.regexp_extract_all(F.regexp_extract(html, _TO_LAST_CLOSE, 0), F.lit(_SCRIPT), F.lit(1))


def scripts(html: Column) -> Column:
    """The texts of a page's ld+json scripts that are not blank."""
    return F.filter(F.transform(_found(html), trimmed), lambda x: x != "")


def _read(script: Column) -> Column:
    bare = F.regexp_replace(F.replace(F.replace(script, F.lit("<!--"), F.lit("")), F.lit("-->"), F.lit("")), r"(?s)\A\s*/\*.*?\*/", "")
    return F.coalesce(trees.parsed(script), trees.parsed(trimmed(bare)))


def member(node: Column, name: str) -> Column:
    return F.try_element_at(node["members"], F.lit(name))


def display(value: Column) -> Column:
    """A text without blanks around it, or a number as text; null for anything else and for blank texts."""
    text = trees.as_text(value)
    number = F.when(trees.scalar_kind(value) == "number", F.try_variant_get(value, "$", "double"))
    scalar = trees.as_object(value).isNull() & trees.as_list(value).isNull()
    return F.when(scalar & text.isNotNull(), F.nullif(trimmed(text), F.lit(""))).when(scalar & (F.abs(number) < float("inf")), trees.number_text(number))


def full(value: Column, blank_counts: bool = False) -> Column:
    """Whether a member is there and not empty; texts of white space are empty unless blank_counts."""
    text = trees.as_text(value)
    return F.coalesce(
        F.when(value.isNull() | F.is_variant_null(value), False).when(trees.as_object(value).isNotNull(), F.size(trees.as_object(value)) > 0)
        .when(trees.as_list(value).isNotNull(), F.size(trees.as_list(value)) > 0).when(text.isNotNull(), (text if blank_counts else trimmed(text)) != ""), F.lit(True))


def of_type(node: Column, kind: str) -> Column:
    """Whether a node's @type is a text, or holds it as one of several."""
    types = member(node, "@type")
    listed = F.exists(trees.as_list(types), lambda t: F.coalesce(trees.as_text(t) == kind, F.lit(False)))
    return F.coalesce(F.when(trees.as_list(types).isNotNull(), listed).otherwise(trees.as_text(types) == kind), F.lit(False))


def nodes(html: Column) -> Column:
    """The objects in a page's scripts as (pos, members), in page order."""
    def opened(n: Column) -> Column:
        graph = trees.as_list(member(n, "@graph"))
        return F.transform(F.coalesce(n["items"], graph), lambda x, i: _node(F.concat(n["pos"], F.array(i)), x))

    def walked(texts: Column) -> Column:
        read = F.transform(texts, lambda s, i: let(_read(s), lambda v: _node(F.array(i), v)))
        depth = F.aggregate(texts, F.lit(1), lambda n, s: n + F.length(s) - F.length(F.translate(s, "[{", "")))
        return trees.unfolded(F.filter(read, lambda n: n["members"].isNotNull() | n["items"].isNotNull()), opened, depth, plain_levels=1)

    found = let(F.coalesce(scripts(html), F.array().cast("array<string>")), walked)
    objects = F.transform(F.filter(found, lambda n: n["members"].isNotNull()), lambda n: record(pos=n["pos"], members=n["members"]))
    return F.array_sort(objects, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))


def _node(pos: Column, value: Column) -> Column:
    return record(pos=pos, members=trees.as_object(value), items=trees.as_list(value))


def typed_nodes(html: Column, kind: str = "Recipe") -> Column:
    """The nodes of a type as (ord, name, id, score, missing, members); score counts the required members."""
    mine = F.filter(nodes(html), lambda n: of_type(n, kind))

    def judged(n: Column, i: Column) -> Column:
        missing = F.filter(F.array(*[F.when(~full(member(n, f)), f) for f in REQUIRED]), lambda x: x.isNotNull())
        return let(missing, lambda m: record(ord=i, name=display(member(n, "name")), id=display(member(n, "@id")), score=len(REQUIRED) - F.size(m), missing=m, members=n["members"]))

    return F.transform(mine, judged)


def distinct_items(found: Column) -> Column:
    """One of typed_nodes() for each distinct item of a page: the richest, the first of equals.

    Items are grouped by folded name, else by @id, else each stands alone. Two or more @ids in a group are as many
    items, and its nodes without an @id fold into them. Items stand in the order of their groups, then of their @ids.
    """
    folded = lambda n: F.regexp_replace(F.lower(n["name"]), r"(?U)\s+", " ")
    group = lambda n: F.coalesce(F.concat(F.lit("name:"), folded(n)), F.concat(F.lit("id:"), n["id"]), F.concat(F.lit("#"), n["ord"].cast("string")))
    grouped = F.transform(found, lambda n: record(group=group(n), node=n))

    def several(all_nodes: Column) -> Column:
        def kept(n: Column) -> Column:
            mine = F.filter(all_nodes, lambda o: o["group"] == n["group"])
            ids = F.array_distinct(F.filter(F.transform(mine, lambda o: o["node"]["id"]), lambda x: x.isNotNull()))
            split = F.size(ids) > 1
            item = F.filter(mine, lambda o: ~split | F.coalesce(o["node"]["id"] == n["node"]["id"], F.lit(False)))
            best = F.array_max(F.transform(item, lambda o: record(score=o["node"]["score"], ord=-o["node"]["ord"])))
            first = lambda of: F.array_min(F.transform(of, lambda o: o["node"]["ord"]))
            is_best = (~split | n["node"]["id"].isNotNull()) & (-best["ord"] == n["node"]["ord"])
            return record(at=F.array(first(mine), first(item)), keep=is_best, node=n["node"])

        return F.filter(F.transform(all_nodes, kept), lambda x: x["keep"])

    kept = F.array_sort(let(grouped, several), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return F.transform(kept, lambda x: x["node"])


def decided(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, decision, n_items, present, missing, titles, item): multiple is decided before what is missing is looked at.

    item holds the members of the page's only item, if there is one.
    """
    rows = pages.select(key, let(distinct_items(typed_nodes(F.col(html))), lambda x: x).alias("__items"))
    n, one = F.size("__items"), F.get("__items", F.lit(0))
    missing = F.when(n > 1, F.array().cast("array<string>")).when(n == 1, one["missing"]).otherwise(F.array(*map(F.lit, REQUIRED)))
    return rows.select(
        key, F.when(n > 1, "multiple").when(F.size(missing) > 0, "insufficient").otherwise("sufficient").alias("decision"), n.alias("n_items"), (n > 0).alias("present"),
        missing.alias("missing"), F.transform("__items", lambda x: x["name"]).alias("titles"), F.when(n == 1, one["members"]).alias("item"),
    )


def _depth(value: Column) -> Column:
    text = F.to_json(value)
    return F.coalesce(F.length(text) - F.length(F.translate(text, "[{", "")), F.lit(0)) + 1


def _first(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda x: x.isNotNull()), F.lit(0))


def _in_order(found: Column, shown: Callable[[Column], Column]) -> Column:
    ordered = F.array_sort(found, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return F.transform(ordered, shown)


def _author(value: Column) -> Column:
    """The first name in a text, an object with one, or lists of these."""
    opened = lambda n: F.transform(n["items"], lambda x, i: record(pos=F.concat(n["pos"], F.array(i)), value=x, items=trees.as_list(x)))
    found = trees.unfolded(F.array(record(pos=F.array().cast("array<int>"), value=value, items=trees.as_list(value))), opened, _depth(value), plain_levels=1)
    name = lambda v: F.when(trees.as_object(v).isNotNull(), display(F.try_element_at(trees.as_object(v), F.lit("name")))).otherwise(display(v))
    return _first(_in_order(found, lambda n: name(n["value"])))


def _steps(value: Column) -> Column:
    """Instructions as (heading, text): lines of a text, texts, steps, and sections that give their name to what they hold."""
    none = F.lit(None).cast("string")

    def step(pos: Column, v: Column, heading: Column) -> Column:
        return record(pos=pos, value=v, members=trees.as_object(v), heading=heading)

    def section(n: Column) -> Column:
        return of_type(n, "HowToSection") | trees.as_list(member(n, "itemListElement")).isNotNull()

    def opened(n: Column) -> Column:
        held = F.when(section(n), F.coalesce(trees.as_list(member(n, "itemListElement")), F.array().cast("array<variant>")))
        return F.transform(held, lambda x, i: step(F.concat(n["pos"], F.array(i)), x, F.coalesce(display(member(n, "name")), n["heading"])))

    def text(n: Column) -> Column:
        said = F.coalesce(display(member(n, "text")), display(member(n, "name")))
        return record(heading=n["heading"], text=F.when(n["members"].isNotNull(), F.when(~section(n), said)).otherwise(F.nullif(trimmed(trees.as_text(n["value"])), F.lit(""))))

    top = F.transform(F.coalesce(trees.as_list(value), F.array(value)), lambda x, i: step(F.array(i), x, none))
    structured = F.filter(_in_order(trees.unfolded(top, opened, _depth(value), plain_levels=1), text), lambda s: s["text"].isNotNull())
    prose = F.transform(prose_lines(trees.as_text(value)), lambda line: record(heading=none, text=line))
    return F.when(value.isNull(), F.filter(structured, lambda _: F.lit(False))).when(trees.as_text(value).isNotNull(), F.filter(prose, lambda s: ~F.regexp_like(s["text"], F.lit(r"(?U)\A\s*\z")))).otherwise(structured)


def blocks(item: Column) -> Column:
    """A node's members as blocks (type, heading, text), in reading order."""
    at = lambda name: F.try_element_at(item, F.lit(name))
    none = F.lit(None).cast("string")
    block = lambda kind, text, heading=none: record(type=F.lit(kind), heading=heading, text=text)
    listed = lambda v: F.transform(F.coalesce(trees.as_list(v), F.array(v)), display)
    heads = F.array(
        block("title", display(at("name"))), block("author", let(at("author"), _author)), block("metadata", _first(listed(at("recipeYield"))), F.lit("recipeYield")),
        *[block("metadata", display(at(f)), F.lit(f)) for f in ("prepTime", "cookTime", "totalTime", "description")],
    )
    lines = F.transform(listed(at("recipeIngredient")), lambda x: block("ingredient", x))
    steps = F.transform(let(at("recipeInstructions"), _steps), lambda s: block("instruction", s["text"], s["heading"]))
    return F.filter(F.concat(heads, lines, steps), lambda b: b["text"].isNotNull())


def captured(found: Column) -> Column:
    """The text of blocks(): a line for each, with its heading before it."""
    return F.array_join(F.transform(found, lambda b: F.concat_ws(": ", b["heading"], b["text"])), "\n")


def pictures(item: Column) -> Column:
    """The addresses that a node's image declares, in order: texts, objects' url and contentUrl, and lists of these."""
    value = F.try_element_at(item, F.lit("image"))

    def node(pos: Column, v: Column) -> Column:
        return record(pos=pos, value=v, items=trees.as_list(v))

    def found(v: Column) -> Column:
        opened = lambda n: F.transform(n["items"], lambda x, i: node(F.concat(n["pos"], F.array(i)), x))
        all_nodes = trees.unfolded(F.array(node(F.array().cast("array<int>"), v)), opened, _depth(v), plain_levels=1)
        of = lambda v, name: trees.as_text(F.try_element_at(trees.as_object(v), F.lit(name)))
        texts = F.flatten(_in_order(all_nodes, lambda n: F.array(trees.as_text(n["value"]), of(n["value"], "url"), of(n["value"], "contentUrl"))))
        return F.filter(F.transform(F.filter(texts, lambda x: x.isNotNull()), trimmed), lambda x: x != "")

    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(let(value, found))


def first_pictures(items: DataFrame, key: str, base: str, item: str = "item") -> DataFrame:
    """(key, picture): the first of each item's addresses that resolves against base to an http or https one."""
    each = items.select(key, base, F.posexplode_outer(pictures(F.col(item))).alias("__pos", "__address"))
    each = each.withColumn("__found", first_resolvable(base, F.array("__address")))
    best = F.min(F.when(F.col("__found").isNotNull(), F.struct("__pos", "__found")))
    return each.groupBy(key).agg(best["__found"].alias("picture"))


def publisher(item: Column) -> Column:
    """The name of a node's publisher, or of the first of several."""
    value = F.try_element_at(item, F.lit("publisher"))
    one = F.when(trees.as_list(value).isNotNull(), F.get(trees.as_list(value), F.lit(0))).otherwise(value)
    name = F.when(trees.as_object(one).isNotNull(), F.try_element_at(trees.as_object(one), F.lit("name"))).otherwise(one)
    return F.nullif(trimmed(trees.as_text(name)), F.lit(""))


def measured(html: Column, kind: str = "Recipe") -> Column:
    """(n_scripts, n_nodes, fields, shape) of a page's richest node: which members it has, and how its instructions are kept.

    Here a blank text counts, and of equally rich nodes the last in its script does.
    """
    mine = F.filter(nodes(html), lambda n: of_type(n, kind))
    here = lambda n, f: full(member(n, f), blank_counts=True)

    def shape(v: Column) -> Column:
        first = F.get(trees.as_list(v), F.lit(0))
        kind_of = F.coalesce(trees.as_text(F.try_element_at(trees.as_object(first), F.lit("@type"))), F.lit("?"))
        return (
            F.when(v.isNull() | F.is_variant_null(v), "absent").when(trees.as_text(v).isNotNull(), "string").when(trees.as_object(first).isNotNull(), F.concat(F.lit("list<"), kind_of, F.lit(">")))
            .when(first.isNotNull(), "list<string>").otherwise("other")
        )

    def scored(n: Column) -> Column:
        back = F.transform(n["pos"], lambda p, i: F.when(i == 0, p).otherwise(-p))
        score = sum(here(n, f).cast("int") for f in REQUIRED)
        fields = F.filter(F.array(*[F.when(here(n, f), f) for f in MEASURED]), lambda x: x.isNotNull())
        return record(rank=-score, back=back, fields=fields, shape=shape(member(n, "recipeInstructions")))

    best = lambda found: record(n_scripts=F.size(_found(html)), n_nodes=F.size(found), fields=F.array_min(found)["fields"], shape=F.array_min(found)["shape"])
    return let(F.transform(mine, scored), best)


def coverage(pages: DataFrame, html: str = "html", fetched: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, total, fetched, present, sufficient, coverage by member, shapes): rates of pages that were fetched alone.

    fetched tells pages that came with status 200 and a body; a page that did not is no page without structured data.
    """
    by = by or []
    got = F.coalesce(fetched if fetched is not None else F.lit(True), F.lit(False)) & (F.coalesce(F.length(html), F.lit(0)) > 0)
    rows = pages.select(*by, got.alias("__got"), F.when(got, measured(F.col(html))).alias("__m")).select(*by, "__got", "__m.*")
    present = F.col("__got") & (F.col("n_nodes") > 0)
    enough = present & (F.size(F.array_intersect("fields", F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED))
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("__got").alias("fetched"), F.count_if(present).alias("present"), F.count_if(enough).alias("sufficient"),
        *[F.count_if(present & F.array_contains("fields", f)).alias(f"has_{f}") for f in MEASURED],
        *[F.count_if(present & (F.col("shape") == s)).alias(a) for s, a in (("string", "shape_string"), ("absent", "shape_absent"), ("list<string>", "shape_texts"))],
        F.count_if(present & F.startswith("shape", F.lit("list<")) & (F.col("shape") != "list<string>")).alias("shape_objects"),
    )
    return counted
