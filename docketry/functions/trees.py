"""Nested JSON documents as trees of variants, walked inside their rows by built-in functions alone.

A document's nodes are found level by level: `aggregate` carries the nodes of one level and opens them with casts of a
variant to a map or a list. Expressions copy what they hold at every turn, so whole tables are walked by leaf_rows(),
seen_rows() and source_ref_rows(), where a generator opens the levels. Nothing is shuffled and no document is parsed twice; what a node hands down to its members
(a path, a scope, a place in a contract) is a column built by the caller. Documents that are not JSON, or hold a key
twice, have no nodes. Members of objects stand in the order of their keys, those of lists in their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFS, WORDING = "sourceRefs", "sourceText"
#: What `\s` and trimming take as white space: all of Unicode's, and the mark that may begin a text.
_BLANK = r"^[\s\x{FEFF}]*$"


def record(**fields: Column) -> Column:
    """A struct whose names hold wherever it stands: Spark drops aliases inside expressions beside a generator."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once.

    It is the start of an aggregate over nothing: a transform over a list of one would copy whatever use gives, with all
    that lies in it, once more for each let around it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, use)


def each(rows: DataFrame, keep: list[str], items: Column | str, name: str = "x", place: str | None = None) -> DataFrame:
    """One row for each item of a list of structs, with its place if that is named; none for empty lists.

    Beside a plain explode Spark infers a filter on the list's size and moves it below what makes the list, which is then
    made anew for the filter; beside an outer one it does not.
    """
    found = F.explode_outer(items).alias(name) if place is None else F.posexplode_outer(items).alias(place, name)
    return rows.select(*keep, found).where(F.col(name).isNotNull())


def parsed(json: Column) -> Column:
    """The variant of a text that is JSON as a whole, else null.

    The parser stops after the first value, so the text is read as a list with its hash behind it: more values, or a
    text that closes the list, do not give that list.
    """
    # its length is seen from what follows the hash: a cast to a list would copy the document
    whole = lambda v, end: F.try_variant_get(v, "$[2]", "variant").isNull() & (F.try_variant_get(v, "$[1]", "bigint") == end)
    both = lambda j: record(v=F.try_parse_json(F.concat(F.lit("["), j, F.lit(","), F.xxhash64(j).cast("string"), F.lit("]"))), end=F.xxhash64(j))
    return let(let(json, both), lambda x: F.when(whole(x["v"], x["end"]), F.try_variant_get(x["v"], "$[0]", "variant")))


def as_object(value: Column) -> Column:
    """A variant's members by key; null if it is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    """The text of a variant that is a string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def scalar_kind(value: Column) -> Column:
    """string, number, boolean or null of a variant that is no object or list."""
    return let(F.schema_of_variant(value), _kind)


def _kind(kind: Column) -> Column:
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def number_text(value: Column) -> Column:
    """A double as JSON's own language prints it: whole numbers without a point, exponents from 1e21 and below 1e-6."""
    size = F.abs(value)
    plain = lambda scale: F.regexp_replace(F.regexp_replace(value.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E(\\d)", "E+$1"), "E", "e")
    whole = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(plain(17))
    return F.when(value == 0, "0").when(size >= 1e21, power).when(size >= 1, whole).when(size >= 1e-6, plain(30)).otherwise(power)


def scalar_text(value: Column) -> Column:
    """A scalar as text: null as `null`, numbers as number_text()."""
    number = lambda: let(F.try_variant_get(value, "$", "double"), number_text)
    shown = lambda kind: F.when(kind == "null", "null").when(kind == "number", number()).otherwise(F.try_variant_get(value, "$", "string"))
    return let(scalar_kind(value), shown)


Handed = Callable[[Column, Column, Column], Column]


def nodes(json: Column, start: Column | None = None, handed: Handed | None = None) -> Column:
    """All nodes of a document as a list of (path, pos, key, value, members, items, own), level by level.

    path is written with keys as they are; pos holds the place at every level, so it sorts nodes into document order.
    members and items are an object's and a list's, null for others. own begins as start at the root; a member's is
    handed(the parent, the key or null in lists, the member's value).
    """
    return let(json, lambda j: let(parsed(j), lambda v: _walked(v, F.lit(0) if start is None else start, handed, _brackets(j))))


def _walked(value: Column, start: Column, handed: Handed | None, deepest: Column, path: Column | None = None, plain_levels: int | None = None) -> Column:
    """nodes() of a variant, at a path."""
    handed = handed or (lambda parent, key, value: parent["own"])

    def node(path: Column, pos: Column, key: Column, value: Column, own: Column) -> Column:
        return record(path=path, pos=pos, key=key, value=value, members=as_object(value), items=as_list(value), own=own)

    no_key = F.lit(None).cast("string")

    def opened(n: Column) -> Column:
        below = lambda step, i: (F.concat(n["path"], F.lit("/"), step), F.concat(n["pos"], F.array(i)))
        members = F.transform(F.map_entries(n["members"]), lambda e, i: node(*below(e["key"], i), e["key"], e["value"], handed(n, e["key"], e["value"])))
        items = F.transform(n["items"], lambda x, i: node(*below(i.cast("string"), i), no_key, x, handed(n, no_key, x)))
        return F.coalesce(members, items)

    root = F.filter(F.array(node(F.lit("") if path is None else path, F.array().cast("array<int>"), no_key, value, start)), lambda n: n["value"].isNotNull())
    return unfolded(root, opened, deepest, plain_levels or PLAIN)


def _brackets(json: Column) -> Column:
    """No document is deeper than it has opening brackets."""
    return F.coalesce(F.length(json) - F.length(F.translate(json, "{[", "")), F.lit(0)) + 1


#: Levels that are opened one after the other, and those that are opened in a loop before the text's brackets are counted.
PLAIN, LOOPED = 10, 40


def unfolded(root: Column, opened: Callable[[Column], Column], deepest: Column, plain_levels: int = PLAIN) -> Column:
    """A list of nodes, their members opened(node), their members' members and so on, level by level.

    opened gives null for nodes without members. A loop copies all nodes found so far at every turn, so the levels that
    most documents have are written out, unless opened is so deep an expression that Spark does not resolve it within its
    limit of turns, or its nodes are few. deepest bounds the number of levels; few documents come near it, so the loop
    goes on in two phases, as long as there are nodes.
    """
    none = F.array().cast("array<int>")
    below = lambda front: F.flatten(F.filter(F.transform(front, opened), lambda x: x.isNotNull()))
    left = lambda level, steps: F.when(F.size(level["front"]) > 0, steps).otherwise(none)

    def deeper(level: Column, _: Column) -> Column:
        return F.when(F.size(level["front"]) == 0, level).otherwise(record(front=below(level["front"]), done=F.concat(level["done"], level["front"])))

    def looped(level: Column) -> Column:
        first = F.array(*[F.lit(i) for i in range(LOOPED)])
        rest = lambda at: F.aggregate(left(at, F.sequence(F.lit(1), deepest)), at, deeper, lambda end: end["done"])
        return F.aggregate(left(level, first), level, deeper, rest)

    def plain(fronts: list[Column]) -> Column:
        if len(fronts) == plain_levels:
            return F.when(F.size(fronts[-1]) == 0, F.concat(*fronts)).otherwise(looped(record(front=fronts[-1], done=F.concat(*fronts[:-1]) if fronts[1:] else F.filter(fronts[0], lambda _: F.lit(False)))))
        return F.when(F.size(fronts[-1]) == 0, F.concat(*fronts)).otherwise(let(below(fronts[-1]), lambda front: plain([*fronts, front])))

    return let(root, lambda front: plain([front]))


#: Levels that a generator opens, a row for each node; documents that are deeper, which are few, are walked inside their row.
LEVELS = 9


def _deeper_than(levels: int, json: Column) -> Column:
    """Whether a text that is JSON has brackets inside one another, more than levels deep."""
    brackets = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*+"|[^\[\]{}"]+', "")
    for _ in range(levels):
        brackets = F.regexp_replace(brackets, r"\{\}|\[\]", "")
    return F.coalesce(brackets != "", F.lit(False))


def items_of(value: Column) -> Column:
    """The number of a list's items, null for other variants; none is copied."""
    return F.size(F.try_variant_get(value, "$", "array<boolean>"))


def _is_open(value: Column) -> Column:
    """Whether a variant is an object or a list."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull() | F.try_variant_get(value, "$", "array<boolean>").isNotNull()


def _opened(at: DataFrame, value: str) -> DataFrame:
    """at with a row for each member of its variants: (__pos, __key, __value), null where there is none.

    The generator cuts members out, where a cast to a map writes the whole subtree anew.
    """
    return at.lateralJoin(at.sparkSession.tvf.variant_explode_outer(F.col(value).outer()).toDF("__pos", "__key", "__value"))


def _step() -> Column:
    return F.concat("__path", F.lit("/"), F.coalesce("__key", F.col("__pos").cast("string")))


def leaf_rows(rows: DataFrame, keep: list[str], value: str, json: str = "json", levels: int = LEVELS) -> DataFrame:
    """(keep, path, kind, text): a row for each scalar at and below a variant; one without path, kind and text where there is none.

    json is the text that the variant lies in, no less deep. Rows stay in the partition of what they are leaves of.
    """
    one = lambda path, value: record(path=path, value=value)
    inside = F.transform(_scalars(_walked(F.col(value), F.lit(0), None, _brackets(F.col(json)), plain_levels=1)), lambda n: one(n["path"], n["value"]))
    at = rows.select(*keep, value, json, _deeper_than(levels, F.col(json)).alias("__deep"))
    at = at.select(*keep, F.when(~F.col("__deep"), F.col(value)).alias("__v"), F.explode_outer(F.when(F.col("__deep"), inside)).alias("__n"))
    at = at.select(*keep, F.coalesce("__n.path", F.lit("")).alias("__path"), F.coalesce("__n.value", "__v").alias("__v"))
    for _ in range(levels):
        at = _opened(at, "__v").select(*keep, F.when(F.col("__pos").isNull(), F.col("__path")).otherwise(_step()).alias("__path"), F.coalesce("__value", "__v").alias("__v"))
    at = at.select(*keep, "__path", F.when(~_is_open(F.col("__v")), F.col("__v")).alias("__v"))
    at = at.withColumn("__type", F.schema_of_variant("__v"))
    at = at.select(*keep, "__path", "__v", _kind(F.col("__type")).alias("kind"))
    at = at.withColumn("__n", F.when(F.col("kind") == "number", F.try_variant_get("__v", "$", "double")))
    text = F.when(F.col("kind") == "null", "null").when(F.col("kind") == "number", number_text(F.col("__n"))).otherwise(F.try_variant_get("__v", "$", "string"))
    return at.select(*keep, F.when(F.col("kind").isNotNull(), F.col("__path")).alias("path"), "kind", text.alias("text"))


Node = dict[str, Column] | Column


def seen_rows(
    rows: DataFrame, keep: list[str], value: str, start: Column, handed: Callable[[Node, Column], Column], seen: Callable[[Node], Column],
    hidden: Callable[[Column], Column], json: str = "json", levels: int = LEVELS,
) -> DataFrame:
    """(keep, root, found): the values of seen(node) that are not null, for all objects and lists at and below a variant, in lists.

    A node has a path, a value and own: start at the root, handed(the parent, the key or null in lists) below. hidden tells
    keys whose members are left out. What an object or a list gives goes on with its first member, so no row stands for it
    alone. Each variant, and what is none, has one row with root. Rows stay in the partition of what they come from.
    """
    v, own, open_, lead = F.col("__v"), F.col("__own"), F.col("__open"), F.coalesce(F.col("__pos"), F.lit(0)) == 0
    here = {"path": F.col("__path"), "own": own, "value": v}
    with_seen = lambda: F.when(F.col("__seen").isNotNull(), F.concat(F.coalesce("__found", none), F.array("__seen"))).otherwise(F.coalesce("__found", none))
    # beside what the caller hands down, a node knows whether it lies below a hidden key
    wrapped = lambda n: {"path": n["path"], "own": n["own"]["own"], "value": n["value"]}
    both = lambda parent, key, _: record(own=handed(wrapped(parent), key), hidden=parent["own"]["hidden"] | F.coalesce(hidden(key), F.lit(False)))
    walked = _walked(F.col(value), record(own=start, hidden=F.lit(False)), both, _brackets(F.col(json)), plain_levels=1)
    walked = F.filter(walked, lambda n: ~n["own"]["hidden"] & (n["members"].isNotNull() | n["items"].isNotNull()))
    inside = F.filter(F.transform(walked, lambda n: seen(wrapped(n))), lambda x: x.isNotNull())
    at = rows.select(*keep, value, json, _deeper_than(levels, F.col(json)).alias("__deep"))
    at = at.select(*keep, F.lit(True).alias("__root"), F.lit("").alias("__path"), start.alias("__own"), F.when(~F.col("__deep"), F.col(value)).alias("__v"), F.when(F.col("__deep"), inside).alias("__found"))
    none = F.array().cast(at.schema["__found"].dataType)
    for _ in range(levels):
        at = at.withColumn("__open", F.coalesce(_is_open(v), F.lit(False)))
        at = at.withColumn("__seen", F.when(open_, seen(here)))
        at = at.withColumn("__found", with_seen())
        below = F.when(~F.coalesce(hidden(F.col("__key")), F.lit(False)) & _is_open(F.col("__value")), F.col("__value"))
        at = _opened(at, "__v").select(
            *keep, (F.col("__root") & lead).alias("__root"), F.when(F.col("__pos").isNull(), F.col("__path")).otherwise(_step()).alias("__path"),
            F.when(F.col("__pos").isNull(), own).otherwise(handed(here, F.col("__key"))).alias("__own"),
            F.when(F.col("__pos").isNotNull(), below).when(~open_, v).alias("__v"), F.when(lead, F.col("__found")).otherwise(none).alias("__found"),
        ).where("__v IS NOT NULL OR __root OR size(__found) > 0")
    return at.select(*keep, F.col("__root").alias("root"), F.coalesce("__found", none).alias("found"))


def _scalars(found: Column) -> Column:
    return F.filter(found, lambda n: n["members"].isNull() & n["items"].isNull())


def leaves(json: Column) -> Column:
    """Scalar leaves as (path, kind, text). Empty objects and lists give none; keys are written as they are."""
    return F.transform(_scalars(nodes(json)), lambda n: record(path=n["path"], kind=scalar_kind(n["value"]), text=scalar_text(n["value"])))


def value_leaves(value: Column) -> Column:
    """The texts of the scalars at and below a variant; numbers and booleans as text, nulls left out."""
    found = lambda v: F.filter(_scalars(_walked(v, F.lit(0), None, _brackets(F.to_json(v)))), lambda n: ~F.is_variant_null(n["value"]))
    return let(value, lambda v: F.transform(found(v), lambda n: scalar_text(n["value"])))


def _full_list(value: Column) -> Column:
    return F.coalesce(F.size(as_list(value)) > 0, F.lit(False))


#: What a node is to the search for references: outside of any list of them, such a list, its entry, or inside an entry.
_OUTSIDE, _LISTED, _ENTRY, _INSIDE = range(4)


def _listed(key: Column, value: Column) -> Column:
    return F.when(key.eqNullSafe(F.lit(REFS)), F.when(as_list(value).isNotNull(), _LISTED).otherwise(_OUTSIDE)).otherwise(_OUTSIDE)


def _entries(found: Column) -> Column:
    """The entries among nodes, with their owner below the root, their place and their value."""
    owner = lambda n: F.regexp_replace(n["path"], f"/{REFS}/[0-9]+$", "")
    return F.transform(F.filter(found, lambda n: n["own"] == _ENTRY), lambda n: record(owner=owner(n), ord=F.element_at(n["pos"], -1), value=n["value"]))


def _reference_state(parent: Column, key: Column, value: Column) -> Column:
    return F.when(parent["own"] == _OUTSIDE, _listed(key, value)).when(parent["own"] == _LISTED, _ENTRY).otherwise(_INSIDE)


def _reference(owner: Column, ord: Column, value: Column) -> Column:
    field = lambda name: as_text(F.try_variant_get(value, f"$.{name}", "variant"))
    return record(owner=owner, ord=ord, block=field("blockId"), pointer=field("payloadPointer"))


def source_refs(json: Column) -> Column:
    """Every entry of a list of references anywhere in a document: (owner, ord, block, pointer).

    owner is the path of what the references belong to. What lies inside an entry is not searched for more.
    """
    return F.transform(_entries(nodes(json, F.lit(_OUTSIDE), _reference_state)), lambda n: _reference(n["owner"], n["ord"], n["value"]))


def source_ref_rows(rows: DataFrame, keep: list[str], json: str = "json", levels: int = 9) -> DataFrame:
    """(keep, owner, ord, block, pointer): source_refs() as rows.

    The first levels are opened by a generator, a row for each node: it cuts a member out, where a cast to a map writes
    its whole subtree anew. What lies deeper, in few documents, is searched as in source_refs().
    """
    at = rows.select(*keep, F.lit("").alias("__owner"), F.lit(None).cast("int").alias("__ord"), parsed(F.col(json)).alias("__v"), F.lit(_OUTSIDE).alias("__state"))
    state, outside = F.col("__state"), F.col("__state") == _OUTSIDE
    for _ in range(levels):
        opened = rows.sparkSession.tvf.variant_explode_outer(F.when(state != _ENTRY, F.col("__v")).outer()).toDF("__pos", "__key", "__value")
        listed = _listed(F.col("__key"), F.col("__value"))
        step = F.when(outside & (listed == _OUTSIDE), F.concat("__owner", F.lit("/"), F.coalesce("__key", F.col("__pos").cast("string")))).otherwise(F.col("__owner"))
        at = at.lateralJoin(opened).select(
            *keep, step.alias("__owner"), F.when(state == _LISTED, F.col("__pos")).otherwise(F.col("__ord")).alias("__ord"),
            F.when(state == _ENTRY, F.col("__v")).otherwise(F.col("__value")).alias("__v"), F.when(outside, listed).otherwise(_ENTRY).alias("__state")).where("__v IS NOT NULL")
    # the owner of a list's entries is the list's own
    below = _entries(_walked(F.col("__v"), state, _reference_state, _brackets(F.to_json("__v"))))
    deeper = F.transform(below, lambda n: record(owner=F.concat("__owner", F.when(outside, n["owner"]).otherwise("")), ord=n["ord"], value=n["value"]))
    found = F.when(state == _ENTRY, F.array(record(owner=F.col("__owner"), ord=F.col("__ord"), value=F.col("__v")))).otherwise(deeper)
    entries = each(at, keep, found)
    return entries.select(*keep, _reference(F.col("x.owner"), F.col("x.ord"), F.col("x.value")).alias("r")).select(*keep, "r.*")


def claims(json: Column) -> Column:
    """Every wording that is not blank, with the references that ground it: (path, text, owner, blocks, pointers).

    The references are those of the nearest object, at or above the wording's, whose list of them is not empty; owner
    is that object's path. Nothing inside references or a wording is searched.
    """
    texts = lambda refs, name: F.filter(F.transform(refs, lambda r: as_text(F.try_element_at(as_object(r), F.lit(name)))), lambda x: x.isNotNull())
    start = record(refs=F.array().cast("array<variant>"), owner=F.lit(""), hidden=F.lit(False))

    def grounded(n: Column) -> tuple[Column, Column]:
        """The references that count in an object, and whose they are."""
        own = F.try_element_at(n["members"], F.lit(REFS))
        return F.when(_full_list(own), as_list(own)).otherwise(n["own"]["refs"]), F.when(_full_list(own), n["path"]).otherwise(n["own"]["owner"])

    def state(parent: Column, key: Column, value: Column) -> Column:
        refs, owner = grounded(parent)
        hidden = parent["own"]["hidden"] | F.coalesce(key.isin(REFS, WORDING), F.lit(False))
        return record(refs=refs, owner=owner, hidden=hidden)

    def wording(n: Column) -> Column:
        return as_text(F.try_element_at(n["members"], F.lit(WORDING)))

    def claim(n: Column) -> Column:
        refs, owner = grounded(n)
        return record(path=n["path"], text=wording(n), owner=owner, blocks=texts(refs, "blockId"), pointers=texts(refs, "payloadPointer"))

    found = F.filter(nodes(json, start, state), lambda n: ~n["own"]["hidden"] & wording(n).isNotNull() & ~F.regexp_like(wording(n), F.lit("(?U)" + _BLANK)))
    return F.transform(found, claim)


def claim_rows(rows: DataFrame, keep: list[str], value: str, json: str = "json", levels: int = LEVELS) -> DataFrame:
    """(keep, root, found): claims() of a variant in lists, on rows as seen_rows() gives them."""
    texts = lambda refs, name: F.filter(F.transform(refs, lambda r: as_text(F.try_variant_get(r, f"$.{name}", "variant"))), lambda x: x.isNotNull())

    def grounded(n: Node) -> tuple[Column, Column]:
        own = F.try_variant_get(n["value"], f"$.{REFS}", "variant")
        full = F.coalesce(items_of(own) > 0, F.lit(False))
        return F.when(full, own).otherwise(n["own"]["refs"]), F.when(full, n["path"]).otherwise(n["own"]["owner"])

    def handed(n: Node, key: Column) -> Column:
        refs, owner = grounded(n)
        return record(refs=refs, owner=owner)

    def seen(n: Node) -> Column:
        refs, owner = grounded(n)
        text = as_text(F.try_variant_get(n["value"], f"$.{WORDING}", "variant"))
        listed = F.coalesce(as_list(refs), F.array().cast("array<variant>"))
        return F.when(text.isNotNull() & ~F.regexp_like(text, F.lit("(?U)" + _BLANK)), record(path=n["path"], text=text, owner=owner, blocks=texts(listed, "blockId"), pointers=texts(listed, "payloadPointer")))

    start = record(refs=F.lit(None).cast("variant"), owner=F.lit(""))
    return seen_rows(rows, keep, value, start, handed, seen, lambda key: key.isin(REFS, WORDING), json, levels)


def resolved(value: Column, pointer: Column) -> Column:
    """What a JSON Pointer names inside a variant, null where it names nothing; a JSON null is a variant of its own."""
    steps = F.transform(F.split(F.substr(pointer, F.lit(2)), "/"), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(at: Column, key: Column) -> Column:
        # a path of one step takes one member out; a key with both kinds of quotes has no path
        member = lambda path: F.try_variant_get(at, path, "variant")
        quoted = lambda sign: member(F.concat(F.lit(f"$[{sign}"), key, F.lit(f"{sign}]")))
        named = F.when(key == "", F.try_element_at(as_object(at), key)).when(~F.contains(key, F.lit("'")), quoted("'")).when(~F.contains(key, F.lit('"')), quoted('"')).otherwise(F.try_element_at(as_object(at), key))
        return F.when(place(key), F.coalesce(member(F.concat(F.lit("$["), key, F.lit("]"))), named)).otherwise(named)

    # in one step with all numbers as places; only where that finds nothing a number may be an object's key
    place = lambda key: F.regexp_like(key, F.lit("^(0|[1-9][0-9]{0,8})$"))
    path = lambda keys: F.concat(F.lit("$"), F.array_join(F.transform(keys, lambda k: F.when(place(k), F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit("['"), k, F.lit("']")))), ""))
    plain = lambda keys: F.forall(keys, lambda k: (k != "") & ~F.contains(k, F.lit("'")))
    stepwise = lambda keys: F.aggregate(keys, value, step)
    at_once = lambda keys: F.coalesce(F.try_variant_get(value, path(keys), "variant"), F.when(F.exists(keys, place), stepwise(keys)))
    found = let(steps, lambda keys: F.when(plain(keys), at_once(keys)).otherwise(stepwise(keys)))
    return F.when(pointer == "", value).when(F.startswith(pointer, F.lit("/")), found)


def leaf_count(json: Column) -> Column:
    """The number of scalar leaves, by the commas of the text without its strings; 0 if it does not parse.

    Every node but the root is a member, and a container has one comma less than members: so leaves are one more than
    commas, less the containers that are empty.
    """
    bare = F.regexp_replace(F.regexp_replace(canonical(json), r"\\.", ""), '"[^"]*+"', "s")
    count = lambda text, what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit(what[1:])))
    return F.coalesce(let(bare, lambda x: (count(x, ",") + 1 - count(x, "{}") - count(x, "[]")).cast("int")), F.lit(0))


def canonical(json: Column) -> Column:
    """A document's text with its members in the order of their keys; null if it does not parse."""
    return F.to_json(parsed(json))


def compared(before: Column, after: Column) -> Column:
    """Two documents as the list of the pairs (path, a, b) of their nodes that are not the same in both.

    Pairs are opened from the roots down, and subtrees of equal text are left closed: what is read is what differs and
    the ways that lead there. a or b is null where one document has no such node.
    """

    def pair(path: Column, a: Column, b: Column) -> Column:
        return record(path=path, a=a, b=b, a_members=as_object(a), b_members=as_object(b), a_items=as_list(a), b_items=as_list(b))

    def by_key(members: Column, items: Column) -> Column:
        places = F.transform(items, lambda _, i: i.cast("string"))
        return F.coalesce(members, F.map_from_arrays(places, items), F.create_map().cast("map<string,variant>"))

    def opened(p: Column) -> Column:
        at = lambda step: F.concat(p["path"], F.lit("/"), step)
        lists = F.transform(
            F.slice(F.sequence(F.lit(0), F.greatest(F.size(p["a_items"]), F.size(p["b_items"]))), F.lit(1), F.greatest(F.size(p["a_items"]), F.size(p["b_items"]))),
            lambda i: pair(at(i.cast("string")), F.get(p["a_items"], i), F.get(p["b_items"], i)))
        alike = F.zip_with(F.map_entries(p["a_members"]), F.map_values(p["b_members"]), lambda e, v: pair(at(e["key"]), e["value"], v))
        mixed = lambda x: F.transform(F.array_union(F.map_keys(x["a"]), F.map_keys(x["b"])), lambda k: pair(at(k), F.try_element_at(x["a"], k), F.try_element_at(x["b"], k)))
        inner = p["a_members"].isNotNull() | p["b_members"].isNotNull() | p["a_items"].isNotNull() | p["b_items"].isNotNull()
        pairs = (
            F.when(p["a_items"].isNotNull() & p["b_items"].isNotNull(), lists)
            .when(F.map_keys(p["a_members"]) == F.map_keys(p["b_members"]), alike)
            .when(inner, let(record(a=by_key(p["a_members"], p["a_items"]), b=by_key(p["b_members"], p["b_items"])), mixed))
        )
        return F.filter(pairs, lambda c: ~F.coalesce(F.to_json(c["a"]) == F.to_json(c["b"]), F.lit(False)))

    def both(docs: Column) -> Column:
        alike = lambda v: F.to_json(v["a"]).eqNullSafe(F.to_json(v["b"]))
        roots = let(record(a=parsed(docs["a"]), b=parsed(docs["b"])), lambda v: F.filter(F.array(pair(F.lit(""), v["a"], v["b"])), lambda _: ~alike(v)))
        return unfolded(roots, opened, F.greatest(_brackets(docs["a"]), _brackets(docs["b"])), plain_levels=1)

    return let(record(a=before, b=after), both)


def differences(pairs: Column) -> Column:
    """The leaves of compared() that differ, in kind or in text: (path, before_kind, before, after_kind, after)."""

    def side(c: Column, name: str, of: Callable[[Column], Column]) -> Column:
        return F.when(c[f"{name}_members"].isNull() & c[f"{name}_items"].isNull(), of(c[name]))

    out = F.transform(pairs, lambda c: record(
        path=c["path"], before_kind=side(c, "a", scalar_kind), before=side(c, "a", scalar_text), after_kind=side(c, "b", scalar_kind), after=side(c, "b", scalar_text)))
    return F.filter(out, lambda x: ~(x["before_kind"].eqNullSafe(x["after_kind"]) & x["before"].eqNullSafe(x["after"])))
