"""Scoring of captures against truths, of runs, and of whole folders of documents under a contract.

A flat document is a row (fixture, title, yields, times, temperatures, ingredients, instructions, split_reserved,
nutrition, classifications): lists of strings, maps of strings, ingredients as (name, quantity, unit, group) and
split_reserved as (use, reserve). Null lists and maps count as empty. Truths and captures meet in one join on the
fixture; everything after it happens inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import quantity_norm, string_norm, unit_norm
from docketry.functions.trees import each, let, record

# Units that are not amounts of their own, the times that adjudication compares, the kinds of uses.
AMBIGUOUS = ["can", "clove", "pinch", "stick", "handful"]
TIMES = ["prep", "cook", "total"]
PARTIAL, REMAINING = ["use_partial_unspecified", "reserve_for_later"], ["use_remaining"]


def _norm(text: Column) -> Column:
    return string_norm(F.coalesce(text, F.lit("")))


def _quantity(text: Column) -> Column:
    return quantity_norm(F.coalesce(text, F.lit("")))


def _list(values: Column) -> Column:
    return F.coalesce(values, F.array())


def _norms(values: Column) -> Column:
    return F.transform(_list(values), _norm)


def same_in_any_order(left: Column, right: Column) -> Column:
    """Whether two lists hold the same values equally often. Null only equals null."""
    return F.array_sort(left).eqNullSafe(F.array_sort(right))


def same_sequence(left: Column, right: Column) -> Column:
    """Whether two lists hold the same values in the same order. Null only equals null."""
    return left.eqNullSafe(right)


def malformed_times(times: Column) -> Column:
    """Keys of a truth's times that are labels: such a truth is not scored for times."""
    return F.filter(F.map_keys(F.coalesce(times, F.create_map().cast("map<string,string>"))), lambda k: F.endswith(F.lower(k), F.lit("_label")))


def _covers(truth: Column, capture: Column, key, value) -> Column:
    """Whether each entry of one map is in the other, both in normal form; of like keys in a capture the last counts."""
    entry = lambda e: record(key=key(e["key"]), value=value(e["value"]))

    def covered(held: Column) -> Column:
        like = lambda e: F.filter(held, lambda h: h["key"] == e["key"])
        return F.forall(F.transform(F.map_entries(truth), entry), lambda e: F.coalesce(F.try_element_at(like(e), F.lit(-1))["value"] == e["value"], F.lit(False)))

    return let(_list(F.transform(F.map_entries(capture), entry)), covered)


def _paired(truth: DataFrame, capture: DataFrame, how: str = "inner") -> DataFrame:
    fields = [c for c in truth.columns if c != "fixture"]
    t = truth.select("fixture", F.struct(*fields).alias("t"))
    return t.join(capture.select("fixture", F.struct(*fields).alias("c")), "fixture", how)


def missing_runs(truth: DataFrame, capture: DataFrame) -> DataFrame:
    """Fixtures without a capture: they are not scored, and a verdict needs them."""
    return truth.select("fixture").join(capture.select("fixture"), "fixture", "left_anti")


def malformed(truth: DataFrame) -> DataFrame:
    """(fixture, keys) of truths whose times hold labels."""
    return truth.select("fixture", malformed_times(F.col("times")).alias("keys")).where(F.size("keys") > 0)


def circular(truth: DataFrame, capture: DataFrame) -> DataFrame:
    """One row: captures, and how many of them equal their truth, which would prove nothing."""
    text = lambda d: F.to_json(F.struct(*[F.array_sort(F.map_entries(d[c])).alias(c) if kind.startswith("map") else d[c].alias(c) for c, kind in truth.dtypes if c != "fixture"]))
    same = _paired(truth, capture).select((text(F.col("t")) == text(F.col("c"))).alias("same"))
    return same.agg(F.count("*").alias("captures"), F.count_if("same").alias("identical"))


def field_checks(truth: DataFrame, capture: DataFrame) -> DataFrame:
    """(fixture, field, edge, ok), one row for each comparison of a truth with its capture.

    Fields that a truth does not state give no row. Times hold only if all of the truth's times do; a malformed truth
    gives none. Ingredients match by their first namesake in the capture.
    """
    return pair_checks(_paired(truth, capture))


def pair_checks(pairs: DataFrame) -> DataFrame:
    """field_checks() of rows that hold a fixture, its truth t and its capture c. Each normal form is made once in a row."""
    t, c = F.col("t"), F.col("c")

    def check(field: str, ok: Column, edge: Column | None = None, when: Column | None = None) -> Column:
        one = F.array(record(field=F.lit(field), edge=F.lit(None).cast("string") if edge is None else edge, ok=F.coalesce(ok, F.lit(False))))
        return one if when is None else F.filter(one, lambda x: F.coalesce(when, F.lit(False)))

    def yielded(y: Column) -> Column:
        several = F.size(y["t"]) > 1
        alike = lambda: same_in_any_order(y["t"], y["c"])
        return F.when(several, check("multiple_yields", alike(), F.lit("multiple_yields"))).otherwise(check("yield", alike()))

    stated = F.map_filter(t["times"], lambda k, v: F.coalesce(v, F.lit("")) != "")
    timed = (F.size(malformed_times(t["times"])) == 0) & (F.size(F.map_keys(stated)) > 0)

    def heated(hot: Column) -> Column:
        held = F.forall(hot["t"], lambda x: F.array_contains(hot["c"], x)) & (F.size(hot["t"]) == F.size(hot["c"]))
        edge = F.when(F.exists(hot["t"], lambda x: F.contains(x, F.lit(".."))), F.lit("ranges"))
        return check("temperature", held, edge, F.size(hot["t"]) > 0)

    def item(i: Column) -> Column:
        return record(name=_norm(i["name"]), quantity=_quantity(i["quantity"]), unit=unit_norm(i["unit"]), group=_norm(i["group"]))

    def met(theirs: Column) -> Column:
        """The truth's ingredients, each with its namesake, null if there is none."""
        namesake = lambda n: F.get(F.filter(theirs, lambda x: x["name"] == n["name"]), F.lit(0))
        return F.transform(_list(t["ingredients"]), lambda i: let(item(i), lambda n: record(
            n=n, m=namesake(n), wanted=F.coalesce(i["quantity"], F.lit("")), grouped=F.coalesce(i["group"], F.lit("")) != "")))

    def compared(x: Column) -> Column:
        n, m, named = x["n"], x["m"], x["m"].isNotNull()
        edge = F.when(F.contains(x["wanted"], F.lit("/")), "fractions").when(F.regexp_like(x["wanted"], F.lit(r"-|–|—|\bto\b")), "ranges")
        return F.concat(
            check("ingredient.name", named), check("ingredient.quantity", named & (m["quantity"] == n["quantity"]), edge),
            check("ingredient.unit", named & (m["unit"] == n["unit"]), F.when(n["unit"].isin(AMBIGUOUS), F.lit("ambiguous_units"))))

    def ingredients(items: Column) -> Column:
        grouped = F.filter(items, lambda x: x["grouped"])
        in_groups = F.forall(grouped, lambda x: x["m"].isNotNull() & (x["m"]["group"] == x["n"]["group"]))
        return F.concat(F.flatten(F.transform(items, compared)), check("ingredient_group", in_groups, None, F.size(grouped) > 0))

    def instructed(steps: Column) -> Column:
        return F.concat(F.flatten(F.transform(steps["t"], lambda s: check("instruction.text", F.array_contains(steps["c"], s)))), check("instruction.order", same_sequence(steps["t"], steps["c"])))

    splits = _list(t["split_reserved"])
    use = lambda x: record(use=_norm(x["use"]), reserve=_norm(x["reserve"]))
    kept = let(F.transform(_list(c["split_reserved"]), use), lambda held: F.forall(
        F.transform(splits, use), lambda s: F.exists(held, lambda x: F.contains(x["use"], s["use"]) & F.contains(x["reserve"], s["reserve"]))))
    same = lambda x: x
    checks = F.concat(
        check("title", _norm(t["title"]) == _norm(c["title"])), let(record(t=_norms(t["yields"]), c=_norms(c["yields"])), yielded),
        check("time", _covers(stated, c["times"], same, _norm), None, timed),
        let(record(t=F.transform(_list(t["temperatures"]), _quantity), c=F.transform(_list(c["temperatures"]), _quantity)), heated),
        let(let(F.transform(_list(c["ingredients"]), item), met), ingredients),
        let(record(t=_norms(t["instructions"]), c=_norms(c["instructions"])), instructed), check("split_reserved", kept, None, F.size(splits) > 0),
        check("nutrition", _covers(t["nutrition"], c["nutrition"], _norm, _quantity), None, F.size(F.map_keys(t["nutrition"])) > 0),
        check("classification", _covers(t["classifications"], c["classifications"], _norm, _norm), None, F.size(F.map_keys(t["classifications"])) > 0),
    )
    return each(pairs, ["fixture"], checks).select("fixture", "x.*")


def disagreements(truth: DataFrame, capture: DataFrame) -> DataFrame:
    """(fixture, field, truth, capture): where two readings differ, as text. Lists are joined by |, in normal form.

    Ingredients meet by name, the last of like names; steps by place. A different number of steps is a row of its own,
    since prose may have been cut otherwise without being misread.
    """
    return pair_disagreements(_paired(truth, capture))


def pair_disagreements(pairs: DataFrame) -> DataFrame:
    """disagreements() of rows that hold a fixture, its truth t and its capture c."""
    t, c = F.col("t"), F.col("c")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    row = lambda field, a, b, when: F.filter(F.array(F.struct(field.alias("field"), text(a).alias("truth"), text(b).alias("capture"))), lambda x: F.coalesce(when, F.lit(False)))
    differ = lambda field, a, b: row(F.lit(field), a, b, _norm(a) != _norm(b))
    joined = lambda x: F.array_join(x, "|")
    listed = lambda field, a, b: row(F.lit(field), joined(a), joined(b), a != b)
    ours, theirs = _list(t["ingredients"]), _list(c["ingredients"])
    names = lambda items: F.array_distinct(F.transform(items, lambda i: _norm(i["name"])))
    last = lambda items, name: F.try_element_at(F.filter(items, lambda i: _norm(i["name"]) == name), F.lit(-1))
    both = F.array_intersect(names(ours), names(theirs))

    def changed(name: Column) -> Column:
        a, b = last(ours, name), last(theirs, name)
        parts = [row(F.concat(F.lit(f"ingredient.{f} ["), name, F.lit("]")), a[f], b[f], _norm(a[f]) != _norm(b[f])) for f in ("quantity", "unit")]
        return F.concat(*parts)

    steps, taken = _norms(t["instructions"]), _norms(c["instructions"])
    shared = F.slice(F.arrays_zip(steps.alias("a"), taken.alias("b")), F.lit(1), F.least(F.size(steps), F.size(taken)))
    rows = F.concat(
        differ("title", t["title"], c["title"]), listed("yields", _norms(t["yields"]), _norms(c["yields"])),
        *[differ(f"times.{k}", F.try_element_at(t["times"], F.lit(k)), F.try_element_at(c["times"], F.lit(k))) for k in TIMES],
        listed("temperatures", F.array_sort(_norms(t["temperatures"])), F.array_sort(_norms(c["temperatures"]))),
        F.flatten(F.transform(F.array_except(names(ours), names(theirs)), lambda n: row(F.lit("ingredient.missing"), n, F.lit(""), F.lit(True)))),
        F.flatten(F.transform(F.array_except(names(theirs), names(ours)), lambda n: row(F.lit("ingredient.extra"), F.lit(""), n, F.lit(True)))),
        F.flatten(F.transform(both, changed)),
        row(F.lit("instruction.count"), F.size(steps), F.size(taken), F.size(steps) != F.size(taken)),
        F.flatten(F.transform(shared, lambda p, i: row(F.concat(F.lit("instruction["), i.cast("string"), F.lit("]")), p["a"], p["b"], p["a"] != p["b"]))),
    )
    return each(pairs, ["fixture"], rows).select("fixture", "x.*")


def _last_of(entries: Column, key: str, text: str) -> Column:
    """A map of the entries that have both parts; of like keys the last counts."""
    whole = F.filter(_list(entries), lambda e: (F.coalesce(e[key], F.lit("")) != "") & (F.coalesce(F.trim(e[text]), F.lit("")) != ""))
    keys = F.array_distinct(F.transform(whole, lambda e: e[key]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(whole, lambda e: e[key] == k), F.lit(-1))[text]))


def split_pairs(uses: Column) -> Column:
    """(use, reserve) of each id that is used in part and, in any place, used up: the first label of either kind.

    uses: (id, usage, label) in document order; those without id or label do not count.
    """
    whole = F.filter(_list(uses), lambda u: (F.coalesce(u["id"], F.lit("")) != "") & (F.coalesce(F.trim(u["label"]), F.lit("")) != ""))

    def pairs(whole: Column) -> Column:
        of = lambda kinds: F.filter(whole, lambda u: u["usage"].isin(kinds))
        ids = F.array_distinct(F.transform(of(REMAINING), lambda u: u["id"]))
        first = lambda kinds, k: F.get(F.filter(of(kinds), lambda u: u["id"] == k), F.lit(0))["label"]
        return F.filter(F.transform(ids, lambda k: F.struct(first(PARTIAL, k).alias("use"), first(REMAINING, k).alias("reserve"))), lambda p: p["use"].isNotNull())

    return let(whole, pairs)


def projected(documents: DataFrame, keep: list[str] = []) -> DataFrame:
    """The flat document of each whole one, with the columns to keep.

    documents: fixture, title, groups (title, ingredients (name, quantity, unit)), sections (steps (text,
    temperatures, uses (id, usage, label))), times (type, text), yields, nutrition (name, text), classifications
    (kind, text). A group's name is its title, and a title is taken as its wording.
    """
    items = F.flatten(F.transform(_list(F.col("groups")), lambda g: F.transform(
        _list(g["ingredients"]), lambda i: F.struct(i["name"].alias("name"), i["quantity"].alias("quantity"), i["unit"].alias("unit"), g["title"].alias("group")))))
    steps = F.flatten(F.transform(_list(F.col("sections")), lambda s: _list(s["steps"])))
    stated = lambda values: F.filter(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    times = _last_of(F.col("times"), "type", "text")
    return documents.select(
        "fixture", *keep, "title", stated(_list(F.col("yields"))).alias("yields"), F.map_filter(times, lambda k, v: k.isin(TIMES)).alias("times"),
        stated(F.flatten(F.transform(steps, lambda s: _list(s["temperatures"])))).alias("temperatures"), items.alias("ingredients"),
        stated(F.transform(steps, lambda s: s["text"])).alias("instructions"), split_pairs(F.flatten(F.transform(steps, lambda s: _list(s["uses"])))).alias("split_reserved"),
        _last_of(F.col("nutrition"), "name", "text").alias("nutrition"), _last_of(F.col("classifications"), "kind", "text").alias("classifications"))


def run_scores(runs: DataFrame, references: DataFrame) -> DataFrame:
    """runs (shape, fixture, model, run, valid, block_ids, refs) with refs_total, refs_resolved, unresolved, signature.

    A capture has no references to resolve and so no counts; a normalization's are looked up in its fixture's
    reference blocks (fixture, known), those of any other shape in its own. The signature of a normalization is null.
    """
    joined = runs.join(references.select("fixture", "known"), "fixture", "left")
    refers, lone = F.col("shape") != "capture", F.col("shape") == "normalization"
    known = _list(F.when(lone, F.col("known")).otherwise(F.col("block_ids")))
    missing = F.filter(_list(F.col("refs")), lambda r: ~F.array_contains(known, r))
    total = F.when(refers, F.size(_list(F.col("refs"))))
    return joined.select(
        *runs.columns, total.alias("refs_total"), (total - F.size(missing)).alias("refs_resolved"),
        F.when(refers, F.array_distinct(missing)).otherwise(F.array().cast("array<string>")).alias("unresolved"),
        F.when(~lone, F.array_join(F.array_sort(F.array_distinct(_list(F.col("block_ids")))), ",")).alias("signature"))


def run_summary(scores: DataFrame) -> DataFrame:
    """Runs, valid ones, references and the stability of block ids for each (shape, fixture, model)."""
    full = (F.col("refs_total") > 0) & (F.col("refs_resolved") == F.col("refs_total"))
    return scores.groupBy("shape", "fixture", "model").agg(
        F.count("*").alias("runs"), F.count_if("valid").alias("valid"), F.sum("refs_total").alias("refs_total"), F.sum("refs_resolved").alias("refs_resolved"),
        F.count_if(full).alias("fully_resolved"), F.count_distinct(F.nullif("signature", F.lit(""))).alias("signatures"),
    ).withColumn("stable", F.col("signatures") <= 1)


def validity_sweep(rows: DataFrame, by: list[str], violations: str = "violations") -> DataFrame:
    """How many documents of each kind keep their contract: (by, total, valid)."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.size(violations) == 0).alias("valid"))


def sweep_failures(rows: DataFrame, key: list[str], violations: str = "violations") -> DataFrame:
    """(key, message) of documents that break their contract; reasons are joined by semicolons."""
    return rows.where(F.size(violations) > 0).select(*key, F.array_join(F.array_sort(violations), "; ").alias("message"))
