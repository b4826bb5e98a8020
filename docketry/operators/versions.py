"""Operators over the append-only version log: latest, listing, append, projection, aggregation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import trees


def latest(log: DataFrame, key: str = "recipe_id", order: str = "version") -> DataFrame:
    """The key and its greatest version: identifiers only, so wide documents are joined back afterwards."""
    return log.groupBy(key).agg(F.max(order).alias(order))


def latest_rows(log: DataFrame, key: str = "recipe_id", order: str = "version") -> DataFrame:
    """The whole row of the greatest version of each key, by rank; Spark prunes ranks before the shuffle."""
    at = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__rank", F.row_number().over(at)).where("__rank = 1").drop("__rank")


def library(log: DataFrame) -> DataFrame:
    """One row per document: its latest version and that version's title, null where the title is declared absent."""
    return log.groupBy("recipe_id").agg(F.max("version").alias("latest_version"), F.max_by("title", "version").alias("title"))


def upserted(log: DataFrame, key: str, sequence: list[str], payload: list[str]) -> DataFrame:
    """Last write wins: the payload of each key's last row."""
    return log.groupBy(key).agg(*[F.max_by(F.struct(c), F.struct(*sequence))[c].alias(c) for c in payload])


def appended(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """new with versions that go on from each document's greatest existing one. One writer at a time is assumed."""
    most = existing.groupBy("recipe_id").agg(F.max("version").alias("__most"))
    at = Window.partitionBy("recipe_id").orderBy(*order)
    numbered = new.withColumn("__n", F.row_number().over(at)).join(most, "recipe_id", "left")
    return numbered.withColumn("version", (F.coalesce("__most", F.lit(0)) + F.col("__n")).cast("int")).drop("__most", "__n")


def version_conflicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose (recipe_id, version) is taken: the write that has to fail."""
    return new.join(existing.select("recipe_id", "version"), ["recipe_id", "version"], "left_semi")


def extracted(documents: DataFrame) -> DataFrame:
    """The flattened ingredient projection of nested documents, with 0-based ordinals. Empty groups give no row."""
    groups = documents.select("recipe_id", "version", F.posexplode("doc.groups").alias("group_ordinal", "g"))
    items = groups.select("recipe_id", "version", "group_ordinal", F.posexplode("g.ingredients").alias("ordinal", "i"))
    return items.select("recipe_id", "version", "group_ordinal", "ordinal", "i.*")


def projection(doc: Column) -> Column:
    """The rows of extracted() as a list inside the document's own row."""
    rows = lambda g, at: F.transform(g["ingredients"], lambda i, n: F.struct(at.alias("group_ordinal"), n.alias("ordinal"), i.alias("i")))
    return F.flatten(F.filter(F.transform(doc["groups"], rows), lambda x: x.isNotNull()))


def wanted_text(kind: Column, value_text: Column, text: Column) -> Column:
    """The wording of an amount that is not exact: the trimmed quantity wording, or the untrimmed line."""
    return F.when(~kind.eqNullSafe(F.lit("exact")), F.coalesce(F.nullif(F.trim(value_text), F.lit("")), text))


def shopping(rows: DataFrame) -> DataFrame:
    """What the given documents need, by folded name and raw unit. Only exact amounts are summed.

    The wordings of all other amounts stay as a sorted list with duplicates.
    """
    exact = F.col("val_kind").eqNullSafe(F.lit("exact")) & F.col("val_value").isNotNull()
    keyed = rows.select(
        F.lower(F.trim("name")).alias("ingredient"), F.coalesce("unit", F.lit("")).alias("unit"), "recipe_id",
        F.when(exact, F.col("val_value")).alias("exact"), wanted_text(F.col("val_kind"), F.col("val_source_text"), F.col("source_text")).alias("wording"),
    )
    return keyed.groupBy("ingredient", "unit").agg(
        F.countDistinct("recipe_id").alias("recipe_count"), F.count("exact").alias("exact_count"), F.sum("exact").alias("summed_value"),
        F.count("wording").alias("unsummable_count"), F.array_sort(F.collect_list("wording")).alias("unsummable"),
    )


def shopping_of_latest(log: DataFrame, projection: DataFrame) -> DataFrame:
    return shopping(projection.join(latest(log), ["recipe_id", "version"]))


def shopping_of_documents(documents: DataFrame) -> DataFrame:
    """As shopping_of_latest, from nested documents: identifiers first, then the documents, then their lines."""
    return shopping(extracted(documents.join(latest(documents.select("recipe_id", "version")), ["recipe_id", "version"])))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """How often a row is in one frame more than in the other, for rows that differ."""
    both = left.select("*", F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select("*", F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return both.groupBy(*left.columns).agg(F.sum("__l").alias("only_left"), F.sum("__r").alias("only_right")).where("only_left != only_right")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows that only one of two formulations gives. Both are 0 where they agree."""
    return agreement_of(differences(left, right))


def agreement_of(found: DataFrame) -> DataFrame:
    """agreement() of differences that are found already."""
    return found.agg(
        F.coalesce(F.sum(F.greatest(F.col("only_left") - F.col("only_right"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("only_right") - F.col("only_left"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def gathered_differences(pairs: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """differences() of rows that stand as two lists of structs beside the key of what they belong to.

    Keys whose lists hold the same rows, in any order, are done inside their row; only the rows of others are counted.
    """
    none = F.array().cast(dict(pairs.dtypes)[left])
    a, b = (F.coalesce(F.col(c), none) for c in (left, right))
    side = lambda rows, n: F.transform(rows, lambda x: F.struct(x.alias("x"), F.lit(n).alias("l"), F.lit(1 - n).alias("r")))
    open_ = trees.each(pairs.where(~((a == b) | (F.sort_array(a) == F.sort_array(b)))), key, F.concat(side(a, 1), side(b, 0)), "__row")
    rows = open_.select(*key, "__row.x.*", F.col("__row.l").alias("__l"), F.col("__row.r").alias("__r"))
    return rows.groupBy(*[c for c in rows.columns if c not in ("__l", "__r")]).agg(F.sum("__l").alias("only_left"), F.sum("__r").alias("only_right")).where("only_left != only_right")


def leaf_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Leaves (key, path, kind, text) of two versions that differ; if only the kind does, it is written out."""
    a = left.select(*key, "path", F.col("kind").alias("ka"), F.col("text").alias("ta"))
    b = right.select(*key, "path", F.col("kind").alias("kb"), F.col("text").alias("tb"))
    both = a.join(b, [*key, "path"], "full_outer")
    same = F.col("ka").eqNullSafe(F.col("kb")) & F.col("ta").eqNullSafe(F.col("tb"))
    kinds = F.col("ta").eqNullSafe(F.col("tb")) & ~F.col("ka").eqNullSafe(F.col("kb"))
    shown = lambda t, k: F.when(kinds, F.concat(t, F.lit(" ("), k, F.lit(")"))).otherwise(F.col(t))
    return both.where(~same).select(*key, "path", shown("ta", F.col("ka")).alias("before"), shown("tb", F.col("kb")).alias("after"))


def with_digests(log: DataFrame, json: str = "json") -> DataFrame:
    """log with digest and n_leaves of each document: written with a version, they spare reading it when it is compared.

    Documents that differ in the order of members alone have one digest; those that do not parse have none.
    """
    return log.withColumns({"digest": F.md5(trees.canonical(F.col(json))), "n_leaves": trees.leaf_count(F.col(json))})


def document_diff(before: DataFrame, after: DataFrame, key: list[str], json: str = "json") -> DataFrame:
    """(key, n_leaves, changes, n_opened) of every document that both frames, as with_digests() gives them, hold.

    Documents with equal digests are not read; of the others only the subtrees that differ are opened. changes are the
    leaves that differ, as in trees.differences(); n_leaves are those of the document before, n_opened the pairs of nodes
    that were looked at. The frames meet in one join, so that each is made once.
    """
    sides = before.select(*key, F.col("digest").alias("__da"), F.col(json).alias("__a"), "n_leaves").join(after.select(*key, F.col("digest").alias("__db"), F.col(json).alias("__b")), key)
    return pair_diff(sides, key, "__a", "__b", F.coalesce(F.col("__da") == F.col("__db"), F.lit(False)))


def pair_diff(pairs: DataFrame, key: list[str], before: str, after: str, equal: Column | None = None) -> DataFrame:
    """document_diff() of rows that hold both documents, and n_leaves of the first. Those known to be equal are not read."""

    def found(p: Column) -> Column:
        return trees.record(changes=trees.differences(p), n_opened=F.size(p))

    none = F.lit(None).cast("string")
    diff = trees.let(trees.compared(F.col(before), F.col(after)) if equal is None else trees.compared(F.when(~equal, F.col(before)).otherwise(none), F.when(~equal, F.col(after)).otherwise(none)), found)
    return pairs.select(*key, "n_leaves", diff.alias("__d")).select(*key, "n_leaves", "__d.changes", "__d.n_opened")


def change_rows(diff: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, before, after) of document_diff(); where only the kind differs, it is written out."""
    rows = trees.each(diff, key, "changes", "c").select(*key, "c.*")
    before, after = shown({c: F.col(c) for c in rows.columns})
    return rows.select(*key, "path", before.alias("before"), after.alias("after"))


def shown(change: Column | dict[str, Column]) -> tuple[Column, Column]:
    """Both sides of a change as they are written out."""
    kinds = change["before"].eqNullSafe(change["after"])
    side = lambda name: F.when(kinds, F.concat(change[name], F.lit(" ("), change[f"{name}_kind"], F.lit(")"))).otherwise(change[name])
    return side("before"), side("after")


def change_counts(diff: DataFrame, key: list[str], beside: list[str] = []) -> DataFrame:
    """(key, n_changes, same) of document_diff(): same counts the leaves that are alike, without reading them."""
    lost = F.size(F.filter("changes", lambda c: c["before_kind"].isNotNull()))
    return diff.select(*key, F.size("changes").alias("n_changes"), (F.col("n_leaves") - lost).alias("same"), *beside)


def same_leaves(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """How many leaves two versions share."""
    return left.join(right, [*key, "path", "kind", "text"]).groupBy(*key).agg(F.count("*").alias("same"))


def branches(diff: DataFrame) -> DataFrame:
    """Differing leaves by the first part of their path."""
    return diff.groupBy(F.split("path", "/")[1].alias("branch")).agg(F.count("*").alias("n"))


def dangling(rows: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key no target has: a foreign key's violations."""
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in on)).join(targets.select(*on).distinct(), on, "left_anti")


def inserted_if_absent(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: later inserts of a key do nothing."""
    at = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("__rank", F.row_number().over(at)).where("__rank = 1").drop("__rank")


def resolved_grants(mints: DataFrame, revocations: DataFrame) -> DataFrame:
    """Grants that are not revoked. A revoked digest stays known, so it cannot be minted again."""
    return mints.join(revocations.select("digest").distinct(), "digest", "left_anti")


def decomposed(documents: DataFrame) -> dict[str, DataFrame]:
    """Nested documents as relational tables: documents, groups and ingredients, each with its owner's key."""
    groups = documents.select("recipe_id", "version", F.posexplode("doc.groups").alias("group_ordinal", "g"))
    return {
        "documents": documents.select("recipe_id", "version", "doc.doc_key", "doc.title"),
        "groups": groups.select("recipe_id", "version", "group_ordinal", F.col("g.title").alias("title")),
        "ingredients": extracted(documents),
    }


def recomposed(tables: dict[str, DataFrame]) -> DataFrame:
    """The nested documents again, without loss: all tables meet in one shuffle, by the documents' key."""
    key = ["recipe_id", "version"]
    fields = [c for c in tables["ingredients"].columns if c not in (*key, "group_ordinal", "ordinal")]
    item = tables["ingredients"].select(*key, F.struct("group_ordinal", "ordinal", *fields).alias("i"))
    group = tables["groups"].select(*key, F.struct("group_ordinal", "title").alias("g"))
    document = tables["documents"].select(*key, F.struct("doc_key", "title").alias("d"))
    together = item.unionByName(group, allowMissingColumns=True).unionByName(document, allowMissingColumns=True)
    held = together.groupBy(*key).agg(F.first("d", ignorenulls=True).alias("d"), F.array_sort(F.collect_list("g")).alias("g"), F.array_sort(F.collect_list("i")).alias("i"))
    own = lambda g: F.filter("i", lambda x: x["group_ordinal"] == g["group_ordinal"])
    groups = F.transform("g", lambda g: F.struct(g["title"].alias("title"), F.transform(own(g), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("ingredients")))
    return held.where("d IS NOT NULL").select(*key, F.struct("d.doc_key", "d.title", groups.alias("groups")).alias("doc"))
