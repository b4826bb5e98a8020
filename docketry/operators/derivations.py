"""Derived views of documents: interchange mapping, durations, plans, cards. No number is ever made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import block_ids
from docketry.functions.trees import let, record

# Seconds of each unit's names.
SECONDS = {
    1: "s sec secs second seconds sek sekunde sekunden", 60: "m min mins minute minutes minuten",
    3600: "h hr hrs hour hours std stunde stunden", 86400: "d day days tag tage",
}
# The interchange field of each kind of time.
TIME_FIELDS = {"prep": "prepTime", "cook": "cookTime", "bake": "cookTime", "total": "totalTime"}


def iso_duration(kind: Column, value: Column, unit: Column) -> Column:
    """struct(iso, reason): an ISO 8601 duration for an exact, whole and positive number of seconds, else why not."""
    pairs = F.create_map(*[F.lit(x) for n, names in SECONDS.items() for name in names.split() for x in (name, float(n))])

    # each step's columns are bound once: written out in one another they would be computed hundreds of times
    def seconds(folded: Column) -> Column:
        return let(F.try_element_at(pairs, folded), lambda per_unit: record(folded=folded, per_unit=per_unit, exact=value * per_unit, whole=F.floor(value * per_unit + 0.5)))

    def judged(x: Column) -> Column:
        unfit = F.isnan(x["exact"]) | (F.abs(x["exact"]) == float("inf")) | (F.abs(x["exact"] - x["whole"]) > 1e-9) | (x["whole"] <= 0)
        reason = (
            F.when(~kind.eqNullSafe(F.lit("exact")) | value.isNull(), "non_exact_value")
            .when(F.coalesce(x["folded"], F.lit("")) == "", "missing_unit").when(x["per_unit"].isNull(), "unrecognized_unit").when(unfit, "not_representable")
        )
        # cut to a range in which a long holds it before it is divided
        return let(reason, lambda why: record(n=F.when(why.isNull(), x["whole"].cast("long")), reason=why))

    def written(x: Column) -> Column:
        part = lambda x, sign: F.when(x > 0, F.concat(x.cast("string"), F.lit(sign))).otherwise("")
        iso = lambda n: F.concat(F.lit("PT"), part(F.floor(n / 3600), "H"), part(F.floor(n % 3600 / 60), "M"), part(n % 60, "S"))
        return record(iso=F.when(x["reason"].isNull(), let(x["n"], iso)), reason=x["reason"])

    return let(let(let(F.lower(F.trim(unit)), seconds), judged), written)


def mapped_times(times: DataFrame, key: list[str]) -> DataFrame:
    """times (key, pos, type, kind, value, unit, wording) with field, iso and omission.

    The first time that names a field claims it, even if its duration is then omitted; later ones are duplicates.
    """
    pairs = [F.lit(x) for item in TIME_FIELDS.items() for x in item]
    rows = times.withColumn("field", F.try_element_at(F.create_map(*pairs), F.col("type")))
    at = Window.partitionBy(*key, "field").orderBy("pos")
    rows = rows.withColumns({"__n": F.row_number().over(at), "__iso": iso_duration(F.col("kind"), F.col("value"), F.col("unit"))})
    omission = F.when(F.col("field").isNull(), "unmapped_time_type").when(F.col("__n") > 1, "duplicate_time_type").otherwise(F.col("__iso.reason"))
    out = rows.withColumns({"omission": omission, "iso": F.when(omission.isNull(), F.col("__iso.iso"))})
    return out.withColumn("field", F.coalesce("field", F.concat(F.lit("times."), "type"))).drop("__n", "__iso")


def mapped_yields(kind: Column, value: Column, unit: Column, wording: Column) -> Column:
    """A quantitative value for an exact yield, else its wording and the omission."""
    exact = kind.eqNullSafe(F.lit("exact")) & value.isNotNull()
    return F.struct(F.when(exact, value).alias("value"), F.when(exact, unit).alias("unit_text"), wording.alias("name"), F.when(~exact, F.lit("non_exact_value")).alias("omission"))


def measurable(kind: Column) -> Column:
    return F.coalesce(~kind.isin("qualitative", "none"), F.lit(False))


def routed(usage: Column) -> Column:
    """Where a use goes: reserved, part_of, remaining or amounts."""
    return F.when(usage == "reserve_for_later", "reserved").when(usage == "use_partial_unspecified", "part_of").when(usage == "use_remaining", "remaining").otherwise("amounts")


def amounts(uses: DataFrame) -> DataFrame:
    """uses (…, usage, use_text, use_unit, use_kind, whole_text, whole_unit, whole_kind) with route, text, measurable, whole.

    A split or reserved use never inherits the quantity of the whole.
    """
    route = routed(F.col("usage"))
    stated = F.col("use_kind").isNotNull() | F.col("use_text").isNotNull()
    inherits = ~stated & (route == "amounts")
    wording = lambda t, u: F.concat_ws(" ", t, F.nullif(u, F.lit("")))
    text = F.when(stated, wording(F.col("use_text"), F.col("use_unit"))).when(inherits, wording(F.col("whole_text"), F.col("whole_unit"))).otherwise("")
    kind = F.when(stated, F.col("use_kind")).when(inherits, F.col("whole_kind"))
    whole = F.when(route.isin("part_of", "remaining"), wording(F.col("whole_text"), F.col("whole_unit")))
    return uses.withColumns({"route": route, "text": text, "measurable": measurable(kind), "whole": whole})


def starts_now(cue: Column, action: Column, unit_number: Column) -> Column:
    """Whether a prerequisite has to be begun now: needed from the second unit on, and not made by its own step.

    A step makes it if all words of the cue of more than two letters occur in its action; a cue without any is begun.
    """
    words = F.filter(F.split(F.lower(cue), r"[^\p{L}\p{N}°]+"), lambda w: F.length(w) > 2)
    made = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower(action), w))
    return (unit_number >= 2) & ~made


def needs_amount_block(splits: Column, reserved: Column, amounts_: Column, critical: Column, any_measurable: Column) -> Column:
    """Counts of a unit's parts to whether its amounts are worth a block."""
    return (splits + reserved > 0) | ((amounts_ > 0) & ((critical > 0) | any_measurable))


def critical(durations: Column, temperatures: Column, doneness: Column, waits: Column) -> Column:
    """Critical wordings in their fixed order, each with its kind; arguments are lists of wordings."""
    tagged = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))
    return F.concat(tagged(durations, "duration"), tagged(temperatures, "temperature"), tagged(doneness, "doneness"), tagged(waits, "wait"))


def at_hand_suppressed(items: Column, on: bool = False) -> Column:
    """Ingredients without those that state no quantity, if that is asked for."""
    return F.filter(items, lambda i: i["val_kind"].isNotNull()) if on else items


def plan(documents: DataFrame) -> DataFrame:
    """Units of every document in order: (recipe_id, version, n, section, action, amount, measurable, needs_block).

    Sections are groups and steps their lines; each step's own line is its amount.
    """
    sections = documents.select("recipe_id", "version", F.posexplode("doc.groups").alias("s", "g"))
    steps = sections.select("recipe_id", "version", "s", F.col("g.title").alias("section"), F.posexplode("g.ingredients").alias("p", "i"))
    at = Window.partitionBy("recipe_id", "version").orderBy("s", "p")
    can = measurable(F.col("i.val_kind"))
    return steps.select(
        "recipe_id", "version", F.row_number().over(at).alias("n"), "section", F.col("i.source_text").alias("action"),
        F.concat_ws(" ", F.trim("i.val_source_text"), F.nullif(F.col("i.unit"), F.lit(""))).alias("amount"), can.alias("measurable"),
        needs_amount_block(F.lit(0), F.lit(0), F.lit(1), F.lit(0), can).alias("needs_block"),
    )


def carried_media(log: DataFrame, explicit: str = "media", out: str = "carried") -> DataFrame:
    """Each version's own media, or that of the last version before it that has some."""
    at = Window.partitionBy("recipe_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(out, F.last(explicit, ignorenulls=True).over(at))


def card(documents: DataFrame) -> DataFrame:
    """Display strings of a document: title or a stated gap, attribution, number of ingredients, first amount."""
    flat = F.flatten(F.transform("doc.groups", lambda g: g["ingredients"]))
    first = F.get(flat, F.lit(0))
    return documents.select(
        "recipe_id", "version", F.coalesce("doc.title", F.lit("(no title in source)")).alias("title"), F.size(flat).alias("n_ingredients"),
        F.concat_ws(" ", F.trim(first["val_source_text"]), first["unit"]).alias("first_amount"))


def snapshots(captures: DataFrame, blocks: DataFrame, adapter: str, adapter_version: str, run_id: str, model: str | None = None) -> DataFrame:
    """(snapshot_id, snapshot): captures (snapshot_id, source_type, captured_text, payload) with their blocks and provenance.

    Blocks (snapshot_id, ord, type, heading, heading_norm, text, text_norm) get their ids here and stand in order. A
    capture without blocks has an empty list, for the contract to refuse.
    """
    named = block_ids(blocks).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("block_id").alias("id"), "type", "heading", "text"))).alias("blocks"))
    origin = F.struct(F.lit(adapter).alias("adapter"), F.lit(adapter_version).alias("adapter_version"), F.lit(run_id).alias("run_id"), F.lit(model).cast("string").alias("model"))
    none = F.array().cast(dict(named.dtypes)["blocks"])
    return captures.join(named, "snapshot_id", "left").select("snapshot_id", F.struct(
        "snapshot_id", F.lit(1).alias("version"), "source_type", "captured_text", "payload", F.coalesce("blocks", none).alias("blocks"), origin.alias("provenance")).alias("snapshot"))
