"""Evaluation roll-ups: tallies, quantiles, stability, cost, coverage, verdicts, and the bar registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(checks: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    """Hits, totals and rates; a rate is null where nothing was checked."""
    return checks.groupBy(*by).agg(F.count_if(F.col(ok)).alias("hits"), F.count(ok).alias("total")).withColumn("rate", F.try_divide("hits", "total"))


def nearest_rank(values: str, q: float) -> Column:
    """sorted[min(n - 1, floor(q n))]. A group's values come together, so this is for bounded groups."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * q).cast("int")))


#: Stretches of values into which nearest_ranks cuts a group.
STRETCHES = 256


def nearest_ranks(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles of groups of any size, in two steps.

    Values are counted, and approximate quantiles cut each group into stretches. Sums over stretches, a bounded number
    for each group, tell which stretch holds a rank; only these stretches are ranked value by value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(by).agg(F.percentile_approx(value, [k / STRETCHES for k in range(1, STRETCHES)], STRETCHES * 4).alias("__cuts"))
    counts = counts.join(cuts, F.equal_null(counts[by], cuts[by])).drop(cuts[by])
    counts = counts.withColumn("__at", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    sums = counts.groupBy(by, "__at").agg(F.sum("n").alias("__n"))
    before, everything = Window.partitionBy(by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__all": F.sum("__n").over(everything)})
    rank = {name: F.least(F.col("__all") - 1, F.floor(F.col("__all") * q)) for name, q in quantiles.items()}
    holds = [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")) for r in rank.values()]
    sums = sums.where(reduce(lambda x, y: x | y, holds)).withColumnsRenamed({by: "__by", "__at": "__stretch"})
    near = counts.join(sums, F.equal_null(F.col(by), F.col("__by")) & (F.col("__at") == F.col("__stretch")))
    upto = F.col("__before") + F.sum("n").over(Window.partitionBy(by, "__at").orderBy(value))
    near = near.withColumn("__upto", upto)
    inside = lambda r: (r < F.col("__upto")) & (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n"))
    return near.groupBy(by).agg(*[F.min(F.when(inside(r), F.col(value))).alias(name) for name, r in rank.items()])


def stability(runs: DataFrame, by: list[str], ids: str) -> DataFrame:
    """Distinct signatures of runs: their sorted ids joined. Stable: at most one that is not empty."""
    signed = runs.withColumn("__sig", F.array_join(F.array_sort(ids), ","))
    return signed.groupBy(*by).agg(F.count("*").alias("runs"), F.count_distinct(F.nullif("__sig", F.lit(""))).alias("signatures")).withColumn("stable", F.col("signatures") <= 1)


def cost(runs: DataFrame, by: list[str], tokens: str, ok: str) -> DataFrame:
    """Tokens per attempt and per success, rounded half up; none without a success."""
    out = runs.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if(F.col(ok)).alias("successes"), F.sum(tokens).alias("tokens"))
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    return out.withColumns({"per_attempt": half_up(F.try_divide("tokens", "attempts")), "per_success": half_up(F.try_divide("tokens", "successes"))})


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, rounded down."""
    return F.floor(F.try_divide(100 * part, whole)).cast("long")


def verdict(rates: DataFrame, bars: DataFrame, identical: Column) -> DataFrame:
    """One row: PASS only if every bar has a rate that meets it; inconclusive if all captures equal their truths."""
    joined = bars.join(rates, "field", "left")
    out = joined.agg(
        F.count_if(F.col("rate").isNull()).alias("unmeasured"), F.count_if(F.col("rate") < F.col("bar")).alias("failing"), F.max(identical).alias("identical"))
    return out.select("failing", "unmeasured", F.when(F.col("identical"), "INCONCLUSIVE_CIRCULAR").when((F.col("failing") > 0) | (F.col("unmeasured") > 0), "FAIL").otherwise("PASS").alias("verdict"))


def active_bars(registry: DataFrame) -> DataFrame:
    """Entries that no later entry supersedes."""
    return registry.join(registry.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("seq")), "seq", "left_anti")


def registration_digest(active: DataFrame) -> DataFrame:
    """One row: the digest of the active set, sorted."""
    line = F.concat_ws("|", "kind", "bar", F.format_string("%.4f", "value"))
    return active.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("digest"))


def not_append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries that are gone or changed in the new registry."""
    return old.exceptAll(new.select(*old.columns).join(old.select("seq"), "seq", "left_semi").select(*old.columns))


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """The label of the first rule one of whose words a text holds."""
    out, low = None, F.lower(text)
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def run_names(name: Column) -> Column:
    """struct(shape, fixture, model, run) of <shape>__<fixture>__<model>__runNN.json."""
    pattern = r"^(.+?)__(.+?)__(.+?)__run(\d+)\.json$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(part(1).alias("shape"), part(2).alias("fixture"), part(3).alias("model"), part(4).try_cast("int").alias("run"))


def rendered(report: DataFrame) -> str:
    """A table of text for a small report; a cell without a measurement is an error, never a zero."""
    rows = report.collect()
    if any(v is None for r in rows for v in r):
        raise ValueError("a cell is not measured")
    head = "| " + " | ".join(report.columns) + " |"
    return "\n".join([head, "|" + "-|" * len(report.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)])
