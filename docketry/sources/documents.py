"""Sources: directories of JSON documents, content-addressed bytes, fetched responses, and model replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.web import content_id


def json_documents(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(file, json, parsed): each file of a folder with a suffix, as one row; parsed is null where it is no JSON."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"), F.try_parse_json("value").alias("parsed"))


def put_bytes(store: str, rows: DataFrame, content: str = "content") -> DataFrame:
    """Appends contents that a store does not hold yet; returns (content_id) of all given rows. Putting twice is putting once."""
    spark = rows.sparkSession
    given = rows.select(content_id(F.col(content)).alias("content_id"), F.col(content).alias("content")).dropDuplicates(["content_id"])
    fanned = given.withColumn("fan", F.substring("content_id", 8, 2))
    held = stored_bytes(spark, store)
    new = fanned if held is None else fanned.join(held.select("content_id"), "content_id", "left_anti")
    new.write.mode("append").partitionBy("fan").parquet(store)
    return given.select("content_id")


def stored_bytes(spark: SparkSession, store: str) -> DataFrame | None:
    """(content_id, content, fan) of a store, or None where nothing was ever put."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("content_id string, content binary, fan string").parquet(store)


def get_bytes(spark: SparkSession, store: str, wanted: str) -> DataFrame:
    """The row of a content id, from its own folder alone; none for an id that is malformed."""
    held = stored_bytes(spark, store)
    if held is None:
        return spark.createDataFrame([], "content_id string, content binary, fan string")
    whole = F.lit(wanted).rlike(r"^sha256:[0-9a-f]{64}$")
    return held.where(whole & (F.col("fan") == wanted[7:9]) & (F.col("content_id") == wanted))


@dataclass(frozen=True)
class FetchPolicy:
    """The bounds of a guarded fetch. There is no network here: responses come as rows."""

    redirects: int = 5
    size: int = 5 * 1024 * 1024
    seconds: float = 10.0
    types: tuple[str, ...] = ("text/html", "application/xhtml+xml", "text/plain")

    def code(self, hops: Column, located: Column, content_type: Column, size: Column, seconds: Column) -> Column:
        """OK or why a response is refused: bounds are tested in the order in which a fetch meets them."""
        kind = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
        return (
            F.when(seconds > self.seconds, "TIME_LIMIT").when(~located, "REDIRECT_INVALID").when(hops > self.redirects, "REDIRECT_LIMIT")
            .when(~kind.isin(*self.types), "CONTENT_TYPE_NOT_ALLOWED").when(size > self.size, "SIZE_LIMIT").otherwise("OK")
        )


def model_stage(rows: DataFrame, key: str, prompt: str, transport: Callable[[str], str], accept: Callable[[str], str | None]) -> DataFrame:
    """(key, reply, reason, calls): replies that accept() takes, after one repair that quotes its objection, else null.

    transport is injected; it must be picklable, and is a fake in tests. A call that raises counts as refused.
    """
    kind = dict(rows.dtypes)[key]

    def ask(text: str) -> tuple[str | None, str | None, int]:
        reason = None
        for call in (1, 2):
            try:
                reply = transport(text if reason is None else f"{text}\nThe last reply was refused: {reason}")
                reason = accept(reply)
            except Exception as error:  # any transport's failure is a refusal, never an answer
                reply, reason = None, f"transport: {error}"
            if reason is None:
                return reply, None, call
        return None, reason, 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [ask(p) for p in frame[prompt]]
            yield pd.DataFrame({key: frame[key], "reply": [m[0] for m in made], "reason": [m[1] for m in made], "calls": [m[2] for m in made]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, reason string, calls int")
