"""The document model over the driver's tables as temporary views, for spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docketry.plans import bindings


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    made = {"versions": bindings.versions, "ingredients": bindings.ingredients, "nested_documents": bindings.nested}
    for name, build in made.items():
        build(spark, sf_dir).createOrReplaceTempView(name)
    return list(made)
