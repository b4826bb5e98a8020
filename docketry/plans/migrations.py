"""Which migrations to run: a file is applied if the table that it makes exists."""

from __future__ import annotations

from pyspark.sql import SparkSession


def plan_migrations(spark: SparkSession, files: list[tuple[str, str]]) -> list[str]:
    """Files (name, sentinel table) still to run, in name order; an applied file after a pending one is an error."""
    pending: list[str] = []
    for name, sentinel in sorted(files):
        if spark.catalog.tableExists(sentinel):
            if pending:
                raise ValueError(f"{name} is applied, but {pending[0]} is not")
        else:
            pending.append(name)
    return pending
