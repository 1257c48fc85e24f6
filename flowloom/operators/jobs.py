"""Jobs over stored tables: staging, a keyed store, the use-case job and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.logs import completed_cases
from flowloom.operators.variants import with_variant
from flowloom.sources.writers import append_new, exists, read_version, write_version


def move_staged(spark: SparkSession, staging: str, main: str, condition: str = "true") -> None:
    """Append the staged rows that meet a condition to the main table, then empty the staging table.

    The rows are appended before staging is emptied: a job that is lost between the two runs again and appends again,
    so callers that must not see rows twice use append_new with a key.
    """
    staged = spark.read.parquet(staging)
    staged.filter(condition).write.mode("append").parquet(main)
    spark.createDataFrame([], staged.schema).write.mode("overwrite").parquet(staging)


class Store:
    """Tables by name in a folder; every put is a version of its own, and get gives the newest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def put(self, name: str, df: DataFrame) -> int:
        version = 1
        while exists(self.spark, f"{self._at(name)}/version={version}"):
            version += 1
        write_version(df, self._at(name), version)
        return version

    def get(self, name: str) -> DataFrame:
        if not exists(self.spark, self._at(name)):
            raise KeyError(name)
        version = 1
        while exists(self.spark, f"{self._at(name)}/version={version + 1}"):
            version += 1
        return self.spark.read.parquet(f"{self._at(name)}/version={version}")


def run_use_case(log: DataFrame, job: dict) -> int:
    """M5: of a log the completed cases (those with a start and an end activity), their variants, appended to the job's
    target where they are new. Returns how many were. A job that is run again adds nothing."""
    done = completed_cases(log, job["starts"], job["finishes"])
    cases = with_variant(log.join(done, "case_id", "left_semi")).select("case_id", "variant", "start_us", "end_us")
    return append_new(cases, job["target"], ["case_id"])


def with_states(df: DataFrame, column: str, changes: dict[str, str], missing: str | None = None) -> DataFrame:
    """M7: a column's states replaced as ``changes`` says; null becomes ``missing``."""
    state = F.col(column)
    for old, new in changes.items():
        state = F.when(F.col(column) == old, new).otherwise(state)
    return df.withColumn(column, F.coalesce(state, F.lit(missing)) if missing is not None else state)


__all__ = ["Store", "move_staged", "read_version", "run_use_case", "with_states"]
