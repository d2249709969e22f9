"""Readers and writers of query sets, result documents and logs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.sources.store import settle

QUERY = T.StructType([T.StructField("query", T.StringType()), T.StructField("reference", T.StringType()), T.StructField("track", T.StringType())])


def read_queries(spark: SparkSession, path: str, schema: T.StructType = QUERY) -> DataFrame:
    """Query rows of a .jsonl file (a row a line, blank lines skipped) or of a JSON list or single object."""
    reader = spark.read.schema(schema)
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist, on any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def read_results(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """One row for each result document that exists and parses, with its path; the others are left out."""
    here = existing(spark, paths)
    fields = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    if not here:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("path", T.StringType())]))
    rows = spark.read.schema(fields).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").json(here)
    parsed = settle(rows.withColumn("path", F.input_file_name()))  # Spark filters on the marker of broken rows only once they are stored
    return parsed.where("_broken IS NULL").drop("_broken")


def write_result(examples: DataFrame, aggregate: DataFrame, path: str) -> None:
    """A result of any size as JSON lines of all examples and of the aggregate, in two folders; `documents` writes one document a condition."""
    examples.write.mode("overwrite").json(f"{path}/per_example")
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")


def start_log(df: DataFrame, path: str) -> None:
    """Begin an append-only JSON log with these rows."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def on_tracks(queries: DataFrame, tracks: str, track_col: str = "track") -> DataFrame:
    """The queries of the tracks in a comma-separated list, whatever their case; without a track a query is on none."""
    wanted = [t.strip().upper() for t in tracks.split(",")]
    return queries.where(F.upper(F.coalesce(track_col, F.lit(""))).isin(*wanted) & (F.coalesce(track_col, F.lit("")) != ""))


def planned(runs: DataFrame, outputs: DataFrame, phases: Sequence[int], key: str = "output", force: bool = False, dry_run: bool = False) -> DataFrame:
    """The catalogued runs of some phases with status: skip (output exists), dry or run."""
    chosen = runs.where(F.col("phase").isin(*phases))
    there = outputs.select(key).distinct().withColumn("__there", F.lit(True))
    skip = F.coalesce("__there", F.lit(False)) & F.lit(not force)
    return chosen.join(there, key, "left").withColumn("status", F.when(skip, "skip").otherwise(F.lit("dry" if dry_run else "run"))).drop("__there")


def executed(plan: DataFrame, run: Callable[[Row], None], label: str = "label") -> DataFrame:
    """(label, outcome) of a catalogue with status, as `planned` makes it: the due runs are run one by one, in the order of phase and label.

    outcome: ok, failed (the run raised an error; the others go on), skip or dry. A catalogue
    holds a row for each run that someone wrote down, and the driver starts them.
    """
    found = []
    for row in plan.orderBy("phase", label).collect():
        outcome = row.status
        if outcome == "run":
            try:
                run(row)
                outcome = "ok"
            except Exception as error:
                warnings.warn(f"{row[label]}: {error}", stacklevel=2)
                outcome = "failed"
        found.append((row[label], outcome))
    return plan.sparkSession.createDataFrame(found, T.StructType([plan.schema[label], T.StructField("outcome", T.StringType())]))


def pending(runs: DataFrame, outputs: DataFrame, key: str = "output", force: bool = False) -> DataFrame:
    """Catalogued runs whose output is not there yet; all of them with force."""
    return runs if force else runs.join(outputs, key, "left_anti")
