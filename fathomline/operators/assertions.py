"""Data-quality checks: many measures in one aggregate of each table, comparisons between tables, and a roll-up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.sources.store import settle

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


class Check(NamedTuple):
    """A measure (an aggregate) of a table, and what it must be; level is the status where it is not, or is null."""

    name: str
    table: str
    measure: Column
    holds: Callable[[Column], Column]
    level: str = FAIL


class Equal(NamedTuple):
    """Two checks, by name, whose measures must be equal, such as the lengths of a pair of tables."""

    name: str
    left: str
    right: str
    level: str = FAIL


def covered(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """One row (known, missing): distinct keys of rows that the others have, and that they lack; null keys don't count."""
    sides = [df.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().withColumn("side", F.lit(i)) for i, df in enumerate((rows, others))]
    both = sides[0].union(sides[1]).groupBy("key").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    return both.agg(F.count_if(F.col("first") < F.col("last")).alias("known"), F.count_if(F.col("last") == 0).alias("missing"))


def checked(tables: Mapping[str, DataFrame], checks: Sequence[Check], equal: Sequence[Equal] = ()) -> DataFrame:
    """(check, status, value): PASS or the level of each check. A table is scanned once for all of its checks.

    A table that is None is missing: its checks get their level and no value.
    """
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        mine = [c for c in checks if c.table == table]
        frame = tables[table]
        if frame is None:
            continue
        measures = frame.agg(*(c.measure.cast("double").alias(f"m{i}") for i, c in enumerate(mine)))
        state = lambda i, c: F.when(F.coalesce(c.holds(F.col(f"m{i}")), F.lit(False)), PASS).otherwise(c.level)
        parts.append(measures.select(F.inline(F.array(*(F.struct(F.lit(c.name).alias("check"), state(i, c).alias("status"), F.col(f"m{i}").alias("value")) for i, c in enumerate(mine))))))
    spark = next(t for t in tables.values() if t is not None).sparkSession
    gone = [(c.name, c.level, None) for c in checks if tables[c.table] is None]
    out = spark.createDataFrame(gone, "check string, status string, value double")
    for part in parts:
        out = out.union(part)
    if not equal:
        return out
    out = settle(out)
    of = lambda name: F.max(F.when(F.col("check") == name, F.col("value")))
    sides = out.agg(*(of(n).alias(f"{s}{i}") for i, e in enumerate(equal) for s, n in (("l", e.left), ("r", e.right))))
    status = lambda i, e: F.when(F.coalesce(F.col(f"l{i}") == F.col(f"r{i}"), F.lit(False)), PASS).otherwise(e.level)
    return out.union(sides.select(F.inline(F.array(*(F.struct(F.lit(e.name).alias("check"), status(i, e).alias("status"), (F.col(f"l{i}") - F.col(f"r{i}")).alias("value")) for i, e in enumerate(equal))))))


def rolled_up(results: DataFrame) -> DataFrame:
    """One row: n_pass, n_warn, n_fail and verdict, FAIL if any check fails, else WARN if any warns."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(n(PASS).alias("n_pass"), n(WARN).alias("n_warn"), n(FAIL).alias("n_fail")).withColumn("verdict", F.when(F.col("n_fail") > 0, FAIL).when(F.col("n_warn") > 0, WARN).otherwise(PASS))
