"""Shared pieces of the corpus operators: shared-folder tables and, from functions/hashing, word hashing in numpy."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.hashing import _BYTE, LOWER, PIECE, SEPARATOR, _power_tables, byte_runs, mix, runs_of, shingle_sets, span_hashes, utf8, word_spans  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where a local session names none (tests, notebooks) is a local one set; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    base = sc._jsc.sc().getCheckpointDir()
    if base.isDefined():
        return base.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame, level: int = 3) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    level is zstd's; a higher one is for tables that hold whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once.

    The value is the start of an aggregate without steps and body its finish. An element of a
    transformed array would do too, but it works out the type of all that body holds at each call.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda state, _: state, body)


def frequent(counts: DataFrame, most_words: int, most_bytes: int) -> DataFrame:
    """The words of the highest counts that fit both bounds; counts go together in steps of about a tenth."""
    step = counts.select("word", F.floor(F.log(F.col("n").cast("double")) * 10).cast("int").alias("step"))
    sizes = step.groupBy("step").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("step")).collect()  # some hundred rows
    words = size = 0
    least = 1 << 30
    for r in sizes:
        words, size = words + r.words, size + r.bytes
        if words > most_words or size > most_bytes:
            break
        least = r.step
    return step.where(F.col("step") >= least).select("word")


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df, written in this order with a number that rises along it; numbers have gaps between the ranges sorted in parallel."""
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with gapless numbers from 0 in this order: each range sorted in parallel begins where those before it end."""
    laid = placed(df, name, *order)
    part, begin, so_far = F.shiftright(name, 33).cast("int"), [], 0
    for p, n in sorted((r.p, r["count"]) for r in laid.groupBy(part.alias("p")).count().collect()):  # a row for each range
        begin += [so_far] * (p + 1 - len(begin))
        so_far += n
    starts = F.from_json(F.lit(json.dumps(begin)), "array<bigint>")
    return laid.withColumn(name, F.get(starts, part) + F.col(name).bitwiseAND((1 << 33) - 1))
