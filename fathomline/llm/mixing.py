"""Mixing sources to target weights.

Sizes are added up for each source; a source's rate is its target over its size. Every
document is taken floor(rate) times, and once more if its hash-seeded draw falls under the
rate's fraction. Each source draws with the one of a few seeds whose expected and taken
sizes lie nearest, which one aggregation over (document, seed) tells, so that a source of
few or very uneven documents comes near its target too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import byte_runs, numbered, settle, utf8, word_spans

#: Draws of a document; a source uses one of them.
DRAWS = 64
#: Sources whose rates are sent to all executors, and their names' most bytes; beyond, rates are joined by salted source.
SENT_SOURCES, SENT_BYTES = 1 << 16, 1 << 23
SALTS = 64


@F.arrow_udf(T.LongType())
def n_words(texts: pa.Array) -> pa.Array:
    """Words (runs without space and tab to carriage return) of each text; none for null."""
    runs = (texts.slice(i, j - i) for i, j in byte_runs(texts))
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(word_spans(*utf8(run))[2]) for run in runs)]), pa.int64())


def draw_key(id_col: str, text_col: str) -> Column:
    """What seeds a document's draws: its id and the digest of its text, so that rows without an id are told apart."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(known(id_col), F.lit(":"), F.md5(known(text_col))))


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) of a key and a seed."""
    digest = F.md5(F.concat(key, F.lit(":"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (source, source_size, weight) with target: share of all sizes by weight, at most `most` times the source's size.

    What a full source can't take is dealt to the others by weight, until none is above its
    limit. The driver holds four sums a round; each round but the last fills a source.
    """
    limit, n_full, level, full = F.lit(most) * F.col("source_size"), -1, 0.0, F.lit(False)
    zero, total = F.lit(0), sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    while True:
        held, weight = F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))
        sums = sources.agg(F.count_if(full).alias("n"), F.coalesce(held, zero).alias("held"), F.coalesce(weight, zero).alias("weight")).first()
        if not sums.weight or sums.n <= n_full:
            break
        n_full, level = sums.n, (share * total - most * sums.held) / sums.weight
        full = F.lit(level) * F.col("weight") > limit
    return sources.withColumn("target", F.when(full, limit).otherwise(F.lit(level) * F.col("weight")).cast("double"))


def rates(sized: DataFrame, weighted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate and seed (which draw the source uses), a row for each source.

    sized: (source, size, key); weighted: (source, weight), weights of zero or more.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = sums["source"].eqNullSafe(weighted["source"])
    known = settle(sums.join(weighted, by_source, "left").select(sums["source"], "source_size", F.coalesce(weighted["weight"].cast("double"), F.lit(0.0)).alias("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aimed = settle(targets(known, share, most).select("source", "source_size", "target", rate.alias("rate")))
    drawn = with_rates(sized, aimed.select("source", "rate")).select("source", "size", "key", (F.col("rate") - F.floor("rate")).alias("odds"), F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("seed"))
    taken = F.sum(F.when(draw(F.col("key"), F.col("seed")) < F.col("odds"), F.col("size")).otherwise(0))
    off = drawn.groupBy("source", "seed", "odds").agg(taken.alias("taken"), F.sum("size").alias("all"))
    best = off.groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("odds") * F.col("all")).alias("off"), "seed")).alias("best"))
    chosen = best.select(F.col("source").alias("s"), "best.seed")
    return settle(aimed.join(chosen, F.col("source").eqNullSafe(F.col("s")), "left").select(*aimed.columns, "seed"))


def with_rates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the columns of their source in `found`, a written table with a row for each source.

    Rates are sent to all executors while they are few; else a hot source's rows go over
    SALTS keys.
    """
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    side = found.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if size.n <= SENT_SOURCES and size.bytes <= SENT_BYTES:
        return rows.join(F.broadcast(side), same).drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    side = side.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(side, same & (F.col("__salt") == F.col("__slot"))).drop("__source", "__salt", "__slot")


def copies(sized: DataFrame, found: DataFrame) -> DataFrame:
    """sized with source_size, target and copies: how often the mix takes each row."""
    once_more = draw(F.col("key"), F.col("seed")) < F.col("rate") - F.floor("rate")
    return with_rates(sized, found).withColumn("copies", (F.floor("rate") + once_more.cast("int")).cast("long")).drop("rate", "seed")


def mix(df: DataFrame, weighted: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: all rows and columns of df, each row as often as it is taken, with copy (long, from 0).

    weighted: (source, weight), a row for each source; a source that is missing there
    weighs nothing. A document's size is its words. Null texts have size 0 and are drawn like
    others; null sources are one source, null ids are told apart by their texts; ties and
    rows that repeat id and text share their draw, so all or none of them are taken once
    more; an empty table gives an empty mix; an input column named copy is replaced, and
    other columns are kept. Reruns agree, as draws come from ids and texts alone.
    """
    kept = df.drop("copy").select(F.struct("*").alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw_key(id_col, text_col).alias("key"))
    found = rates(settle(kept.select("source", "size", "key")), weighted, share, most)
    taken = copies(kept, found).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).select("row.*", "copy")


def in_turn(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the weights in turn over the distinct sources by code point, null last."""
    each = numbered(sources.select("source").distinct(), "__turn", F.asc_nulls_last("source"))
    return each.select("source", F.get(F.array(*map(F.lit, weights)), (F.col("__turn") % len(weights)).cast("int")).alias("weight"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    """Digest of the mix of all documents: how many words of each it takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = settle(docs.select("doc_id", "source", n_words("text").alias("size"), draw_key("doc_id", "text").alias("key")))
    mixed = copies(sized, rates(sized.drop("doc_id"), in_turn(sized)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP13_SQL = rf"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
known AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER before, 0) AS held, coalesce(sum(weight) OVER before, 0) AS w
  FROM known WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(min_by((1.5::DOUBLE * total - 2.0::DOUBLE * held) / (weights - w), held) FILTER (WHERE (1.5::DOUBLE * total - 2.0::DOUBLE * held) / (weights - w) * weight <= 2.0::DOUBLE * source_size), 0) AS level FROM filled),
aimed AS MATERIALIZED (
  SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target,
    CASE WHEN source_size > 0 THEN least(level * weight, 2.0::DOUBLE * source_size) / source_size ELSE 0 END AS rate FROM known, level),
drawn AS MATERIALIZED (
  SELECT key, seed, ('0x' || substr(md5(key || ':' || seed), 1, 8))::BIGINT / 4294967296::DOUBLE AS draw
  FROM (SELECT DISTINCT key FROM sized), range({DRAWS}) r(seed)),
off AS (
  SELECT s.source, seed, abs(sum(CASE WHEN draw < rate - floor(rate) THEN size ELSE 0 END)::DOUBLE - (rate - floor(rate)) * sum(size)::DOUBLE) AS off
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source JOIN drawn USING (key) GROUP BY s.source, seed, rate),
chosen AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM off GROUP BY source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source JOIN drawn d ON d.key = s.key AND d.seed = c.seed"""
