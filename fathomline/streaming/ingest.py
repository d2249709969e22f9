"""Incremental ingest: files arrive, chunks that repeat none kept before are appended.

Each micro-batch is deduplicated in itself in arrival order (batch, then ordinal) and
against everything kept so far; "first kept wins" therefore holds over the whole stream.
What was kept lies in a stored inverted index (see `kept`), of which a batch reads the
buckets of its own shingles only. A batch is written under its own number, so a batch that
is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators import dedup, ingest
from fathomline.sources.store import settle
from fathomline.streaming.kept import KeptIndex


def ingest_batch(batch: DataFrame, batch_id: int, out: str, id_col: str, text_col: str, threshold: float = 0.85, window: int = 256, overlap: int = 32) -> None:
    """Chunk one micro-batch and append what is new: table chunks under out, a folder for each batch, and the index of what was kept."""
    pieces = ingest.chunks(batch.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "text", window, overlap)
    ordered = settle(pieces.withColumn("ord", F.struct("doc", "chunk_idx")))
    sigs = settle(dedup.signatures(ordered, "ord", "chunk_text"))
    index = KeptIndex(batch.sparkSession, f"{out}/kept", threshold)
    index.open(batch_id, sigs)
    fresh = settle(sigs.join(index.repeats(sigs), "ord", "left_anti"))
    kept = settle(dedup.accepted_signatures(fresh, threshold).where("kept").select("ord"))
    ordered.join(kept, "ord", "left_semi").select("doc", "chunk_idx", "chunk_text", "token_count").write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
    index.add(sigs.join(kept, "ord", "left_semi").select("set"))


def start(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, id_col: str, text_col: str, files: int = 1, **options) -> StreamingQuery:
    """A query that ingests the Parquet files of a folder as they come, `files` at a time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    write = lambda batch, number: ingest_batch(batch, number, out, id_col, text_col, **options)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
