"""From sources to chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import joined, stripped, words
from fathomline.operators import dedup
from fathomline.sources.store import settle, shuffles_freed


def mapped(df: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    """The mapped source fields under their canonical names as text; a missing field or value is empty."""
    have = set(df.columns)
    return df.select(*((F.coalesce(F.col(s).cast("string"), F.lit("")) if s in have else F.lit("")).alias(t) for s, t in field_map.items()))


def body_of(parts: Column) -> Column:
    """Non-empty parts of a list, one a line, stripped."""
    return stripped(F.array_join(F.filter(parts, lambda p: F.coalesce(stripped(p), F.lit("")) != ""), "\n"))


def sampled(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn by hashed id, in draw order: the same rows on every run and engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def sections(df: DataFrame, names: tuple[str, ...] = ("title", "abstract", "body")) -> DataFrame:
    """One row for each non-empty section column, with its ordinal; the section columns go."""
    rest = [c for c in df.columns if c not in names]
    each = F.array(*(F.struct(F.lit(n).alias("section"), F.col(n).alias("text")) for n in names))
    return df.select(*rest, F.posexplode(each).alias("section_ord", "s")).select(*rest, "section_ord", "s.section", "s.text").where(stripped(F.col("text")) != "")


def chunks(df: DataFrame, text_col: str = "text", window: int = 256, overlap: int = 32, tokens: Column | None = None) -> DataFrame:
    """Overlapping token windows: chunk_idx from 0, chunk_text and token_count; the text goes.

    The step is window - overlap, at least 1, and the last window is the first that reaches
    the end. Without tokens there is no chunk; a blank window takes no index.
    """
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be positive and overlap in [0, window)")
    step = max(1, window - overlap)
    rest = [c for c in df.columns if c != text_col]
    rows = df.withColumn("__t", words(F.col(text_col)) if tokens is None else tokens)
    n = F.size("__t")
    count = F.when(n == 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / step) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.slice("__t", i * step + 1, window))
    if tokens is not None:  # words are never blank
        pieces = F.filter(pieces, lambda p: F.exists(p, lambda t: stripped(t) != ""))
    return rows.select(*rest, F.posexplode(pieces).alias("chunk_idx", "__p")).select(*rest, "chunk_idx", joined(F.col("__p")).alias("chunk_text"), F.size("__p").alias("token_count"))


def corpus_counts(chunked: DataFrame, doc_col: str) -> DataFrame:
    """Documents, chunks, tokens and the longest chunk, in one row."""
    return chunked.agg(
        F.countDistinct(doc_col).alias("n_docs"),
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.max("token_count"), F.lit(0)).cast("bigint").alias("longest"),
    )


def corpus(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.85, window: int = 256, overlap: int = 32) -> tuple[DataFrame, DataFrame]:
    """(chunks kept, one row of counts): chunk, drop repeats of kept chunks, count.

    Chunks are walked by document, then by place; the counts are documents, chunks seen and
    chunks kept. The table is read several times, and once more for the chunks kept: neither
    texts of chunks nor all their sets are written, which would take several times its size.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    with shuffles_freed(df.sparkSession):
        rows, accepted = dedup.accepted_anew(dedup.window_signatures(docs, "doc", "text", window, overlap), threshold)
        walked = settle(accepted)
    whole = chunks(docs, "text", window, overlap).withColumn("ord", F.struct("doc", "chunk_idx"))
    kept = whole.join(walked.where("kept").select("ord"), "ord", "left_semi").drop("ord")
    seen = rows.agg(F.countDistinct("ord.doc").alias("n_docs"), F.count("*").alias("n_seen"))
    return kept, seen.crossJoin(F.broadcast(walked.agg(F.count_if("kept").alias("n_kept"))))
