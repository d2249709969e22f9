"""Stupid-backoff scores of documents against n-gram counts of all other documents.

The counts live in a table partitioned by n-gram hash. To keep it narrow the n-grams of a
block of documents are sorted, cut at the partitions' bounds and stored as one compressed
column of hashes and one of counts for each block and partition, so an n-gram that a third
of all documents hold costs one entry a block. A partition adds its blocks' counts up and
answers every block in the block's own order; blocks then meet their answers in a join,
explode their documents into n-grams again, look each up and sum logarithms by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import LOWER, byte_runs, mix, settle, span_hashes, utf8, word_spans

#: Bytes of text in a block of documents (a longer text is a block of its own) and for each partition of the counts.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 8 << 20
HASH_BITS = 56
_STEP = np.uint64(0xD1B54A32D192ED03)
BACKOFF = 0.4


def grams_of(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """56-bit hashes of the 1- to order-grams of all texts, in document order, and each text's number of words."""
    offsets, data = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(offsets, data)
    words = np.diff(first)
    one = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(words), dtype=np.int32), words)
    out, run = [one >> np.uint64(64 - HASH_BITS)], one
    for k in range(1, order):  # each order adds a word to the runs of the one before
        run = mix(run[:-1] * _STEP + one[k:]) if len(one) > k else one[:0]
        out.append(run[doc[: len(run)] == doc[k:]] >> np.uint64(64 - HASH_BITS))
    return out, words


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _expand(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, n * 8), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def in_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, texts): a row for each run of about block_bytes of a partition, its texts compressed."""

    def made(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = pa.concat_arrays([r.column(1) for r in rows])
        offsets, data = utf8(texts)
        ids = pa.concat_arrays([r.column(0) for r in rows])
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.record_batch([pa.array([block]), whole(ids), whole(pa.array(np.diff(offsets))), pa.array([pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)], pa.binary())], ["block", "ids", "sizes", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            start = 0
            for i, n in enumerate(np.diff(utf8(batch.column(1))[0]).tolist()):
                if size and size + n > block_bytes:
                    yield made(block, [*rows, batch.slice(start, i - start)])
                    block, size, rows, start = block + 1, 0, [], i
                size += n
            rows.append(batch.slice(start))
        if size or rows:
            yield made(block, rows)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(gather, f"block long, ids array<{kind}>, sizes array<long>, texts binary")


def _texts(sizes: np.ndarray, packed: bytes) -> pa.Array:
    """The texts of a block."""
    total = int(sizes.sum())
    data = pa.Codec("zstd").decompress(packed, total) if total else pa.py_buffer(b"")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), data])


def measured(df: DataFrame, text_col: str) -> DataFrame:
    """(bytes, words): sums over parts of the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in (b.column(0).slice(i, j - i) for b in batches for i, j in byte_runs(b.column(0))):
            offsets, data = utf8(column)
            yield pa.record_batch([pa.array([len(data)], pa.int64()), pa.array([len(word_spans(offsets, data)[0])], pa.int64())], ["bytes", "words"])

    return df.select(text_col).mapInArrow(measure, "bytes long, words long")


def counted(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """(block, part, n, hashes, counts): the distinct n-grams of each block by partition of their hashes."""

    def table(block: int, texts: pa.Array) -> pa.RecordBatch:
        seen, times = np.unique(np.concatenate(grams_of(texts, order)[0]), return_counts=True)
        cut = np.searchsorted(seen, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - bits))
        parts = np.flatnonzero(np.diff(cut))
        steps = np.diff(seen, prepend=np.uint64(0))
        columns: list[list] = [[], []]
        for a, b in zip(cut[parts], cut[parts + 1], strict=True):
            columns[0].append(_squeeze(np.concatenate([seen[a : a + 1], steps[a + 1 : b]])))
            columns[1].append(_squeeze(times[a:b]))
        return pa.record_batch([pa.array(np.full(len(parts), block)), pa.array(parts), pa.array(np.diff(cut)[parts]), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary())], ["block", "part", "n", "hashes", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy()
                yield table(batch.column("block")[i].as_py(), _texts(sizes, batch.column("texts")[i].as_py()))

    return blocks.mapInArrow(count, "block long, part long, n long, hashes binary, counts binary")


def summed(table: DataFrame) -> DataFrame:
    """(block, part, n, totals): for each row of `counted` the counts over all blocks, in its order."""

    def add(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        hashes = np.concatenate([np.cumsum(_expand(h, n), dtype=np.uint64) for h, n in zip(rows.column("hashes").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_expand(c, n) for c, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
        place = np.unique(hashes, return_inverse=True)[1]
        totals = np.bincount(place, counts).astype(np.uint64)[place]
        cut = np.cumsum([0, *sizes])
        return pa.table([rows.column("block"), rows.column("part"), rows.column("n"), pa.array([_squeeze(totals[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["block", "part", "n", "totals"])

    return table.groupBy("part").applyInArrow(add, "block long, part long, n long, totals binary")


def _own(grams: list[np.ndarray], words: np.ndarray, totals: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every n-gram occurrence its place among the distinct ones and how often its own document holds it.

    An n-gram that occurs once in all documents needs no count.
    """
    seen, place = np.unique(np.concatenate(grams), return_inverse=True)
    if len(seen) != len(totals):
        raise RuntimeError("a block changed between the counting and the scoring of its n-grams")
    places, owns, at = [], [], 0
    for k, gram in enumerate(grams):
        mine = place[at : at + len(gram)]
        at += len(gram)
        doc = np.repeat(np.arange(len(words)), np.maximum(words - k, 0))
        own = np.ones(len(gram), np.int64)
        more = np.flatnonzero(totals[mine] > 1)
        _, back, times = np.unique(doc[more] * len(seen) + mine[more], return_inverse=True, return_counts=True)
        own[more] = times[back]
        places.append(mine)
        owns.append(own)
    return places, owns


def backoff_logs(totals: np.ndarray, places: list[np.ndarray], owns: list[np.ndarray], words: np.ndarray, size: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(log score, order used) of every word, in document order; counts leave out the word's own document."""
    order = len(places)
    first = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], words)
    left = np.maximum(size - np.repeat(words, words), 1).astype(np.float64)  # words outside the document
    counts = []
    for k, (place, own) in enumerate(zip(places, owns, strict=True)):
        spread = np.full(first[-1], 0.0)
        spread[at >= k] = (totals[place] - own).astype(np.float64)  # the n-gram that ends at each word
        counts.append(spread)
    score = np.full(first[-1], np.nan)
    used = np.zeros(first[-1], np.int64)
    weight = np.ones(first[-1])
    for k in range(order - 1, -1, -1):
        here = np.isnan(score) & (at >= k)
        found = here & (counts[k] > 0)
        below = np.roll(counts[k - 1], 1) if k else left  # the context: the shorter n-gram that ends one word before
        score[found] = np.log(weight[found] * counts[k][found] / below[found])
        used[found] = k + 1
        weight[here & ~found] *= alpha
    missing = np.isnan(score)
    score[missing] = np.log(weight[missing] / left[missing])
    return score, used


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = BACKOFF, block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES, plain_scan: bool = False) -> DataFrame:
    """(id, n_words, log_score, seen_1 .. seen_<order>) of every row.

    log_score sums, over the words of the whole text, the logarithm of the stupid-backoff
    score: count(n-gram) / count(context) at the longest order whose n-gram occurs in other
    documents, times alpha for each order given up; a word that no other document holds
    counts as alpha to one more power over the words of the others. seen_k: words scored at
    order k. Words are lower-cased (A-Z) runs of non-separators. Without words (null, empty)
    log_score is 0. Repeated rows see each other's counts, as they are other documents; an
    empty table gives none; other columns are not read. df is written to the shared folder
    first unless it only reads files (plain_scan), as its blocks must be the same twice.
    """
    source = df.select(id_col, text_col)
    if not plain_scan:
        source = settle(source)
    blocks = in_blocks(source, id_col, text_col, block_bytes)
    whole = measured(source, text_col).agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    size = int(whole.words or 0)
    bits = max(1, int(-(-(whole.bytes or 0) // partition_bytes)).bit_length())
    answers = summed(counted(blocks, order, bits))

    def score(texts: pa.Table, parts: pa.Table) -> pa.Table:
        row = {c: texts.column(c).combine_chunks()[0] for c in texts.column_names}
        grams, words = grams_of(_texts(row["sizes"].values.to_numpy(), row["texts"].as_py()), order)
        rows = sorted(zip(parts.column("part").to_pylist(), parts.column("n").to_pylist(), parts.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([np.zeros(0, np.uint64), *(_expand(t, n) for _, n, t in rows)]).astype(np.int64)
        places, owns = _own(grams, words, totals)
        logs, used = backoff_logs(totals, places, owns, words, size, alpha)
        doc = np.repeat(np.arange(len(words)), words)
        total = lambda w: np.bincount(doc, w, minlength=len(words))
        hits = [pa.array(total(used == k).astype(np.int64)) for k in range(1, order + 1)]
        return pa.table([row["ids"].values, pa.array(words.astype(np.int64)), pa.array(total(logs)), *hits], names)

    names = ["id", "n_words", "log_score", *(f"seen_{k}" for k in range(1, order + 1))]
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in names[3:])])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    scores = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), plain_scan=True)
    per_word = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scores.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), per_word.alias("per_word"), "seen_1", "seen_2", "seen_3")


#: The same scores from one row for each n-gram of each document.
OP2_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, k, array_to_string(w[i-k+1:i], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) p, range(1, 4) r(k) WHERE i >= k),
own AS MATERIALIZED (SELECT doc_id, k, gram, count(*) AS own FROM g GROUP BY ALL),
total AS MATERIALIZED (SELECT k, gram, sum(own) AS total FROM own GROUP BY ALL),
others AS MATERIALIZED (SELECT doc_id, own.k, gram, (total - own)::DOUBLE AS c FROM own JOIN total USING (k, gram)),
size AS (SELECT sum(len(w)) AS words FROM w),
seen AS MATERIALIZED (SELECT g.doc_id, g.i, g.k, c FROM g JOIN others USING (doc_id, k, gram)),
place AS MATERIALIZED (SELECT doc_id, i, max(c) FILTER (WHERE k = 1) AS c1, max(c) FILTER (WHERE k = 2) AS c2, max(c) FILTER (WHERE k = 3) AS c3 FROM seen GROUP BY doc_id, i),
scored AS (SELECT p.doc_id, CASE WHEN p.c3 > 0 THEN 3 WHEN p.c2 > 0 THEN 2 WHEN p.c1 > 0 THEN 1 ELSE 0 END AS used,
  CASE WHEN p.c3 > 0 THEN ln(p.c3 / b.c2) WHEN p.c2 > 0 THEN ln((CASE WHEN p.i >= 3 THEN 0.4::DOUBLE ELSE 1 END) * p.c2 / b.c1)
    ELSE ln(pow(0.4::DOUBLE, least(p.i, 3) - (CASE WHEN p.c1 > 0 THEN 1 ELSE 0 END)) * (CASE WHEN p.c1 > 0 THEN p.c1 ELSE 1 END) / greatest(words - len(w.w), 1)) END AS s
  FROM place p JOIN w USING (doc_id) CROSS JOIN size LEFT JOIN place b ON b.doc_id = p.doc_id AND b.i = p.i - 1),
sums AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (WHERE used = 1) AS u1, count(*) FILTER (WHERE used = 2) AS u2, count(*) FILTER (WHERE used = 3) AS u3 FROM scored GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS per_word, coalesce(u1, 0)::BIGINT AS seen_1, coalesce(u2, 0)::BIGINT AS seen_2, coalesce(u3, 0)::BIGINT AS seen_3
FROM w LEFT JOIN sums USING (doc_id)"""
