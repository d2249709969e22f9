"""Packing along a space-filling curve.

Each document's bag of words is hashed to a vector and projected to four dimensions, the
point's place on a Hilbert curve is its sort key, and the token streams of the documents
are laid end to end along the curve and cut every `length` tokens. Neighbours in the
corpus of topics share sequences, and only the very last sequence can be short.

The stream is laid in parallel: rows are dealt to ranges of the curve, the ranges' token
totals (one number each) give every range its start in the stream, and each range is then
cut on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import LOWER, byte_runs, mix, settle, span_hashes, utf8, word_spans
from fathomline.llm.tokens import default_ranks, default_tokenizer, fast_encoder, special_tokens

DIMS, BITS = 4, 8
#: Most ranges of the curve, and rows sampled for the bounds of each: what the driver holds has a bound.
MOST_RANGES, SAMPLED = 1 << 14, 64


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits a dimension.

    Walks the bits from the top: undoes the curve's reflections and exchanges, Gray-codes
    across dimensions, then interleaves the bits.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            flip = (x[d] & bit) > 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ turn) >> level) & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of each text: hashed word counts, random projection, direction, 8 bits a dimension."""
    offsets, data = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(offsets, data)
    h = span_hashes(data, starts, ends)
    point = np.zeros((len(column), DIMS))
    for d in range(DIMS):
        value = (mix(h + np.uint64(d + 1)) >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1
        sums = np.concatenate([[0.0], np.cumsum(value)])
        point[:, d] = sums[first[1:]] - sums[first[:-1]]
    norm = np.sqrt((point**2).sum(axis=1))[:, None]
    point = np.divide(point, norm, out=np.zeros_like(point), where=norm > 0)
    return hilbert_key(np.clip(((point + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def _order(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """(key, tag) as fixed-width bytes that sort in that order."""
    both = np.empty((len(key), 2), dtype=">u8")
    both[:, 0], both[:, 1] = key, tag
    return both.view("S16")[:, 0]


def encoded(df: DataFrame, id_col: str, text_col: str, ranks_path: str, end_id: int, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, key, tag (unique), n, ids (packed unsigned integers, the end id last) of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = fast_encoder(ranks_path, special), TaskContext.get().partitionId() << 40
        width = "<u2" if max(encoder.n_vocab, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype=width).tobytes()
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(1))):
            texts = batch.column(1)
            ids = [encoder.encode_to_numpy(t or "", allowed_special="all").astype(width).tobytes() + end for t in texts.to_pylist()]
            n = np.array([len(x) for x in ids], np.int64) // np.dtype(width).itemsize
            tag = np.arange(at, at + len(ids))
            at += len(ids)
            yield pa.record_batch([batch.column(0), pa.array(curve_keys(texts)), pa.array(tag), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "key", "tag", "n", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {kind}, key long, tag long, n long, ids binary")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, ranks_path: str | None = None, end_id: int = 1, range_tokens: int = 4_000_000, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens along the Hilbert curve.

    One row for each piece: doc_id, key, start (tokens of its document before it), length,
    ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset (place in
    the sequence). Null and empty texts hold only the end id; ties on the curve lie in
    input order; repeated rows are packed each; other columns of df are not read; an empty
    table gives no pieces; a text of any length is cut over as many sequences as it needs.
    special: (string, id) pairs that are one token where a text holds the string; without
    them every string is ordinary text. A range of the curve has about range_tokens tokens,
    and more where there would be over MOST_RANGES of them.
    """
    path = ranks_path or default_ranks()
    table = settle(encoded(df, id_col, text_col, path, end_id, special))
    total = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    ranges = min(MOST_RANGES, max(1, -(-total.tokens // range_tokens)))
    share = min(1.0, SAMPLED * ranges / max(1, total.rows))  # only the ranges' bounds come from a sample
    sample = table.select("key", "tag", "n").sample(share, seed=1).toPandas().sort_values(["key", "tag"])
    weight = sample["n"].to_numpy().cumsum()
    at = np.unique(np.searchsorted(weight, [weight[-1] * i / ranges for i in range(1, ranges)])) if len(weight) else []
    bounds = _order(sample["key"].to_numpy()[at], sample["tag"].to_numpy()[at]) if len(at) else np.zeros(0, "S16")

    def to_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.searchsorted(bounds, _order(batch.column("key").to_numpy(), batch.column("tag").to_numpy()), side="right")
            yield batch.append_column("range", pa.array(where.astype(np.int64)))

    sums = table.select("key", "tag", "n").mapInArrow(to_range, "key long, tag long, n long, range long").groupBy("range").agg(F.sum("n").alias("n")).collect()
    begin, so_far = {}, 0
    for r in sorted(sums, key=lambda r: r["range"]):
        begin[r["range"]], so_far = so_far, so_far + r["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            rows = {n: [] for n in ("row", "start", "length", "ids", "sequence_id", "offset")}
            for i, (where, n, ids) in enumerate(zip(batch.column("range").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True)):
                if where != here:
                    here, at = where, begin[where]
                packed = ids.as_buffer()
                full = np.frombuffer(packed, dtype=f"<u{packed.size // n}").astype("<u4")
                done = 0
                while done < n:
                    take = min(length - at % length, n - done)
                    for name, value in (("row", i), ("start", done), ("length", take), ("ids", full[done : done + take].tobytes()), ("sequence_id", at // length), ("offset", at % length)):
                        rows[name].append(value)
                    done, at = done + take, at + take
            take = pa.array(rows.pop("row"), pa.int64())
            ids = pa.array(rows.pop("ids"), pa.binary())
            start, size, seq, off = (pa.array(v, pa.int64()) for v in rows.values())
            yield pa.record_batch([batch.column("doc_id").take(take), batch.column("key").take(take), start, size, ids, batch.column("n").take(take), seq, off], ["doc_id", "key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = table.schema["doc_id"].dataType.simpleString()
    dealt = table.mapInArrow(to_range, f"doc_id {kind}, key long, tag long, n long, ids binary, range long")
    laid = dealt.repartition(int(ranges), "range").sortWithinPartitions("range", "key", "tag")
    return laid.mapInArrow(cut, f"doc_id {kind}, key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op6_query(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), special=special_tokens(default_tokenizer()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
