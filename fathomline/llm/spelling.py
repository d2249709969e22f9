"""Spelling variant grouping: words one edit apart, by rolling-hash deletions.

Words are counted over the whole corpus. Prefix and suffix sums of a polynomial hash give
the hash of a word without each of its code points in one vectorised step; these integer
keys, and each word's own, are dealt by their top bits, sorted and kept where two words
share one. Two words that share a deletion at one place differ by a replaced code point; a
word that is another's deletion lacks one. Keys only nominate: what survives is grouped by
the strings themselves, so colliding hashes join nothing.

Within a group only the best and the second best member matter to the others, so no pairs
are made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import _BYTE, LOWER, _power_tables, byte_runs, mix, placed, settle, utf8

#: Rows of word counts that a task holds before it sends them on.
COUNTED_AT_ONCE = 1 << 17
#: Bytes of a run whose checksum is made for all runs at once.
STEPPED = 64
#: Top bits of a key that say where it is dealt.
RADIX_BITS = 12
#: The place of a word's own key among the places of its deletions.
WHOLE = -1

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The first UTF-8 byte of U+00C0 to U+00FF.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1).astype(np.uint32)
    return row


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each byte span, carried on from the checksum before it; byte by byte over all spans at once."""
    order = np.argsort(starts - ends, kind="stable")
    length = (ends - starts)[order]
    state, at = ~before.astype(np.uint32)[order], starts[order]
    for i in range(min(STEPPED, int(length[0])) if len(length) else 0):
        k = len(length) - int(np.searchsorted(length[::-1], i, side="right"))
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + i]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~state
    for j in np.flatnonzero(ends - starts > STEPPED):
        out[j] = zlib.crc32(data[starts[j] + STEPPED : ends[j]].tobytes(), int(out[j]))
    return out


def letter_runs(texts: pa.Array, ids: list[str], slip: int | None, shortest: int) -> pa.Array:
    """All runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least `shortest` code points.

    slip: in a run whose crc32, behind the document's id and a colon, this number divides, the
    code point at the checksum modulo the run's length is left out before its length counts.
    """
    offsets, data = utf8(texts)
    n, data = len(data), LOWER[data]
    second = np.zeros(n + 1, dtype=bool)
    second[1:] = data == _LEAD
    second = second[:n]
    inside = _LETTER[data] | (data == _LEAD) | second
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.flatnonzero(inside & ~second)  # the first byte of each code point
    at = np.searchsorted(first, starts)
    points = np.searchsorted(first, ends) - at
    if slip:
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        sums = checksums(data, starts, ends, prefix[np.searchsorted(offsets, starts, side="right") - 1])
        hit = np.flatnonzero(sums % np.uint32(slip) == 0)
        gone = first[at[hit] + sums[hit].astype(np.int64) % points[hit]]
        inside[gone] = False
        inside[gone[data[gone] == _LEAD] + 1] = False
        points[hit] -= 1
    kept = points >= shortest
    mark = np.zeros(n + 1, dtype=np.int8)
    mark[starts[kept]] += 1
    np.subtract.at(mark, ends[kept], 1)
    inside &= np.cumsum(mark[:n], dtype=np.int8) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    cuts = np.concatenate([total[starts[kept]], total[-1:]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), int(kept.sum()), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])])


def word_counts(df: DataFrame, id_col: str, text_col: str, slip: int | None = None, shortest: int = 5) -> DataFrame:
    """(word, n): the runs of letters of all texts, counted in each task and then together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.RecordBatch:
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return pa.table([table.column("word"), table.column("n_sum")], ["word", "n"])

        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(1))):
            counts = letter_runs(batch.column(1), batch.column(0).to_pylist(), slip, shortest).value_counts()
            held.append(pa.table([counts.field("values"), counts.field("counts")], ["word", "n"]))
            rows += len(counts)
            if rows > COUNTED_AT_ONCE:
                held = [summed()]
                rows = held[0].num_rows
                if rows > COUNTED_AT_ONCE // 2:
                    yield from _batches(held[0])
                    held, rows = [], 0
        if rows:
            yield from _batches(summed())

    known = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")
    counts = df.select(known, F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 14))


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's row, place, key): the hash of each word without the code point at each place, and its own at WHOLE.

    Words hold code points up to U+00FF only. With sums S of code points times powers of the
    base, what stands before a place and what stands behind it, moved one place down, are
    differences of S; their sum is the hash.
    """
    offsets, data = utf8(words)
    lead = data == _LEAD
    kept = np.flatnonzero(~lead)
    points = data[kept].astype(np.int64)
    points = np.where(np.concatenate([[False], lead])[kept], points + 0x40, points)
    starts = np.searchsorted(kept, offsets)
    lengths = np.diff(starts)
    n, starts = len(points), starts[:-1]
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[points] * up[:n], out=sums[1:])
    row = np.repeat(np.arange(len(words)), lengths)
    s, at = starts[row], np.arange(n)
    ends = starts + lengths
    without = (sums[at] - sums[s]) * down[s] + (sums[ends[row]] - sums[at + 1]) * down[s + 1]
    whole = (sums[ends] - sums[starts]) * down[starts]
    keys = mix(np.concatenate([without ^ (lengths[row] - 1).astype(np.uint64), whole ^ lengths.astype(np.uint64)]))
    return np.concatenate([row, np.arange(len(words))]), np.concatenate([at - s, np.full(len(words), WHOLE)]), keys


def shared_keys(words: DataFrame) -> DataFrame:
    """(id, place) of the keys that two words or more have, of words (id, word)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(1), 1 << 17)):
            row, place, key = deletion_keys(batch.column(1))
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32))], ["key", "id", "place"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last key may go on in the next batch
            yield _met(*(x[:last] for x in rest))
            rest = [x[last:] for x in rest]
        if rest is not None:
            yield _met(*rest)

    keys = words.select("id", "word").mapInArrow(emit, "key long, id long, place int")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "id")
    return dealt.mapInArrow(keep, "id long, place int")


def _met(key: np.ndarray, of: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The rows, sorted by key and word, whose key has two words or more."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    other = ~new
    other[1:] &= of[1:] != of[:-1]
    met = np.zeros(int(new.sum()), dtype=bool)
    met[group[other]] = True
    keep = met[group] if len(key) else np.zeros(0, dtype=bool)
    return pa.record_batch([pa.array(of[keep], pa.int64()), pa.array(place[keep], pa.int32())], ["id", "place"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best struct(less, id)) of every word with a word one edit away; words: (id, word, n), ids in code-point order.

    best is the near word of largest n, ties to the smaller id; less is -n. Groups share a
    string but for one place or are one word's deletions, so the alphabet and that word's
    length bound them.
    """
    at = F.col("place")
    left = F.when(at == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    met = settle(shared_keys(words).join(words, "id").select("place", left.alias("left"), F.struct((-F.col("n")).alias("less"), "id").alias("one")))
    listed = met.where(at != WHOLE).groupBy("left", "place").agg(F.sort_array(F.collect_list("one")).alias("all")).where(F.size("all") > 1)
    other = lambda x: F.when(x == F.get("all", F.lit(0)), F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))
    near = lambda x, n, best: F.struct(x["id"].alias("id"), n.cast("long").alias("n"), best.alias("best"))
    replaced = listed.select(F.inline(F.transform("all", lambda x: near(x, F.size("all") - 1, other(x)))))
    lacking = met.groupBy("left").agg(F.max(F.when(at == WHOLE, F.col("one"))).alias("whole"), F.sort_array(F.collect_set(F.when(at != WHOLE, F.col("one")))).alias("all")).where(F.col("whole").isNotNull() & (F.size("all") > 0))
    shorter = F.array(near(F.col("whole"), F.size("all"), F.get("all", F.lit(0))))
    both = F.concat(shorter, F.transform("all", lambda x: near(x, F.lit(1), F.col("whole"))))
    return replaced.union(lacking.select(F.inline(both))).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form), a forest: every id's last form, by doubling the steps in each round."""
    known = settle(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = settle(known.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return known


def variants(counts: DataFrame, at_least: int = 3, times: float = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of (word, n) with n of at least `at_least`.

    Two words are near if they differ by one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (ties: smallest in code-point order) if that n
    is `times` its own or more; root is the last form on the way from the word, itself where
    it has none. Words hold code points up to U+00FF and are distinct; other columns are
    dropped; an empty table gives an empty one.
    """
    words = placed(counts.where(F.col("n") >= at_least).select("word", "n"), "id", F.asc("word"))
    near = settle(neighbours(words))
    own = words.join(near, "id", "left")
    best = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    found = settle(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best["id"].alias("form_id"), (-best["less"]).alias("form_n")))
    last = roots(found.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    name = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    full = found.join(last.withColumnRenamed("root", "root_id"), "id", "left").join(name("form"), "form_id", "left").join(name("root"), "root_id", "left")
    return full.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Variants of the documents' words of five letters or more, of which every 97th run by checksum lost a letter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(docs, "doc_id", "text", slip=97, shortest=5)).select("word", "form", "root", "n", "n_near", "form_n")
