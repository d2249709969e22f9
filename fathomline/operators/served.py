"""A stored lexical index that answers the k best chunks without reading all postings.

    segment=<n>/postings  (term, block, hits, top) in folders by bucket of the term
    segment=<n>/terms     (term, df) in the same buckets
    segment=<n>/stats     (n, total, kind): chunks, their terms, and the type of their ids

A block is BLOCK neighbouring chunks; a term's row holds its postings there and the largest
part, without idf, that they can add to a score. Statistics are sums over segments, made for
the asked terms alone, so adding chunks is writing a segment. A search reads the buckets of
its terms, without their postings at first: the largest parts bound every block's best
score. The blocks of highest bounds are scored; their k-th score rules out all blocks bounded
below it, whose postings are never read. Postings are made a block at a time where the chunks
lie, and scored a block at a time, so each is exchanged once when it is stored and once when
it is scored, and no row for a query and a posting is ever exchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.text import terms
from fathomline.operators.fusion import QUERY_BLOCK, rounded
from fathomline.operators.search import K1, B, top
from fathomline.sources.store import settle, shared_folder

#: Chunks in a block, folders of a segment, and blocks that are scored first for each query.
BLOCK, BUCKETS, PROBED = 128, 64, 8
#: Rows of asked terms that are sent to all executors.
SENT_TERMS = 1 << 18


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def part(tf: Column, length: Column, average: Column | float, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a chunk's score, without idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _segments(spark: SparkSession, path: str) -> list[str]:
    """Folders of the whole segments, in order; stats is written last."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    found = sorted((int(x[8:]) for x in names if x.startswith("segment=")))
    return [f"{path}/segment={i}" for i in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/segment={i}/stats/_SUCCESS"))]


def _of_blocks(rows: pa.Table) -> pa.RecordBatch:
    """(term, block, ids, tfs, lens) of whole blocks of (id, block, terms): a row for each term of a block, and one without term for all its chunks."""
    listed = rows.column("terms").combine_chunks()
    n, sizes = len(listed), listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = listed.flatten().dictionary_encode()
    kinds = len(words.dictionary) + 1  # the last stands for no term
    blocks, at = np.unique(rows.column("block").to_numpy(), return_inverse=True)
    every, held = np.arange(n), np.repeat(np.arange(n), sizes)
    keys = np.concatenate([(at[held] * kinds + words.indices.to_numpy()) * n + held, (at * kinds + kinds - 1) * n + every])
    found, tf = np.unique(keys, return_counts=True)
    row, pair = found % n, found // n
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    ends = pa.array(np.append(starts, len(pair)), pa.int32())
    term = pa.array(pair[starts] % kinds, pa.int32(), mask=pair[starts] % kinds == kinds - 1)
    ids = rows.column("id").combine_chunks().take(pa.array(row))
    lists = (pa.ListArray.from_arrays(ends, x) for x in (ids, pa.array(tf, pa.int32()), pa.array(sizes[row], pa.int32())))
    return pa.record_batch([words.dictionary.take(term), pa.array(blocks[pair[starts] // kinds]), *lists], ["term", "block", "ids", "tfs", "lens"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_of_blocks of a task's chunks, some blocks at a time; a block that a batch cuts waits for its rest."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        block = rows.column("block").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for i in range(0, len(cuts) - 1, 8):
            j = min(i + 8, len(cuts) - 1)
            yield _of_blocks(rows.slice(cuts[i], cuts[j] - cuts[i]))
        waiting = rows.slice(cuts[-1])
    if waiting is not None:
        yield _of_blocks(waiting)


def add(chunks: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Store chunks as a further segment of the index at path, which may not exist yet. Ids are distinct over all segments."""
    spark = chunks.sparkSession
    name = f"{path}/segment={len(_segments(spark, path))}"
    rows = chunks.select(F.col(id_col).alias("id"), F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"), terms(F.col(text_col)).alias("terms"))
    kind = rows.schema["id"].dataType.simpleString()
    placed = settle(rows.mapInArrow(_in_blocks, f"term string, block long, ids array<{kind}>, tfs array<int>, lens array<int>"))
    total = F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, x: s + x)
    stats = settle(placed.where("term IS NULL").agg(F.coalesce(F.sum(F.size("ids").cast("bigint")), F.lit(0).cast("bigint")).alias("n"), F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias("total"), F.lit(kind).alias("kind")))
    size = stats.first()
    average = size.total / size.n if size.total else 1.0
    placed = placed.where("term IS NOT NULL").withColumn("bucket", _bucket(BUCKETS))
    stored = placed.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block")
    hits = F.arrays_zip("ids", "tfs", "lens").cast(f"array<struct<id:{kind},tf:int,len:int>>")
    most = F.array_max(F.transform("hits", lambda h: part(h["tf"], h["len"], F.lit(average))))
    stored = stored.withColumn("hits", hits).select("term", "block", "hits", most.alias("top"), F.lit(average).alias("average"), "bucket")
    stored.write.mode("overwrite").partitionBy("bucket").parquet(f"{name}/postings")
    df = placed.groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df"))
    df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{name}/terms")
    stats.write.mode("overwrite").parquet(f"{name}/stats")


class Served:
    """The index at a path, as it is now."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.names, self.buckets = spark, _segments(spark, path), buckets
        if not self.names:
            raise ValueError(f"no index at {path}")
        sums = spark.read.parquet(*(f"{n}/stats" for n in self.names)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("kind").alias("kind")).first()
        self.n, self.average = sums.n, sums.total / sums.n if sums.total else 1.0
        hits = f"array<struct<id:{sums.kind},tf:int,len:int>>"
        self.shapes = {"postings": f"term string, block bigint, hits {hits}, top double, average double, bucket int", "terms": "term string, df bigint, bucket int"}

    def _read(self, table: str, buckets: list[int]) -> DataFrame:
        """Rows of a table in these buckets, with their segment."""
        out = None
        for i, name in enumerate(self.names):
            rows = self.spark.read.schema(self.shapes[table]).parquet(f"{name}/{table}").where(F.col("bucket").isin(buckets)).withColumn("segment", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def asked(self, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, list[int]]:
        """(query, term, weight) for the terms that the index has, with how often they are asked and idf as weight; and their buckets."""
        each = queries.select(F.col(query_id).alias("query"), F.explode(terms(F.col(query_text))).alias("term"))
        times = settle(each.groupBy("query", "term").agg(F.count("*").alias("times")))
        buckets = [r.b for r in times.select(_bucket(self.buckets).alias("b")).distinct().collect()]  # at most `buckets` rows
        df = self._read("terms", buckets).join(F.broadcast(times.select("term").distinct()) if times.count() <= SENT_TERMS else times.select("term").distinct(), "term", "left_semi")
        df = df.groupBy("term").agg(F.sum("df").cast("double").alias("df"))
        idf = F.log((self.n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
        return settle(times.join(df, "term").select("query", "term", (F.col("times") * idf).alias("weight"))), buckets

    def _scored(self, wanted: DataFrame, asked: DataFrame, buckets: list[int], k: int | None = None) -> DataFrame:
        """(query, id, score) over the postings of the asked terms in wanted (query, segment, block).

        With k, only rows that can be among a query's k best: the best of each block, and of
        these none that is under the query's `least`, where wanted has that column.
        """
        size = asked.agg(F.count("*").alias("n"), F.countDistinct("query").alias("queries")).first()
        parts, out = max(1, -(-size.n // SENT_TERMS), -(-size.queries // QUERY_BLOCK)), None
        for i in range(parts):
            mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i) if parts > 1 else asked
            scored = self._scored_part(wanted, mine, buckets, k)
            out = scored if out is None else out.union(scored)
        return out

    def _scored_part(self, wanted: DataFrame, asked: DataFrame, buckets: list[int], k: int | None) -> DataFrame:
        """_scored for asked terms that can be sent to all executors."""
        names = settle(asked.groupBy("query").agg(F.min("term").alias("one")).select("query", (F.row_number().over(Window.orderBy("query")) - 1).cast("int").alias("q")))
        known = settle(asked.groupBy("term").agg(F.count("*").alias("n")).select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("t")))
        pairs = asked.join(F.broadcast(names), "query").join(F.broadcast(known), "term").select("t", "q", "weight").toArrow().sort_by("t")  # of checked size
        t, of, weight = (pairs.column(c).to_numpy() for c in ("t", "q", "weight"))
        first = np.searchsorted(t, np.arange((t.max() if len(t) else 0) + 2))
        sent, average = self.spark.sparkContext.broadcast((first, of, weight)), self.average
        least = F.col("least") if "least" in wanted.columns else F.lit(None).cast("double")
        open_ = wanted.withColumn("least", least).join(F.broadcast(names), "query").select("segment", "block", "q", "least")
        places = settle(open_.select("segment", "block").distinct())
        rows = self._read("postings", buckets).join(F.broadcast(known), "term").select("segment", "block", "t", "hits")
        rows = rows.join(F.broadcast(places) if places.count() <= SENT_TERMS else places, ["segment", "block"], "left_semi")
        rows = rows.select("segment", "block", "t", F.col("hits.id").alias("ids"), F.col("hits.tf").alias("tfs"), F.col("hits.len").alias("lens"))
        kind = rows.schema["ids"].dataType.elementType.simpleString()

        def score(held: pa.Table, asking: pa.Table) -> pa.Table:
            first, of, weight = sent.value
            held, asking = held.combine_chunks(), asking.combine_chunks()
            sizes = pc.list_value_length(held.column("ids")).to_numpy().astype(np.int64)
            ids = pc.list_flatten(held.column("ids")).combine_chunks().dictionary_encode()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            term, tf, length = np.repeat(held.column("t").to_numpy(), sizes), *(pc.list_flatten(held.column(c)).to_numpy().astype(np.float64) for c in ("tfs", "lens"))
            chosen, least = asking.column("q").to_numpy(), asking.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.full(int(of.max()) + 1 if len(of) else 1, -1)
            place[chosen] = np.arange(len(chosen))
            each = first[term + 1] - first[term]
            pair = np.arange(int(each.sum())) + np.repeat(first[term] - (np.cumsum(each) - each), each)
            hit, column = np.repeat(np.arange(len(term)), each), place[of[pair]]
            hit, column, pair = (x[column >= 0] for x in (hit, column, pair))
            n = len(ids.dictionary)
            worth = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
            scores = np.bincount(ids.indices.to_numpy()[hit] * len(chosen) + column, weights=worth[hit] * weight[pair], minlength=n * len(chosen)).reshape(n, len(chosen))
            keep = scores > 0
            if k is not None:
                keep &= ~(scores < least - 2e-6)  # one without least is kept
                if n > k:
                    near = rounded(scores)
                    keep &= near >= np.partition(near, n - k, axis=0)[n - k] - 1  # digits may be rounded otherwise in the end
            row, column = np.nonzero(keep)
            return pa.table([pa.array(chosen[column], pa.int32()), ids.dictionary.take(pa.array(row)), pa.array(scores[row, column])], ["q", "id", "score"])

        scored = rows.groupBy("segment", "block").cogroup(open_.groupBy("segment", "block")).applyInArrow(score, f"q int, id {kind}, score double")
        return scored.join(F.broadcast(names), "q").select("query", "id", "score")

    def bounds(self, asked: DataFrame, buckets: list[int]) -> DataFrame:
        """(query, segment, block, bound, n): no chunk of the block has a higher score; n postings of asked terms lie there."""
        rows = self._read("postings", buckets).select("segment", "block", "term", "top", "average", F.size("hits").alias("n"))
        grown = F.greatest(F.lit(1.0), F.lit(self.average) / F.col("average"))  # a part grows less than the average length does
        asked = F.broadcast(asked) if asked.count() <= SENT_TERMS else asked
        return rows.join(asked, "term").groupBy("query", "segment", "block").agg(F.sum(F.col("weight") * F.col("top") * grown).alias("bound"), F.sum("n").alias("n"))

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, probed: int = PROBED) -> tuple[DataFrame, DataFrame]:
        """(query, id, score, rank): the k best chunks with an asked term, as an exhaustive ranking has them; and the blocks read, as of `bounds`.

        Ranked by the score to six digits, then by descending id. Empty queries, and those
        without a term of the index, have no rows.
        """
        asked, buckets = self.asked(queries, query_id, query_text)
        bounds = settle(self.bounds(asked, buckets))
        first = settle(top(bounds.withColumn("id", F.struct("segment", "block")), probed, "bound").drop("id", "rank"))
        probe = settle(top(self._scored(first, asked, buckets, k), k))
        least = probe.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("found")).where(F.col("found") >= k)
        at = ["query", "segment", "block"]
        open_ = bounds.join(first.select(*at), at, "left_anti").join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6))
        rest = settle(open_.select(*bounds.columns, "least"))
        more = self._scored(rest, asked, buckets, k)
        return top(probe.drop("rank").unionByName(more), k), first.select(*bounds.columns).unionByName(rest.drop("least"))


def temporary(spark: SparkSession) -> str:
    """A path for an index that lives as long as the session's shared folder."""
    return f"{shared_folder(spark)}/served/{uuid.uuid4().hex}"
