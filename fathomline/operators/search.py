"""Lexical and dense retrieval for batches of queries, rank fusion, reranking and context assembly."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import stripped, terms
from fathomline.functions.vectors import dot
from fathomline.operators import fusion
from fathomline.sources.store import settle

K1, B = 1.5, 0.75
RRF_OFFSET = 60
#: Queries that are sent to all executors at once; larger batches go in blocks of this size.
QUERY_BLOCK = 4096
NO_HITS = "(nothing was retrieved for this question)"
RETRIEVAL_OFF = "(retrieval is switched off)"
MODES = ("hybrid", "dense")


def lexical_index(chunks: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """postings (term, id, tf, len), term_stats (term, df, idf), corpus_stats (n, avgdl); len: terms of the whole chunk."""
    tokens = chunks.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"))
    tokens = tokens.withColumn("len", F.size("terms").cast("bigint"))
    postings = tokens.select("id", "len", F.explode("terms").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    return {"postings": postings, "term_stats": term_stats(postings, stats), "corpus_stats": stats}


def term_stats(postings: DataFrame, corpus_stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
    return postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus_stats)).select("term", "df", idf.alias("idf"))


def bm25(index: dict[str, DataFrame], queries: DataFrame, query_id: str, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) for chunks that hold a query term; a repeated query term counts as often."""
    asked = queries.select(F.col(query_id).alias("query"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(index["term_stats"].select("term", "idf"), "term")
    tf, length = F.col("tf").cast("double"), F.col("len").cast("double")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avgdl")))
    rows = weighted.join(index["postings"], "term").crossJoin(F.broadcast(index["corpus_stats"].select("avgdl")))
    return rows.groupBy("query", "id").agg(F.sum(part).alias("score"))


def dense(queries: DataFrame, vectors: DataFrame, query_id: str, query_vec: str, id_col: str, vec_col: str) -> DataFrame:
    """(query, id, score): inner product of every query with every vector, a block of queries at a time."""
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_vec).alias("qv"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else asked
        scored = rows.crossJoin(F.broadcast(part)).select("query", "id", dot(F.col("qv"), F.col("v")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def by_score(score: str = "score") -> list[Column]:
    """Descending score to six digits, then descending id."""
    return [F.desc(F.round(score, 6)), F.desc("id")]


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with rank from 0."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*by_score(score)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("bigint"))


def fused(dense_scores: DataFrame, sparse_scores: DataFrame, pool: int = 50, offset: int = RRF_OFFSET) -> DataFrame:
    """(query, id, dense, sparse, rd, rs, rrf, rank): reciprocal-rank fusion over all chunks, the best `pool` of each query.

    Both rankings cover every chunk with a dense score; a chunk without a lexical match has 0.
    Ids are distinct within a query.

    A chunk of the pool lies under offset + 2 * pool in one of the rankings: two ranks beyond
    that are worth less than the last of the first `pool` ranks alone. So these heads are the
    candidates, found with a limit before the shuffle; a candidate's rank in the other ranking
    is a count of better rows, made by putting every row between the sorted candidates and
    adding up. No task holds or sorts a whole ranking.
    """
    rows = dense_scores.withColumnRenamed("score", "dense").join(sparse_scores.withColumnRenamed("score", "sparse"), ["query", "id"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    rows = rows.where(F.col("query").isNotNull())  # said here, so that all three uses below share one exchange
    head = offset + 2 * pool
    key = lambda s: F.struct((F.round(s, 6) + 0.0).alias("s"), F.col("id").alias("id"))
    place = lambda s: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(key(s))))
    heads = [rows.withColumn("place", place(s)).where(F.col("place") <= head).drop("place") for s in ("dense", "sparse")]
    candidates = heads[0].unionByName(heads[1]).distinct()
    lists = candidates.groupBy("query").agg(*(F.sort_array(F.collect_list(key(s)), asc=False).alias(f"{s}_keys") for s in ("dense", "sparse")))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((2 * head).bit_length()))))

    def better(s: str) -> Column:
        """How many candidates of the row's query come before it, by halving steps."""
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(f"{s}_keys", at + step - 1) > key(s), at + step).otherwise(at))

    sides = F.array(*(F.struct(F.lit(s).alias("side"), better(s).alias("at")) for s in ("dense", "sparse")))
    tally = rows.join(lists, "query").select("query", F.inline(sides)).groupBy("query", "side", "at").count()
    ranks = tally.select("query", "side", "at", (F.sum("count").over(Window.partitionBy("query", "side").orderBy("at")) - 1).alias("r"))
    both = ranks.groupBy("query", "at").agg(*(F.max(F.when(F.col("side") == s, F.col("r"))).alias(s) for s in ("dense", "sparse")))
    out = candidates.withColumns({"da": place("dense") - 1, "sa": place("sparse") - 1})
    for at, side, name in (("da", "dense", "rd"), ("sa", "sparse", "rs")):
        out = out.join(both.select("query", F.col("at").alias(at), F.col(side).alias(name)), ["query", at])
    score = F.lit(1.0) / (offset + F.col("rd")) + F.lit(1.0) / (offset + F.col("rs"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("rrf", 9)), F.desc("id")))
    return out.drop("da", "sa").withColumn("rrf", score).withColumn("rank", best).where(F.col("rank") <= pool).withColumn("rank", (F.col("rank") - 1).cast("bigint")).select("query", "id", "dense", "sparse", "rd", "rs", "rrf", "rank")


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of a query's distinct terms that a text holds. A stand-in for a cross-encoder in tests."""
    asked = F.array_distinct(terms(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, terms(text))) / F.size(asked))


def reranked(pool: DataFrame, scorer: Callable[[Column, Column], Column], query_text: str, text_col: str) -> DataFrame:
    """pool with ce (the scorer's value), and rank by it; only the pool is scored."""
    scored = pool.withColumn("ce", scorer(F.col(query_text), F.col(text_col)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*by_score("ce")))
    return scored.withColumn("rank", (place - 1).cast("bigint"))


def diverse(pool: DataFrame, vec_col: str, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """(query, id, rank): walks each query's pool in rank order and skips what is nearer than the threshold to one taken.

    A pool is a bounded list (the fused pool), so it is folded in one row.
    """
    listed = pool.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col(vec_col).alias("v")))).alias("pool"))
    empty = F.slice("pool", 1, 0)
    near = lambda taken, x: F.exists(taken, lambda y: dot(x["v"], y["v"]) > threshold)
    taken = F.aggregate("pool", empty, lambda acc, x: F.when((F.size(acc) >= k) | near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("query", F.posexplode(taken).alias("place", "t")).select("query", F.col("t.id").alias("id"), F.col("place").cast("bigint").alias("rank"))


def best_outside(ranked: DataFrame) -> DataFrame:
    """position (from 0) that puts the best hits at both ends: best first, second best last."""
    n = F.count("*").over(Window.partitionBy("query"))
    half = F.floor(F.col("rank") / 2)
    return ranked.withColumn("position", F.when(F.col("rank") % 2 == 0, half).otherwise(n - 1 - half).cast("bigint"))


def in_order(ranked: DataFrame) -> DataFrame:
    """position (from 0) that leaves the hits in their order."""
    return ranked.withColumn("position", F.col("rank").cast("bigint"))


def loaded(load: Callable[[], Callable[[Column, Column], Column]]) -> Callable[[Column, Column], Column] | None:
    """The scorer that load() makes; none, with a warning, where it can't, so that a search ranks by the dense score."""
    try:
        return load()
    except Exception as error:
        warnings.warn(f"no reranking: {error}", stacklevel=2)
        return None


def context(hits: DataFrame, queries: DataFrame, query_id: str, text_col: str, doc_col: str, retrieval: bool = True) -> DataFrame:
    """(query, context): numbered hits by position, a blank line between; a fixed sentence where there are none."""
    if not retrieval:
        return queries.select(F.col(query_id).alias("query"), F.lit(RETRIEVAL_OFF).alias("context"))
    entry = F.concat(F.lit("[Doc "), (F.col("position") + 1).cast("string"), F.lit(" | id="), F.col(doc_col).cast("string"), F.lit("]\n"), stripped(F.col(text_col)), F.lit("\n"))
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("all"))
    made = lists.select("query", F.array_join(F.transform("all", lambda x: x["e"]), "\n").alias("context"))
    return queries.select(F.col(query_id).alias("query")).join(made, "query", "left").select("query", F.coalesce("context", F.lit(NO_HITS)).alias("context"))


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, *, chunk_id: str, chunk_text: str, vec: str, query_id: str, query_text: str, query_vec: str, mode: str = "hybrid", scorer: Callable[[Column, Column], Column] | None = None, pool: int = 50, k: int = 5, threshold: float = 0.85) -> DataFrame:
    """(query, id, rank, score): the whole retrieval path for a batch of queries.

    Mode "dense" ranks by the dense score alone; one that is not in MODES is an error. The
    score is the reranker's where there is one, else the dense one, in the order of the
    ranking. An empty store gives no rows.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "hybrid":
        both = vectors if chunk_text in vectors.columns else vectors.join(chunks.select(chunk_id, chunk_text), chunk_id)
        pooled = settle(fusion.hybrid(both, queries, id_col=chunk_id, text_col=chunk_text, vec_col=vec, query_id=query_id, query_text=query_text, query_vec=query_vec, pool=pool, offset=RRF_OFFSET, k1=K1, b=B))
    else:
        pooled = top(dense(queries, vectors, query_id, query_vec, chunk_id, vec).withColumnRenamed("score", "dense"), pool, "dense")
    pooled = pooled.join(vectors.select(F.col(chunk_id).alias("id"), F.col(vec).alias("v")), "id")
    if scorer is not None:
        texts = chunks.select(F.col(chunk_id).alias("id"), F.col(chunk_text).alias("t"))
        asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).alias("q"))
        pooled = reranked(pooled.join(texts, "id").join(asked, "query"), scorer, "q", "t")
    score = F.col("ce") if scorer is not None else F.col("dense")
    taken = diverse(pooled, "v", threshold, k)
    return taken.join(pooled.select("query", "id", score.alias("score")), ["query", "id"]).select("query", "id", "rank", "score")
