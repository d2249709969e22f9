"""Queries over corpus, index and retrieval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V
from fathomline.operators import dedup, fusion, ingest, search, served
from fathomline.plans import sql
from fathomline.sources.store import manifest, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("text_len"))


def normalize_docs(spark, sf_dir):
    paragraphs = F.regexp_extract_all("html", F.lit(r"<p>([^\n]*?)</p>"), 1)
    plain = F.transform(paragraphs, lambda p: F.regexp_replace(p, "<[^>]*>", ""))
    raw = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("heading"), ingest.body_of(plain).alias("parts"))
    return ingest.mapped(raw, {"page_id": "doc_uid", "heading": "title", "summary": "abstract", "parts": "body", "url": "url"})


def sample_docs(spark, sf_dir):
    return ingest.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


def _three(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.get(lines, F.lit(0)).alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("abstract"), F.array_join(F.slice(lines, 3, F.size(lines)), "\n").alias("body"))


def sections(spark, sf_dir):
    return ingest.sections(_three(spark, sf_dir)).select("doc_id", F.col("section_ord").cast("bigint").alias("section_ord"), "section", F.md5("text").alias("digest"))


def _chunked(spark, sf_dir):
    return ingest.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chunk_docs(spark, sf_dir):
    c = _chunked(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("token_count").cast("bigint").alias("token_count"), F.md5("chunk_text").alias("digest"))


def corpus_stats(spark, sf_dir):
    return ingest.corpus_counts(_chunked(spark, sf_dir), "doc_id")


def corpus_build(spark, sf_dir):
    _, counts = ingest.corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counts


def shingles(spark, sf_dir):
    sig = dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sig.select(F.col("ord").alias("doc_id"), F.size("set").cast("bigint").alias("n_shingles"))


def neardup_pairs(spark, sf_dir):
    classed = dedup.classes(dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return dedup.similar_pairs(classed).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def dedup_keep(spark, sf_dir):
    return dedup.accepted(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("ord").alias("doc_id"), "kept")


def tokenize(spark, sf_dir):
    t = T.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_terms"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def _index(spark, sf_dir):
    return search.lexical_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def bm25_index(spark, sf_dir):
    return _index(spark, sf_dir)["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


def _lexical(spark, sf_dir, k):
    """The k best documents of each benchmark text by BM25."""
    docs, asks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fusion.lexical(docs, asks, id_col="doc_id", text_col="text", query_id="item_id", query_text="text", k=k, k1=search.K1, b=search.B)


def bm25_search(spark, sf_dir):
    return _lexical(spark, sf_dir, 10).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def served_search(spark, sf_dir):
    """The ten best documents of each benchmark text, from a stored index of two segments."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), served.temporary(spark)
    for part in (0, 1):
        served.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), "doc_id", "text", path)
    found, _ = served.Served(spark, path).search(table(spark, sf_dir, "benchmark"), "item_id", "text", 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def normalize_vec(spark, sf_dir):
    v = V.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 5).alias("norm"), F.round(F.get(V.unit(v), F.lit(0)), 5).alias("first"))


def _centroids(spark, sf_dir):
    """A query vector for each label: the mean of its vectors, at length one."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x"))
    means = e.groupBy("label", "d").agg(F.avg("x").alias("x"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return listed.select(F.col("label").cast("bigint").alias("label"), V.unit(F.transform("v", lambda p: p["x"])).alias("qv"))


def _similar(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return search.dense(_centroids(spark, sf_dir), vectors, "label", "qv", "vec_id", "v"), vectors


def dense_topk(spark, sf_dir):
    scored, _ = _similar(spark, sf_dir)
    return search.top(scored, 10).select(F.col("query").alias("label"), "rank", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"))


def redundancy_filter(spark, sf_dir):
    scored, vectors = _similar(spark, sf_dir)
    pool = search.top(scored, 50).join(vectors.withColumnRenamed("vec_id", "id"), "id")
    return search.diverse(pool, "v", threshold=0.3, k=5).select(F.col("query").alias("label"), "rank", F.col("id").alias("vec_id"))


def _encoded(spark, sf_dir):
    """Stand-in vectors of documents and benchmark texts."""
    docs = V.with_stand_in(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "v")
    asks = V.with_stand_in(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q")), "q", "qv")
    return settle(docs), settle(asks)


def _fused(spark, sf_dir):
    docs, asks = _encoded(spark, sf_dir)
    pool = fusion.hybrid(docs, asks, id_col="doc_id", text_col="text", vec_col="v", query_id="item_id", query_text="q", query_vec="qv", pool=50)
    return settle(pool), docs, asks


def hybrid_rrf(spark, sf_dir):
    pool, _, _ = _fused(spark, sf_dir)
    return pool.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "rd", "rs", F.round("rrf", 6).alias("rrf"))


def _reranked(spark, sf_dir):
    pool, docs, asks = _fused(spark, sf_dir)
    full = pool.join(docs.select(F.col("doc_id").alias("id"), "text", "v"), "id").join(asks.select(F.col("item_id").alias("query"), "q"), "query")
    return search.reranked(full, search.overlap_scorer, "q", "text")


def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("ce", 6).alias("score"))


def hybrid_search(spark, sf_dir):
    docs, asks = _encoded(spark, sf_dir)
    found = search.search(docs, docs, asks, chunk_id="doc_id", chunk_text="text", vec="v", query_id="item_id", query_text="q", query_vec="qv", scorer=search.overlap_scorer)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _bm25_five(spark, sf_dir):
    return search.best_outside(_lexical(spark, sf_dir, 5))


def litm_order(spark, sf_dir):
    return _bm25_five(spark, sf_dir).select(F.col("query").alias("item_id"), "rank", "position", F.col("id").alias("doc_id"))


def context_block(spark, sf_dir):
    five = settle(_bm25_five(spark, sf_dir))
    found = F.broadcast(five.select("id").distinct()) if five.count() <= fusion.TERM_BLOCK else five.select("id").distinct()
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(found, "id", "left_semi")
    hits = five.join(texts, "id")
    made = search.context(hits, table(spark, sf_dir, "benchmark"), "item_id", "text", "id")
    return made.select(F.col("query").alias("item_id"), F.md5("context").alias("digest"), F.length("context").cast("bigint").alias("size"))


def index_manifest(spark, sf_dir):
    tables = {"chunks": table(spark, sf_dir, "documents"), "vectors": table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")}
    m = manifest(tables, "stand-in", dataset="documents", version="ignored")
    return m.select(F.col("version").cast("bigint").alias("version"), "encoder", "n_chunks", F.col("embed_dim").cast("bigint").alias("embed_dim"), "dataset")


QUERIES = {f.__name__: f for f in (scan_documents, normalize_docs, sample_docs, sections, chunk_docs, corpus_stats, corpus_build, shingles, neardup_pairs, dedup_keep, tokenize, bm25_index, bm25_search, served_search, normalize_vec, dense_topk, redundancy_filter, hybrid_rrf, rerank, hybrid_search, litm_order, context_block, index_manifest)}

_TERMS, _WORDS, _STRIP = sql.terms, sql.words, sql.stripped

_BM25 = rf"""
tok AS MATERIALIZED (SELECT doc_id AS id, unnest({_TERMS('text')}) AS term FROM documents),
post AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM tok GROUP BY term, id),
lens AS MATERIALIZED (SELECT doc_id AS id, len({_TERMS('text')}) AS len FROM documents),
cs AS MATERIALIZED (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
ts AS MATERIALIZED (SELECT term, count(*) AS df, ln((n::DOUBLE - count(*)::DOUBLE + 0.5::DOUBLE) / (count(*)::DOUBLE + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM post, cs GROUP BY term, n),
ask AS MATERIALIZED (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS MATERIALIZED (SELECT query, post.id, sum(times::DOUBLE * idf * tf::DOUBLE * 2.5::DOUBLE / (tf::DOUBLE + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len::DOUBLE / avgdl))) AS score
  FROM ask JOIN ts USING (term) JOIN post USING (term) JOIN lens ON lens.id = post.id, cs GROUP BY query, post.id)
"""

_FIVE = """five AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id DESC) - 1 AS rank FROM bm QUALIFY rank < 5),
placed AS (SELECT *, CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE count(*) OVER (PARTITION BY query) - 1 - rank // 2 END AS position FROM five)"""

_CENTRE = """
e AS MATERIALIZED (SELECT vec_id AS id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT label, d, avg(v[d]) AS x FROM e, range(1, 65) r(d) GROUP BY label, d),
c AS MATERIALIZED (SELECT label, list(x ORDER BY d) AS q FROM m GROUP BY label),
cu AS MATERIALIZED (SELECT label, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS q FROM c),
sim AS MATERIALIZED (SELECT cu.label, id, list_inner_product(q, v) AS score FROM cu, e),
ranked AS MATERIALIZED (SELECT label, id, score, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, id DESC) - 1 AS rank FROM sim QUALIFY rank < 50)
"""


def _stand_in(source: str, key: str) -> str:
    return rf"""
SELECT {key} AS key, list(x / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY d) AS v FROM (
  SELECT {key}, d, coalesce(x, 0)::DOUBLE AS x, sqrt(sum(coalesce(x, 0)::DOUBLE * coalesce(x, 0)) OVER (PARTITION BY {key})) AS s
  FROM (SELECT {key}, d FROM {source}, range(16) r(d)) g LEFT JOIN (
    SELECT {key}, (h % 16) AS d, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END) AS x
    FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest({_TERMS('text')}) AS t FROM {source})) GROUP BY ALL) s USING ({key}, d)) GROUP BY {key}"""


_FUSED = f"""{_BM25},
dv AS MATERIALIZED ({_stand_in('documents', 'doc_id')}),
qv AS MATERIALIZED ({_stand_in('benchmark', 'item_id')}),
dn AS MATERIALIZED (SELECT qv.key AS query, dv.key AS id, list_inner_product(qv.v, dv.v) AS dense FROM qv, dv),
two AS (SELECT dn.query, dn.id, dense, coalesce(bm.score, 0) AS sparse FROM dn LEFT JOIN bm ON bm.query = dn.query AND bm.id = dn.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dense, 6) DESC, id DESC) - 1 AS rd, row_number() OVER (PARTITION BY query ORDER BY round(sparse, 6) DESC, id DESC) - 1 AS rs FROM two),
fu AS (SELECT *, 1.0::DOUBLE / (60 + rd) + 1.0::DOUBLE / (60 + rs) AS rrf FROM rk),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 9) DESC, id DESC) - 1 AS rank FROM fu QUALIFY rank < 50)"""

_RERANKED = f"""{_FUSED},
ce AS (SELECT query, pool.id, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt))::DOUBLE / len(qt) END AS ce
  FROM pool JOIN (SELECT item_id, list_distinct({_TERMS('text')}) AS qt FROM benchmark) b ON b.item_id = query JOIN (SELECT doc_id, list_distinct({_TERMS('text')}) AS dt FROM documents) d ON d.doc_id = pool.id),
rr AS MATERIALIZED (SELECT query, id, ce, row_number() OVER (PARTITION BY query ORDER BY round(ce, 6) DESC, id DESC) - 1 AS rank FROM ce)"""

_WORDED = f"""
w AS MATERIALIZED (SELECT doc_id, {_WORDS("lower(text)")} AS w FROM documents),"""
_SETS = rf"""{_WORDED}
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(md5(s), '' ORDER BY s)) AS k FROM sh GROUP BY doc_id),
rep AS MATERIALIZED (SELECT k, min(doc_id) AS id, any_value(n) AS n FROM sz GROUP BY k),
hit AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM (SELECT sh.* FROM sh JOIN rep ON rep.id = doc_id) x JOIN (SELECT sh.* FROM sh JOIN rep ON rep.id = doc_id) y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pr AS MATERIALIZED (SELECT a, b, c::DOUBLE / (p.n + q.n - c) AS jaccard FROM hit JOIN rep p ON p.id = a JOIN rep q ON q.id = b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.85)"""

_KEPT = """node AS MATERIALIZED (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS r FROM pr GROUP BY b),
      walk(r, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT node.r, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM walk JOIN node ON node.r = walk.r + 1),
      last AS (SELECT gone FROM walk ORDER BY r DESC LIMIT 1)"""

#: Chunks in place of documents, numbered by document and place.
_CHUNKED = f"""
d AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents),
piece AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END)) AS i FROM d),
w AS MATERIALIZED (SELECT doc_id * 1000000 + i AS doc_id, list_transform(w[i*224+1:i*224+256], lambda x: lower(x)) AS w FROM piece),"""

ORACLES = {
    "scan_documents": "SELECT doc_id, lang, source, n_chars, length(text) AS text_len FROM documents",
    "normalize_docs": rf"""SELECT page_id::VARCHAR AS doc_uid, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '' AS abstract,
      {_STRIP("array_to_string(list_filter(list_transform(regexp_extract_all(html, '<p>([^\n]*?)</p>', 1), lambda p: regexp_replace(p, '<[^>]*>', '', 'g')), lambda p: " + _STRIP('p') + " <> ''), chr(10))")} AS body, coalesce(url, '') AS url FROM pages""",
    "sample_docs": "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
    "sections": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
      s AS (SELECT doc_id, unnest([{{'o': 0, 'n': 'title', 't': l[1]}}, {{'o': 1, 'n': 'abstract', 't': coalesce(l[2], '')}}, {{'o': 2, 'n': 'body', 't': array_to_string(l[3:], chr(10))}}]) AS s FROM l)
      SELECT doc_id, s.o::BIGINT AS section_ord, s.n AS section, md5(s.t) AS digest FROM s WHERE {_STRIP('s.t')} <> ''""",
    "chunk_docs": f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents),
      c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END)) AS i FROM w)
      SELECT doc_id, i AS chunk_idx, len(w[i*224+1:i*224+256]) AS token_count, md5(array_to_string(w[i*224+1:i*224+256], ' ')) AS digest FROM c""",
    "corpus_stats": f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents),
      c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END)) AS i FROM w)
      SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, sum(len(w[i*224+1:i*224+256]))::BIGINT AS n_tokens, max(len(w[i*224+1:i*224+256])) AS longest FROM c""",
    "shingles": f"WITH {_SETS} SELECT w.doc_id, coalesce(n, 0) AS n_shingles FROM w LEFT JOIN sz USING (doc_id)",
    "neardup_pairs": f"WITH {_SETS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pr",
    "dedup_keep": f"""WITH RECURSIVE {_SETS}, {_KEPT}
      SELECT w.doc_id, coalesce(w.doc_id = rep.id AND NOT list_contains(gone, rep.id), false) AS kept FROM w LEFT JOIN sz USING (doc_id) LEFT JOIN rep USING (k), last""",
    "corpus_build": f"""WITH RECURSIVE {_SETS.replace(_WORDED, _CHUNKED)}, {_KEPT}
      SELECT count(DISTINCT w.doc_id // 1000000) AS n_docs, count(*) AS n_seen, count(*) FILTER (WHERE w.doc_id = rep.id AND NOT list_contains(gone, rep.id)) AS n_kept FROM w LEFT JOIN sz USING (doc_id) LEFT JOIN rep USING (k), last""",
    "tokenize": f"SELECT doc_id, len({_TERMS('text')}) AS n_terms, len(list_distinct({_TERMS('text')})) AS n_distinct FROM documents",
    "bm25_index": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM ts",
    "bm25_search": f"WITH {_BM25} SELECT query AS item_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id DESC) - 1 AS rank, id AS doc_id, round(score, 4) AS score FROM bm QUALIFY rank < 10",
    "served_search": f"WITH {_BM25} SELECT query AS item_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id DESC) - 1 AS rank, id AS doc_id, round(score, 4) AS score FROM bm QUALIFY rank < 10",
    "normalize_vec": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 5) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 5) AS first FROM e",
    "dense_topk": f"WITH {_CENTRE} SELECT label, rank, id AS vec_id, round(score, 4) AS score FROM ranked WHERE rank < 10",
    "redundancy_filter": f"""WITH RECURSIVE {_CENTRE},
      pv AS MATERIALIZED (SELECT ranked.label, rank, id, v FROM ranked JOIN e USING (id)),
      near AS MATERIALIZED (SELECT y.label, y.rank, list(x.id) AS near FROM pv x JOIN pv y ON x.label = y.label AND x.rank < y.rank AND list_inner_product(x.v, y.v) > 0.3 GROUP BY y.label, y.rank),
      walk(label, rank, taken) AS (SELECT label, -1::BIGINT, []::BIGINT[] FROM cu UNION ALL
        SELECT w.label, p.rank, CASE WHEN len(taken) >= 5 OR list_has_any(taken, coalesce(near, []::BIGINT[])) THEN taken ELSE list_append(taken, p.id) END
        FROM walk w JOIN pv p ON p.label = w.label AND p.rank = w.rank + 1 LEFT JOIN near n ON n.label = p.label AND n.rank = p.rank),
      done AS (SELECT label, arg_max(taken, rank) AS taken FROM walk GROUP BY label)
      SELECT label, generate_subscripts(taken, 1) - 1 AS rank, unnest(taken) AS vec_id FROM done""",
    "hybrid_rrf": f"WITH {_FUSED} SELECT query AS item_id, rank, id AS doc_id, rd, rs, round(rrf, 6) AS rrf FROM pool",
    "rerank": f"WITH {_RERANKED} SELECT query AS item_id, rank, id AS doc_id, round(ce, 6) AS score FROM rr",
    "hybrid_search": f"""WITH RECURSIVE {_RERANKED},
      pv AS MATERIALIZED (SELECT query, rank, id, v, ce FROM rr JOIN dv ON dv.key = id),
      near AS MATERIALIZED (SELECT y.query, y.rank, list(x.id) AS near FROM pv x JOIN pv y ON x.query = y.query AND x.rank < y.rank AND list_inner_product(x.v, y.v) > 0.85 GROUP BY y.query, y.rank),
      walk(query, rank, taken) AS (SELECT DISTINCT query, -1::BIGINT, []::BIGINT[] FROM pv UNION ALL
        SELECT w.query, p.rank, CASE WHEN len(taken) >= 5 OR list_has_any(taken, coalesce(near, []::BIGINT[])) THEN taken ELSE list_append(taken, p.id) END
        FROM walk w JOIN pv p ON p.query = w.query AND p.rank = w.rank + 1 LEFT JOIN near n ON n.query = p.query AND n.rank = p.rank),
      done AS (SELECT query, arg_max(taken, rank) AS taken FROM walk GROUP BY query),
      out AS (SELECT query, generate_subscripts(taken, 1) - 1 AS rank, unnest(taken) AS id FROM done)
      SELECT query AS item_id, out.rank, id AS doc_id, round(ce, 6) AS score FROM out JOIN (SELECT query, id, ce FROM pv) p USING (query, id)""",
    "litm_order": f"WITH {_BM25}, {_FIVE} SELECT query AS item_id, rank, position, id AS doc_id FROM placed",
    "context_block": f"""WITH {_BM25}, {_FIVE},
      made AS (SELECT query, string_agg('[Doc ' || (position + 1) || ' | id=' || id || ']' || chr(10) || {_STRIP('text')} || chr(10), chr(10) ORDER BY position) AS context FROM placed JOIN documents ON doc_id = id GROUP BY query),
      every AS (SELECT item_id, coalesce(context, '(nothing was retrieved for this question)') AS context FROM benchmark LEFT JOIN made ON query = item_id)
      SELECT item_id, md5(context) AS digest, length(context) AS size FROM every""",
    "index_manifest": "SELECT 1::BIGINT AS version, 'stand-in' AS encoder, (SELECT count(*) FROM documents) AS n_chunks, (SELECT max(len(embedding)) FROM embeddings) AS embed_dim, 'documents' AS dataset",
}
