"""Queries over text, verification, metric, report and resampling operators, with their SQL.

Model outputs are stand-ins made from the tables by rule (canned answers, word-overlap votes),
so every query covers whole tables and any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V
from fathomline.operators import metrics, report, stats, verify
from fathomline.plans import sql
from fathomline.plans.retrieval import table
from fathomline.sources.readers import on_tracks, planned


def sentence_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.md5("sentence").alias("digest"))


def truncate_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.truncated(F.col("text"), 150)).alias("cut"), F.md5(T.truncated(F.col("text"), 480, keep_short=True)).alias("clipped"))


def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("So: "), F.col("props"), F.lit(" [1, 2] done")).alias("t"))
    return e.select("event_id", T.json_object(F.col("t")).alias("object"), T.json_array(F.col("t")).alias("array"), F.get_json_object(T.json_object(F.col("t")), "$.k").cast("bigint").alias("k"))


#: Canned keyword answers in five shapes: list, comma string, no JSON, other key, JSON inside prose.
def _answers(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.pmod("doc_id", F.lit(5)).alias("shape"))
    listed = F.concat(F.lit('{"Topics": ["'), F.col("lang"), F.lit('", " '), F.col("source"), F.lit(' "]}'))
    comma = F.concat(F.lit('{"Topics": "'), F.col("lang"), F.lit(", "), F.col("source"), F.lit('"}'))
    raw = F.when(F.col("shape") == 0, listed).when(F.col("shape") == 1, comma).when(F.col("shape") == 2, "no json here").when(F.col("shape") == 3, '{"Other": 1}').otherwise(F.concat(F.lit("Sure: "), listed, F.lit(" done")))
    return d.select("doc_id", "lang", raw.alias("raw"))


def keyword_parse(spark, sf_dir):
    k = T.keywords(F.col("raw"), "Topics")
    return _answers(spark, sf_dir).select("doc_id", F.array_join(k, "|").alias("found"), F.size(k).cast("bigint").alias("n"))


def parse_rate(spark, sf_dir):
    flagged = _answers(spark, sf_dir).select("lang", (F.size(T.keywords(F.col("raw"), "Topics")) == 0).alias("failed"))
    return report.failure_rate(flagged, "lang", "failed").select("lang", "n", F.round("rate", 6).alias("rate"))


#: Canned verdicts: a claim for each turn before, labelled by turn; every seventh answer is broken.
def _verdicts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    label = lambda i: F.element_at(F.array(*map(F.lit, ("supported", "partial", "unsupported", "odd"))), (F.pmod(i + F.col("conv_id"), F.lit(4)) + 1).cast("int"))
    claims = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("turn", F.lit(1))), lambda i: F.concat(F.lit('{"text":"c","label":"'), label(i), F.lit('"}'))), ",")
    overall = F.when(F.pmod("conv_id", F.lit(2)) == 0, "unsupported").otherwise("supported")
    raw = F.when(F.pmod("conv_id", F.lit(7)) == 3, "{broken").otherwise(F.concat(F.lit('{"claims":['), claims, F.lit('],"overall":"'), overall, F.lit('"}')))
    return c.select("conv_id", "turn", raw.alias("raw"))


def verdict_parse(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("conv_id", "turn", verify.verdict(F.col("raw")).alias("v")).select("conv_id", "turn", "v.*").withColumn("worst_claims", F.array_join("worst_claims", "|"))


def label_dist(spark, sf_dir):
    v = verdict_parse(spark, sf_dir)
    out = report.distribution(v, "overall", ["n_supported", "n_partial", "n_unsupported"])
    return out.select("overall", "label", "total", F.round("share", 6).alias("share"))


def poison_context(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.md5(verify.poisoned(F.col("text"), F.lit("All of this is false."))).alias("digest"))


#: Claims are sentences of assistant turns, chunks the other turns of the conversation, and three
#: stand-in voters ask for different shares of a claim's distinct terms.
def _claims(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("claim", "sentence")).withColumn("query", F.col("conv_id") * 1000 + F.col("turn"))


def _shares(spark, sf_dir) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").where("role <> 'assistant'").select("conv_id", F.col("turn").alias("chunk_pos"), F.array_distinct(T.terms(F.col("text"))).alias("held"))
    pairs = _claims(spark, sf_dir).select("query", "conv_id", F.col("claim").cast("bigint").alias("claim"), F.array_distinct(T.terms(F.col("sentence"))).alias("said")).join(chunks, "conv_id")
    share = F.size(F.array_intersect("said", "held")) / F.greatest(F.size("said"), F.lit(1))
    return pairs.select("query", "claim", "chunk_pos", share.alias("share"))


def _votes(spark, sf_dir) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(i).alias("model"), F.lit(least).alias("least")) for i, least in enumerate((0.2, 0.3, 0.5)))))
    return _shares(spark, sf_dir).select("query", "claim", "chunk_pos", "share", models.alias("m")).select("query", "claim", "chunk_pos", "m.model", (F.col("share") >= F.col("m.least")).alias("is_entail"))


def nli_vote(spark, sf_dir):
    return verify.majority(_votes(spark, sf_dir), ["query", "claim", "chunk_pos"])


def claim_pairs(spark, sf_dir):
    return verify.representative(nli_vote(spark, sf_dir), ["query", "claim"])


def _rates(spark, sf_dir, judged, referenced=None) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"))
    claims = _claims(spark, sf_dir).select("query", F.col("claim").cast("bigint").alias("claim"))
    return verify.unsupported_rate(asked, claims, judged, referenced=referenced).withColumn("rate", F.round("rate", 6))


def hallucination_ctx(spark, sf_dir):
    return _rates(spark, sf_dir, claim_pairs(spark, sf_dir))


def hallucination_ref(spark, sf_dir):
    """One premise: the conversation's first turn that is not the assistant's; without one there is no rate."""
    votes = nli_vote(spark, sf_dir)
    first = votes.groupBy("query").agg(F.min("chunk_pos").alias("p"))
    one = votes.join(first, "query").where("chunk_pos = p").select("query", "claim", "supported")
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'assistant'").join(c.where("role <> 'assistant' AND conv_id % 5 <> 2").select("conv_id").distinct(), "conv_id", "left_semi")
    return _rates(spark, sf_dir, one, asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query")))


def _turns(spark, sf_dir) -> DataFrame:
    """Assistant turns with the text of the turn before (empty for a first turn)."""
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("before", F.coalesce(metrics.previous(c, "conv_id", "turn", "text"), F.lit(""))).where("role = 'assistant'").select("conv_id", "turn", "text", "before")


def _rouge(n, stem_terms=False):
    def query(spark, sf_dir):
        out = metrics.ngram_overlap(_turns(spark, sf_dir), ["conv_id", "turn"], "text", "before", n, stem_terms)
        return out.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))

    return query


def rouge_l(spark, sf_dir):
    both = metrics.subsequence_f1(T.terms(F.col("text")), T.terms(F.col("before")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(both, 6).alias("f1"))


def rouge_l_stemmed(spark, sf_dir):
    listed = metrics.stemmed(_turns(spark, sf_dir), ["conv_id", "turn"], ["text", "before"])
    return listed.select("conv_id", "turn", F.round(metrics.subsequence_f1(F.col("text"), F.col("before")), 6).alias("f1"))


def greedy_match_f1(spark, sf_dir):
    """Texts are runs of eight vectors; each is matched with the next."""
    tokens = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("text"), V.doubles(F.col("embedding")).alias("v"))
    pairs = tokens.select(F.col("text").alias("candidate"), (F.col("text") + 1).alias("reference")).distinct()
    out = metrics.greedy_match(tokens, pairs, "text", "v")
    return out.select("candidate", "reference", *(F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")))


#: Predicted keywords are an answer's distinct terms and gold ones those of the turn before, in three classes by length.
CLASSES = {"short": (1, 3), "middle": (4, 7), "long": (8, 10_000)}


def _keywords(spark, sf_dir) -> DataFrame:
    of = lambda c, lo, hi: F.filter(F.array_distinct(T.terms(F.col(c))), lambda x: (F.length(x) >= lo) & (F.length(x) <= hi))
    each = F.array(*(F.struct(F.lit(n).alias("class"), of("text", *r).alias("predicted"), of("before", *r).alias("gold")) for n, r in CLASSES.items()))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.inline(each))


def _prf(empty_is_perfect):
    def query(spark, sf_dir):
        out = _keywords(spark, sf_dir).select("conv_id", "turn", "class", metrics.set_scores(F.col("predicted"), F.col("gold"), empty_is_perfect).alias("s"))
        return out.select("conv_id", "turn", "class", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))

    return query


keyword_prf = _prf(True)


def keyword_misses(spark, sf_dir):
    """Hits, false positives and false negatives of every turn and class, sorted."""
    d = _keywords(spark, sf_dir).select("conv_id", "turn", "class", metrics.set_differences(F.col("predicted"), F.col("gold")).alias("d"))
    return d.select("conv_id", "turn", "class", *(F.array_join(F.array_sort(f"d.{c}"), "|").alias(c) for c in ("hits", "false_positives", "false_negatives")))


def keyword_micro(spark, sf_dir):
    out = metrics.micro(_keywords(spark, sf_dir), ["conv_id", "turn"], "class", "predicted", "gold")
    return out.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def keyword_agg(spark, sf_dir):
    return keyword_prf(spark, sf_dir).groupBy("class").agg(*(F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "f1")))


def keyword_pivot(spark, sf_dir):
    out = report.pivoted(keyword_prf(spark, sf_dir), "turn", "class", list(CLASSES), "f1")
    return out.select("turn", *(F.round(c, 5).alias(c) for c in CLASSES))


#: Speed samples: an event's value is its time, the length of its properties its tokens.
def _samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.length("props").alias("tokens"))


def latency_summary(spark, sf_dir):
    out = metrics.speed_summary(_samples(spark, sf_dir), "event_type", F.col("tokens"), F.col("value"))
    return out.select("event_type", *(F.round(c, 4).alias(c) for c in ("rate_mean", "rate_std", "seconds_mean")), "n")


def gen_length(spark, sf_dir):
    out = metrics.length_profile(table(spark, sf_dir, "conversations"), "role", "text")
    return out.select("role", "n", F.round("words_mean", 5).alias("words_mean"), "words_max", F.round("pct_over", 5).alias("pct_over"), F.round("pct_cut", 5).alias("pct_cut"))


def _tracks(spark, sf_dir, subtotal) -> DataFrame:
    e = table(spark, sf_dir, "events")
    triggered = F.col("value") > 50
    again = triggered & (F.col("event_id") % 3 != 0)
    pre = F.when(triggered, F.col("user_id") % 3)
    counts = (F.col("user_id") % 4).alias("pre_supported"), pre.alias("pre_unsupported"), F.when(again, F.col("user_id") % 4 + pre).alias("post_supported"), F.when(again, F.lit(0)).alias("post_unsupported")
    rows = e.select("event_type", triggered.alias("triggered"), again.alias("regenerated"), (again & (F.col("user_id") % 2 == 0)).alias("recovered"), *counts)
    out = metrics.trigger_summary(rows, "event_type", subtotal, ("supported", "unsupported"))
    return out.withColumns({c: F.round(c, 6) for c in ("trigger_rate", "recovery_rate")})


def track_summary(spark, sf_dir):
    return _tracks(spark, sf_dir, False)


def track_rollup(spark, sf_dir):
    return _tracks(spark, sf_dir, True)


def delta_report(spark, sf_dir):
    """Mean capped against mean uncapped length by source of document."""
    n = F.size(T.words(F.col("text")))
    d = table(spark, sf_dir, "documents").select("source", n.alias("full"), F.least(n, F.lit(150)).alias("capped"))
    out = report.deltas(d.groupBy("source").agg(F.avg("capped").alias("words")), d.groupBy("source").agg(F.avg("full").alias("words")), "source", ["words"])
    return out.select("source", *(F.round(c, 5).alias(c) for c in ("words_a", "words_b", "words_delta")))


def score_quantiles(spark, sf_dir):
    out = report.quantiles(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", *(F.round(c, 5).alias(c) for c in ("q25", "q50", "q75")))


def _summary(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("speed"), F.round(F.avg("p_size"), 4).alias("error"))


def minmax_norm(spark, sf_dir):
    out = report.min_max(_summary(spark, sf_dir), ["speed", "error"])
    return out.select("p_type", F.round("speed", 5).alias("speed"), F.round("error", 5).alias("error"))


def running_min_frontier(spark, sf_dir):
    return report.frontier(_summary(spark, sf_dir), "speed", "error", "p_type")


def _facts(spark, sf_dir) -> DataFrame:
    """A score for each user and kind of event: the mean value."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 9).alias("v"))
    return stats.facts(e, "event_type", "user_id", {"value": F.col("v")})


def score_fact(spark, sf_dir):
    return _facts(spark, sf_dir)


ROUNDS = 10_000


def bootstrap_ci(spark, sf_dir):
    out = stats.interval(_facts(spark, sf_dir), ["condition"], rounds=ROUNDS)
    return out.select("condition", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


def _paired(spark, sf_dir) -> DataFrame:
    """Differences of two halves of each user's value: events of even and of odd number."""
    e = table(spark, sf_dir, "events").withColumn("half", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    both = e.groupBy("half", "user_id").agg(F.round(F.avg("value"), 9).alias("v"))
    complete = both.groupBy("user_id").count().where("count = 2").select("user_id")
    scores = stats.facts(both.join(complete, "user_id"), "half", "user_id", {"value": F.col("v")})
    return stats.differences(scores, "even", "odd").withColumn("value", F.round("value", 6))


def paired_bootstrap(spark, sf_dir):
    out = stats.interval(_paired(spark, sf_dir), ["a", "b"], rounds=ROUNDS)
    return out.select("a", "b", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")), ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def permutation_test(spark, sf_dir):
    return stats.sign_flip(_paired(spark, sf_dir), ["a", "b"], rounds=ROUNDS).select("a", "b", F.round("mean", 4).alias("mean"), F.round("p", 6).alias("p"))


def pairwise_report(spark, sf_dir):
    diffs = stats.all_differences(_facts(spark, sf_dir))
    out = stats.interval(diffs, ["a", "b"], rounds=ROUNDS).join(stats.sign_flip(diffs, ["a", "b"], rounds=ROUNDS).select("a", "b", "p"), ["a", "b"])
    flags = ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant_ci"), (F.col("p") < 0.05).alias("significant_p")
    return out.select("a", "b", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")), F.round("p", 6).alias("p"), *flags)


def report_qa(spark, sf_dir):
    """One row for each registered condition, with nulls for one that was not run."""
    registry = spark.createDataFrame([(c,) for c in ("click", "purchase", "view", "signup", "logout", "never_run")], "condition string")
    ran = bootstrap_ci(spark, sf_dir)
    return registry.join(ran, "condition", "left")


#: Anchor against comparison by field, with the scale of the report; the last was never run.
CONTRASTS = (("click", "purchase", "value", 1.0), ("click", "view", "value", 100.0), ("view", "never_run", "value", 1.0))


def contrast_table(spark, sf_dir):
    """Kinds of event over the users that have all of them."""
    scores = _facts(spark, sf_dir).where("condition IN ('click', 'purchase', 'view')")
    everywhere = scores.groupBy("example").count().where("count = 3").select("example")
    out = stats.contrasts(scores.join(everywhere, "example"), CONTRASTS)
    return report.marked(out).select("a", "b", "field", *(F.round(c, 3).alias(c) for c in ("delta", "low", "high")), F.round("p", 6).alias("p"), "significant", "mark")


def qa_aggregate(spark, sf_dir):
    """Five score fields of each user and kind of event, as means with intervals."""
    high = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    fields = {"mean": F.avg("value"), "least": F.min("value"), "most": F.max("value"), "events": F.count("*").cast("double"), "high": high}
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(*(F.round(f, 9).alias(n) for n, f in fields.items()))
    out = stats.aggregate(e, "event_type", "user_id", list(fields))
    return out.select("condition", *(F.round(c, 4).alias(c) for c in out.columns if c != "condition"))


def formatted_scores(spark, sf_dir):
    """Report cells of each kind of event; a kind of its own has no figures."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    s = s.union(spark.createDataFrame([("never_run", None, None)], "event_type string, m double, d double"))
    m, d = F.col("m"), F.col("d")
    return s.select("event_type", T.mean_interval(m, m - d, m + d).alias("interval"), T.mean_interval(m / 1000, (m - d) / 1000, (m + d) / 1000, percent=True).alias("percent"), T.plus_minus(m, d).alias("spread"), T.fixed(m).alias("mean"), T.sign(m - 20).alias("sign"))


def length_scatter(spark, sf_dir):
    out = report.scatter(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"), "source", "text", "n_chars")
    return out.select("doc_id", "source", "words", "over", "n_chars", F.round("words_mean", 4).alias("words_mean"), F.round("score_mean", 4).alias("score_mean"))


def nested_keywords(spark, sf_dir):
    """Keyword lists with objects among the items."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"Topics": [{"name": "'), "lang", F.lit(' "}, "'), "source", F.lit('", {"id":'), F.col("doc_id").cast("string"), F.lit("}]}")).alias("raw"))
    return d.select("doc_id", F.array_join(T.keywords(F.col("raw"), "Topics", nested=True), "|").alias("found"))


def track_filter(spark, sf_dir):
    return on_tracks(table(spark, sf_dir, "events"), "Click, VIEW", "event_type").select("event_id", "event_type")


def run_plan(spark, sf_dir):
    """Nations as runs, their region as phase; those of even number have an output."""
    runs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("phase"), F.concat(F.lit("out/"), F.col("n_nationkey").cast("string")).alias("output"))
    done = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("out/"), F.col("n_nationkey").cast("string")).alias("output"))
    return planned(runs, done, [0, 2, 3]).select("label", "phase", "status")


def dq_checks(spark, sf_dir):
    d, e, v = (table(spark, sf_dir, t) for t in ("documents", "events", "embeddings"))
    return report.checks([
        report.assertion(d, "documents.text present", F.col("text").isNull() | (T.stripped(F.col("text")) == "")),
        report.assertion(d, "documents.long enough", F.size(T.words(F.col("text"))) < 5, fatal=False),
        report.assertion(e, "events.value present", F.col("value").isNull() | F.isnan("value")),
        report.assertion(v, "embeddings.size", F.size("embedding") != 64),
    ])


QUERIES = {f.__name__: f for f in (sentence_split, truncate_words, json_extract, keyword_parse, parse_rate, verdict_parse, label_dist, poison_context, nli_vote, claim_pairs, hallucination_ctx, hallucination_ref, rouge_l, rouge_l_stemmed, greedy_match_f1, keyword_misses, keyword_micro, keyword_agg, keyword_pivot, latency_summary, gen_length, track_summary, track_rollup, delta_report, score_quantiles, minmax_norm, running_min_frontier, score_fact, bootstrap_ci, paired_bootstrap, permutation_test, pairwise_report, report_qa, contrast_table, qa_aggregate, formatted_scores, length_scatter, nested_keywords, track_filter, run_plan, dq_checks)}
QUERIES |= {"rouge1": _rouge(1), "rouge2": _rouge(2), "rouge1_stemmed": _rouge(1, True), "rouge2_stemmed": _rouge(2, True), "keyword_prf": keyword_prf, "keyword_prf_strict": _prf(False)}

_TERMS, _WORDS, _SENT = sql.terms, sql.words, sql.sentences

_ANSWERS = """shaped AS (SELECT doc_id, lang, source, doc_id % 5 AS shape FROM documents),
answers AS (SELECT doc_id, lang, CASE shape WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|' || source WHEN 4 THEN lang || '|' || source ELSE '' END AS found FROM shaped)"""

_VERDICT = """turns AS (SELECT conv_id, turn, conv_id % 7 = 3 AS broken, list_transform(range(1, greatest(turn, 1) + 1), lambda i: (['supported', 'partial', 'unsupported', 'unsupported'])[(i + conv_id) % 4 + 1]) AS l FROM conversations WHERE role = 'assistant'),
counted AS (SELECT conv_id, turn, broken, CASE WHEN broken THEN [] ELSE l END AS l FROM turns),
verdicts AS (SELECT conv_id, turn, len(l) AS n_claims, len(list_filter(l, lambda x: x = 'supported')) AS n_supported, len(list_filter(l, lambda x: x = 'partial')) AS n_partial, len(list_filter(l, lambda x: x = 'unsupported')) AS n_unsupported,
  CASE WHEN broken THEN 'unsupported' WHEN conv_id % 2 = 1 THEN 'supported' WHEN list_contains(l, 'unsupported') THEN 'unsupported' WHEN list_contains(l, 'partial') THEN 'partial' ELSE 'supported' END AS overall,
  coalesce(array_to_string(list_transform(list_filter(l, lambda x: x = 'unsupported'), lambda x: 'c'), '|'), '') AS worst_claims FROM counted)"""

_CLAIMS = f"""claims AS MATERIALIZED (SELECT query, conv_id, i - 1 AS claim, s[i] AS sentence FROM (SELECT conv_id * 1000 + turn AS query, conv_id, {_SENT('text')} AS s FROM conversations WHERE role = 'assistant'), range(1, 100000) r(i) WHERE i <= len(s)),
held AS (SELECT conv_id, turn AS chunk_pos, list_distinct({_TERMS('text')}) AS held FROM conversations WHERE role <> 'assistant'),
share AS (SELECT query, claim, chunk_pos, len(list_intersect(said, held))::DOUBLE / greatest(len(said), 1) AS share FROM (SELECT query, conv_id, claim, list_distinct({_TERMS('sentence')}) AS said FROM claims) JOIN held USING (conv_id)),
votes AS MATERIALIZED (SELECT query, claim, chunk_pos, 3::BIGINT AS n_votes, (CASE WHEN share >= 0.2 THEN 1 ELSE 0 END + CASE WHEN share >= 0.3 THEN 1 ELSE 0 END + CASE WHEN share >= 0.5 THEN 1 ELSE 0 END) > 1 AS supported FROM share),
pairs AS MATERIALIZED (SELECT query, claim, bool_or(supported) AS supported, coalesce(min(CASE WHEN supported THEN chunk_pos END), min(chunk_pos)) AS chunk_pos, count(*) AS n_chunks FROM votes GROUP BY query, claim),
asked AS (SELECT conv_id * 1000 + turn AS query FROM conversations WHERE role = 'assistant')"""
_CLAIMS = _CLAIMS.replace("range(1, 100000) r(i) WHERE i <= len(s)", "unnest(range(1, len(s) + 1)) r(i)")


def _rate_sql(judged: str) -> str:
    return f"""SELECT asked.query, coalesce(n, 0) AS n_claims, coalesce(bad, 0) AS n_unsupported, coalesce(round(bad::DOUBLE / n, 6), 1.0) AS rate FROM asked LEFT JOIN (
      SELECT c.query, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(j.supported, false)) AS bad FROM claims c LEFT JOIN ({judged}) j ON j.query = c.query AND j.claim = c.claim GROUP BY c.query) x ON x.query = asked.query"""


_TURNS = """turns AS MATERIALIZED (SELECT * FROM (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations) WHERE role = 'assistant')"""


def _rouge_sql(n: int) -> str:
    side = lambda c, name: f"{name} AS (SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i+{n - 1}], ' '))) AS gram FROM (SELECT conv_id, turn, {_TERMS(c)} AS t FROM turns) WHERE len(t) >= {n}) GROUP BY ALL)"
    return f"""WITH {_TURNS}, {side('text', 'c')}, {side('before', 'r')},
      hit AS (SELECT conv_id, turn, sum(least(c.n, r.n))::DOUBLE AS h FROM c JOIN r USING (conv_id, turn, gram) GROUP BY ALL),
      nc AS (SELECT conv_id, turn, sum(n)::DOUBLE AS n FROM c GROUP BY ALL), nr AS (SELECT conv_id, turn, sum(n)::DOUBLE AS n FROM r GROUP BY ALL),
      pr AS (SELECT turns.conv_id, turns.turn, coalesce(h / nc.n, 0) AS p, coalesce(h / nr.n, 0) AS r FROM turns LEFT JOIN hit USING (conv_id, turn) LEFT JOIN nc USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn))
      SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr"""


_PAIRS = f"""{_TURNS},
kw AS MATERIALIZED (SELECT conv_id, turn, k.class AS class, list_filter(list_distinct({_TERMS('text')}), lambda x: length(x) BETWEEN k.lo AND k.hi) AS p, list_filter(list_distinct({_TERMS('before')}), lambda x: length(x) BETWEEN k.lo AND k.hi) AS g
  FROM turns, (VALUES ('short', 1, 3), ('middle', 4, 7), ('long', 8, 10000)) k(class, lo, hi))"""


def _prf_sql(source: str, keys: str, blank: str) -> str:
    return f"""SELECT {keys}, CASE WHEN len(p) = 0 AND len(g) = 0 THEN {blank} WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE round(h / len(p), 6) END AS precision,
      CASE WHEN len(p) = 0 AND len(g) = 0 THEN {blank} WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE round(h / len(g), 6) END AS recall,
      CASE WHEN len(p) = 0 AND len(g) = 0 THEN {blank} WHEN len(p) = 0 OR len(g) = 0 OR h = 0 THEN 0.0 ELSE round(2 * (h / len(p)) * (h / len(g)) / (h / len(p) + h / len(g)), 6) END AS f1
      FROM (SELECT *, len(list_intersect(p, g))::DOUBLE AS h FROM {source})"""


_PRF = _prf_sql("kw", "conv_id, turn, class", "1.0::DOUBLE")
_TRACK = "count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_triggered, round(count(*) FILTER (WHERE value > 50) / count(*)::DOUBLE, 6) AS trigger_rate, count(*) FILTER (WHERE value > 50 AND event_id % 3 <> 0) AS n_regenerated, count(*) FILTER (WHERE value > 50 AND event_id % 3 <> 0 AND user_id % 2 = 0) AS n_recovered, round(count(*) FILTER (WHERE value > 50 AND event_id % 3 <> 0 AND user_id % 2 = 0) / nullif(count(*) FILTER (WHERE value > 50), 0)::DOUBLE, 6) AS recovery_rate, sum(user_id % 4)::BIGINT AS pre_supported, coalesce(sum(user_id % 3) FILTER (WHERE value > 50), 0)::BIGINT AS pre_unsupported, coalesce(sum(user_id % 4 + user_id % 3) FILTER (WHERE value > 50 AND event_id % 3 <> 0), 0)::BIGINT AS post_supported, 0::BIGINT AS post_unsupported FROM events"
_FACTS = "facts AS MATERIALIZED (SELECT event_type AS condition, user_id AS example, 'value' AS field, round(avg(value), 9) AS value FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL)"
_PAIRED = """halves AS (SELECT user_id, event_id % 2 AS h, round(avg(value), 9) AS v FROM events GROUP BY ALL),
facts AS MATERIALIZED (SELECT 'even|odd' AS condition, x.user_id AS example, round(x.v - y.v, 6) AS value FROM halves x JOIN halves y ON x.user_id = y.user_id AND x.h = 0 AND y.h = 1)"""


def _drawn_sql(seed: int) -> str:
    """placed with every round r and the draw h of each row and round."""
    m = (1 << 31) - 1
    y = f"SELECT placed.*, r, ((r * 48271 + {seed}) % {m} * 69621 + i * 16807 + 12345) % {m} AS y FROM placed, range(1, {ROUNDS + 1}) t(r)"
    return f"SELECT *, xor(w, w >> 11) AS h FROM (SELECT *, xor(z, z >> 7) * 62089911 % {m} AS w FROM (SELECT *, xor(y, y >> 13) * 39373 % {m} AS z FROM ({y})))"


_BOOT = f"""placed AS MATERIALIZED (SELECT condition, value, row_number() OVER (PARTITION BY condition ORDER BY example) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM facts),
drawn AS (SELECT condition, r, h % n AS pick FROM ({_drawn_sql(42)})),
means AS (SELECT d.condition, r, round(avg(v.value), 6) AS m FROM drawn d JOIN placed v ON v.condition = d.condition AND v.i = d.pick GROUP BY d.condition, r),
ends AS (SELECT condition, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY condition),
ci AS (SELECT condition, round(avg(value), 4) AS mean, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM facts JOIN ends USING (condition) GROUP BY condition)"""

ORACLES = {
    "sentence_split": f"SELECT conv_id, turn, i - 1 AS pos, md5(s[i]) AS digest FROM (SELECT conv_id, turn, {_SENT('text')} AS s FROM conversations), unnest(range(1, len(s) + 1)) r(i)",
    "truncate_words": f"SELECT doc_id, md5(array_to_string(({_WORDS('text')})[1:150], ' ')) AS cut, md5(CASE WHEN len({_WORDS('text')}) <= 480 THEN text ELSE array_to_string(({_WORDS('text')})[1:480], ' ') END) AS clipped FROM documents",
    "json_extract": """SELECT event_id, props AS object, '[1, 2]' AS "array", CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "keyword_parse": f"WITH {_ANSWERS} SELECT doc_id, found, CASE WHEN found = '' THEN 0 ELSE 2 END::BIGINT AS n FROM answers",
    "parse_rate": f"WITH {_ANSWERS} SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE found = '') / count(*)::DOUBLE, 6) AS rate FROM answers GROUP BY lang",
    "verdict_parse": f"WITH {_VERDICT} SELECT * FROM verdicts",
    "label_dist": f"""WITH {_VERDICT}, s AS (SELECT overall, sum(n_supported) AS a, sum(n_partial) AS b, sum(n_unsupported) AS c FROM verdicts GROUP BY overall),
      l AS (SELECT overall, unnest([{{'label': 'n_supported', 'total': a}}, {{'label': 'n_partial', 'total': b}}, {{'label': 'n_unsupported', 'total': c}}]) AS x, a + b + c AS al FROM s)
      SELECT overall, x.label AS label, x.total::BIGINT AS total, round(x.total::DOUBLE / nullif(al, 0), 6) AS share FROM l""",
    "poison_context": "SELECT item_id, md5('[Doc 0] All of this is false.' || chr(10) || chr(10) || text) AS digest FROM benchmark",
    "nli_vote": f"WITH {_CLAIMS} SELECT query, claim, chunk_pos, n_votes, supported FROM votes",
    "claim_pairs": f"WITH {_CLAIMS} SELECT query, claim, supported, chunk_pos, n_chunks FROM pairs",
    "hallucination_ctx": f"WITH {_CLAIMS} {_rate_sql('SELECT query, claim, supported FROM pairs')}",
    "hallucination_ref": f"""WITH {_CLAIMS}, known AS (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'assistant' AND conv_id % 5 <> 2),
      r AS ({_rate_sql('SELECT query, claim, supported FROM (SELECT *, min(chunk_pos) OVER (PARTITION BY query) AS p FROM votes) WHERE chunk_pos = p')})
      SELECT query, CASE WHEN conv_id IS NULL THEN 0 ELSE n_claims END AS n_claims, CASE WHEN conv_id IS NULL THEN 0 ELSE n_unsupported END AS n_unsupported, CASE WHEN conv_id IS NULL THEN NULL ELSE rate END AS rate FROM r LEFT JOIN known ON conv_id = query // 1000""",
    "rouge1": _rouge_sql(1),
    "rouge2": _rouge_sql(2),
    "rouge_l": f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, {_TERMS('text')} AS a, {_TERMS('before')} AS b FROM turns),
      l AS (SELECT conv_id, turn, len(a) + len(b) AS n, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(
        list_transform(a, lambda x: list_transform(b, lambda y: (y = x)::INT)),
        lambda row, hit: list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::INT]), lambda made, j: list_append(made, greatest(made[j[1]], row[j[1] + 1], row[j[1]] + hit[j[1]])), [0]::INT[]),
        list_transform(range(len(b) + 1), lambda j: 0::INT))[-1] END AS hit FROM w)
      SELECT conv_id, turn, CASE WHEN hit = 0 THEN 0 ELSE round(2.0::DOUBLE * hit / n, 6) END AS f1 FROM l""",
    "greedy_match_f1": """WITH t AS MATERIALIZED (SELECT vec_id // 8 AS text, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      met AS MATERIALIZED (SELECT c.text AS candidate, r.text AS reference, c.vec_id AS a, r.vec_id AS b, list_inner_product(c.v, r.v) AS sim FROM t c JOIN t r ON r.text = c.text + 1),
      p AS (SELECT candidate, reference, avg(m) AS p FROM (SELECT candidate, reference, a, max(sim) AS m FROM met GROUP BY ALL) GROUP BY ALL), q AS (SELECT candidate, reference, avg(m) AS r FROM (SELECT candidate, reference, b, max(sim) AS m FROM met GROUP BY ALL) GROUP BY ALL)
      SELECT candidate, reference, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 5) AS f1 FROM p JOIN q USING (candidate, reference)""",
    "keyword_prf": f"WITH {_PAIRS} {_PRF}",
    "keyword_prf_strict": f"WITH {_PAIRS} {_prf_sql('kw', 'conv_id, turn, class', '0.0::DOUBLE')}",
    "keyword_misses": f"""WITH {_PAIRS} SELECT conv_id, turn, class, coalesce(array_to_string(list_sort(list_filter(p, lambda x: list_contains(g, x))), '|'), '') AS hits,
      coalesce(array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(g, x))), '|'), '') AS false_positives, coalesce(array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(p, x))), '|'), '') AS false_negatives FROM kw""",
    "keyword_micro": f"""WITH {_PAIRS}, u AS (SELECT conv_id, turn, flatten(list(list_transform(p, lambda x: class || '::' || x))) AS p, flatten(list(list_transform(g, lambda x: class || '::' || x))) AS g FROM kw GROUP BY conv_id, turn) {_prf_sql('u', 'conv_id, turn', '1.0::DOUBLE')}""",
    "keyword_agg": f"WITH {_PAIRS}, s AS ({_PRF}) SELECT class, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1 FROM s GROUP BY class",
    "keyword_pivot": f"""WITH {_PAIRS}, s AS ({_PRF}) SELECT turn, round(avg(f1) FILTER (WHERE class = 'short'), 5) AS "short", round(avg(f1) FILTER (WHERE class = 'middle'), 5) AS "middle", round(avg(f1) FILTER (WHERE class = 'long'), 5) AS "long" FROM s GROUP BY turn""",
    "latency_summary": "SELECT event_type, round(avg(r), 4) AS rate_mean, round(stddev_pop(r), 4) AS rate_std, round(avg(value), 4) AS seconds_mean, count(*) AS n FROM (SELECT *, CASE WHEN value > 0 THEN length(props)::DOUBLE / value ELSE 0 END AS r FROM events) GROUP BY event_type",
    "gen_length": f"""SELECT role, count(*) AS n, round(avg(w), 5) AS words_mean, max(w)::BIGINT AS words_max, round(avg(CASE WHEN w > 150 THEN 100.0::DOUBLE ELSE 0 END), 5) AS pct_over, round(avg(CASE WHEN w > 150 THEN (w - 150) / w::DOUBLE * 100 ELSE 0 END), 5) AS pct_cut FROM (SELECT role, len({_WORDS('text')}) AS w FROM conversations) GROUP BY role""",
    "track_summary": f"SELECT event_type, {_TRACK} GROUP BY event_type",
    "track_rollup": f"SELECT event_type, {_TRACK} GROUP BY ROLLUP (event_type)",
    "delta_report": f"SELECT source, round(avg(least(w, 150)), 5) AS words_a, round(avg(w), 5) AS words_b, round(avg(w) - avg(least(w, 150)), 5) AS words_delta FROM (SELECT source, len({_WORDS('text')}) AS w FROM documents) GROUP BY source",
    "score_quantiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.75), 5) AS q75 FROM events GROUP BY event_type",
    "minmax_norm": """WITH s AS (SELECT p_type, round(avg(p_retailprice), 4) AS speed, round(avg(p_size), 4) AS error FROM part GROUP BY p_type)
      SELECT p_type, round((speed - (min(speed) OVER () - 0.01::DOUBLE)) / ((max(speed) OVER () + 0.01::DOUBLE) - (min(speed) OVER () - 0.01::DOUBLE)), 5) AS speed, round((error - (min(error) OVER () - 0.01::DOUBLE)) / ((max(error) OVER () + 0.01::DOUBLE) - (min(error) OVER () - 0.01::DOUBLE)), 5) AS error FROM s""",
    "running_min_frontier": """WITH s AS (SELECT p_type, round(avg(p_retailprice), 4) AS speed, round(avg(p_size), 4) AS error FROM part GROUP BY p_type),
      w AS (SELECT *, min(error) OVER (ORDER BY speed, p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM s) SELECT p_type, speed, error FROM w WHERE least IS NULL OR error < least""",
    "score_fact": f"WITH {_FACTS} SELECT condition, example, field, value FROM facts",
    "bootstrap_ci": f"WITH {_FACTS}, {_BOOT} SELECT condition, mean, low, high FROM ci",
    "paired_bootstrap": f"WITH {_PAIRED}, {_BOOT} SELECT 'even' AS a, 'odd' AS b, mean, low, high, low > 0 OR high < 0 AS significant FROM ci",
    "permutation_test": f"""WITH {_PAIRED}, placed AS (SELECT value, row_number() OVER (ORDER BY example) - 1 AS i FROM facts),
      flips AS (SELECT r, round(avg(CASE WHEN h % 2 = 0 THEN value ELSE -value END), 6) AS m FROM ({_drawn_sql(43)}) GROUP BY r),
      seen AS (SELECT round(avg(value), 6) AS mean FROM facts)
      SELECT 'even' AS a, 'odd' AS b, round(mean, 4) AS mean, round((count(*) FILTER (WHERE abs(m) >= abs(mean)) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM flips, seen GROUP BY mean""",
    "pairwise_report": f"""WITH {_FACTS.replace("facts AS", "scores AS")}, sizes AS (SELECT condition, count(*) AS n FROM scores GROUP BY condition),
      met AS (SELECT x.condition AS a, y.condition AS b, x.example, x.value - y.value AS value FROM scores x JOIN scores y ON x.example = y.example AND x.condition < y.condition),
      fit AS (SELECT a, b FROM (SELECT a, b, count(*) AS m FROM met GROUP BY a, b) c JOIN sizes p ON p.condition = a JOIN sizes q ON q.condition = b WHERE m = p.n AND m = q.n),
      facts AS MATERIALIZED (SELECT a || '|' || b AS condition, example, value FROM met JOIN fit USING (a, b)), {_BOOT},
      flips AS (SELECT condition, r, round(avg(CASE WHEN h % 2 = 0 THEN value ELSE -value END), 6) AS m FROM ({_drawn_sql(43)}) GROUP BY condition, r),
      seen AS (SELECT condition, round(avg(value), 6) AS mean FROM facts GROUP BY condition),
      p AS (SELECT condition, round((count(*) FILTER (WHERE abs(m) >= abs(mean)) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM flips JOIN seen USING (condition) GROUP BY condition)
      SELECT split_part(condition, '|', 1) AS a, split_part(condition, '|', 2) AS b, mean, low, high, p, low > 0 OR high < 0 AS significant_ci, p < 0.05 AS significant_p FROM ci JOIN p USING (condition)""",
    "contrast_table": f"""WITH {_FACTS.replace("facts AS", "every AS")}, three AS (SELECT * FROM every WHERE condition IN ('click', 'purchase', 'view') AND example IN (SELECT example FROM every WHERE condition IN ('click', 'purchase', 'view') GROUP BY example HAVING count(*) = 3)),
      wanted AS (SELECT * FROM (VALUES ('click', 'purchase', 'value', 1.0::DOUBLE), ('click', 'view', 'value', 100.0::DOUBLE), ('view', 'never_run', 'value', 1.0::DOUBLE)) w(a, b, field, scale)),
      facts AS MATERIALIZED (SELECT a || '|' || b AS condition, x.example, x.value - y.value AS value FROM wanted JOIN three x ON x.condition = a JOIN three y ON y.condition = b AND y.example = x.example),
      {_BOOT.replace("round(avg(value), 4) AS mean, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high", "avg(value) AS mean, any_value(low) AS low, any_value(high) AS high")},
      flips AS (SELECT condition, r, round(avg(CASE WHEN h % 2 = 0 THEN value ELSE -value END), 6) AS m FROM ({_drawn_sql(43)}) GROUP BY condition, r),
      seen AS (SELECT condition, round(avg(value), 6) AS mean FROM facts GROUP BY condition),
      p AS (SELECT condition, (count(*) FILTER (WHERE abs(m) >= abs(mean)) + 1) / (count(*) + 1)::DOUBLE AS p FROM flips JOIN seen USING (condition) GROUP BY condition)
      SELECT a, b, field, round(mean * scale, 3) AS delta, round(low * scale, 3) AS low, round(high * scale, 3) AS high, round(p, 6) AS p, coalesce((low > 0 OR high < 0) AND p < 0.05, false) AS significant, CASE WHEN low > 0 OR high < 0 THEN '*' ELSE '' END AS mark
      FROM wanted LEFT JOIN ci ON ci.condition = a || '|' || b LEFT JOIN p ON p.condition = a || '|' || b""",
    "qa_aggregate": f"""WITH each AS (SELECT event_type, user_id AS example, round(avg(value), 9) AS mean, round(min(value), 9) AS least, round(max(value), 9) AS most, count(*)::DOUBLE AS events, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 9) AS high FROM events GROUP BY event_type, user_id),
      facts AS MATERIALIZED (SELECT event_type || '|' || f AS condition, example, value FROM (UNPIVOT each ON mean, least, most, events, high INTO NAME f VALUE value)), {_BOOT}
      SELECT split_part(condition, '|', 1) AS condition, {', '.join(f"max(CASE WHEN split_part(condition, '|', 2) = '{f}' THEN {c} END) AS {f}_{n}" for f in ('mean', 'least', 'most', 'events', 'high') for c, n in (('mean', 'mean'), ('low', 'ci_low'), ('high', 'ci_high')))} FROM ci GROUP BY 1""",
    "formatted_scores": """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY event_type UNION ALL SELECT 'never_run', NULL, NULL)
      SELECT event_type, coalesce(printf('%.4f [%.4f, %.4f]', m, m - d, m + d), '--') AS interval, coalesce(printf('%.2f [%.2f, %.2f]', m / 10, (m - d) / 10, (m + d) / 10), '--') AS percent,
        coalesce(printf('%.2f', m), '--') || ' ± ' || coalesce(printf('%.2f', d), '--') AS spread, coalesce(printf('%.4f', m), '--') AS mean, CASE WHEN m >= 20 THEN '+' ELSE '' END AS sign FROM s""",
    "length_scatter": f"""WITH w AS (SELECT doc_id, source, len({_WORDS('text')})::BIGINT AS words, n_chars FROM documents)
      SELECT doc_id, source, words, words > 150 AS over, n_chars, round(avg(words) OVER (PARTITION BY source), 4) AS words_mean, round(avg(n_chars) OVER (PARTITION BY source), 4) AS score_mean FROM w""",
    "nested_keywords": """SELECT doc_id, lang || '|' || source || '|{"id":' || doc_id || '}' AS found FROM documents""",
    "track_filter": "SELECT event_id, event_type FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW')",
    "run_plan": "SELECT n_name AS label, n_regionkey AS phase, CASE WHEN n_nationkey % 2 = 0 THEN 'skip' ELSE 'run' END AS status FROM nation WHERE n_regionkey IN (0, 2, 3)",
    "report_qa": f"WITH {_FACTS}, {_BOOT}, registry AS (SELECT unnest(['click', 'purchase', 'view', 'signup', 'logout', 'never_run']) AS condition) SELECT condition, mean, low, high FROM registry LEFT JOIN ci USING (condition)",
    "dq_checks": f"""WITH c AS (SELECT 'documents.text present' AS name, count(*) FILTER (WHERE text IS NULL OR {sql.stripped('text')} = '') AS n_bad, true AS fatal FROM documents
      UNION ALL SELECT 'documents.long enough', count(*) FILTER (WHERE len({_WORDS('text')}) < 5), false FROM documents
      UNION ALL SELECT 'events.value present', count(*) FILTER (WHERE value IS NULL OR isnan(value)), true FROM events
      UNION ALL SELECT 'embeddings.size', count(*) FILTER (WHERE len(embedding) <> 64), true FROM embeddings)
      SELECT name, CASE WHEN n_bad = 0 THEN 'PASS' WHEN fatal THEN 'FAIL' ELSE 'WARN' END AS status, n_bad FROM c""",
}
