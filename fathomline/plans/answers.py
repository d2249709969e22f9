"""Queries over the answering path, its verifier modes, report rows and quality suites, with their SQL.

As in `evaluation`, model outputs are stand-ins made from the tables by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import assertions, report, stats, verify
from fathomline.operators.assertions import FAIL, PASS, WARN, Check, Equal
from fathomline.plans import answering, evaluation, sql
from fathomline.plans.retrieval import table


def normal_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normal_term(F.col("text"))).alias("collapsed"), F.md5(T.normal_term(F.col("text"), collapse=False)).alias("kept"))


#: Canned verdicts with four labels and an odd one: a claim for each turn before; every seventh answer is broken.
_FOUR = (*verify.LABELS4, "odd")


def verdict_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    label = lambda i: F.element_at(F.array(*map(F.lit, _FOUR)), (F.pmod(i + F.col("conv_id"), F.lit(5)) + 1).cast("int"))
    claims = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("turn", F.lit(1))), lambda i: F.concat(F.lit('{"text":"c","label":"'), label(i), F.lit('"}'))), ",")
    overall = F.element_at(F.array(*map(F.lit, ("unsupported", "WEAK_ENTAILMENT", "strange"))), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    raw = F.when(F.pmod("conv_id", F.lit(7)) == 3, "{broken").otherwise(F.concat(F.lit('{"claims":['), claims, F.lit('],"overall":"'), overall, F.lit('"}')))
    return c.select("conv_id", "turn", verify.verdict(raw, verify.labels_of("split-partial")).alias("v")).select("conv_id", "turn", "v.*").drop("worst_claims")


def retry_prompts(spark, sf_dir):
    v = evaluation._verdicts(spark, sf_dir).select("conv_id", "turn", verify.verdict(F.col("raw")).alias("v"))
    return v.select("conv_id", "turn", F.md5(verify.retry_prompt(F.lit("Answer."), F.col("v.worst_claims"))).alias("digest"))


def claim_best(spark, sf_dir):
    """The representative chunk by a single model's score: the share of a claim's distinct terms that the chunk holds."""
    scored = evaluation._shares(spark, sf_dir).withColumn("supported", F.col("share") >= 0.2)
    return verify.representative(scored, ["query", "claim"], "share")


def _digit(text: str) -> int:
    return len(text) % 5


#: What the stand-in verifier says of an answer by its last digit; 4 breaks it.
_BY_DIGIT = ("supported", "partial", "unsupported", "supported")


def _canned_verdict(asked: str) -> str:
    digit = int(asked[-1])
    if digit == 4:
        return "{broken"
    return f'{{"claims":[{{"text":"{asked[-2:]}","label":"{_BY_DIGIT[digit]}"}}],"overall":"{_BY_DIGIT[digit]}"}}'


def answer_loop(spark, sf_dir):
    """Every user turn answered from the turn before it, verified, and answered once more where a claim is unsupported."""
    c = table(spark, sf_dir, "conversations")
    before = F.coalesce(evaluation.metrics.previous(c, "conv_id", "turn", "text"), F.lit("none"))
    asked = c.withColumn("context", before).where("role = 'user' AND text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("text").alias("question"), "context")
    generator = lambda: lambda prompts: [f"a{_digit(p)}" for p in prompts]
    verifier = lambda: lambda texts: [_canned_verdict(t) for t in texts]
    out = answering.answered(asked, generator, verifier, regenerate=True)
    return out.select("query", "answer", F.col("verdict.overall").alias("overall"), F.col("verdict.n_unsupported").alias("n_unsupported"), "regenerated", F.col("verdict_after.overall").alias("overall_after"))


#: Condition and whether it had context; the last was never run.
_REGISTRY = (("click", True), ("purchase", True), ("view", False), ("never_run", True))


def qa_table(spark, sf_dir):
    """Cells of value and risk by kind of event; kinds without context have no risk."""
    registry = spark.createDataFrame(list(_REGISTRY), "condition string, has_context boolean")
    risk = F.col("event_id") % 7 / 7
    figures = [f(c).alias(f"{n}_{k}") for n, c in (("value", F.col("value")), ("risk", risk)) for k, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    return report.qa_rows(registry, table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition")).agg(*figures), ["value", "risk"], grounded=["risk"], percent=["risk"])


def constrained_delta(spark, sf_dir):
    """Native keyword scores against those of constrained answers, which hold terms of even length only, by class."""
    keywords = evaluation._keywords(spark, sf_dir)

    def scores(predicted) -> DataFrame:
        s = keywords.select("class", evaluation.metrics.set_scores(predicted, F.col("gold")).alias("s"))
        return s.groupBy("class").agg(*(F.avg(f"s.{c}").alias(c) for c in ("precision", "recall", "f1")))

    even = F.filter("predicted", lambda x: F.length(x) % 2 == 0)
    return report.contrast_rows(scores(F.col("predicted")), scores(even).where("class <> 'long'"), "class", ["precision", "recall", "f1"])


def flip_unobserved(spark, sf_dir):
    """Sign flips without the observed mean among the rounds."""
    out = stats.sign_flip(evaluation._paired(spark, sf_dir), ["a", "b"], rounds=evaluation.ROUNDS, observed=False)
    return out.select("a", "b", F.round("mean", 4).alias("mean"), F.round("p", 6).alias("p"))


#: name, table, aggregate (the same in Spark SQL and DuckDB), comparison and bound, level.
_RULES = (
    ("documents.rows", "documents", "count(*)", ">=", 100, FAIL),
    ("documents.ids present", "documents", "count(*) - count(doc_id)", "=", 0, FAIL),
    ("documents.ids distinct", "documents", "count(doc_id) - count(DISTINCT doc_id)", "=", 0, FAIL),
    ("documents.texts present", "documents", "sum(CASE WHEN text IS NULL OR length(text) = 0 THEN 1 ELSE 0 END)", "=", 0, WARN),
    ("documents.lengths match", "documents", "sum(CASE WHEN length(text) <> n_chars THEN 1 ELSE 0 END)", "=", 0, FAIL),
    ("documents.languages", "documents", "count(DISTINCT lang)", "<=", 4, FAIL),
    ("documents.longest", "documents", "max(n_chars)", "<=", 10_000, WARN),
    ("embeddings.rows", "embeddings", "count(*)", ">=", 100, FAIL),
    ("embeddings.ids distinct", "embeddings", "count(*) - count(DISTINCT vec_id)", "=", 0, FAIL),
    ("embeddings.labels present", "embeddings", "count(*) - count(label)", "=", 0, FAIL),
    ("pages.rows", "pages", "count(*)", ">=", 10, FAIL),
    ("pages.urls present", "pages", "count(*) - count(url)", "=", 0, WARN),
    ("pages.urls distinct", "pages", "count(url) - count(DISTINCT url)", "=", 0, WARN),
    ("benchmark.rows", "benchmark", "count(*)", ">=", 30, FAIL),
    ("benchmark.texts distinct", "benchmark", "count(text) - count(DISTINCT text)", "=", 0, FAIL),
    ("labels.rows", "labels", "count(*)", ">=", 10, FAIL),
    ("labels.quality range", "labels", "sum(CASE WHEN quality NOT IN (0, 1) THEN 1 ELSE 0 END)", "=", 0, FAIL),
    ("labels.toxic share", "labels", "avg(toxic)", "<=", 0.5, WARN),
    ("conversations.rows", "conversations", "count(*)", ">=", 10, FAIL),
    ("conversations.roles", "conversations", "count(DISTINCT role)", "=", 2, WARN),
    ("conversations.first turn", "conversations", "min(turn)", "=", 0, WARN),
    ("events.values finite", "events", "sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)", "=", 0, FAIL),
)
#: Pairs of tables that should be as long as each other, and keys that one table should have of another.
_PAIRS = (("documents and embeddings", "documents.rows", "embeddings.rows", WARN), ("pages and benchmark", "pages.rows", "benchmark.rows", WARN))
_KEYS = (("labels in documents", "labels", "documents", "doc_id", FAIL),)
_HOLDS = {">=": lambda bound: lambda v: v >= bound, "<=": lambda bound: lambda v: v <= bound, "=": lambda bound: lambda v: v == bound}


def dq_suite(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in dict.fromkeys(r[1] for r in _RULES)}
    checks = [Check(name, source, F.expr(measure), _HOLDS[op](bound), level) for name, source, measure, op, bound, level in _RULES]
    for name, rows, others, key, level in _KEYS:
        tables[name] = assertions.covered(tables[rows], tables[others], key)
        checks.append(Check(name, name, F.max("missing"), _HOLDS["="](0), level))
    return assertions.checked(tables, checks, [Equal(*p) for p in _PAIRS]).withColumn("value", F.round("value", 6))


def dq_totals(spark, sf_dir):
    return assertions.rolled_up(dq_suite(spark, sf_dir))


QUERIES = {f.__name__: f for f in (normal_terms, verdict_split, retry_prompts, claim_best, answer_loop, qa_table, constrained_delta, flip_unobserved, dq_suite, dq_totals)}

_SPLIT = f"""turns AS (SELECT conv_id, turn, conv_id % 7 = 3 AS broken, list_transform(range(1, greatest(turn, 1) + 1), lambda i: ({list(_FOUR[:4]) + ['unsupported']!r})[(i + conv_id) % 5 + 1]) AS l FROM conversations WHERE role = 'assistant'),
counted AS (SELECT conv_id, turn, broken, CASE WHEN broken THEN [] ELSE l END AS l FROM turns)"""
_N = lambda label: f"len(list_filter(l, lambda x: x = '{label}')) AS n_{label}"

_STATES = " UNION ALL ".join(
    [f"SELECT '{name}' AS \"check\", value, value {op} {bound} AS fine, '{level}' AS level FROM (SELECT ({measure})::DOUBLE AS value FROM {source})" for name, source, measure, op, bound, level in _RULES]
    + [f"SELECT '{name}', value, value = 0, '{level}' FROM (SELECT count(DISTINCT {key})::DOUBLE AS value FROM {rows} r ANTI JOIN {others} o USING ({key}) WHERE {key} IS NOT NULL)" for name, rows, others, key, level in _KEYS]
)
_SUITE = f"""rules AS MATERIALIZED ({_STATES}),
suite AS (SELECT "check", value, fine, level FROM rules""" + "".join(f""" UNION ALL SELECT '{name}', x.value - y.value, x.value = y.value, '{level}' FROM rules x, rules y WHERE x."check" = '{a}' AND y."check" = '{b}'""" for name, a, b, level in _PAIRS) + f"""),
states AS (SELECT "check", CASE WHEN coalesce(fine, false) THEN '{PASS}' ELSE level END AS status, round(value, 6) AS value FROM suite)"""

_ASK = f"length('{answering.TASKS['qa']}') + length('Context:') + length('Question: ') + 5"
_RETRY = "length('Leave out or support with the context:') + 7"

ORACLES = {
    "normal_terms": f"SELECT doc_id, md5(regexp_replace(lower({sql.stripped('text')}), '{T.SPACE}+', ' ', 'g')) AS collapsed, md5(lower({sql.stripped('text')})) AS kept FROM documents",
    "verdict_split": f"""WITH {_SPLIT} SELECT conv_id, turn, len(l) AS n_claims, {', '.join(map(_N, verify.LABELS4))},
      CASE WHEN broken OR conv_id % 3 <> 1 THEN 'unsupported' ELSE 'weak_entailment' END AS overall FROM counted""",
    "retry_prompts": f"""WITH {evaluation._VERDICT}
      SELECT conv_id, turn, md5('Answer.' || chr(10) || chr(10) || 'Leave out or support with the context:' || chr(10) || array_to_string(list_transform(list_filter(string_split(worst_claims, '|'), lambda x: x <> ''), lambda x: '- ' || x), chr(10))) AS digest FROM verdicts""",
    "claim_best": f"WITH {evaluation._CLAIMS} SELECT query, claim, bool_or(share >= 0.2) AS supported, arg_min(chunk_pos, (-share, chunk_pos)) AS chunk_pos, count(*) AS n_chunks FROM share GROUP BY query, claim",
    "answer_loop": f"""WITH t AS (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS before FROM conversations),
      asked AS (SELECT conv_id * 1000 + turn AS query, {_ASK} + length(text) + length(before) AS n FROM t WHERE role = 'user' AND text IS NOT NULL),
      once AS (SELECT query, n % 5 AS d, (n + {_RETRY}) % 5 AS e FROM asked),
      said AS (SELECT *, ({list(_BY_DIGIT) + ['unsupported']!r})[d + 1] AS overall, ({list(_BY_DIGIT) + ['unsupported']!r})[e + 1] AS later FROM once)
      SELECT query, 'a' || CASE WHEN d = 2 THEN e ELSE d END AS answer, overall, CASE WHEN d = 2 THEN 1 ELSE 0 END::BIGINT AS n_unsupported, d = 2 AS regenerated, CASE WHEN d = 2 THEN later END AS overall_after FROM said""",
    "qa_table": f"""WITH s AS (SELECT event_type AS condition, avg(value) AS v, min(value) AS vl, max(value) AS vh, avg(event_id % 7 / 7::DOUBLE) * 100 AS r, min(event_id % 7 / 7::DOUBLE) * 100 AS rl, max(event_id % 7 / 7::DOUBLE) * 100 AS rh, true AS ran FROM events GROUP BY event_type),
      g AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {str(h).lower()})" for c, h in _REGISTRY)}) x(condition, has_context))
      SELECT condition, CASE WHEN ran THEN printf('%.4f [%.4f, %.4f]', v, vl, vh) ELSE '{T.PLACEHOLDER}' END AS value,
        CASE WHEN ran AND NOT has_context THEN '{report.UNDEFINED}' WHEN ran THEN printf('%.2f [%.2f, %.2f]', r, rl, rh) ELSE '{T.PLACEHOLDER}' END AS risk FROM g LEFT JOIN s USING (condition)""",
    "constrained_delta": f"""WITH {evaluation._PAIRS},
      two AS (SELECT class, 'native' AS kind, p, g FROM kw UNION ALL SELECT class, 'constrained', list_filter(p, lambda x: length(x) % 2 = 0), g FROM kw WHERE class <> 'long'),
      each AS (SELECT class, kind, len(p) = 0 AND len(g) = 0 AS blank, coalesce(len(list_intersect(p, g))::DOUBLE / nullif(len(p), 0), 0) AS p, coalesce(len(list_intersect(p, g))::DOUBLE / nullif(len(g), 0), 0) AS r FROM two),
      mean AS MATERIALIZED (SELECT class, kind, avg(CASE WHEN blank THEN 1 ELSE p END) AS precision, avg(CASE WHEN blank THEN 1 ELSE r END) AS recall, avg(CASE WHEN blank THEN 1 WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS f1 FROM each GROUP BY class, kind),
      x AS (SELECT class, kind, precision, recall, f1, false AS change FROM mean
        UNION ALL SELECT class, 'constrained', NULL, NULL, NULL, false FROM (SELECT class FROM mean GROUP BY class HAVING count(*) = 1)
        UNION ALL SELECT n.class, 'delta', coalesce(c.precision, 0) - n.precision, coalesce(c.recall, 0) - n.recall, coalesce(c.f1, 0) - n.f1, true FROM (FROM mean WHERE kind = 'native') n LEFT JOIN (FROM mean WHERE kind = 'constrained') c USING (class))
      SELECT class, kind, {', '.join(f"CASE WHEN {c} IS NULL THEN '{T.PLACEHOLDER}' WHEN change AND {c} >= 0 THEN '+' || printf('%.3f', {c}) ELSE printf('%.3f', {c}) END AS {c}" for c in ('precision', 'recall', 'f1'))} FROM x""",
    "flip_unobserved": evaluation.ORACLES["permutation_test"].replace("+ 1) / (count(*) + 1)::DOUBLE", ") / count(*)::DOUBLE"),
    "dq_suite": f"""WITH {_SUITE} SELECT "check", status, value FROM states""",
    "dq_totals": f"""WITH {_SUITE}, n AS (SELECT count(*) FILTER (WHERE status = 'PASS') AS n_pass, count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'FAIL') AS n_fail FROM states)
      SELECT *, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM n""",
}
