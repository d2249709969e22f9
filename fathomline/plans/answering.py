"""The answering path over a batch of questions: retrieve, assemble, generate, verify, and answer again once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators import verify
from fathomline.sources.models import Model, applied

TASKS = {
    "qa": "Answer in a few sentences, from the context alone.",
    "keywords": "Reply with one JSON object that lists the keywords of each class.",
}


def prompt(task: str, context: str, question: str):
    """The prompt column of a task; an unknown task is an error."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    return F.concat(F.lit(f"{TASKS[task]}\n\nContext:\n"), F.col(context), F.lit("\n\nQuestion: "), F.col(question))


def answered(questions: DataFrame, generator: Callable[[], Model], verifier: Callable[[], Model] | None = None, *, task: str = "qa", context: str = "context", checked_context: str | None = None, retrieval: bool = True, regenerate: bool = False, mode: str = "standard") -> DataFrame:
    """questions (query, question, context) with answer, verdict, regenerated and verdict_after.

    Verification runs only for questions and answers with retrieval on. checked_context
    names another context for the verifier, so that a generator can be shown a planted one.
    Rows with unsupported claims are answered once more if regenerate is set; a verdict that
    does not parse never asks for that. mode names the verifier's labels (verify.MODES), which
    the fields of verdict follow. Every model's output is written before it is used.
    """
    labels = verify.labels_of(mode)
    first = applied(questions.withColumn("prompt", prompt(task, context, "question")), "prompt", "answer", T.StringType(), generator)
    shape = f"struct<n_claims:bigint,{','.join(f'n_{x}:bigint' for x in labels)},overall:string,worst_claims:array<string>>"
    none = F.lit(None).cast(shape)
    if verifier is None or task != "qa" or not retrieval:
        return first.withColumns({"verdict": none, "regenerated": F.lit(False), "verdict_after": none}).drop("prompt")

    def judged(df: DataFrame, out: str) -> DataFrame:
        asked = df.withColumn("__ask", F.concat(F.lit("Context:\n"), F.col(checked_context or context), F.lit("\n\nAnswer:\n"), F.col("answer")))
        return applied(asked, "__ask", "__raw", T.StringType(), verifier).withColumn(out, verify.verdict(F.col("__raw"), labels).cast(shape)).drop("__ask", "__raw")

    seen = judged(first, "verdict").withColumn("n", F.col("verdict.n_unsupported"))
    again, stand = verify.second_pass(seen, "n", regenerate)
    stand = stand.withColumns({"regenerated": F.lit(False), "verdict_after": none}).drop("n", "prompt")
    retry = again.withColumn("prompt", verify.retry_prompt(F.col("prompt"), F.col("verdict.worst_claims"))).drop("answer", "n")
    redone = judged(applied(retry, "prompt", "answer", T.StringType(), generator), "verdict_after").withColumn("regenerated", F.lit(True)).drop("prompt")
    return stand.unionByName(redone.select(stand.columns))
