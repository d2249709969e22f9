"""Stemmed overlap, matching, verifier modes, fallbacks, quality suites, result documents, the model endpoint and run catalogues."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.stemming import stem
from fathomline.operators import assertions, metrics, report, search, verify
from fathomline.operators.assertions import FAIL, PASS, WARN, Check, Equal
from fathomline.plans.answering import answered
from fathomline.sources import documents, models, readers
from fathomline.sources.endpoint import Endpoint

#: Examples that were published with the algorithm.
PUBLISHED = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems():
    assert [stem(w) for w in PUBLISHED[::2]] == PUBLISHED[1::2]
    assert [stem(w) for w in ("a", "is", "dying", "skies", "enjoy", "cry", "spied", "died")] == ["a", "is", "die", "sky", "enjoy", "cri", "spi", "die"]


def test_stemmed_overlap(spark):
    rows = spark.createDataFrame([(1, "Running runners ran quickly", "the runner runs quick"), (2, None, "x"), (3, "cats cat", "cat")], "k int, a string, b string")
    listed = {r.k: (r.a, r.b) for r in metrics.stemmed(rows, ["k"], ["a", "b"]).collect()}
    assert listed == {1: (["run", "runner", "ran", "quickli"], ["the", "runner", "run", "quick"]), 2: ([], ["x"]), 3: (["cat", "cat"], ["cat"])}
    got = {r.k: (r.precision, r.recall) for r in metrics.ngram_overlap(rows, ["k"], "a", "b", 1, stem_terms=True).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.5, 1.0)}
    plain = {r.k: r.recall for r in metrics.ngram_overlap(rows, ["k"], "a", "b", 1).collect()}
    assert plain[1] == 0.0


def test_matching_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MATCHED_AT_ONCE", 2)
    rng = np.random.default_rng(1)
    texts = {i: rng.normal(size=(n, 3)) for i, n in enumerate((5, 1, 4))}
    tokens = spark.createDataFrame([(i, v.tolist()) for i, m in texts.items() for v in m] + [(9, None)], "t int, v array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 9)], "candidate int, reference int")
    got = {(r.candidate, r.reference): (r.precision, r.recall) for r in metrics.greedy_match(tokens, pairs, "t", "v").collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 0)}
    for (a, b), found in got.items():
        similar = texts[a] @ texts[b].T
        assert found == pytest.approx((similar.max(axis=1).mean(), similar.max(axis=0).mean()))


def test_four_labels_in_the_answering_path(spark):
    q = spark.createDataFrame([(1, "who?", "c")], "query int, question string, context string")
    raw = '{"claims":[{"text":"x","label":"Weak_Entailment"},{"text":"y","label":"supported"}],"overall":"unsupported"}'
    got = answered(q, lambda: lambda p: ["so" for _ in p], lambda: lambda p: [raw for _ in p], mode="split-partial").first()
    assert (got.verdict.n_weak_entailment, got.verdict.n_supported, got.verdict.n_citation_noncompliance, got.verdict.n_unsupported) == (1, 1, 0, 0)
    assert got.verdict.overall == "unsupported"  # stands, as four labels are not softened
    three = answered(q, lambda: lambda p: ["so" for _ in p], lambda: lambda p: [raw for _ in p]).first()
    assert three.verdict.overall == "unsupported" and three.verdict.n_unsupported == 1
    with pytest.raises(ValueError, match="verifier mode"):
        answered(q, lambda: None, lambda: None, mode="five")


def test_representative_by_score(spark):
    pairs = spark.createDataFrame([(1, 0, False, 0.1), (1, 1, True, 0.3), (1, 2, False, 0.9), (2, 4, False, 0.2), (2, 3, False, 0.2)], "c int, chunk_pos long, supported boolean, s double")
    pick = lambda **k: {r.c: (r.supported, r.chunk_pos) for r in verify.representative(pairs, ["c"], **k).collect()}
    assert pick() == {1: (True, 1), 2: (False, 3)}
    assert pick(score="s") == {1: (True, 2), 2: (False, 3)}


def test_scorer_that_does_not_load():
    with pytest.warns(UserWarning, match="no reranking"):
        assert search.loaded(lambda: 1 / 0) is None
    assert search.loaded(lambda: search.overlap_scorer) is search.overlap_scorer


def test_in_order(spark):
    ranked = spark.createDataFrame([(1, 0), (1, 1)], "query int, rank long")
    assert [r.position for r in search.in_order(ranked).orderBy("rank").collect()] == [0, 1]


def test_catalogue_runs_what_is_due(spark):
    runs = spark.createDataFrame([("x", 1, "o1"), ("y", 1, "o2"), ("z", 2, "o3"), ("w", 1, "o4")], "label string, phase int, output string")
    plan = readers.planned(runs, spark.createDataFrame([("o1",)], "output string"), [1, 2])
    seen = []

    def run(row):
        seen.append(row.label)
        if row.label == "y":
            raise RuntimeError("broken")

    with pytest.warns(UserWarning, match="y: broken"):
        got = {r.label: r.outcome for r in readers.executed(plan, run).collect()}
    assert seen == ["w", "y", "z"]
    assert got == {"x": "skip", "y": "failed", "z": "ok", "w": "ok"}


def test_quality_suite(spark):
    one, two = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double"), spark.createDataFrame([(1,), (3,), (None,)], "k int")
    cover = assertions.covered(one, two, "k")
    assert cover.first().asDict() == {"known": 1, "missing": 1}
    checks = [Check("rows", "one", F.count("*"), lambda v: v >= 2), Check("values", "one", F.count_if(F.col("v").isNull()), lambda v: v == 0, WARN), Check("nothing", "one", F.max(F.lit(None).cast("double")), lambda v: v == 0, WARN), Check("size", "two", F.count("*"), lambda v: v == 3), Check("gone", "none", F.count("*"), lambda v: v >= 0)]
    found = assertions.checked({"one": one, "two": two, "none": None}, checks, [Equal("pair", "rows", "size"), Equal("lost", "rows", "gone", WARN)])
    assert {r.check: r.status for r in found.collect()} == {"rows": PASS, "values": WARN, "nothing": WARN, "size": PASS, "gone": FAIL, "pair": FAIL, "lost": WARN}
    assert assertions.rolled_up(found).first().asDict() == {"n_pass": 2, "n_warn": 3, "n_fail": 2, "verdict": FAIL}
    plain = assertions.checked({"one": one}, checks[:3])
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_qa_rows_blank_what_a_condition_cannot_have(spark):
    registry = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "condition string, has_context boolean")
    summary = spark.createDataFrame([("a", 0.5, 0.25, 0.75), ("b", 0.5, 0.25, 0.75)], "condition string, h_mean double, h_low double, h_high double")
    got = {r.condition: r.h for r in report.qa_rows(registry, summary, ["h"], grounded=["h"], percent=["h"]).collect()}
    assert got == {"a": "50.00 [25.00, 75.00]", "b": report.UNDEFINED, "c": report.PLACEHOLDER}


def test_result_documents_are_written_whole(spark, tmp_path):
    examples = spark.createDataFrame([("a", i, None if i == 3 else i / 2) for i in range(40)] + [("b", 1, 1.0), (None, 1, 1.0)], "condition string, example long, score double").repartition(4)
    aggregate = examples.groupBy("condition").agg(F.avg("score").alias("mean")).union(spark.createDataFrame([("only", 0.0)], "condition string, mean double"))
    path = f"{tmp_path}/results"
    documents.write_documents(examples, aggregate, "condition", path)
    documents.write_documents(examples.where("condition = 'b'"), aggregate.where("condition = 'b'"), "condition", path)  # replaces its own document alone
    a = json.loads((tmp_path / "results/a.json").read_text())
    assert [x["example"] for x in a["per_example"]] == list(range(40)) and a["per_example"][3] == {"example": 3, "score": None}
    assert json.loads((tmp_path / "results/only.json").read_text()) == {"condition": "only", "per_example": [], "aggregate": {"mean": 0.0}}
    assert sorted(p.name for p in (tmp_path / "results").iterdir()) == ["a.json", "b.json", "only.json"]
    schema = T.StructType.fromDDL("condition string, per_example array<struct<example: long, score: double>>, aggregate struct<mean: double>")
    read = readers.read_results(spark, [f"{path}/{n}.json" for n in ("a", "b", "gone")], schema)
    assert {r.condition: (len(r.per_example), r["aggregate"]["mean"]) for r in read.collect()} == {"a": (40, pytest.approx(sum(i / 2 for i in range(40) if i != 3) / 39)), "b": (1, 1.0)}


def test_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("double")
    def broken(x):
        if x == 17:
            raise ValueError
        return float(x)

    examples = spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 4).alias("condition"), "id", broken("id").alias("score"))
    aggregate = examples.groupBy("condition").agg(F.count("*").alias("n"))
    (tmp_path / "results").mkdir()
    with pytest.raises(Exception, match="ValueError"):
        documents.write_documents(examples, aggregate, "condition", f"{tmp_path}/results")
    assert list((tmp_path / "results").iterdir()) == []


class _Answers(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    connections, asked, failures = set(), [], [0]

    def _send(self, status, body):
        text = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(text)))
        self.end_headers()
        self.wfile.write(text)

    def do_GET(self):
        self._send(200, {"models": [{"name": "tiny:1"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.connections.add(self.client_address)
        self.asked.append(body)
        if self.failures[0]:
            self.failures[0] -= 1
            self._send(503, {})
        else:
            self._send(200, {"response": body["prompt"].upper()})

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    _Answers.connections, _Answers.asked, _Answers.failures = set(), [], [0]
    running = ThreadingHTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}"
    running.shutdown()


def test_endpoint(server):
    waits = []
    _Answers.failures[0] = 2
    model = Endpoint(server, "tiny:1", system="be brief", form="json", pause=waits.append)()
    assert model(["one", "two"]) == ["ONE", "TWO"]
    assert waits == [1, 2] and len(_Answers.asked) == 4 and len(_Answers.connections) == 1  # one kept connection
    assert _Answers.asked[0]["system"] == "be brief" and _Answers.asked[0]["format"] == "json" and _Answers.asked[0]["stream"] is False
    _Answers.failures[0] = 3
    with pytest.raises(OSError, match="503"):
        Endpoint(server, "tiny:1", pause=waits.append)()(["x"])
    assert Endpoint(server, "tiny:1").models() == ["tiny:1"] and Endpoint(server, "tiny:1").ping()
    assert Endpoint("http://127.0.0.1:9", "x").models() == [] and not Endpoint("http://127.0.0.1:9", "x").ping()


def test_endpoint_on_executors(spark, server):
    texts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, t string").repartition(3)
    got = models.applied(texts, "t", "answer", T.StringType(), Endpoint(server, "tiny:1")).collect()
    assert {r.i: r.answer for r in got} == {i: f"P{i}" for i in range(20)}
    assert len(_Answers.connections) <= 3
