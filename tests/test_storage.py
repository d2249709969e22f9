"""Index storage, readers, models, the answering path and streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators import search
from fathomline.plans.answering import answered, prompt
from fathomline.sources import models, readers, store
from fathomline.streaming import ingest as streaming


@pytest.fixture
def index(spark):
    chunks = spark.createDataFrame([(1, "fever and cough"), (2, "the weather")], "id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vec array<double>")
    lexical = search.lexical_index(chunks, "id", "text")
    return {"chunks": chunks, "vectors": vectors, **{k: lexical[k] for k in ("postings", "term_stats", "corpus_stats")}}


def test_index_round_trip(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    assert not store.index_exists(spark, path)
    store.save_index(index, path, "stand-in", dataset="tiny", n_chunks="9")
    assert store.index_exists(spark, path)
    row = spark.read.parquet(f"{path}/manifest").first()
    assert (row.n_chunks, row.embed_dim, row.dataset) == (2, 2, "tiny")
    loaded = store.load_index(spark, path, "stand-in")
    assert loaded["chunks"].count() == 2
    with pytest.raises(ValueError, match="encoder"):
        store.load_index(spark, path, "other")
    spark.range(1).select(F.lit(99).alias("version"), F.lit("x").alias("encoder")).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="version"):
        store.load_index(spark, path)


def test_readers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "reference": "b"}\n\n{"query": "c"}\n')
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a"}, {"query": "b"}]))
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.read_queries(spark, f"{tmp_path}/q.jsonl").where("query IS NOT NULL").count() == 2
    assert readers.read_queries(spark, f"{tmp_path}/q.json").count() == 2
    schema = T.StructType([T.StructField("query", T.StringType())])
    got = readers.read_results(spark, [f"{tmp_path}/q.json", f"{tmp_path}/none.json", f"{tmp_path}/bad.json"], schema)
    assert got.count() == 2
    assert readers.read_results(spark, [f"{tmp_path}/none.json"], schema).count() == 0


def test_log_and_catalogue(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "output string")
    readers.start_log(one, f"{tmp_path}/log")
    readers.append_log(one, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    runs = spark.createDataFrame([("a",), ("b",)], "output string")
    assert [r.output for r in readers.pending(runs, one).collect()] == ["b"]
    assert readers.pending(runs, one, force=True).count() == 2


def test_retries_and_names():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert models.retried(call, 2, waits.append) == "done" and waits == [1, 2]
    assert models.resolve("small") and models.resolve("a:b") == "a:b"
    with pytest.raises(ValueError):
        models.resolve("what")


def test_answering(spark):
    q = spark.createDataFrame([(1, "who?", "clean"), (2, "why?", "odd")], "query int, question string, context string")

    def generator():
        return lambda prompts: ["Odd one. Two." if "odd" in p else "Fine." for p in prompts]

    def verifier():
        bad = '{"claims":[{"text":"x","label":"unsupported"}],"overall":"unsupported"}'
        good = '{"claims":[{"text":"x","label":"supported"}],"overall":"supported"}'
        return lambda prompts: [bad if "Odd" in p else good for p in prompts]

    got = {r.query: r for r in answered(q, generator, verifier, regenerate=True).collect()}
    assert (got[1].regenerated, got[1].verdict.overall, got[1].verdict_after) == (False, "supported", None)
    assert (got[2].regenerated, got[2].verdict.n_unsupported, got[2].verdict_after.overall) == (True, 1, "unsupported")
    off = answered(q, generator, verifier, retrieval=False).first()
    assert off.verdict is None and not off.regenerated
    with pytest.raises(ValueError, match="task"):
        prompt("dance", "context", "question")


def test_streaming_keeps_the_first(spark, tmp_path):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(40))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    for i, batch in enumerate([[(1, text("a")), (2, text("a"))], [(3, text("a") + " more"), (4, text("b")), (5, "")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        import time

        time.sleep(1.1)
    for i in range(2):
        import shutil

        (tmp_path / "flat").mkdir(exist_ok=True)
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            shutil.copy(f, tmp_path / "flat" / f"{i}.parquet")
    query = streaming.start(spark, f"{tmp_path}/flat", schema, f"{tmp_path}/out", f"{tmp_path}/cp", "id", "text")
    query.awaitTermination(120)
    kept = sorted(r.doc for r in spark.read.parquet(f"{tmp_path}/out/chunks").collect())
    assert kept in ([1, 4], [3, 4])  # files of one second may come in either order


def test_load_or_build_and_refresh(spark, index, tmp_path):
    path, built = f"file://{tmp_path}/index", []

    def build():
        built.append(1)
        return index

    for rebuild, times in ((False, 1), (False, 1), (True, 2)):
        loaded = store.load_or_build(spark, path, build, "stand-in", rebuild, dataset="tiny")
        assert len(built) == times and loaded["chunks"].count() == 2
    with pytest.raises(RuntimeError, match="no chunks"):
        store.load_or_build(spark, path, lambda: index | {"chunks": index["chunks"].limit(0)}, "stand-in", rebuild=True)
    more = spark.createDataFrame([(3, "fever fever again and again"), (4, "")], "id int, text string")
    fresh = search.lexical_index(more, "id", "text")
    store.append_chunks(path, {"chunks": more, "vectors": spark.createDataFrame([(3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, vec array<double>"), "postings": fresh["postings"]})
    store.refresh(spark, path)
    whole = search.lexical_index(index["chunks"].union(more), "id", "text")
    loaded = store.load_index(spark, path, "stand-in")
    for name in ("term_stats", "corpus_stats"):
        assert sorted(map(tuple, loaded[name].collect())) == sorted(map(tuple, whole[name].collect()))
    row = spark.read.parquet(f"{path}/manifest").first()
    assert (row.n_chunks, row.dataset, row.encoder) == (4, "tiny", "stand-in")


def test_retry_prompt_lists_unsupported_claims_only(spark):
    q = spark.createDataFrame([(1, "why?", "c")], "query int, question string, context string")
    seen = f"{store.shared_folder(spark).removeprefix('file:')}/prompts.txt"

    def generator():
        def model(prompts):
            with open(seen, "a") as out:
                out.writelines(p + "\n#\n" for p in prompts)
            return ["First is so. Second is not." for _ in prompts]

        return model

    raw = '{"claims":[{"text":" First is so. ","label":"Supported"},{"text":"Second is not.","label":"UNSUPPORTED"},{"text":"Odd.","label":"what"}],"overall":"unsupported"}'
    answered(q, generator, lambda: lambda prompts: [raw for _ in prompts], regenerate=True).collect()
    retry = open(seen).read().split("\n#\n")[1]
    assert "- Second is not." in retry and "- Odd." in retry and "First is so." not in retry


def test_encoders(spark):
    made = models.Encoder("two", lambda: lambda texts: [[float(len(t))] for t in texts], lambda: lambda texts: [[-float(len(t))] for t in texts])
    assert models.encoder_of(" Two ", {"two": made}) is made
    with pytest.raises(ValueError):
        models.encoder_of("three", {"two": made})
    df = spark.createDataFrame([("abc",)], "t string")
    assert [made.encoded(df, "t", "v", as_queries=q).first().v for q in (False, True)] == [[3.0], [-3.0]]


def test_tracks_and_plans(spark):
    q = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (4, None), (5, "")], "id int, track string")
    assert sorted(r.id for r in readers.on_tracks(q, " A,b").collect()) == [1, 2]
    runs = spark.createDataFrame([("x", 1, "o1"), ("y", 1, "o2"), ("z", 2, "o3")], "label string, phase int, output string")
    done = spark.createDataFrame([("o1",), ("o1",)], "output string")
    status = lambda **k: {r.label: r.status for r in readers.planned(runs, done, [1], **k).collect()}
    assert status() == {"x": "skip", "y": "run"}
    assert status(force=True) == {"x": "run", "y": "run"}
    assert status(dry_run=True) == {"x": "skip", "y": "dry"}


def test_result_documents(spark, tmp_path):
    examples = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, score double")
    readers.write_result(examples, examples.agg(F.avg("score").alias("mean")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/per_example").count() == 2
    assert spark.read.json(f"{tmp_path}/r/aggregate").first()["mean"] == pytest.approx(0.6)
