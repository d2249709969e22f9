"""Tables in the folder that the cluster shares, and the stored retrieval index."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the stored index's layout.
INDEX_VERSION = 1
#: Folders of the shared folder in which tables lie that were written to be read again.
WRITTEN = ("settled", "tables")
#: Spark's setting for shuffle files that nothing reads after their query.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLES = ("chunks", "vectors", "postings", "term_stats", "corpus_stats")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets a local one, on a cluster that is an error."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathomline-"))
    return context.getCheckpointDir().get()


def settle(df: DataFrame, **options: str) -> DataFrame:
    """df, written to the shared folder (with options of the writer) and read again: a cut lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(settled: DataFrame) -> None:
    """Delete a table in the shared folder that nothing reads any more, such as the last round's of a loop."""
    spark = settled.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        if folder.split("/")[-2] in WRITTEN:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run meanwhile go when it ends, and not when the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def save_index(tables: dict[str, DataFrame], path: str, encoder: str, **more: str) -> None:
    """Write the index tables and a one-row manifest; more keys cannot override its own."""
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    manifest(tables, encoder, **more).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(tables: dict[str, DataFrame], encoder: str, **more: str) -> DataFrame:
    """version, encoder, n_chunks and embed_dim of an index, with further keys as text."""
    fixed = {"version": F.lit(INDEX_VERSION), "encoder": F.lit(encoder)}
    extra = {k: F.lit(v) for k, v in more.items() if k not in {*fixed, "n_chunks", "embed_dim"}}
    dims = tables["vectors"].agg(F.max(F.size("vec")).alias("embed_dim"))
    return tables["chunks"].agg(F.count("*").alias("n_chunks")).crossJoin(F.broadcast(dims)).withColumns(fixed | extra)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether all tables and the manifest are there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")) for name in (*TABLES, "manifest"))


def load_index(spark: SparkSession, path: str, encoder: str | None = None) -> dict[str, DataFrame]:
    """The stored tables; another layout version or another encoder than asked for is an error."""
    row = spark.read.parquet(f"{path}/manifest").first()
    if row.version != INDEX_VERSION:
        raise ValueError(f"index version {row.version}, expected {INDEX_VERSION}")
    if encoder is not None and row.encoder != encoder:
        raise ValueError(f"index was built with encoder {row.encoder}, not {encoder}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def load_or_build(spark: SparkSession, path: str, build: Callable[[], dict[str, DataFrame]], encoder: str, rebuild: bool = False, **more: str) -> dict[str, DataFrame]:
    """The stored index, or the one that build() makes, which is stored first; one without chunks is an error."""
    if rebuild or not index_exists(spark, path):
        tables = build()
        if tables["chunks"].isEmpty():
            raise RuntimeError("no chunks to index")
        save_index(tables, path, encoder, **more)
    return load_index(spark, path, encoder)


def append_chunks(path: str, more: dict[str, DataFrame]) -> None:
    """Add chunks, vectors and postings to a stored index; the statistics follow with `refresh`."""
    for name in ("chunks", "vectors", "postings"):
        more[name].write.mode("append").parquet(f"{path}/{name}")


def refresh(spark: SparkSession, path: str) -> None:
    """Statistics and manifest of a stored index anew, from its chunks and postings."""
    from fathomline.operators.search import term_stats

    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "postings")}
    n = tables["chunks"].agg(F.count("*").alias("n"))
    stats = settle(n.crossJoin(F.broadcast(tables["postings"].agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")))).select("n", (F.col("t") / F.col("n")).alias("avgdl")))
    stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
    term_stats(tables["postings"], stats).write.mode("overwrite").parquet(f"{path}/term_stats")
    old = spark.read.parquet(f"{path}/manifest").first().asDict()
    more = {k: v for k, v in old.items() if k not in ("version", "encoder", "n_chunks", "embed_dim")}
    settle(manifest(tables, old["encoder"], **more)).write.mode("overwrite").parquet(f"{path}/manifest")
