"""A stored inverted index of the shingle sets that a stream has kept.

    base=<n>/known        shingles that repeat most, which fixes the order of prefixes
    base=<n>/prefix, sets everything kept before batch n, merged
    batch=<n>/prefix, sets what batch n kept
    done/<name>           an empty file for each folder above that is whole

prefix holds (s, k, n, place) in folders by bucket of the shingle s, sets holds (k, set) in
folders by bucket of the set's key k. A batch finds its folders with one listing of done,
reads the buckets of its own prefix shingles, and of sets the buckets of the keys it met.
Every MERGE batches all is merged into a new base, with the order made anew, so neither the
listing nor the files of a bucket grow with the stream. Base and batch folders are written
whole before their file in done, and again in the same way if they were not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import dedup
from fathomline.sources.store import forget, settle

#: Folders of prefix and sets, and batches between two merges.
BUCKETS, MERGE = 256, 16
SHAPES = {"prefix": "s bigint, k bigint, n int, place int, bucket int", "sets": "k bigint, set array<bigint>, bucket int"}


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(buckets)).cast("int")


class KeptIndex:
    """The index under a path, as one batch sees it; open first, then repeats, then add."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, buckets: int = BUCKETS, merge: int = MERGE):
        self.spark, self.path, self.threshold, self.buckets, self.merge = spark, path, threshold, buckets, merge

    def _done(self) -> set[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()

    def _finish(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        file = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/{name}")
        file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(file, True).close()

    def open(self, batch: int, sigs: DataFrame) -> None:
        """See what the batches before this one have kept; merge it first if it is time. sigs: (set) of this batch."""
        self.batch = batch
        done = self._done()
        bases = [int(x[5:]) for x in done if x.startswith("base=") and int(x[5:]) <= batch]
        self.base = max(bases, default=0)
        self.batches = sorted(int(x[6:]) for x in done if x.startswith("batch=") and self.base <= int(x[6:]) < batch)
        if not bases:
            self._write_base(0, sigs.select("set").where(F.size("set") > 0), stored=False)
        elif len(self.batches) >= self.merge:
            self._write_base(batch, self.read("sets").select("set"), stored=True)

    def _write_base(self, number: int, sets: DataFrame, stored: bool) -> None:
        """A base in the order that these sets give; stored says that it holds them, too."""
        known = dedup.most_repeated(dedup.repeated(sets), dedup.KNOWN_SHINGLES)
        self.spark.createDataFrame(known).write.mode("overwrite").parquet(f"{self.path}/base={number}/known")
        self.base, self.batches = number, []
        self._write(f"base={number}", sets if stored else sets.limit(0))
        self._finish(f"base={number}")

    def _write(self, name: str, sets: DataFrame) -> None:
        keyed = settle(sets.select(F.xxhash64("set").alias("k"), "set"))
        prefix = self._prefixes(keyed.select(F.col("k").alias("id"), "set")).withColumnRenamed("id", "k")
        for table, rows, key in (("prefix", prefix.select("s", "k", "n", "place"), "s"), ("sets", keyed, "k")):
            placed = rows.withColumn("bucket", bucket_of(key, self.buckets))
            placed.repartition("bucket").sortWithinPartitions("bucket", *rows.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/{table}")
        forget(keyed)

    def _prefixes(self, reps: DataFrame) -> DataFrame:
        known = self.spark.read.schema("s bigint, n bigint").parquet(f"{self.path}/base={self.base}/known").toArrow()  # at most KNOWN_SHINGLES rows
        return dedup.prefixes(reps, self.threshold, known)

    def read(self, table: str) -> DataFrame:
        """All rows of prefix or sets that this batch sees, with bucket."""
        folders = [f"base={self.base}", *(f"batch={i}" for i in self.batches)]
        parts = [self.spark.read.schema(SHAPES[table]).parquet(f"{self.path}/{name}/{table}") for name in folders]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _of(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of a table in the buckets of these keys."""
        found = [r.bucket for r in keys.select(bucket_of(key, self.buckets).alias("bucket")).distinct().collect()]  # at most `buckets` rows
        return self.read(table).where(F.col("bucket").isin(found)).drop("bucket")

    def repeats(self, sigs: DataFrame) -> DataFrame:
        """(ord) of those of (ord, set) that are as similar as the threshold to a kept set."""
        sized = sigs.where(F.size("set") > 0)
        mine = settle(self._prefixes(sized.select(F.col("ord").alias("id"), "set")))
        met = dedup.meeting(mine.alias("x"), self._of("prefix", mine, "s").alias("y"), self.threshold)
        pairs = settle(met.select(F.col("x.id").alias("ord"), F.col("y.k").alias("k")).distinct())
        both = pairs.join(sized, "ord").join(self._of("sets", pairs, "k").withColumnRenamed("set", "other"), "k")
        shared = F.size(F.array_intersect("set", "other"))
        return both.where(shared / (F.size("set") + F.size("other") - shared) >= self.threshold).select("ord").distinct()

    def add(self, sets: DataFrame) -> None:
        """Store what this batch has kept."""
        self._write(f"batch={self.batch}", sets.where(F.size("set") > 0))
        self._finish(f"batch={self.batch}")
