"""Fixity audit of replicated WARC archives with Merkle trees.

Records are laid out in archives by offset. Two kinds of leaves make a tree for each archive:
the digest of every record, and over ordered runs of FANOUT neighbours the digest of their
offsets, lengths and digests, then runs of runs up to one root. Replicas are compared root
by root; below a root that differs only the children of differing nodes are looked at, so
an audit of sound replicas reads one row for each archive and a damaged record costs
FANOUT rows a level.

All of it is DataFrame functions. A node is made from its FANOUT children by a grouped sum,
so no task ever holds an archive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import settle

FANOUT = 16
#: Records in an archive; sets the number of levels of its tree.
ARCHIVE = 1024
#: Archives of records without an id are numbered down from here; 2^20 of them at most.
NAMELESS = -(1 << 62)


def warc_record(identity: Column, url: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record (binary): header, blank line, payload, two line ends."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(identity.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archived(df: DataFrame, id_col: str, record: Column, archive_records: int = ARCHIVE) -> DataFrame:
    """(archive, place, id, offset, length, digest) of every row; the bytes stay where they are.

    An archive holds the ids of one run of archive_records numbers, in order; a record's
    place in it is its id's, so a lost record leaves its place empty and moves the offsets
    of what follows, and nothing else. Rows that repeat an id share a place: their records
    follow each other in the order of their digests. Rows without an id lie in archives of
    their own, below all others, by the first bits of their digests.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), record.alias("record"))
    rows = rows.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})
    bits = lambda start: F.conv(F.substring("digest", start, 5), 16, 10).cast("long")
    named = F.col("id").isNotNull()
    rows = rows.withColumns({
        "archive": F.when(named, F.floor(F.col("id") / archive_records).cast("long")).otherwise(F.lit(NAMELESS) - bits(1)),
        "place": F.when(named, F.pmod("id", F.lit(archive_records))).otherwise(F.pmod(bits(6), F.lit(archive_records))).cast("int"),
    })
    order = Window.partitionBy("archive").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", "place", "id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "digest")


def tree(records: DataFrame, archive_records: int = ARCHIVE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (archive, node, digest, length) from the leaves, one for each place, to the roots.

    A node's digest covers its children's digests and byte lengths in order, that is the
    offset range of each child inside the node's own range. Ranges are relative, so a record
    that changed its length disturbs the nodes above it and no others.
    """

    def joined(rows: DataFrame, node: Column, order: str) -> DataFrame:
        entry = F.concat_ws(":", F.col("length").cast("string"), F.col("digest")).alias("entry")
        rows = rows.select("archive", node.alias("node"), "length", F.struct(F.col(order), entry).alias("child"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["entry"]), "\n")
        return rows.groupBy("archive", "node").agg(F.sha2(text, 256).alias("digest"), F.sum("length").alias("length"))

    levels = [settle(joined(records, F.col("place"), "offset"))]
    width = archive_records
    while width > 1:
        width = -(-width // fanout)
        levels.append(settle(joined(levels[-1], F.floor(F.col("node") / fanout).cast("int"), "node")))
    return levels


def differing(one: Sequence[DataFrame], other: Sequence[DataFrame], fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """(archive, node) of the leaves that differ, and how many nodes differed on each level from the roots down."""
    found, seen = None, []
    for a, b in zip(reversed(one), reversed(other), strict=True):
        if found is not None:
            up = found.select("archive", F.col("node").alias("up"))
            a, b = (x.join(up, (x["archive"] == up["archive"]) & (F.floor(x["node"] / fanout) == up["up"]), "left_semi") for x in (a, b))
        a = a.select("archive", "node", F.struct("digest", "length").alias("mine"))
        b = b.select("archive", "node", F.struct("digest", "length").alias("theirs"))
        found = settle(a.join(b, ["archive", "node"], "full").where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("archive", "node"))
        seen.append(found.count())
    return found, seen


def audit(one: DataFrame, other: DataFrame, archive_records: int = ARCHIVE, fanout: int = FANOUT) -> DataFrame:
    """(archive, id, offset, length, digest, other_digest, status) of all records of both replicas.

    one, other: frames of `archived`. status: sound, corrupt, missing (not in the other) or
    extra (only there). Records whose leaf agrees are sound without being compared. offset,
    length and digest are the first replica's where it has the record. Records without an id
    are told apart by their digests, so one that was altered is missing and extra. Empty
    replicas are fine.
    """
    one, other = settle(one), settle(other)
    leaves, _ = differing(tree(one, archive_records, fanout), tree(other, archive_records, fanout), fanout)
    odd = leaves.select("archive", F.col("node").alias("place"))
    keys = ["archive", "place", "name", "turn"]

    def turn(x: DataFrame) -> DataFrame:
        x = x.join(odd, ["archive", "place"], "left_semi").withColumn("name", F.coalesce(F.col("id").cast("string"), "digest"))
        return x.withColumn("turn", F.row_number().over(Window.partitionBy("archive", "place", "name").orderBy("digest")))

    a = turn(one).select(*keys, "id", "offset", "length", "digest")
    b = turn(other).select(*keys, F.col("id").alias("i"), F.col("offset").alias("o"), F.col("length").alias("l"), F.col("digest").alias("other_digest"))
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("other_digest"), "corrupt").otherwise("sound")
    damaged = a.join(b, keys, "full").select("archive", F.coalesce("id", "i").alias("id"), F.coalesce("offset", "o").alias("offset"), F.coalesce("length", "l").alias("length"), "digest", "other_digest", status.alias("status"))
    sound = one.join(odd, ["archive", "place"], "left_anti").select("archive", "id", "offset", "length", "digest", F.col("digest").alias("other_digest"), F.lit("sound").alias("status"))
    return sound.unionByName(damaged)


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for the registered query: some records altered, some lost, some added."""
    letter = F.concat(F.lit("?"), F.substring("html", 2, F.length("html")))
    kept = pages.where("page_id IS NULL OR page_id % 389 <> 7").withColumn("html", F.when(F.col("page_id") % 97 == 5, letter).otherwise(F.col("html")))
    more = pages.where("page_id % 1009 = 11").withColumn("page_id", F.col("page_id") + 10_000_019)
    return kept.unionByName(more)


def op9_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    found = audit(archived(pages, "page_id", record), archived(damaged_copy(pages), "page_id", record))
    return found.select(F.col("id").alias("page_id"), "archive", "offset", "length", "digest", "other_digest", "status")


#: Offsets, digests and statuses follow from the records alone; the trees only save comparisons.
OP9_SQL = r"""
WITH replica AS (
  SELECT 1 AS side, page_id, url, html FROM pages
  UNION ALL
  SELECT 2, page_id, url, CASE WHEN page_id % 97 = 5 THEN '?' || substr(html, 2) ELSE html END FROM pages WHERE page_id IS NULL OR page_id % 389 <> 7
  UNION ALL
  SELECT 2, page_id + 10000019, url, html FROM pages WHERE page_id % 1009 = 11
), record AS (
  SELECT side, page_id,
         encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS bytes
  FROM replica
), digested AS (
  SELECT side, page_id, octet_length(bytes) AS length, sha256(bytes) AS digest FROM record
), laid AS (
  SELECT *, coalesce(page_id // 1024, -4611686018427387904 - ('0x' || substr(digest, 1, 5))::BIGINT) AS archive,
         coalesce(page_id % 1024, ('0x' || substr(digest, 6, 5))::BIGINT % 1024) AS place, coalesce(page_id::VARCHAR, digest) AS name FROM digested
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, name ORDER BY digest) AS turn,
         CAST(coalesce(sum(length) OVER (PARTITION BY side, archive ORDER BY place, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM laid
), a AS (SELECT * FROM placed WHERE side = 1), b AS (SELECT * FROM placed WHERE side = 2)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset",
       coalesce(a.length, b.length) AS length, a.digest AS digest, b.digest AS other_digest,
       CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt' ELSE 'sound' END AS status
FROM a FULL JOIN b ON a.name = b.name AND a.turn = b.turn
"""
