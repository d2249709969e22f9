"""Near-duplicate groups by HyperMinHash.

A document's shingle hashes fall into REGISTERS buckets; each register keeps the smallest
hash of its bucket in compressed form, its count of leading zeros beside MANTISSA bits after
the first one. Bands of registers are the join keys; candidates pass a Jaccard estimate from
their registers, corrected for registers that agree by chance; links are confirmed on the
full shingle sets.

Two ideas keep hot buckets linear. Documents with one and the same set are one class, and a
bucket first links every member only to its smallest member. Members of a bucket that are
still in different components are then all compared: as rows of pairs, if those are few, and
else in numpy blocks without a row for each pair, first on their registers
and then, where those are alike, on their full sets. One meeting is enough in any bucket.

Bands are few and wide for small sets and many for large ones: below a size at which the
possible differences of a linked pair cannot touch all bands, one of them is untouched. It may
be empty, so small sets are banded over several shuffles of the registers. Bands and shuffles
follow from the threshold: a linked pair has no band in common with a chance under MISSED.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import byte_runs, mix, settle, shingle_sets
from fathomline.llm.components import components

REGISTERS, BUCKET_BITS, MANTISSA, HASH_BITS = 256, 8, 10, 53
EMPTY = np.uint16(0xFFFF)
#: Rows of pairs beyond which a bucket is crowded; members whose registers, and members and
#: columns whose sets, are compared at once.
FEW, SIEVE, BLOCK, COLUMNS = 64, 2048, 512, 4096
#: Most chance that the keys of a linked pair have none in common.
MISSED = 0.0005


@dataclass(frozen=True)
class Likeness:
    """Link two sets if num * union <= den * intersection, over shingles of `words` words."""

    words: int = 5
    num: int = 80
    den: int = 100


def registers(ascending: np.ndarray) -> np.ndarray:
    """Compressed registers of one set of ascending 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY)
    if len(ascending):
        bucket = (ascending >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        least = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rest = (ascending[least] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - HASH_BITS)
        fraction, exponent = np.frexp(rest.astype(np.float64))
        zeros = HASH_BITS - exponent
        mantissa = np.where(rest > 0, (fraction - 0.5) * (2 << MANTISSA), 0).astype(np.int64)
        out[bucket[least]] = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    return out


def large_bands(like: Likeness) -> int:
    """Bands of the largest sets: as few and wide as leave a linked pair without a common one with a chance under MISSED."""
    for width in range(REGISTERS, 1, -1):
        if (1 - (like.num / like.den) ** width) ** (REGISTERS // width) <= MISSED:
            return REGISTERS // width
    return REGISTERS


def levels(like: Likeness) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, bands) of each level of set sizes; the last has no largest.

    With sizes up to s, a linked pair's union is at most s * den / num, and the elements in
    one set only are at most (1 - num / den) of it; that many bands and one more suffice.
    """
    out, low, bands = [], 1, 1
    while bands < large_bands(like):
        high = low - 1
        while (like.den - like.num) * ((high + 1) * like.den // like.num) // like.den < bands:
            high += 1
        if high >= low:
            out.append((low, high, bands))
            low = high + 1
        bands *= 2
    return [*out, (low, 1 << 62, large_bands(like))]


@cache
def shuffles(like: Likeness) -> list[int]:
    """For each level the shuffles of the registers that leave a chance under MISSED.

    A linked pair is missed where all its common elements fall into bands that its others
    touch. The last level has enough bands, and at one band linked sets are equal.
    """
    out = []
    for low, high, bands in levels(like)[:-1]:
        touched, worst = [np.eye(1, bands + 1)[0]], 0.0  # chances that d elements touch 0, 1, ... bands
        for size in range(low, high + 1):
            for both in range(size, 0, -1):
                union = both * like.den // like.num
                if union + both < 2 * size:  # the other set would be the smaller one
                    break
                while len(touched) <= union - both:
                    t = touched[-1] * np.arange(bands + 1) / bands
                    t[1:] += touched[-1][:-1] * (bands - np.arange(bands)) / bands
                    touched.append(t)
                worst = max(worst, float(touched[union - both] @ (np.arange(bands + 1) / bands) ** both))
        out.append(1 if worst <= MISSED else int(np.ceil(np.log(MISSED) / np.log(worst))))
    return [*out, 1]


def band_keys(table: np.ndarray, sizes: np.ndarray, like: Likeness) -> list[np.ndarray]:
    """Join keys of each row of registers: the bands of every level at which a linked pair can meet.

    A pair meets at the level of its smaller set, so a set stands at its own level and at
    those down to the smallest size it can be linked with.
    """
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    places = [(level, turn, *of) for level, of in enumerate(levels(like)) for turn in range(shuffles(like)[level])]
    for level, turn, low, high, bands in places:
        rows = np.flatnonzero((sizes >= low) & (sizes * like.num <= high * like.den) if high < 1 << 61 else sizes >= low)
        if not len(rows):
            continue
        order = np.random.default_rng(turn).permutation(REGISTERS) if turn else np.arange(REGISTERS)
        width = REGISTERS // bands
        part = table[rows][:, order[: bands * width]].reshape(len(rows), bands, width)
        padded = np.zeros((len(rows), bands, -(-width // 4) * 4), np.uint16)
        padded[:, :, :width] = part
        words = padded.view(np.uint64)
        key = mix(np.arange(bands, dtype=np.uint64) + np.uint64((turn * 16 + level) * REGISTERS + 1))[None, :].repeat(len(rows), 0)
        for w in range(words.shape[2]):
            key = mix(key ^ words[:, :, w]) + np.uint64(w)
        full = ~(part == EMPTY).all(axis=2)
        for i, row in enumerate(rows):
            out[row].append(key[i][full[i]])
    return [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in out]


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected registers that agree by chance in the sketches of unrelated sets of n and m elements.

    The least hash of a bucket has z leading zeros with the probability that it lies between
    2^-(z+1) and 2^-z; inside that range its mantissa is close to uniform.
    """
    return REGISTERS * (_zeros(n) * _zeros(m)).sum(axis=1) / (1 << MANTISSA)


def _zeros(s: np.ndarray) -> np.ndarray:
    """For each set size the chances of 0, 1, ... leading zeros in the least hash of a bucket."""
    z = np.arange(HASH_BITS)[None, :]
    return (1 - 2.0 ** -(z + 1) / REGISTERS) ** s[:, None] - (1 - 2.0**-z / REGISTERS) ** s[:, None]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of register rows, and the registers that each rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return (same - chance_equal(n.astype(float), m.astype(float))) / np.maximum(used, 1), used


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, like: Likeness) -> np.ndarray:
    """Which of all rows of a are likely links of which of all rows of b, by size and estimate, as in _likely()."""
    same = np.zeros((len(a), len(b)), np.int16)
    other = np.where(b == EMPTY, EMPTY - np.uint16(1), b).T.copy()
    for low in range(0, len(a), 128):
        for half in (0, REGISTERS // 2):  # so that the bytes can't run over
            count = np.zeros(same[low : low + 128].shape, np.uint8)
            for r in range(half, half + REGISTERS // 2):
                count += (a[low : low + 128, r, None] == other[None, r]).view(np.uint8)
            same[low : low + 128] += count
    used = np.maximum(REGISTERS - (a == EMPTY).astype(np.float32) @ (b == EMPTY).astype(np.float32).T, 1)
    chance = REGISTERS * (_zeros(n.astype(float)) @ _zeros(m.astype(float)).T) / (1 << MANTISSA)
    least = like.num / like.den
    sized = (n[:, None] * like.den >= m[None] * like.num) & (m[None] * like.den >= n[:, None] * like.num)
    return sized & ((same - chance) / used >= least - 5 * np.sqrt(least * (1 - least) / used))


def sketched(df: DataFrame, id_col: str, text_col: str, like: Likeness) -> DataFrame:
    """id, n (set size), h1 and h2 (digest of the set), sig (registers), keys (bands) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(1))):
            sets = shingle_sets(batch.column(1), like.words)
            sizes = np.array([len(s) for s in sets], np.int64)
            table = np.stack([registers(s) for s in sets]) if sets else np.zeros((0, REGISTERS), np.uint16)
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            keys = band_keys(table, sizes, like)
            sig = pa.array([r.tobytes() for r in table], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), sig, pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "sig", "keys"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sketch, f"id {kind}, n long, h1 long, h2 long, sig binary, keys array<long>")


def _likely(pairs: DataFrame, sigs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs whose corrected estimate is not five standard errors under the threshold."""
    least = like.num / like.den

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb")]
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            close, used = estimate(*rows, n, m)
            keep = close >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: sigs.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(sieve, pairs.select("a", "b").schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs whose full shingle sets are alike enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column("tb"))):
            keep, last, one = [], None, None
            others = shingle_sets(batch.column("tb"), like.words)
            for i, other in enumerate(others):
                if (a := batch.column("a")[i]) != last:
                    last, one = a, shingle_sets(batch.column("ta").slice(i, 1), like.words)[0]
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both * like.den >= like.num * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(confirm, pairs.select("a", "b").schema)


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y."""
    column = np.unique(np.concatenate([*x, *y]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        held[row[part], column[part] - low] = 1
        total += held[: len(x)] @ held[len(x) :].T
    return total.astype(np.int64)


CELL = ("kind", "key", "bx", "by")


def _within(rows: DataFrame) -> DataFrame:
    """Cells (CELL, side, id, component) in which all rows (key, id, component) of a key meet each other once, SIEVE by SIEVE.

    side: 0 and 1 for the rows of the two blocks of a cell, 2 for those of a block with itself.
    """
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / SIEVE).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    each = rows.join(blocks, "key").select("key", "id", "component", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    return each.select(F.lit(0).alias("kind"), "key", F.least("b", "o").alias("bx"), F.greatest("b", "o").alias("by"), side.alias("side"), "id", "component")


def _across(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cells in which all rows of x meet all rows of y (both key, id, component) of their key."""
    blocks = lambda side, name: side.groupBy("key").agg(F.ceil(F.count("*") / SIEVE).cast("int").alias(name))
    cells = blocks(x, "nx").join(blocks(y, "ny"), "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = lambda rows, bx, by, side: rows.join(cells, "key").select(F.lit(1).alias("kind"), "key", bx.alias("bx"), by.alias("by"), F.lit(side).alias("side"), "id", "component")
    return placed(x, own("nx"), over("ny"), 0).union(placed(y, over("nx"), own("ny"), 1))


def _linked_in_cells(cells: DataFrame, sigs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between the rows of each cell that are in different components.

    All rows of a cell are compared on their registers inside a task. Those that may have a
    link are compared on their full sets, BLOCK by BLOCK; of the links of an id to one
    component the first is returned.
    """
    finer = [*CELL, "ix", "iy"]

    def halves(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
        side = t.column("side").to_numpy()
        return t.filter(pa.array(side != 1)), t.filter(pa.array(side != 0)), bool((side == 2).all())

    def apart(x: pa.Table, y: pa.Table, same: bool) -> np.ndarray:
        parts = [t.column("component").to_numpy() for t in (x, y)]
        return np.triu(parts[0][:, None] != parts[1][None], 1) if same else parts[0][:, None] != parts[1][None]

    def sieve(t: pa.Table) -> pa.Table:
        x, y, same = halves(t)
        out = []
        if len(x) and len(y):
            rows = [np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS) for t in (x, y)]
            close = alike(*rows, *(t.column("n").to_numpy() for t in (x, y)), like) & apart(x, y, same)
            for i in range(0, len(x), BLOCK):
                for j in range(i if same else 0, len(y), BLOCK):
                    some = close[i : i + BLOCK, j : j + BLOCK]
                    left, right = some.any(axis=1), some.any(axis=0)
                    for side, t, at in ((2, x, i + np.flatnonzero(left | right)),) if same and i == j else ((0, x, i + np.flatnonzero(left)), (1, y, j + np.flatnonzero(right))):
                        place = [pa.array(np.full(len(at), v, np.int32)) for v in (i, j, side)]
                        out.append(pa.table([*(t.column(c).take(pa.array(at)) for c in CELL), *place, *(t.column(c).take(pa.array(at)) for c in ("id", "component"))], shape.names))
        return pa.concat_tables([shape.empty_table(), *out])

    kinds = {"kind": pa.int32(), "key": pa.int64(), "id": pa.int64(), "component": pa.int64()}
    shape = pa.schema([(c, kinds.get(c, pa.int32())) for c in (*finer, "side", "id", "component")])

    def compare(t: pa.Table) -> pa.Table:
        x, y, same = halves(t)
        sets = [shingle_sets(t.column("text").combine_chunks(), like.words) for t in (x, y)]
        n, m = (np.array([len(s) for s in side], np.int64) for side in sets)
        both = _shared_counts(*sets)
        i, j = np.nonzero((both * like.den >= like.num * (n[:, None] + m[None, :] - both)) & apart(x, y, same))
        parts = y.column("component").to_numpy()
        first = np.unique(np.stack([i, np.unique(parts, return_inverse=True)[1][j]]), axis=1, return_index=True)[1] if len(i) else []
        pair = np.stack([x.column("id").to_numpy()[i[first]], y.column("id").to_numpy()[j[first]]]) if len(i) else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(pair.min(axis=0)), pa.array(pair.max(axis=0))], ["a", "b"])

    long = ("key", "id", "component")
    near = cells.join(sigs, "id").groupBy(*CELL).applyInArrow(sieve, ", ".join(f"{c} {'long' if c in long else 'int'}" for c in shape.names))
    return settle(near).join(texts, "id").groupBy(*finer).applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id reachable over links.

    Null and empty texts, and texts of separators only, have no shingles and stand alone.
    Rows with equal shingle sets are linked whatever their texts; rows that share an id are
    one document with several texts; a row without an id joins its class, and its
    component_id is null if nobody there has one. A table without rows or without links is
    fine, other columns are not read, texts are read whole.
    """
    like = like or Likeness()
    table = settle(sketched(df, id_col, text_col, like))
    wordy = table.where("n > 0")
    classes = wordy.groupBy("h1", "h2").agg(F.min("id").alias("rep")).where("rep is not null")
    reps = wordy.join(classes, ["h1", "h2"]).where("id = rep").select("id", "n", "sig", "keys")

    bands = reps.select("id", "n", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top")
    shared = settle(bands.join(hubs.select("key", "hub"), "key"))
    involved = shared.select("id").distinct()
    sigs = settle(reps.select("id", "n", "sig").join(involved, "id", "left_semi"))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = settle(source.join(involved, "id", "left_semi"))

    def linked(pairs: DataFrame) -> DataFrame:
        return settle(_confirmed(_likely(pairs, sigs, like), texts, like).distinct())

    def pairs_of(x: DataFrame, y: DataFrame, where: Column) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        sized = (F.col("x.n") * like.den >= F.col("y.n") * like.num) & (F.col("y.n") * like.den >= F.col("x.n") * like.num)
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & sized & where)
        return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def opened(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows (key, id, n) of buckets over several components: with component, the bucket's main one and how many pairs have a side outside it."""
        placed = rows.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        parts = placed.groupBy("key", "component").count().groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", "count").alias("main"), ((F.sum("count") - F.max("count")) * F.sum("count")).alias("pairs"))
        return settle(placed.join(parts.where("parts > 1").drop("parts"), "key"))

    def all_pairs(rows: DataFrame) -> DataFrame:
        return pairs_of(rows.where("component <> main"), rows, (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))

    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = linked(stars)
    found = components(links)

    bucket = opened(shared.drop("hub"), found)
    crowded = bucket.where(F.col("pairs") > FEW)
    outside = settle(crowded.where("component <> main").select("key", "id", "component", "main"))
    home = crowded.where("component = main").select(F.col("main").alias("key"), "id", "component").distinct()
    met = outside.select(F.col("main").alias("key"), "id", "component").distinct()
    more = linked(all_pairs(bucket.where(F.col("pairs") <= FEW)))
    if not outside.isEmpty():
        cells = _across(met, home).union(_within(outside.drop("main")))
        more = more.union(settle(_linked_in_cells(cells, sigs, texts, like)))
    if not more.isEmpty():
        found = components(links.union(more))

    whole = table.select("id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    whole = whole.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return whole.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), like=Likeness(words=3, num=85, den=100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, exactly, then the smallest id that labels can carry over their links.
OP1_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hit AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pr AS MATERIALIZED (SELECT a, b FROM hit JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
two AS MATERIALIZED (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
reach(id, low) AS (SELECT DISTINCT a, a FROM two UNION SELECT two.b, reach.low FROM reach JOIN two ON two.a = reach.id AND reach.low < two.b),
lowest AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN sz USING (doc_id) LEFT JOIN lowest ON lowest.id = w.doc_id"""
