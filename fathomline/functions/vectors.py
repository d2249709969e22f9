"""Vectors as arrays of doubles, and a deterministic stand-in for a text encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.text import let, terms


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a at length 1; the zero vector stays."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def pooled(vectors: Column, mask: Column) -> Column:
    """Masked mean over token vectors (array of arrays); an all-zero mask gives a division by 1e-9."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(kept, F.transform(F.get(vectors, F.lit(0)), lambda x: x * 0.0), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / weight)


def first_token(vectors: Column) -> Column:
    """The vector of the first token, for encoders that pool there."""
    return F.get(vectors, F.lit(0))


def portable_hash(text: Column) -> Column:
    """The first 32 bits of MD5 as an integer; the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def stand_in_vector(text: Column, dims: int = 16) -> Column:
    """A unit vector of hashed, signed term counts. It stands in for a neural encoder in tests and is not one."""

    def part(hashed: Column, d: Column) -> Column:
        mine = F.filter(hashed, lambda h: h % dims == d)
        return F.aggregate(mine, F.lit(0.0), lambda s, h: s + F.when((F.floor(h / dims) % 2) == 0, 1.0).otherwise(-1.0))

    each = F.sequence(F.lit(0), F.lit(dims - 1))
    return unit(let(F.transform(terms(text), portable_hash), lambda hashed: F.transform(each, lambda d: part(hashed, d))))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what is worked out for each term of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _stand_in(listed: pa.Array, dims: int) -> pa.Array:
    """stand_in_vector of rows of terms; each distinct term is hashed once."""
    sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
    words = listed.flatten().dictionary_encode()
    hashed = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4]) for t in words.dictionary.to_pylist()], np.int64)
    place, sign = hashed % dims, np.where(hashed // dims % 2 == 0, 1.0, -1.0)
    code, row = words.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    sums = np.bincount(row * dims + place[code], weights=sign[code], minlength=len(sizes) * dims).reshape(-1, dims).astype(np.float64)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))  # whole numbers: exact in any order
    return pa.FixedSizeListArray.from_arrays(pa.array((sums / np.where(length > 0, length, 1.0)).ravel()), dims).cast(pa.list_(pa.float64()))


def with_stand_in(rows: DataFrame, text_col: str, name: str, dims: int = 16) -> DataFrame:
    """rows with stand_in_vector of a text under `name`, made a batch at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.record_batch([*batch.columns[:-1], _stand_in(batch.columns[-1], dims)], [*batch.schema.names[:-1], name])

    shape = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return rows.withColumn("__terms", terms(F.col(text_col))).mapInArrow(made, shape)
