"""Pluggable models: anything that turns a batch of texts into vectors, scores or answers.

A model is a factory that an executor calls once for each Python worker's partition; what
it returns is called with lists. Deterministic stand-ins serve tests; their numbers say
nothing about any model's quality.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomline.sources.store import settle

Model = Callable[[Sequence[str]], Sequence]


def retried(call: Callable[[], object], retries: int = 2, pause: Callable[[float], None] = time.sleep) -> object:
    """The call's value; after an error again up to `retries` times, waiting 1, 2, 4, then 8 seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            pause(min(2**attempt, 8))
    raise AssertionError


def applied(df: DataFrame, text_col: str, out_col: str, kind: T.DataType, factory: Callable[[], Model], batch: int = 32, retries: int = 2) -> DataFrame:
    """df with out_col, the model's value of each text, in batches; written once, so no model is called again later."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for rows in batches:
            texts, values = rows.column(rows.schema.get_field_index(text_col)).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts[i : i + batch]]
                values += retried(lambda part=part: list(model(part)), retries)
            yield rows.append_column(out_col, pa.array(values))

    return settle(df.mapInArrow(run, schema))


@dataclass(frozen=True)
class Encoder:
    """A text encoder: one model for documents and one for queries, which is the same unless the encoder is asymmetric."""

    name: str
    documents: Callable[[], Model]
    queries: Callable[[], Model] | None = None

    def encoded(self, df: DataFrame, text_col: str, out_col: str, as_queries: bool = False, **settings) -> DataFrame:
        """df with out_col: array<double> from the model for documents or for queries."""
        factory = self.queries if as_queries and self.queries is not None else self.documents
        return applied(df, text_col, out_col, T.ArrayType(T.DoubleType()), factory, **settings)


def encoder_of(name: str, registry: Mapping[str, Encoder]) -> Encoder:
    """The registered encoder of that name, in any case and without outer blanks; an unknown one is an error."""
    found = {k.lower(): v for k, v in registry.items()}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown encoder {name}")
    return found


#: Names under which a generator may be asked for, and what they stand for.
ALIASES = {"small": "stand-in:small", "large": "stand-in:large"}


def resolve(name: str) -> str:
    """A registered alias, a full tag (with a colon), or an error."""
    if name in ALIASES:
        return ALIASES[name]
    if ":" in name:
        return name
    raise ValueError(f"unknown model {name}")
