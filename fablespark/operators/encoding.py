"""Vectors of texts from an encoder that takes a few texts at a time.

Only rows without a vector are encoded, so a run that was cut short goes on where its
last written table ends. The encoder is a callable from texts to rows of numbers; a task sends
it at most ``BATCH_TEXTS`` texts and, a single long text aside, ``BATCH_TOKENS`` white-space tokens at
once, shortest texts of an Arrow batch first, so that a batch holds texts of like
length. Vectors come back with unit length.

Cases: a null text is encoded as an empty one; a vector of zeros, or with a number that
is not finite, stays zeros; rows that have a vector keep it; repeated rows each get one;
an encoder that returns another number of rows is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_TEXTS, BATCH_TOKENS = 16, 16_384

Encoder = Callable[[list[str]], np.ndarray]


def batches_of(texts: list[str], most_texts: int = BATCH_TEXTS, most_tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Places of the texts, batch by batch."""
    sizes = [len(t.split()) for t in texts]
    held, tokens = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (sizes[i], i)):
        if held and (len(held) == most_texts or tokens + sizes[i] > most_tokens):
            yield held
            held, tokens = [], 0
        held.append(i)
        tokens += sizes[i]
    if held:
        yield held


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    rows = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def encode_missing(chunks: DataFrame, encoder: Encoder, text: str = "text", vector: str = "embedding", most_texts: int = BATCH_TEXTS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``chunks`` with a ``vector`` (array<double>) in every row; those that have one are not encoded again."""
    if vector not in chunks.columns:
        chunks = chunks.withColumn(vector, F.lit(None).cast("array<double>"))
    rest = [c for c in chunks.columns if c != vector]
    kinds = dict(chunks.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(b.num_columns - 1)]
            found: list[list[float]] = [[]] * len(texts)
            for places in batches_of(texts, most_texts, most_tokens):
                rows = unit_rows(encoder([texts[i] for i in places]))
                if len(rows) != len(places):
                    raise ValueError(f"the encoder returned {len(rows)} vectors for {len(places)} texts")
                for i, row in zip(places, rows.tolist(), strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*rest, vector])

    todo = chunks.filter(F.col(f"`{vector}`").isNull()).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("t"))
    made = todo.mapInArrow(work, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{vector}` array<double>"]))
    return chunks.filter(F.col(f"`{vector}`").isNotNull()).select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{vector}`").cast("array<double>").alias(vector)).unionByName(made)
