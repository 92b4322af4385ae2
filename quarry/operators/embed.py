"""Vectors of texts by a model that each Python worker loads once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry import config as C

#: Texts to vectors, one row each.
Embedder = Callable[[list[str]], np.ndarray]


class Model(Protocol):
    """A model that workers load: ``load`` gives what turns texts into the vectors of their tokens."""

    dimension: int

    def load(self) -> Callable[[list[str]], list[np.ndarray]]: ...


class DimensionError(ValueError):
    """Code 4001: the model gave vectors of another dimension."""


def pooled(tokens: list[np.ndarray], dimension: int) -> np.ndarray:
    """The mean of each text's token vectors, of length one; zeros where there is no token."""
    out = np.zeros((len(tokens), dimension), np.float64)
    for k, own in enumerate(tokens):
        if len(own):
            if own.shape[1] != dimension:
                raise DimensionError(f"4001: vectors of dimension {own.shape[1]}, not {dimension}")
            out[k] = own.mean(axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def loader(embedder: Embedder | Model) -> Callable[[], Embedder]:
    """What a worker runs once to get the function from texts to vectors."""
    if not hasattr(embedder, "load"):
        return lambda: embedder

    def make() -> Embedder:
        tokens = embedder.load()
        return lambda texts: pooled(tokens(texts), embedder.dimension)

    return make


def embed_rows(rows: DataFrame, body: str, embedder: Embedder | Model, batch: int = C.INFER_BATCH) -> DataFrame:
    """``rows`` with ``embedding array<float>`` of the text column ``body``, in batches on the workers. Null texts are
    empty. The model is loaded once a worker, vectors of several dimensions are an error."""
    make = loader(embedder)

    def start():
        embed, seen = make(), []

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(embed([t if isinstance(t, str) else "" for t in texts]), np.float32)
            seen.append(out.shape[1])
            if out.shape[0] != len(texts) or out.shape[1] != seen[0]:
                raise DimensionError(f"4001: vectors of shape {out.shape} for {len(texts)} texts")
            return out

        return predict

    vectors = predict_batch_udf(start, return_type=ArrayType(FloatType()), batch_size=batch)
    return rows.withColumn("embedding", vectors(F.coalesce(body, F.lit(""))))


class WordShapes:
    """A model of words by their shapes, for tests and as an example: length, first letter's code, vowels, one."""

    dimension = 4

    def load(self) -> Callable[[list[str]], list[np.ndarray]]:
        def tokens(texts: list[str]) -> list[np.ndarray]:
            return [np.array([(len(w), ord(w[0]), sum(c in "aeiou" for c in w), 1) for w in t.split()], np.float64).reshape(-1, 4) for t in texts]

        return tokens
