"""Vectors of texts from a model that each Python worker loads once and calls batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: From texts to an array of (texts, dims).
Model = Callable[[Sequence[str]], np.ndarray]


def embedder(load: Callable[[], Model], *, dims: int = 768, batch_size: int = 32, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``vector``, of length 1, to rows; it fits ``embed_distinct``.

    ``load`` runs in a Python worker, once, and returns the model, which then gets at most ``batch_size`` texts a call. Null and empty texts have an empty vector, and a
    text for which the model gives zeros has zeros. A model with other than ``dims`` columns raises an error.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(model(list(texts)), dtype=np.float64)
            if out.shape != (len(texts), dims):
                raise ValueError(f"the model gave {out.shape} for {len(texts)} texts of {dims} dimensions")
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

        return predict

    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
    given = F.coalesce(F.col(text), F.lit(""))
    return lambda rows: rows.withColumn("vector", F.when(given == "", F.array().cast("array<float>")).otherwise(run(given)))


def letter_model(dims: int) -> Callable[[], Model]:
    """A small fixed model for tests of the way there: counts of a to z times a matrix of whole numbers from -2 to 2."""

    def load() -> Model:
        weights = (np.arange(26)[:, None] * 7 + np.arange(dims)[None] * 3) % 5 - 2
        return lambda texts: np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[97:123] for t in texts]) @ weights

    return load
