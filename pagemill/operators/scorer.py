"""Pluggable block scorers: batch prediction and gradients in one Arrow pass over texts.

A scorer turns the tokens of a block into embeddings, embeddings into class logits, and gives the gradient of one
class's softmax probability. A factory makes it once in each Python worker, so a large model is loaded lazily and
stays. ``DigestScorer`` is the local stand-in: one dimension, the token's weight from its digest, two classes.

Defined results: null texts and texts without a token have no block; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.rationales import integrated_gradients
from pagemill.operators.tokens import token_forms
from pagemill.runtime import ship

BLOCK = 510


class Scorer(Protocol):
    def embed(self, tokens: list[str]) -> np.ndarray:
        """Embedding lookup: (tokens, dimensions)."""

    def logits(self, embeddings: np.ndarray) -> np.ndarray:
        """Class logits of a batch: (batch, tokens, dimensions) to (batch, classes)."""

    def logit_gradient(self, embeddings: np.ndarray) -> np.ndarray:
        """Gradient of each logit: (batch, tokens, dimensions) to (batch, classes, tokens, dimensions)."""


@lru_cache(200_000)
def _weight(token: str) -> float:
    return int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[:4], "big") / 2147483648.0 - 1.0


class DigestScorer:
    """Logits (0, sum of the weights)."""

    def embed(self, tokens: list[str]) -> np.ndarray:
        return np.array([[_weight(t)] for t in tokens]).reshape(-1, 1)

    def logits(self, embeddings: np.ndarray) -> np.ndarray:
        total = embeddings.sum(axis=(1, 2))
        return np.stack([np.zeros_like(total), total], axis=1)

    def logit_gradient(self, embeddings: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros_like(embeddings), np.ones_like(embeddings)], axis=1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probability_gradient(scorer: Scorer, embeddings: np.ndarray, target: int) -> np.ndarray:
    """Gradient of the target's softmax probability with respect to the embeddings, by the chain rule over the logits."""
    p = softmax(scorer.logits(embeddings))
    outer = p[:, target : target + 1] * (np.eye(p.shape[1])[target] - p)  # d p_target / d logit
    return np.einsum("bc,bctd->btd", outer, scorer.logit_gradient(embeddings))


def attributions(scorer: Scorer, embeddings: np.ndarray, target: int, steps: int = 25) -> np.ndarray:
    """Integrated gradients of one block, the mean over the dimensions of each token."""
    shape = embeddings.shape
    gradient = lambda points: probability_gradient(scorer, points.reshape(-1, *shape), target).reshape(len(points), -1)
    return integrated_gradients(embeddings.ravel(), gradient, steps).reshape(shape).mean(axis=1)


_made: dict[Callable[[], Scorer], Scorer] = {}


def _blocks(batch: pa.RecordBatch, factory: Callable[[], Scorer]):
    """(row, block, tokens, scorer) of a batch of (key, text)."""
    if factory not in _made:
        _made[factory] = factory()
    for row, text in enumerate(batch.column(1).to_pylist()):
        tokens = [form.lower() for form in token_forms(text or "")]
        for block, at in enumerate(range(0, len(tokens), BLOCK)):
            yield row, block, tokens[at : at + BLOCK], _made[factory]


def score_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", factory: Callable[[], Scorer] = DigestScorer, target: int = 1) -> DataFrame:
    """(key, block, n, probability, prediction) of each block of a text; the prediction is the class of the largest logit."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for row, block, tokens, scorer in _blocks(batch, factory):
                logits = scorer.logits(scorer.embed(tokens)[None])
                rows.append((row, block, len(tokens), float(softmax(logits)[0, target]), int(logits[0].argmax())))
            yield _batch(batch, key, rows, {"block": pa.int32(), "n": pa.int64(), "probability": pa.float64(), "prediction": pa.int32()})

    schema = f"{key} {dict(docs.dtypes)[key]}, block int, n bigint, probability double, prediction int"
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def block_attributions(docs: DataFrame, key: str = "doc_id", text: str = "text", factory: Callable[[], Scorer] = DigestScorer, target: int = 1, steps: int = 25) -> DataFrame:
    """(key, block, pos, attr): integrated gradients of every token; ``pos`` runs over the text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for row, block, tokens, scorer in _blocks(batch, factory):
                found = attributions(scorer, scorer.embed(tokens), target, steps)
                rows += [(row, block, block * BLOCK + i, a) for i, a in enumerate(found.tolist())]
            yield _batch(batch, key, rows, {"block": pa.int32(), "pos": pa.int32(), "attr": pa.float64()})

    schema = f"{key} {dict(docs.dtypes)[key]}, block int, pos int, attr double"
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, key: str, rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(kinds) + 1)
    keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns[1:], kinds.values()))], [key, *kinds])
