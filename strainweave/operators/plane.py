"""Rows placed in the plane by their distances: classical scaling of all distinct words.

The squared Hamming distance of two words of 64 signs is ((64 - x.y) / 2)^2, a polynomial in x.y. So the doubly centred
matrix is F S F', where F has a row a word of 64 signs and their 2,016 products by pairs, centred, and S is diagonal. Its
eigenvectors follow from F'F, which is one sum over all words, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.operators.hamming import word_distance
from strainweave.plans.shared import cut

#: Up to so many distinct words the driver scales the square of their distances itself.
LANDMARKS = 64
_I, _J = np.triu_indices(64, 1)
#: Rows of one part of the sum, and words of one product of matrices: their counts are whole numbers that float32 holds.
_PART, _WORDS = 128, 4096
#: Weights of the signs and of their products in -1/2 of the squared distance.
_S = np.concatenate([np.full(64, 16.0), np.full(len(_I), -0.25)])


def _frame(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2 x k matrix, k means): a point is -1/2 times the matrix applied to its squared distances less the means.

    Directions without extent give 0. Each axis is turned so that its largest entry is positive.
    """
    squared = distances.astype(float) ** 2
    k = len(squared)
    centre = np.eye(k) - 1.0 / k
    values, vectors = np.linalg.eigh(-0.5 * centre @ squared @ centre)
    axes = np.zeros((2, k))
    for axis, at in enumerate(np.argsort(-values, kind="stable")[:2]):
        if values[at] > 1e-9 * max(1.0, float(squared.max())):
            v = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
            axes[axis] = v / np.sqrt(values[at])
    return axes, squared.mean(axis=1)


def _signs(words: np.ndarray) -> np.ndarray:
    """A row of 64 numbers, 1 or -1, for every word."""
    return np.where((words.astype(np.int64)[:, None] >> np.arange(64)) & 1, 1, -1).astype(np.float32)


def _gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum over the words of one task of all products of 1, signs and products of signs, cut into parts of rows."""
    total, size = None, 1 + len(_S)
    for pdf in parts:
        words = pdf["word"].to_numpy()
        for at in range(0, len(words), _WORDS):
            x = _signs(words[at : at + _WORDS])
            z = np.hstack([np.ones((len(x), 1), np.float32), x, x[:, _I] * x[:, _J]])
            product = z.T @ z
            total = product.astype(np.float64) if total is None else np.add(total, product, out=total)
    if total is not None:
        for at in range(0, size, _PART):
            yield pd.DataFrame({"part": [at], "sums": [total[at : at + _PART].tobytes()]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float64) for b in pdf["sums"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [total.tobytes()]})


def _axes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2 x 2080 weights, 2 offsets): a place is the weights applied to a word's signs and products, less the offset.

    With F'F = U L U' the eigenvectors q of R'SR, R = U L^1/2, have the eigenvalues of the distances, and the places
    along them are F S R q / eigenvalue^1/2. Each axis is turned so that its largest weight is positive.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    extent, u = np.linalg.eigh(centred)
    r = u * np.sqrt(np.maximum(extent, 0.0))
    m = r.T @ (_S[:, None] * r)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    axes = np.zeros((2, len(_S)))
    for axis in range(2):
        value, q = values[-1 - axis], vectors[:, -1 - axis]
        if value > 1e-9 * 64**2:
            a = _S * (r @ q) / np.sqrt(value)
            axes[axis] = a * np.sign(a[np.argmax(np.abs(a))])
    return axes, axes @ mean


def place_words(rows: DataFrame, node: str, landmarks: int = LANDMARKS) -> DataFrame:
    """(node, x, y) of every row with a word, by Hamming distance.

    All distinct words are scaled, each once, and every row has the place of its word: one sum over the distinct words,
    then one pass over the rows. Up to `landmarks` words (64 at most) the driver works on the distances themselves, with
    the same distances between places. With fewer than three distinct words all rows are at 0, 0. Null words have no place.
    """
    own = rows.filter("word is not null").select(node, "word")
    distinct = cut(own.select("word").distinct(), "words")
    most = min(landmarks, LANDMARKS)
    words = [r["word"] for r in distinct.limit(max(most, 2) + 1).collect()]
    if len(words) < 3:
        return own.select(node, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    if len(words) > most:
        return _place_all(own, distinct, node)
    words = sorted(words)
    between = np.array([[((a ^ b) & (2**64 - 1)).bit_count() for b in words] for a in words])
    axes, means = _frame(between)
    squared = F.transform(F.array(*[F.lit(w).cast("bigint") for w in words]), lambda w: F.pow(word_distance(F.col("word"), w).cast("double"), F.lit(2.0)))
    off = F.zip_with("__squared", F.array(*[F.lit(float(m)) for m in means]), lambda a, b: a - b)
    along = lambda axis: F.lit(-0.5) * F.aggregate(F.zip_with(off, F.array(*[F.lit(float(v)) for v in axes[axis]]), lambda a, b: a * b), F.lit(0.0), lambda n, v: n + v)
    return own.select(node, F.explode(F.array(squared)).alias("__squared")).select(node, along(0).alias("x"), along(1).alias("y"))


def _place_all(own: DataFrame, distinct: DataFrame, node: str) -> DataFrame:
    # one task a core, since each gives a sum of the same size
    spread = distinct.repartition(max(1, own.sparkSession.sparkContext.defaultParallelism))
    sums = spread.mapInPandas(_gram, "part int, sums binary").groupBy("part").applyInPandas(_add, "part int, sums binary").collect()
    size = 1 + len(_S)
    gram = np.vstack([np.frombuffer(r["sums"], np.float64).reshape(-1, size) for r in sorted(sums, key=lambda r: r["part"])])
    axes, offsets = _axes(gram)
    square = np.zeros((2, 64, 64))
    square[:, _I, _J] = axes[:, 64:]

    @F.pandas_udf("x double, y double")
    def place(word: pd.Series) -> pd.DataFrame:
        x = _signs(word.to_numpy()).astype(np.float64)
        return pd.DataFrame({c: x @ axes[k, :64] + ((x @ square[k]) * x).sum(1) - offsets[k] for k, c in enumerate("xy")})

    return own.select(node, place("word").alias("__at")).select(node, "__at.x", "__at.y")
