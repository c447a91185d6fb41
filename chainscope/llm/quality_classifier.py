"""Quality classifier: Bradley-Terry pairwise ranking.

Of two labelled documents, one of label 1 and one of label 0, the first is
preferred.  The model gives each text a strength w.x, and the chance that i
is preferred to j is 1 / (1 + exp(-w.(x_i - x_j))): logistic loss on feature
differences, fitted by Newton's steps with a small ridge.  The strength's
cut is the quantile at which as many labelled rows fall below it as have
label 0; a logistic curve around the cut turns strengths into scores, with
the decision at ``at``.

The fit uses at most ``sample`` labelled rows (those of least hash of their
id) and ``pairs`` pairs of them; scores are computed for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.store import apart
from chainscope.llm.features import NAMES, features


@dataclass(frozen=True)
class Model:
    """Strength of a text: (features - mean) / scale . weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.cut + np.log(self.at / (1 - self.at)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int, at: float, ridge: float = 1e-3, seed: int = 11) -> Model:
    """A model from labelled features; without both labels all texts score 0.5."""
    high, low = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(high) or not len(low):
        k = x.shape[1]
        return Model(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(at / (1 - at))), at)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.Generator(np.random.PCG64(seed))
    difference = z[rng.choice(high, pairs)] - z[rng.choice(low, pairs)]
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ (chance - 1) / pairs + ridge * weights
        curve = (difference * (chance * (1 - chance))[:, None]).T @ difference / pairs + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    strength = np.sort(z @ weights)
    k = len(low)  # the quantile len(low) / len(y)
    cut = float((strength[k - 1] + strength[k]) / 2)
    return Model(mean, scale, weights, cut, at)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_pydict({"quality": part.column("quality"), "x": pa.array(list(x), pa.list_(pa.float64()))})


def _scores(batches: Iterator[pa.RecordBatch], model: Model, names: list[str], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, text):
            score = pa.array(model.scores(features(part.column(text))))
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(schema.field(k).type) for k, c in enumerate(names)), score], schema=schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pairs: int = 200_000, at: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labelled rows; the caller leaves out those it holds out.
    Rows without id, label or text are not used."""
    few = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("quality")).where("_id is not null and quality in (0, 1)")
    few = few.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)  # at most `sample` rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    got = rows.join(F.broadcast(few), "_id").select("quality", "text").mapInArrow(_features, "quality int, x array<double>").toPandas()
    x = np.array(got.x.tolist()).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, got.quality.to_numpy()))  # the order in which rows arrive does not matter
    return fit(x[order], got.quality.to_numpy()[order], pairs, at)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score from 0 to 1 more.

    Null and empty texts have features of 0 and are scored by them.  Repeated
    rows score alike.  A column that already has the score's name gives way, all
    others stay whatever their names.  An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != score_col]
    (text,) = apart(docs.columns, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(text))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    kind = StructType([*docs.select(*[f"`{c}`" for c in names]).schema.fields]).add(score_col, DoubleType())
    return rows.mapInArrow(partial(_scores, model=model, names=names, text=text, schema=to_arrow_schema(kind)), kind)
