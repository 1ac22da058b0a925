"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import cut, held_out, learning_rows
from sidelines.llm.stats import ratios, statistics

#: Most labelled rows that a fit uses, and the partitions whose sums the driver adds.
MOST_ROWS, SUMS = 200_000, 8
_BINS = 1000


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.weights + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[i : i + 20_000]) @ self.beta for i in range(0, len(x), 20_000)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.steps
        return np.clip(np.interp(self.raw(x), at, value), 0, 1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means y with weights n, made non-decreasing by pooling neighbours."""
    pools: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist(), strict=True):
        pools.append([a * b, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.repeat([p[0] / p[1] for p in pools], [p[2] for p in pools])


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)


def fit(rows: DataFrame, names: list[str], features: int = 192, ridge: float = 1.0, seed: int = 5) -> Model:
    """rows(label, *names; no nulls). One of SUMS parts, dealt by a hash of the inputs, is left out of the ridge fit and gives the
    isotonic steps; with a part or the rest empty, all rows do both. Sums of the normal equations leave each partition once.
    Without rows every score is 0.5; repeated rows count again."""
    part = F.pmod(F.xxhash64(*names, F.lit(11)), F.lit(SUMS))
    rows = cut(rows.select("label", *names, part.alias("part")).repartition(SUMS), "learn")
    apart = rows.agg(F.count_if(F.col("part") == 0), F.count_if(F.col("part") > 0)).first()
    fitted, steps = (rows.where("part > 0"), rows.where("part = 0")) if all(apart) else (rows, rows)
    first = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([first[f"m_{c}"] or 0.0 for c in names])
    scale = np.array([first[f"s_{c}"] or 1.0 for c in names])
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(len(names)), (len(names), features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))
    if not first["n"]:
        model.steps = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(_matrix(batch, names))
            total += z.T @ np.hstack([z, batch.column("label").to_numpy().astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(r[0]).reshape(features + 1, -1) for r in fitted.mapInArrow(sums, "sums binary").collect()]
    total = np.sum(parts, axis=0)
    model.beta = np.linalg.solve(total[:, :-1] + ridge * np.eye(features + 1), total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.clip(np.rint((model.raw(_matrix(batch, names)) + 0.5) * _BINS / 2), 0, _BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("label").cast(pa.int64())], ["bin", "label"])

    found = steps.mapInArrow(binned, "bin int, label long").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("bin").toPandas()
    model.steps = (found["bin"].to_numpy() * 2 / _BINS - 0.5, isotonic(found["y"].to_numpy(float), found["n"].to_numpy(float)))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score) of each row of docs(doc_id, text); a high score says that label 1 is likely.

    Learns from labels(doc_id, quality) outside the held-out fold, at most about `most` rows chosen by a hash of doc_id.
    Inputs are shares and counts of the whole text alone. Empty and null texts have all counts 0 and a score like any
    other; rows with a null doc_id are scored and count as held out; without labels every score is 0.5.
    """
    names = list(ratios())
    stats = cut(statistics(docs).select("doc_id", *(c.cast("double").alias(k) for k, c in ratios().items())), "stats")
    model = fit(stats.join(learning_rows(labels, "quality", most), "doc_id"), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch, names)))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
