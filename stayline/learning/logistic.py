"""Logistic regression with a penalised intercept, by Newton's method on sums over all rows.

The intercept is the weight of a constant slot and is penalised like every other, so the loss is
|b|^2 / 2 + C sum w log(1 + exp(-y xb)) with y = -1 or 1. A pass adds up loss, gradient and second derivatives; they are of fixed
size, a square of the number of slots. What the driver solves is that one system.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sums of tasks are added in so many groups before they reach the driver
MERGED = 32
# halvings of a step that overshot
HALVINGS = 30


@dataclass(frozen=True)
class Fitted:
    """Weights of the slots and, last, of the constant; the greatest part of the gradient left, per unit of summed row weight."""

    weights: np.ndarray
    gradient: float
    passes: int


def _with_constant(cells: pa.Array, features: int) -> np.ndarray:
    x = np.ones((len(cells), features + 1))
    x[:, :features] = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
    return x


def _terms(x: np.ndarray, label: np.ndarray, row_weight: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives of some rows in one array."""
    side = np.where(label > 0, 1.0, -1.0)
    margin = side * (x @ weights)
    loss = (row_weight * np.logaddexp(0, -margin)).sum()
    missing = np.exp(-np.logaddexp(0, margin))
    gradient = -x.T @ (row_weight * side * missing)
    second = x.T @ ((row_weight * missing * (1 - missing))[:, None] * x)
    return np.concatenate([[loss], gradient, second.ravel()])


def _summed(rows: DataFrame, features: int, weights: np.ndarray) -> np.ndarray:
    size = 1 + (features + 1) + (features + 1) ** 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                label, row_weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                out += _terms(_with_constant(batch.column(2), features), label, row_weight, weights)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for packed in batch.column(2):
                out += np.frombuffer(packed.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

    by_task = rows.mapInArrow(add, "sums binary").select((F.spark_partition_id() % MERGED).alias("part"), F.spark_partition_id().alias("task"), "sums")
    # in the order of tasks, so that the same layout gives the same bits
    merged = by_task.repartition("part").sortWithinPartitions("part", "task").mapInArrow(merge, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"]) for r in merged], axis=0)


def fit(rows: DataFrame, features: int, penalty_c: float = 1.0, passes: int = 100, tolerance: float = 1e-9) -> Fitted:
    """Fit ``rows`` (label 0 or 1, weight, cells: an array of ``features`` finite numbers); store them first.

    Steps end once no part of the gradient, in units of its slot, exceeds ``tolerance`` of the summed row weight. Without rows all weights are 0.
    """
    asked = rows.select(F.col("label").cast("double"), F.col("weight").cast("double"), "cells")
    total = asked.agg(F.sum("weight")).first()[0] or 0.0
    at, step, before, left = np.zeros(features + 1), np.zeros(features + 1), np.inf, 0.0
    used = 0
    if not total:
        return Fitted(at, 0.0, 0)
    halved = 0
    while used < passes:
        used += 1
        sums = _summed(asked, features, at)
        loss = at @ at / 2 + penalty_c * sums[0]
        # a rise within rounding is none
        if not loss <= before + 1e-12 * abs(before) and halved < HALVINGS:
            halved += 1
            step = step / 2
            at = at - step
            continue
        gradient = at + penalty_c * sums[1 : features + 2]
        second = np.eye(features + 1) + penalty_c * sums[features + 2 :].reshape(features + 1, features + 1)
        # in units of each slot, so that amounts and flags are alike
        unit = 1 / np.sqrt(np.diag(second))
        left = float(np.abs(gradient * unit).max() / np.sqrt(penalty_c * total))
        if left <= tolerance:
            break
        step = -unit * np.linalg.solve(second * unit[:, None] * unit[None, :], gradient * unit)
        before, halved, at = loss, 0, at + step
    return Fitted(at, left, used)


def predicted(fitted: Fitted, df: DataFrame, cells: Column, name: str) -> DataFrame:
    """``df`` with the probability of class 1; plain column arithmetic."""
    weights = F.array(*[F.lit(float(w)) for w in fitted.weights[:-1]])
    products = F.zip_with(cells, weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(float(fitted.weights[-1])), lambda total, x: total + x)
    return df.withColumn(name, 1 / (1 + F.exp(-margin)))
