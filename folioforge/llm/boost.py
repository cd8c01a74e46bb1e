"""Gradient-boosted trees: fitted by Spark ML, then carried as plain tuples.

A node is ``(feature, threshold, left, right)`` (left: value <= threshold) or a leaf value. Plain
trees become one SQL expression, or are applied to a numpy matrix, without a model on executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, rounds: int = 12, depth: int = 4, step: float = 0.3, seed: int = 7, weight: str | None = None) -> list | None:
    """Trees for rows (x array<double>, y int 0/1), ``weight`` names a column of how often each counts; None where a class is missing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg((F.sum(weight) if weight else F.count("*")).alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 5:
        return None
    data = rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), *([F.col(weight).cast("double").alias("weight")] if weight else []))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxBins=32, **({"weightCol": "weight"} if weight else {})).fit(data)
    return parsed(model.toDebugString)


def parsed(text: str) -> list:
    """(weight, tree) pairs of Spark's printed form of an ensemble."""
    out, lines = [], [x.strip() for x in text.splitlines()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return float(m[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return int(m[1]), float(m[2]), left, node()

    while at < len(lines):
        m = re.match(r"Tree \d+ \(weight (\S+)\):", lines[at])
        at += 1
        if m:
            out.append((float(m[1]), node()))
    return out


def as_sql(trees: list, features: list[Column]) -> Column:
    """Probability of class 1 as one expression."""

    def column(node):
        if isinstance(node, float):
            return F.lit(node)
        i, t, left, right = node
        return F.when(features[i] <= F.lit(t), column(left)).otherwise(column(right))

    margin = sum((column(tree) * F.lit(w) for w, tree in trees), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def as_numpy(trees: list, x):
    """Probability of class 1 for each row of a matrix."""
    import numpy as np

    margin = np.zeros(len(x))

    def walk(node, rows, w):
        if isinstance(node, float):
            margin[rows] += w * node
        elif len(rows):
            i, t, left, right = node
            low = x[rows, i] <= t
            walk(left, rows[low], w)
            walk(right, rows[~low], w)

    for w, tree in trees:
        walk(tree, np.arange(len(x)), w)
    return 1 / (1 + np.exp(-2 * margin))
