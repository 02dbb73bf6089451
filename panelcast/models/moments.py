"""Ridge regression for many groups at once, from second moments.

Tasks reduce their rows to one Gram matrix per group, Spark sums the matrices by
cell, and each summed matrix is solved on an executor. The penalty is on the weights
only; the intercept is free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# cells of Gram matrices a task holds before it emits them
CELLS_HELD = 4_000_000

COEF_TYPE = "array<struct<intercept:double,weights:array<double>>>"


def _with_keys(df: DataFrame, keys: Sequence[str], tail: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(tail).fields)


class GramSums:
    """Gram matrices of ``[1, x, y]`` by key, held in a task until they have ``CELLS_HELD`` cells."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.held, self.size = list(keys), {}, 0

    def add(self, key: tuple, xs: np.ndarray, ys: np.ndarray) -> None:
        z = np.hstack([np.ones((len(xs), 1)), xs, ys])
        g = z.T @ z
        if key in self.held:
            self.held[key][1].__iadd__(g)
        else:
            self.held[key] = (xs.shape[1], g)
            self.size += g.size

    def full(self) -> bool:
        return self.size > CELLS_HELD

    def take(self) -> pd.DataFrame:
        """What is held, as rows ``(keys, n_x, cells)``; nothing is held then."""
        out = pd.DataFrame(list(self.held), columns=self.keys)
        out["n_x"] = [n for n, _ in self.held.values()]
        out["cells"] = [g[np.triu_indices(len(g))] for _, g in self.held.values()]
        self.held, self.size = {}, 0
        return out


def sum_grams(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, n_x, cells)`` summed over tasks, cell by cell."""
    summed = (partials.select(*keys, "n_x", F.posexplode("cells"))
              .groupBy(*keys, "n_x", "pos").agg(F.sum("col").alias("cell")))
    return summed.groupBy(*keys, "n_x").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "cell"))), lambda c: c["cell"]).alias("cells"))


def gram(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(keys, n_x, cells)``: the upper triangle, row by row, of the Gram matrix of ``[1, x, y]``.

    ``x`` and ``y`` are array columns of the same length within a group. Centre large
    values first: products of uncentred numbers lose digits.
    """
    keys = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = GramSums(keys)
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                sums.add(key, np.stack(part["x"].to_numpy()), np.stack(part["y"].to_numpy()))
                if sums.full():
                    yield sums.take()
        if sums.held:
            yield sums.take()

    partials = rows.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(
        partial, _with_keys(rows, keys, "n_x int, cells array<double>"))
    return sum_grams(partials, keys)


def solve_ridge(grams: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """``(keys, coefs)``: per output an intercept and one weight per input."""
    keys = list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coefs = []
            for n_x, cells in zip(batch["n_x"], batch["cells"]):
                size = int(round((math.sqrt(8 * len(cells) + 1) - 1) / 2))
                g = np.zeros((size, size))
                g[np.triu_indices(size)] = cells
                g += np.triu(g, 1).T
                n, mean = g[0, 0], g[0, 1:] / g[0, 0]
                scatter = g[1:, 1:] - n * np.outer(mean, mean)
                weights = np.linalg.solve(scatter[:n_x, :n_x] + alpha * np.eye(n_x), scatter[:n_x, n_x:])
                intercepts = mean[n_x:] - mean[:n_x] @ weights
                coefs.append([{"intercept": float(b), "weights": w.tolist()} for b, w in zip(intercepts, weights.T)])
            out = batch[keys].copy()
            out["coefs"] = coefs
            yield out

    return grams.mapInPandas(solve, _with_keys(grams, keys, f"coefs {COEF_TYPE}"))
