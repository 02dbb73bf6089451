"""Small dense linear algebra as column expressions: no Python, any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.columns import dot


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def cholesky(matrix: Column) -> Column:
    """The rows of the lower triangle L with L L' = ``matrix`` (array of rows, symmetric, positive definite).

    Each row is a fold over its places, and the rows are a fold over the matrix.
    """
    def row(rows: Column, i: Column) -> Column:
        def place(done: Column, j: Column) -> Column:
            rest = F.get(F.get(matrix, i), j)
            diagonal = F.sqrt(rest - dot(done, done))
            beside = F.get(rows, j)
            below = F.try_divide(rest - dot(done, F.slice(beside, F.lit(1), j)), F.get(beside, j))
            return F.concat(done, F.array(F.when(i == j, diagonal).otherwise(below)))
        made = F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), place)
        return F.concat(rows, F.array(made))
    return F.aggregate(_upto(F.size(matrix)), F.array().cast("array<array<double>>"), row)


def triangular_solve(rows: Column, b: Column) -> Column:
    """x with L L' x = ``b``, for the rows of L; NULL places where a diagonal of L is zero."""
    n = F.size(rows)

    def forward(done: Column, i: Column) -> Column:
        own = F.get(rows, i)
        return F.concat(done, F.array(F.try_divide(F.get(b, i) - dot(F.slice(own, F.lit(1), i), done), F.get(own, i))))

    halfway = F.aggregate(_upto(n), F.array().cast("array<double>"), forward)

    def backward(done: Column, step: Column) -> Column:  # done holds x from place i + 1 on
        i = n - 1 - step
        below = F.transform(F.slice(rows, i + 2, step), lambda r: F.get(r, i))
        return F.concat(F.array(F.try_divide(F.get(halfway, i) - dot(below, done), F.get(F.get(rows, i), i))), done)

    return F.aggregate(_upto(n), F.array().cast("array<double>"), backward)
