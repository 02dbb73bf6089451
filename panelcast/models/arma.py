"""ARMA(1,1) residuals and a posterior over a parameter grid.

The residual ``e[t] = y[t] - mu - phi*y[t-1] - theta*e[t-1]`` is linear in the residual a
stretch of rows starts from. Each block of a series is therefore folded on its own, with
a zero start, next to the response ``c`` to a unit start; blocks then compose in order.
No task ever holds a whole series, and the sum of squares is that of the plain recursion.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.index import index_panel
from panelcast.panel import PANEL, Panel

BLOCK_ROWS = 4096
BLOCKS_PER_GROUP = 1024

_PARAMS = ("mu", "phi", "theta")


def _choices(values: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def _summary(**fields: Column) -> Column:
    return F.struct(*[c.cast("double").alias(name) for name, c in fields.items()])


def _fold_block(cells: Column, mu: Column, phi: Column, theta: Column) -> Column:
    """Sums of squares and products of the zero-start residual ``a`` and the response ``c``."""
    first = cells[0]
    opens = first["pos"] == 1
    zero = F.lit(0.0)
    start = _summary(prev=first["y"], a=F.when(opens, first["y"] - (mu + phi * mu)).otherwise(zero),
                     c=F.when(opens, zero).otherwise(F.lit(1.0)), saa=zero, sac=zero, scc=zero, m=zero)

    def step(s: Column, cell: Column) -> Column:
        a = cell["y"] - (mu + phi * s["prev"] + theta * s["a"])
        c = -theta * s["c"]
        return _summary(prev=cell["y"], a=a, c=c, saa=s["saa"] + a * a, sac=s["sac"] + a * c,
                        scc=s["scc"] + c * c, m=s["m"] + 1)

    return F.aggregate(F.slice(cells, F.lit(2), F.size(cells) - 1), start, step)


def _compose(parts: Column) -> Column:
    """One summary for consecutive stretches."""
    zero = F.lit(0.0)
    start = _summary(a=zero, c=F.lit(1.0), saa=zero, sac=zero, scc=zero, m=zero)

    def then(s: Column, t: Column) -> Column:
        return _summary(
            a=t["a"] + t["c"] * s["a"], c=t["c"] * s["c"],
            saa=s["saa"] + t["saa"] + 2 * s["a"] * t["sac"] + s["a"] * s["a"] * t["scc"],
            sac=s["sac"] + s["c"] * t["sac"] + s["a"] * s["c"] * t["scc"],
            scc=s["scc"] + s["c"] * s["c"] * t["scc"], m=s["m"] + t["m"])

    return F.aggregate(parts, start, then)


def _in_order(place: str) -> Column:
    """The collected summaries of a group, sorted by their place."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), "s")))
    return F.transform(pairs, lambda p: p["s"])


def arma_residual_ss(df: DataFrame, grid: Mapping[str, Sequence[float]], panel: Panel = PANEL,
                     block_rows: int = BLOCK_ROWS, blocks_per_group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """``(keys, mu, phi, theta, ss, n)`` for every series and every point of the grid.

    The first residual starts the recursion and is not scored. A recursion that
    overflows reports an infinite sum.
    """
    keys = list(panel.keys)
    ix = index_panel(df, panel)
    last = F.floor((F.least(F.col("pos") + 1, F.col("n")) - 1) / block_rows)
    placed = ix.withColumn("_block", F.explode(F.sequence(F.floor((F.col("pos") - 1) / block_rows), last)))
    cell = F.struct("pos", F.col(panel.value).alias("y"))
    blocks = placed.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    for name in _PARAMS:
        blocks = blocks.withColumn(name, _choices(grid[name]))
    folded = blocks.select(*keys, *_PARAMS, "_block", _fold_block(
        F.col("_cells"), F.col("mu"), F.col("phi"), F.col("theta")).alias("s"))
    point = [*keys, *_PARAMS]
    group = F.floor(F.col("_block") / blocks_per_group).alias("_group")
    grouped = folded.groupBy(*point, group).agg(_compose(_in_order("_block")).alias("s"))
    whole = grouped.groupBy(*point).agg(_compose(_in_order("_group")).alias("s"))
    ss = F.col("s.saa")
    return whole.select(*point, F.when(F.isnan(ss), F.lit(math.inf)).otherwise(ss).alias("ss"),
                         F.col("s.m").cast("long").alias("n"))


def _normal(x: Column, sd: float) -> Column:
    return -x * x / (2.0 * sd * sd) - math.log(sd * math.sqrt(2.0 * math.pi))


def _half_cauchy(x: Column, scale: float) -> Column:
    return math.log(2.0) - F.ln(math.pi * scale * (1.0 + (x / scale) * (x / scale)))


def log_posterior(ss: Column, n: Column, mu: Column, phi: Column, theta: Column, sigma: Column) -> Column:
    """Gaussian likelihood of the scored residuals and the model's priors, up to a constant."""
    likelihood = -n * F.ln(sigma) - n * (0.5 * math.log(2.0 * math.pi)) - ss / (2.0 * sigma * sigma)
    return likelihood + _half_cauchy(sigma, 5.0) + _normal(theta, 2.0) + _normal(phi, 2.0) + _normal(mu, 10.0)


def arma_grid_posterior(ss: DataFrame, sigma_grid: Sequence[float], panel: Panel = PANEL) -> DataFrame:
    """``(keys, map_*, mean_*)``: the best grid point and the posterior means over the grid."""
    keys = list(panel.keys)
    names = [*_PARAMS, "sigma"]
    points = ss.withColumn("sigma", _choices(sigma_grid)).withColumn(
        "lp", log_posterior(F.col("ss"), F.col("n"), *[F.col(p) for p in names]))
    # a series has as many rows here as the grid has points
    points = points.withColumn("weight", F.exp(F.col("lp") - F.max("lp").over(Window.partitionBy(*keys))))
    best = F.max_by(F.struct(*names), "lp")
    means = [(F.sum(F.col("weight") * F.col(p)) / F.sum("weight")).alias(f"mean_{p}") for p in names]
    found = points.groupBy(*keys).agg(best.alias("best"), *means)
    return found.select(*keys, *[F.col(f"best.{p}").alias(f"map_{p}") for p in names],
                        *[f"mean_{p}" for p in names])
