"""Small fixtures and comparisons."""

from __future__ import annotations

import datetime as dt

import numpy as np

from panelcast.panel import Panel

START = dt.datetime(2024, 1, 1)
# the same rows, once windowed per series and once cut into short blocks
GRID = Panel(step=3_600)
BLOCKS = Panel(rows_per_task=40, block_rows=7)
LAYOUTS = [GRID, BLOCKS]


def panel_of(spark, series: dict[str, list[float]], hours: dict[str, list[int]] | None = None):
    rows = [(s, START + dt.timedelta(hours=(hours or {}).get(s, range(len(values)))[i]), float(v))
            for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def skewed(seed: int = 3) -> tuple[dict[str, list[float]], dict[str, list[int]]]:
    """Three series with gaps; the first holds most of the rows."""
    rng = np.random.default_rng(seed)
    sizes = {"hot": 230, "mid": 60, "tiny": 9}
    values = {s: list(np.round(np.exp(rng.normal(3, 0.4, n)), 3)) for s, n in sizes.items()}
    hours = {s: sorted(rng.choice(n * 3, n, replace=False).tolist()) for s, n in sizes.items()}
    return values, hours


def by_series(df, *cols: str) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for row in sorted(df.collect(), key=lambda x: (x["series_id"], x["pos"])):
        out.setdefault(row["series_id"], []).append(tuple(row[c] for c in cols))
    return out


def values(df, col: str = "value") -> list[float]:
    return [v[0] for rows in by_series(df, col).values() for v in rows]
