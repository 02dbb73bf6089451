"""Windows taken inside tasks: a panel is sent to Python once, in blocks of consecutive rows.

A block also gets the neighbouring rows its windows reach, so what is sent is about the panel's size whatever the length of
the windows, which are strided views there. Blocks of one series go to different tasks; no task holds a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.index import index_panel
from panelcast.panel import PANEL, Panel

#: windows handled at a time
CHUNK = 4096

_BLOCK, _CORE, _HEAD = "_block", "_core", "_head"

#: one block of a series: its key values, its rows by position, and what was sent along for the series (or None)
Window = Callable[[tuple, pd.DataFrame, np.ndarray, object], Iterator[pd.DataFrame]]


def _block_of(pos: Column, panel: Panel) -> Column:
    return F.floor((pos - 1) / panel.block_rows)


def _rows(df: DataFrame, panel: Panel, before: int, after: int) -> DataFrame:
    ix = index_panel(df, panel)
    first = _block_of(F.greatest(F.col("pos") - after, F.lit(1)), panel)
    last = _block_of(F.least(F.col("pos") + before, F.col("n")), panel)
    return ix.select(*panel.keys, F.explode(F.sequence(first, last)).alias(_BLOCK), "pos", "n", panel.time, panel.value).withColumn(
        _CORE, F.col(_BLOCK) == _block_of(F.col("pos"), panel))


def _with_heads(rows: DataFrame, heads: DataFrame | None, panel: Panel) -> DataFrame:
    """Adds one row per series and block, at position 0, that carries the struct ``_head``."""
    if heads is None:
        return rows
    keys = list(panel.keys)
    sizes = rows.groupBy(*keys).agg(F.max("n").alias("_size"))
    others = [c for c in heads.columns if c not in keys]
    placed = heads.select(*keys, F.struct(*others).alias(_HEAD)).join(sizes, keys).withColumn(
        _BLOCK, F.explode(F.sequence(F.lit(0).cast("long"), _block_of(F.col("_size"), panel)))).withColumn("pos", F.lit(0).cast("long"))
    return rows.unionByName(placed.drop("_size"), allowMissingColumns=True)


def _stretches(batches: Iterator[pd.DataFrame], by: list[str], overlap: int) -> Iterator[tuple[tuple, pd.DataFrame, object]]:
    """The rows of each group in turn: (key, rows, head).

    A group that goes on in the next batch is given in parts; a part begins with the last ``overlap`` rows of the one before.
    """
    key, head, held = None, None, None
    for batch in batches:
        if not len(batch):
            continue
        codes = batch[by]
        edges = np.append(np.flatnonzero((codes != codes.shift()).to_numpy().any(axis=1)), len(batch))
        for low, high in zip(edges[:-1], edges[1:]):
            part = batch.iloc[low:high]
            now = tuple(part[by].iloc[0])
            if key is None or any(a != b and not (pd.isna(a) and pd.isna(b)) for a, b in zip(now, key)):
                key, head, held = now, None, None
            if part["pos"].iloc[0] == 0:
                head, part = part[_HEAD].iloc[0], part.iloc[1:]
            if not len(part):
                continue
            rows = part if held is None else pd.concat([held, part])
            held = rows.iloc[max(len(rows) - overlap, 0):]
            yield key, rows, head


def map_windows(df: DataFrame, fn: Window, schema: T.StructType | str, before: int, after: int, panel: Panel = PANEL,
                heads: DataFrame | None = None) -> DataFrame:
    """Calls ``fn(key, rows, windows, head)`` for stretches of windows; it yields frames of ``schema``.

    A window has ``before`` rows, its own row, and ``after`` rows; ``rows`` are the own rows of up to ``CHUNK`` windows (with
    ``pos``, ``n``, the time), ``windows`` an array ``[window, row, member]``, with one member for a panel of single values.
    A missing value is NaN. Rows whose windows leave the series are not given. ``heads`` has at most one row per series,
    which comes as ``head``.
    """
    keys, width = list(panel.keys), before + 1 + after
    rows = _with_heads(_rows(df, panel, before, after), heads, panel)
    dealt = rows.repartition(*keys, _BLOCK).sortWithinPartitions(*keys, _BLOCK, "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part, head in _stretches(batches, [*keys, _BLOCK], width - 1):
            if len(part) < width:
                continue
            values = part[panel.value].to_numpy()
            values = np.stack([np.asarray(v, float) for v in values]) if values.dtype == object and np.ndim(values[0]) else values.astype(float)[:, None]
            views = np.lib.stride_tricks.sliding_window_view(values, width, axis=0).transpose(0, 2, 1)
            own = part.iloc[before : len(part) - after].astype({"pos": "int64", "n": "int64"})
            kept = np.flatnonzero(own[_CORE].to_numpy(bool))
            for low in range(0, len(kept), CHUNK):
                chosen = kept[low : low + CHUNK]
                yield from fn(key[:-1], own.iloc[chosen], views[chosen], head)

    return dealt.mapInPandas(run, schema)


def own_columns(df: DataFrame, names: Sequence[str], tail: str) -> T.StructType:
    """A schema of columns of ``df`` and then ``tail``."""
    return T.StructType([df.schema[c] for c in names] + T.StructType.fromDDL(tail).fields)
