"""Price queries, and train and test data of panels and whole neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.var import to_matrix
from panelcast.operators.graph import neighbor_panel, neighbors
from panelcast.operators.index import attach
from panelcast.operators.reshape import between_exclusive, complete_hours, fill_null, select_nodes
from panelcast.operators.series import calendar_features, chrono_split, log_difference, train_stop
from panelcast.panel import MATRIX, PANEL, Panel
from panelcast.session import stored


CALENDAR = ("hour", "month", "weekday")


def query_prices(df: DataFrame, nodes: str | Sequence[str], start: str, end: str, shards: DataFrame | None = None,
                 panel: Panel = PANEL, hour_ending: bool = False) -> DataFrame:
    """Named series strictly between two delivery dates, NULL prices as zero.

    Set ``hour_ending`` for panels made from labels 1 to 24, whose hour 24 is midnight of the next day.

    With ``shards`` only hours for which every shard has a row are kept, as an inner
    join of all shard tables would.
    """
    ranged = between_exclusive(df, start, end, on=panel.time, hour_ending=hour_ending)
    if shards is not None:
        ranged = complete_hours(ranged, shards, panel.keys[0], panel.time)
    return fill_null(select_nodes(ranged, nodes, panel.keys[0]), 0.0, panel.value)


def train_test_positions(rows: DataFrame, fraction: float) -> DataFrame:
    """``pos`` and ``n`` of a split panel, counted inside each side."""
    stop = train_stop(fraction)
    first = F.col("split") == "train"
    return rows.withColumns({"pos": F.when(first, F.col("pos")).otherwise(F.col("pos") - stop),
                             "n": F.when(first, stop).otherwise(F.col("n") - stop)})


def train_test_panel(df: DataFrame, fraction: float = 0.8, normalize: bool = False, include_calendar: bool = False,
                     log_differences: bool = False, panel: Panel = PANEL) -> DataFrame:
    """``(keys, ts, value, [calendar,] split)`` with ``pos`` and ``n`` counted inside each split.

    ``normalize`` standardises with the training rows' mean and population sd, the
    calendar columns too. Log differences are taken of the value alone, on each side
    of the split by itself, and are NULL where a value is not positive.
    """
    rows = chrono_split(df, fraction, panel)
    columns = [panel.value]
    if include_calendar:
        rows = calendar_features(rows, panel.time).drop("day_name")
        columns += CALENDAR
    if normalize:
        train = rows.filter("split = 'train'").groupBy(*panel.keys)
        stats = train.agg(*[f(c).alias(f"_{name}_{c}") for c in columns
                            for name, f in (("m", F.avg), ("s", F.stddev_pop))])
        rows = attach(rows, stats, panel)
        rows = rows.withColumns({
            c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(1.0)) for c in columns
        }).drop(*[f"_{m}_{c}" for c in columns for m in "ms"])
    rows = train_test_positions(rows, fraction)
    return log_difference(rows, panel.with_keys(*panel.keys, "split")) if log_differences else rows


def neighborhood_matrix(df: DataFrame, edges: DataFrame, catalog: DataFrame, centers: DataFrame,
                        start: str | None = None, end: str | None = None, fill: float | None = None,
                        panel: Panel = PANEL) -> DataFrame:
    """``(center, ts, values)`` of every centre, between two dates when given.

    The neighbourhoods, no larger than the catalog's names allow, are stored once: the
    edge list is by far the larger input and would otherwise be read for every use.
    """
    if start is not None and end is not None:
        df = between_exclusive(df, start, end, on=panel.time)
    family = stored(neighbors(edges, catalog, centers))
    rows = neighbor_panel(df, family, panel.keys[0])
    return to_matrix(rows, family, fill, panel.time, panel.value)


def train_test_rows(matrix: DataFrame, fraction: float = 0.8, panel: Panel = MATRIX) -> DataFrame:
    """Long ``(center, member, ts, value, split)``, cut at the same hour for every member."""
    split = chrono_split(matrix, fraction, panel)
    return split.select(*panel.keys, panel.time, "split", F.posexplode(panel.value)).select(
        *panel.keys, F.col("pos").alias("member"), panel.time, F.col("col").alias("value"), "split")


def train_test_lists(df: DataFrame, lists: DataFrame, fraction: float = 0.8, normalize: bool = False, include_calendar: bool = False,
                     log_differences: bool = False, start: str | None = None, end: str | None = None,
                     panel: Panel = PANEL) -> DataFrame:
    """Train and test rows of whole lists of series: ``(center, member, ts, value, [calendar,] split, pos, n)``.

    ``lists`` has rows ``(center, node, is_center)``. Only hours that every member of a list has count, so all members are
    cut at one hour, the first ``floor(fraction * hours)`` of them being training rows. ``normalize`` then standardises each
    member by its training rows, and calendar columns by those of the list; log differences are taken last, of each side of
    the cut alone (NULL where a value is not positive). ``pos`` and ``n`` count within a side.
    """
    if start is not None and end is not None:
        df = between_exclusive(df, start, end, on=panel.time)
    matrix = to_matrix(neighbor_panel(df, lists, panel.keys[0]), lists, None, panel.time, panel.value)
    whole = panel.with_keys("center").with_value("values")
    ix = train_test_positions(chrono_split(matrix, fraction, whole), fraction)
    columns = list(CALENDAR) if include_calendar else []
    if include_calendar:
        ix = calendar_features(ix, panel.time).drop("day_name")
    rows = ix.select("center", panel.time, "split", "pos", "n", *columns, F.posexplode("values").alias("member", panel.value))
    if normalize:
        names = [panel.value, *columns]
        stats = rows.filter("split = 'train'").groupBy("center", "member").agg(
            *[f(c).alias(f"_{name}_{c}") for c in names for name, f in (("m", F.avg), ("s", F.stddev_pop))])
        rows = rows.join(stats, ["center", "member"])
        rows = rows.withColumns({
            c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(1.0)) for c in names
        }).drop(*stats.columns[2:])
    members = panel.with_keys("center", "member", "split")
    return log_difference(rows, members) if log_differences else rows
