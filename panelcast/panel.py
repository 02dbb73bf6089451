"""Column roles of a long panel ``(series, time, value)``."""

from __future__ import annotations

from dataclasses import dataclass, replace

# A grid series with a step of one hour or more holds at most 8,784 rows a year,
# so a century of it is under a million rows: one task can always sort one series.
BOUNDED_STEP_SECONDS = 3600


@dataclass(frozen=True)
class Panel:
    """Names the columns of a panel; ``(keys, time, ties)`` must be unique, and ``(keys, time)`` not null.

    ``ties`` orders the rows of one series at one time.

    ``step`` is the grid step in seconds when timestamps lie on a regular grid.
    It is what proves a bound on rows per series; leave it ``None`` for raw,
    irregular series, whose size is then measured before anything is windowed.
    ``rows_per_task`` is the largest group one task may sort, ``block_rows`` the
    length of the stretches longer series are cut into.
    """

    keys: tuple[str, ...] = ("series_id",)
    time: str = "ts"
    value: str = "value"
    step: int | None = None
    rows_per_task: int = 1_000_000
    block_rows: int = 100_000
    ties: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.ties)

    @property
    def bounded(self) -> bool:
        return self.step is not None and self.step >= BOUNDED_STEP_SECONDS

    def with_keys(self, *keys: str) -> "Panel":
        return replace(self, keys=tuple(keys))

    def with_value(self, value: str) -> "Panel":
        return replace(self, value=value)


PANEL = Panel()
MATRIX = Panel(keys=("center",), value="values")
