"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def safe_ln(x: Column) -> Column:
    """Natural log; NULL where the argument is not positive."""
    return F.when(x > 0, F.ln(x))


def hour_ts(delivery_date: Column, hour: Column, mode: str = "hour_ending") -> Column:
    """Timestamp of an hour-ending label 1..24.

    ``hour_ending`` puts hour 24 at midnight of the next day; ``compat`` wraps it to
    midnight of the same date.
    """
    if mode not in ("hour_ending", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    h = hour.cast("int")
    h = h % 24 if mode == "compat" else h
    return delivery_date.cast("timestamp_ntz") + F.make_dt_interval(hours=h)


def hour_number(label: Column) -> Column:
    """``'24:00'``, ``'01:00'`` or ``'7'`` as an integer; NULL when it is not a number."""
    return F.split(F.trim(label), ":")[0].try_cast("int")


def parse_date(text: Column) -> Column:
    """ISO or month/day/year text, padded or not."""
    return F.coalesce(F.try_to_date(F.trim(text), "yyyy-M-d"), F.try_to_date(F.trim(text), "M/d/yyyy"))


def name_prefix(name: Column) -> Column:
    """Text before the last underscore, ``''`` when there is none."""
    return F.regexp_extract(name, "^(.*)_", 1)


def substrings(text: Column) -> Column:
    """Every distinct substring; names are short, so an equi-join replaces a scan per pair."""
    n = F.length(text)
    from_each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k)))
    return F.when(n > 0, F.array_distinct(F.flatten(from_each)))


def scale_to_one(x: Column, low: Column, high: Column, upper: Column) -> Column:
    """Affine map of ``[low, high]`` onto ``[1, upper]``; a constant series maps to 1."""
    return F.when(high == low, F.lit(1.0)).otherwise(1.0 + (x - low) * (upper - 1.0) / F.nullif(high - low, F.lit(0.0)))


def unscale_from_one(s: Column, low: Column, high: Column, upper: Column) -> Column:
    return low + (s - 1.0) * (high - low) / F.nullif(upper - 1.0, F.lit(0.0))


def compand(x: Column, mu: float) -> Column:
    """Mu-law value in [-1, 1] of ``x`` clipped to [-1, 1]."""
    return F.signum(x) * F.log1p(mu * F.least(F.abs(x), F.lit(1.0))) / F.log1p(F.lit(float(mu)))


def compand_bin(x: Column, mu: float) -> Column:
    return F.floor((compand(x, mu) + 1.0) / 2.0 * mu + 0.5).cast("int")


def expand_bin(level: Column, mu: float) -> Column:
    signal = 2.0 * (level / F.lit(float(mu))) - 1.0
    return F.signum(signal) * (1.0 / mu) * (F.pow(F.lit(1.0 + mu), F.abs(signal)) - 1.0)


def dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def calendar_columns(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "month": F.month(ts), "weekday": F.weekday(ts),
            "day_name": F.date_format(ts, "EEEE")}
