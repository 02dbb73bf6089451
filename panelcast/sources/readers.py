"""Readers: raw price and load text, stored panels, edge lists, wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.columns import hour_number, parse_date

# Field positions of the two raw price files.
BUS_PRICE_FIELDS = {"delivery_date": 0, "hour_ending": 1, "node": 2, "price": 3}
ZONE_PRICE_FIELDS = {"delivery_date": 0, "hour_ending": 1, "node": 3, "price": 4}

# Headers of the actual and the forecast load file.
LOAD_HEADERS = {
    "actual": ["OperDay", "HourEnding", "COAST", "EAST", "FAR_WEST", "NORTH", "NORTH_C", "SOUTHERN",
               "SOUTH_C", "WEST", "TOTAL", "DSTFlag"],
    "forecast": ["DeliveryDate", "HourEnding", "Coast", "East", "FarWest", "North", "NorthCentral",
                 "SouthCentral", "Southern", "West", "SystemTotal", "DSTFlag"],
}

# First fields by which a header line is recognised.
HEADER_TOKENS = ("DeliveryDate", "Delivery Date", "delivery_date", "OperDay", "date")


def _text_fields(spark: SparkSession, paths: str | Sequence[str], width: int,
                 header_tokens: Sequence[str]) -> DataFrame:
    """Positional string columns; header lines are dropped wherever in a file they stand."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).csv([paths] if isinstance(paths, str) else list(paths),
                                        header=False, mode="PERMISSIVE", enforceSchema=True)
    first = F.trim("_c0")
    return raw.filter(first.isNull() | ~first.isin(*header_tokens))


def read_prices(spark: SparkSession, paths: str | Sequence[str],
                columns: Mapping[str, int] = BUS_PRICE_FIELDS,
                header_tokens: Sequence[str] = HEADER_TOKENS) -> DataFrame:
    """Long prices ``(delivery_date, hour_ending, node, price)`` from one or many CSV files.

    ``columns`` gives the field positions. Unreadable dates and prices become NULL.
    """
    fields = _text_fields(spark, paths, max(columns.values()) + 1, header_tokens)
    at = {name: F.col(f"_c{i}") for name, i in columns.items()}
    return fields.select(
        parse_date(at["delivery_date"]).alias("delivery_date"),
        hour_number(at["hour_ending"]).alias("hour_ending"),
        F.trim(at["node"]).alias("node"),
        at["price"].try_cast("double").alias("price"),
    )


def read_load(spark: SparkSession, paths: str | Sequence[str], header_variant: str = "actual",
              header_tokens: Sequence[str] = HEADER_TOKENS) -> DataFrame:
    """Load by weather zone, one DOUBLE column per zone named as in the file's own header."""
    names = LOAD_HEADERS[header_variant]
    fields = _text_fields(spark, paths, len(names), (*header_tokens, names[0]))
    zones = [F.col(f"_c{i}").try_cast("double").alias(names[i]) for i in range(2, len(names) - 1)]
    return fields.select(parse_date(F.col("_c0")).alias("delivery_date"),
                         hour_number(F.col("_c1")).alias("hour_ending"),
                         *zones, F.trim(f"_c{len(names) - 1}").alias("dst_flag"))


def load_zones(header_variant: str = "actual") -> list[str]:
    return LOAD_HEADERS[header_variant][2:10]


def _load(spark: SparkSession, path_or_table: str) -> DataFrame:
    is_path = "/" in path_or_table or path_or_table.endswith(".parquet")
    return spark.read.parquet(path_or_table) if is_path else spark.read.table(path_or_table)


def load_panel(spark: SparkSession, path_or_table: str) -> DataFrame:
    """A stored long panel: a Parquet path, or a table of the session catalog (JDBC included)."""
    return _load(spark, path_or_table)


def load_edges(spark: SparkSession, path_or_table: str) -> DataFrame:
    """A stored edge list ``(source, sink)``."""
    edges = _load(spark, path_or_table)
    lower = {c.lower(): c for c in edges.columns}
    return edges.select(F.col(lower["source"]).alias("source"), F.col(lower["sink"]).alias("sink"))


def unpivot_prices(wide: DataFrame, keys: Sequence[str], node: str = "node", price: str = "price") -> DataFrame:
    """Wide hour rows to long ``(keys, node, price)``; every non-key column is a node."""
    nodes = [c for c in wide.columns if c not in keys]
    quoted = [f"`{c}`" for c in nodes]
    return wide.unpivot(list(keys), quoted, node, price)
