"""Spark-native operators for panels of hourly or daily numeric series."""

from panelcast.panel import MATRIX, PANEL, Panel

__all__ = ["MATRIX", "PANEL", "Panel"]
