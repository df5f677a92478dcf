"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save(rows: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Writes rows as parquet, csv (with header) or json, under folders by method, budget and the like."""
    writer = rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")
    (writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path))
