"""Distance projection of a stream of series: stateless, so no watermark or state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavelane.operators.distance import distance_features


def stream_distances(series_stream: DataFrame, shapelets: DataFrame, metric: str = "raw", on_short: str = "inf",
                     keep: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Features for each arriving series, against a batch table of shapelets."""
    return distance_features(series_stream, shapelets, metric, on_short, keep=keep)
