"""Shapelet analytics for labelled time series, expressed as Spark jobs."""
