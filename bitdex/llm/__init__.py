"""Operators of a training-data pipeline, each a query over the driver's tables."""
