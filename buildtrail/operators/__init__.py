"""Batch operators: joins, aggregations, windows, sets, graphs and trees over telemetry tables."""
