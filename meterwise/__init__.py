"""Spark-native usage metering: rollups, reports, host deduplication and their sources and sinks."""

__version__ = "0.2.0"

__version__ = "0.2.0"
