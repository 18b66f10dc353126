"""Spark-native analytics for collection fleets: pings, polygons, tickets and sites as DataFrames."""

__version__ = "0.1.0"
