"""Spark-native analytics over fleet telemetry: samples, snapshots, alerts, logs."""

__version__ = "0.1.0"
