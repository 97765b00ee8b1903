"""Monitoring telemetry analytics on Spark: tiered rollups, health, inventory."""
