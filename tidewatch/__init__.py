"""Broadcast telemetry analytics and corpus preparation on PySpark."""
