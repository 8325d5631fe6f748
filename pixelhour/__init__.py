"""Sensor-telemetry analytics on PySpark: JSON readings to pixel/hour bins, device statistics and map reports."""
