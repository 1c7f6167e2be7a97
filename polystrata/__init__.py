"""A PySpark-native analytics engine over telemetry, text, vectors, graphs and logs."""
