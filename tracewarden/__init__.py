"""tracewarden: a Spark-native engine for incident analytics over telemetry tables."""
