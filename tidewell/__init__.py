"""Event-telemetry analytics and corpus preparation on Spark."""
