"""Session-evidence analytics on Spark: DataFrame operators over telemetry events."""
