"""tidewater: operational telemetry analytics written for Spark."""
