"""Structured Streaming forms of the telemetry queries."""
