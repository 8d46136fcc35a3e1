"""Structured Streaming forms of the telemetry and dedup operators."""
