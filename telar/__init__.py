"""Telar: clinical telemetry analytics expressed as Spark plans."""
