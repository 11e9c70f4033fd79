"""Telemetry tables, their store, and the diagnosis queries over them."""
