"""Structured Streaming: deliveries to standing tables, events to windows."""
