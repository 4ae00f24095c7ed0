"""Structured Streaming: live projections and timers that fire in event time."""
