"""Operators over logs, timers, schedules and shards."""
