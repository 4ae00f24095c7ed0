"""Schedule-log analytics on Spark: changelogs, timers, fires, shards and streams."""
