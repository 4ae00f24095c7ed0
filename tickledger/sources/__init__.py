"""Log sources and table sinks."""
