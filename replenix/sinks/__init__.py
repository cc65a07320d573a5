"""replenix.sinks."""
