"""replenix.streaming."""
