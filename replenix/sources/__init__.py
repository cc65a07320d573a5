"""replenix.sources."""
