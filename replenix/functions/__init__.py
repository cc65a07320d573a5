"""replenix.functions."""
