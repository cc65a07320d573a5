"""replenix.operators."""
