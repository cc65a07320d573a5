"""replenix.plans."""
