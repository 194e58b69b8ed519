"""Part of the price-structure engine."""
