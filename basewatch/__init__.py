"""Long-base price-structure analytics on PySpark."""
