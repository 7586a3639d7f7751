"""Detection rules compiled to Spark plans."""
