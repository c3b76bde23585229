"""Time-aligned transcript analytics on Spark."""
