"""Source-review analytics on Spark."""
