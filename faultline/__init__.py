"""Error-log analytics on Spark."""
