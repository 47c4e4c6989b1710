"""Motion time-series analytics on Spark."""
