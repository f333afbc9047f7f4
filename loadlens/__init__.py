"""Request-load analytics on Spark."""
