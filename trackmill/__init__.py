"""Event and trajectory analytics on Spark."""
