"""Small-area vital statistics on Spark."""
