"""Code-fact analytics on Spark."""
