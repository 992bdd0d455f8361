"""Item-based recommendation analytics, and corpus operators, on Spark."""
