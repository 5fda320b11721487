"""Repository-evolution analytics on Spark."""
