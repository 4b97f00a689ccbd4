"""Code-graph and knowledge analytics as DataFrame operators on Spark."""
