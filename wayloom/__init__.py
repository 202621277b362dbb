"""Content-graph analytics as Spark DataFrame operators."""
