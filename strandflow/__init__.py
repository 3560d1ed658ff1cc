"""Assembly-graph analytics as Spark DataFrame operators."""
