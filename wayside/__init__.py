"""Condition-monitoring analytics expressed as Spark DataFrame operators."""
