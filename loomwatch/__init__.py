"""Security-log analytics as composable Spark DataFrame operators."""
