"""Page-object analytics as Spark DataFrame operators."""
