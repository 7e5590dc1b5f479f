"""Market-data analytics as Spark DataFrame, SQL and streaming operators."""
