"""Job-market analytics as Spark DataFrame operators."""
