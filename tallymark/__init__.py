"""Rules-based equity index analytics as Spark DataFrame operators."""
