"""Time-series market-data analytics as lazy PySpark DataFrame operators."""
