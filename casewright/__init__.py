"""Security-event investigation as PySpark DataFrame operators."""
