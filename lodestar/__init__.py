"""Lodestar: funding-opportunity intelligence as PySpark DataFrame operators."""
