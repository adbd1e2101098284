"""Scalar functions, types and validators as Spark expressions."""
