"""Dependency-risk analytics as PySpark DataFrame operators."""
