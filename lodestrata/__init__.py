"""Dependency-evidence analytics and corpus preparation on PySpark DataFrames."""
