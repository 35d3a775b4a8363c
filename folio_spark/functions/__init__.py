"""Scalar functions as Columns: nothing here leaves the JVM."""
