"""Scalar functions: each takes Columns and returns a Column, so that it stays inside the JVM."""
