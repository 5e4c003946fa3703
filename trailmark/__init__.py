"""Trajectory analytics on PySpark."""
