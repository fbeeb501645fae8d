"""Trace and task-graph analytics on Spark."""
