"""Ordered dataflow analytics on Spark."""
