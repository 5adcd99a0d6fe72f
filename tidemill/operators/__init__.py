"""Lowering of stages to DataFrames."""
