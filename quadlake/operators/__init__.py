"""Algebra operators over DataFrames of variable bindings."""
