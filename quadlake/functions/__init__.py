"""Expressions over typed columns."""
