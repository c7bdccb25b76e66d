"""SPARQL over Spark DataFrames."""
