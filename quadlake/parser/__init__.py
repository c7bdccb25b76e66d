"""Parsers for SPARQL and RDF text. Standard library only."""
