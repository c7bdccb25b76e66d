"""Where triples come from and go to: mapped tables, quad tables, RDF text, result formats."""
