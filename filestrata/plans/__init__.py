"""Compositions of the operators: capsules, corpus documents and bundles."""
