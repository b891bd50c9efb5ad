"""Inputs and outputs: directory trees, files tables, parsed sources, dumps."""
