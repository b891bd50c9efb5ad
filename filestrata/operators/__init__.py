"""Relational jobs over the files table, keyed by ``project_id``."""
