"""Readers of alerts, catalogues and solver files; writers of state and observation files."""
