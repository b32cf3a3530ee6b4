"""Readers, writers and the derived views that the registered queries use."""
