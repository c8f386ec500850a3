"""Readers, writers and the adapters that map stored tables onto the data model."""
