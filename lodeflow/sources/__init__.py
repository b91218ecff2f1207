"""Readers and writers of the layered store."""
