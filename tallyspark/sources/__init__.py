"""Readers and writers of run records."""
