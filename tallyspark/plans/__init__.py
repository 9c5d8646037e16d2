"""Queries: how the operators run over the driver's tables, each with its SQL."""
