"""Bindings onto the provided test tables, the registered queries and their SQL."""
