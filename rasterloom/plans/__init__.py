"""Registered queries: operators wired to the driver's tables, each with its checking SQL."""
